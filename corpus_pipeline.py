"""From raw documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept,
and returns a DataFrame; all but the last return the columns of documents.
run() writes each as Parquet to the shared folder and rereads it as the next
one's docs.  Columns of docs beyond COLUMNS are not carried along.  Rows with
one doc_id are taken for one document: the filtering stages decide on them
together, and so on all rows with a null doc_id.  Null texts are empty ones; an
empty table goes through to an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe, classifier, mixing, resemblance, substring
from gleaner.llm.common import stage

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[docs[c].cast(t).alias(c) for c, t in COLUMNS.items()])


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for those with a doc_id in ids (null is a doc_id like any other here)."""
    return docs.join(ids.select(F.col("doc_id").alias("_gone")), F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go."""
    docs = _columns(docs)
    scores = classifier.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scores.filter("predicted = 0"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Near duplicates share 0.8 or more of their five-word shingles, or are linked by such pairs.
    A document without a doc_id stays if none of its group has one.  Rows that
    repeat a doc_id are reduced to one.
    """
    docs = _columns(docs)
    found = resemblance.near_duplicates(docs)
    rest = _without(docs, found.filter("NOT (doc_id <=> component_id)"))
    if found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").head(1):
        rest = rest.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(rest.filter("doc_id IS NULL"))
    return rest


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that occur earlier go; so do documents of which nothing is left."""
    rows = substring.dedup_corpus(_columns(docs), extra={"lang": "string", "source": "string"})
    rows = rows.filter("n_words = 0 OR n_removed < n_words").withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at its target weights, in training order; documents of a second pass are there twice."""
    return mixing.mix_documents(_columns(docs)).withColumn("n_chars", F.length("text").cast("long"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, decoded_sha256: the tokens, and the digest of the bytes that they decode to."""
    rows = bpe.round_trip_documents(_columns(docs))
    return rows.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mixing),
    ("byte-level bpe", byte_bpe),
]

#: The classifier and the BPE stages can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
