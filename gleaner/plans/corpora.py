"""Corpora derived from the driver's tables: text with blank lines, headings, frontmatter and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document is a paragraph."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("d/"), "doc_id", F.lit(".txt")).alias("path"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"))


def corpus_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation with its turns under headings of three levels."""
    c = table(spark, sf_dir, "conversations")
    turn = F.concat(F.repeat(F.lit("#"), (F.lit(1) + F.col("turn") % 3).cast("int")), F.lit(" "), "role", F.lit("\n\n"), "text")
    g = c.filter("role IS NOT NULL AND text IS NOT NULL").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))).alias("x"))
    return g.select("doc_id", F.concat(F.lit("c/"), "doc_id", F.lit(".md")).alias("path"), F.array_join(F.transform("x", lambda v: v["t"]), "\n\n").alias("content"))


#: How the frontmatter of a document is written, by doc_id: inline; a list; quoted; with CRLF; not closed, and so none.
FORMS = ("---\ntags: [{0}, {1}]\n---\n", "---\ntitle: x\ntags:\n  - {0}\n  - {1}\nend: y\n---\n", "---\ntags: [\"{0}\", '{1}']\n---\n", "---\r\ntags: [{0}, {1}, {0}]\r\n---\r\n", "---\ntags: [{0}, {1}]\n")


def corpus_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with frontmatter in FORMS, in folders by source and language."""
    d = table(spark, sf_dir, "documents")
    of = lambda form: F.replace(F.replace(F.lit(form), F.lit("{0}"), F.col("lang")), F.lit("{1}"), F.col("source"))
    head = F.element_at(F.array(*[of(f) for f in FORMS]), (F.col("doc_id") % len(FORMS) + 1).cast("int"))
    return d.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.concat(head, "text").alias("content"), "text")


def one_paragraph(docs: DataFrame, path: str = "path") -> DataFrame:
    """Documents as paragraphs of their own."""
    n = F.size(F.split("text", "\n", -1))
    return docs.select(F.col("doc_id").alias("para_id"), "doc_id", F.col(path).alias("path"), F.lit(0).alias("seq"), F.lit(1).alias("start_line"), n.alias("end_line"), "text", F.lit("").alias("heading"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("d/"), "doc_id", F.lit(".txt")))
    return one_paragraph(d)


def para_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of paragraphs: vec_id is the document's id where there is such a document."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("para_id"), "embedding").filter("embedding IS NOT NULL")
    return e.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("para_id")), "para_id", "left_semi")


#: The queries of the registered searches: rows whose id is divisible by EVERY, with the first words of the text and the vector.
EVERY, QUERY_WORDS = 100, 4


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter((F.col("doc_id") % EVERY == 0) & F.col("text").isNotNull())
    return d.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, QUERY_WORDS), " ").alias("query"))


def queries_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = table(spark, sf_dir, "embeddings").filter((F.col("vec_id") % EVERY == 0) & F.col("embedding").isNotNull())
    return text_queries(spark, sf_dir).join(vec.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), "query_id")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(path, content, mtime) before and after: documents come, go, change, and are touched by the last digit of their id."""
    d = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("d/"), "doc_id", F.lit(".txt"))).withColumn("k", F.col("doc_id") % 10)
    old = d.filter("k <> 3").select("path", F.col("text").alias("content"), (F.lit(1000) + F.col("doc_id")).alias("mtime"))
    new = d.filter("k <> 7").select("path", F.when(F.col("k") == 5, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")).alias("content"), (F.lit(1000) + F.col("doc_id") + F.when(F.col("k").isin(5, 6), 1).otherwise(0)).alias("mtime"))
    return old, new
