"""The registered queries of the retrieval engine, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, text
from ..functions.embedding import embed, l2_normalize
from ..operators import catalog, evaluate, knn, postings, rank, retrieve
from ..operators.segment import split_paragraphs
from ..sources.convert import html_texts, strip_html
from ..sources.files import ingest_filter
from ..staging import new_path
from ..streaming import track
from . import corpora as c

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
K = 10
TAGS = ["en", "src1"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def para_split(s, d):
    both = c.corpus_lines(s, d).unionByName(c.corpus_conv(s, d))
    return split_paragraphs(both).select("path", "seq", "start_line", "end_line", "text")


@query
def heading_breadcrumb(s, d):
    return split_paragraphs(c.corpus_conv(s, d)).select("path", "seq", "heading")


@query
def frontmatter_tags(s, d):
    return c.corpus_fm(s, d).select("doc_id", F.array_join(markup.parse_tags(F.col("content")), ",").alias("tags"))


@query
def auto_tags(s, d):
    return c.corpus_fm(s, d).select("doc_id", F.array_join(markup.auto_tags(F.col("path")), ",").alias("tags"))


def doc_tags(s, d):
    return c.corpus_fm(s, d).select("doc_id", "path", F.explode(markup.merged_tags(F.col("content"), F.col("path"))).alias("tag"))


@query
def doc_tags_merged(s, d):
    return doc_tags(s, d)


@query
def frontmatter_body_lines(s, d):
    fm = c.corpus_fm(s, d)
    return fm.select("doc_id", markup.frontmatter_lines(F.col("content")).alias("n_front"), text.content_hash(markup.hide_frontmatter(F.col("content"))).alias("body_hash"))


@query
def add_frontmatter(s, d):
    docs = c.table(s, d, "documents")
    return docs.select("doc_id", F.md5(markup.with_frontmatter(F.col("text"), F.array("lang", "source"))).alias("digest"))


@query
def content_hash(s, d):
    return c.table(s, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query
def snippet(s, d):
    return c.table(s, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query
def fts_query_string(s, d):
    return c.table(s, d, "benchmark").select("item_id", text.fts_query(F.col("text")).alias("fts"))


@query
def embed_text(s, d):
    p = split_paragraphs(c.corpus_conv(s, d))
    return p.select("path", "seq", F.md5(text.embed_text(F.col("heading"), F.col("text"))).alias("digest"))


@query
def bm25_scores(s, d):
    return rank.bm25(c.paragraphs(s, d), c.text_queries(s, d))


@query
def text_search_topk(s, d):
    return rank.search("text", c.paragraphs(s, d), c.text_queries(s, d), K).select("query_id", "para_id", "rank", "score")


@query
def text_search_tagged(s, d):
    return rank.search("text", c.paragraphs(s, d), c.text_queries(s, d), K, doc_tags=doc_tags(s, d), tags=TAGS).select("query_id", "para_id", "rank", "score")


def _vector(s, d, tags=None):
    return rank.vector_candidates(c.para_vec(s, d), c.queries_with_vectors(s, d), K, c.paragraphs(s, d), doc_tags(s, d), tags).select("query_id", "para_id", "rank", "distance")


@query
def vector_search_topk(s, d):
    return _vector(s, d)


@query
def vector_search_scores(s, d):
    hits = rank.search("vector", c.paragraphs(s, d), c.queries_with_vectors(s, d), K, c.para_vec(s, d))
    return hits.select("query_id", "para_id", "rank", F.round("score", 9).alias("score"))


@query
def query_embed_text(s, d):
    return c.table(s, d, "benchmark").select("item_id", F.md5(text.embed_query(F.col("text"))).alias("digest"))


@query
def document_hashes(s, d):
    """The hash that the index holds for each path after an upsert, and whether a caller's copy is up to date."""
    old, new = c.snapshots(s, d)
    held = catalog.merge_documents(_hashed(old), _hashed(new)).select("path", "hash")
    return held.join(_hashed(old).select("path", F.col("hash").alias("was")), "path", "left").select("path", "hash", F.coalesce(F.col("hash") == F.col("was"), F.lit(False)).alias("same"))


@query
def vector_search_tagged(s, d):
    return _vector(s, d, TAGS)


def _hybrid(s, d, tags=None):
    q = c.queries_with_vectors(s, d)
    out = rank.search("hybrid", c.paragraphs(s, d), q, K, c.para_vec(s, d), doc_tags(s, d), tags)
    return out.select("query_id", "para_id", "rank", F.round("score", 9).alias("score"))


@query
def hybrid_search_topk(s, d):
    return _hybrid(s, d)


@query
def hybrid_search_tagged(s, d):
    return _hybrid(s, d, TAGS)


@query
def rrf_fuse(s, d):
    q, p = c.queries_with_vectors(s, d), c.paragraphs(s, d)
    t, v = rank.text_candidates(p, q, rank.FETCH), rank.vector_candidates(c.para_vec(s, d), q, rank.FETCH)
    return rank.fuse(t, v, 2 * rank.FETCH).select("query_id", "para_id", "rank", F.round("score", 9).alias("score"))


@query
def hydrate_hits(s, d):
    p = c.paragraphs(s, d)
    return retrieve.hydrate(rank.search("text", p, c.text_queries(s, d), K), p)


@query
def get_document(s, d):
    """Every document is asked for."""
    docs = c.corpus_lines(s, d)
    return retrieve.get_documents(docs, docs.select("path")).select("path", F.md5("content").alias("digest"))


@query
def get_paragraph_context(s, d):
    """Every paragraph is asked for, with those on both sides."""
    paras = split_paragraphs(c.corpus_lines(s, d))
    return retrieve.get_paragraphs(paras, paras.select("path", F.col("seq").alias("para")), 1)


@query
def get_line_range(s, d):
    return retrieve.get_lines(c.corpus_lines(s, d), None, 3, 5)


@query
def expand_bodies_budget(s, d):
    p = c.paragraphs(s, d)
    hits = retrieve.hydrate(rank.search("text", p, c.text_queries(s, d), K), p)
    return retrieve.expand_bodies(hits, p, 5, 4000).select("query_id", "rank", "body", "body_truncated")


@query
def tag_and_filter(s, d):
    docs = c.corpus_fm(s, d).select("doc_id", "path")
    return rank.with_all_tags(docs, doc_tags(s, d), ["EN", "src1", "en"], "doc_id")


def _hashed(df):
    return df.withColumn("hash", text.content_hash(F.col("content")))


@query
def upsert_classify(s, d):
    old, new = c.snapshots(s, d)
    return catalog.classify(_hashed(old), _hashed(new))


@query
def upsert_apply(s, d):
    old, new = c.snapshots(s, d)
    return catalog.merge_documents(_hashed(old), _hashed(new)).select("path", "mtime", "hash")


@query
def touch_mtime(s, d):
    old, new = c.snapshots(s, d)
    touched = catalog.classify(_hashed(old), _hashed(new)).filter("status = 'touched'")
    return catalog.merge_documents(_hashed(old), _hashed(new)).join(touched, "path", "left_semi").select("path", "mtime")


@query
def delete_cascade(s, d):
    """What is left of each kept document: paragraphs, tags, and vectors (by the paragraphs they belong to)."""
    old, new = c.snapshots(s, d)
    gone = old.join(new, "path", "left_anti").select("path")
    paras = split_paragraphs(old.select("path", "content")).withColumn("para_id", catalog.para_key("path", "seq"))
    vectors = paras.select("para_id", F.col("path").alias("of"))
    tags = old.select("path", F.explode(markup.merged_tags(F.col("content"), F.col("path"))).alias("tag"))
    kept = catalog.without_paths(paras, gone)
    n = lambda df, name: df.groupBy("path").agg(F.count("*").alias(name))
    left = vectors.join(kept.select("para_id"), "para_id", "left_semi").withColumnRenamed("of", "path")
    return n(kept, "paragraphs").join(n(catalog.without_paths(tags, gone), "tags"), "path").join(n(left, "vectors"), "path")


@query
def prune_missing(s, d):
    old, new = c.snapshots(s, d)
    return catalog.missing_under(old, new, ["d"])


@query
def mark_stale(s, d):
    old, new = c.snapshots(s, d)
    hits = old.select(F.col("path").alias("doc"))
    return retrieve.mark_stale(hits, old, new)


@query
def list_paths(s, d):
    return c.corpus_fm(s, d).select("path")


@query
def abs_key_guard(s, d):
    docs = c.corpus_fm(s, d).withColumn("path", F.concat(F.when(F.col("doc_id") % 3 == 0, "/").when(F.col("doc_id") % 3 == 1, "C:/").otherwise(""), "path"))
    return catalog.absolute_keys(docs)


def _judged(s, d):
    """A case for each benchmark passage and document that holds it; the query is two long words of the passage."""
    bench = c.table(s, d, "benchmark").filter("length(text) > 0")
    docs = c.table(s, d, "documents").select(F.concat(F.lit("d/"), "doc_id", F.lit(".txt")).alias("doc"), "text")
    pairs = evaluate.containing(docs, bench.select("item_id", F.col("text").alias("passage")))
    cases = pairs.select(F.concat_ws("|", F.col("item_id").cast("string"), "doc").alias("case_id"), F.col("item_id").alias("query_id"), "doc", F.lit(None).cast("int").alias("para"))
    long_words = F.slice(F.filter(F.split("text", " "), lambda w: F.length(w) >= 5), 1, 2)
    q = bench.select(F.col("item_id").alias("query_id"), F.array_join(long_words, " ").alias("query"))
    p = c.paragraphs(s, d)
    return evaluate.recalled(retrieve.hydrate(rank.search("text", p, q, K), p), cases)


@query
def eval_recall(s, d):
    return evaluate.recall(_judged(s, d)).withColumn("recall", F.round("recall", 9))


@query
def eval_misses(s, d):
    return _judged(s, d).filter("NOT recalled").select("case_id")


@query
def l2_normalize_vectors(s, d):
    e = c.table(s, d, "embeddings").filter("embedding IS NOT NULL")
    v = e.select("vec_id", l2_normalize(F.transform("embedding", lambda x: (x * 3).cast("float"))).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    weighted = F.aggregate(F.transform("v", lambda x, i: F.round(x.cast("double") * 1e3).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)  # every component at its place
    return v.select("vec_id", F.round(norm, 5).alias("norm"), F.round(F.col("v")[0].cast("double"), 5).alias("first"), weighted.alias("weighted"))


@query
def ingest_filter_files(s, d):
    docs = c.table(s, d, "documents")
    k = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".md", ".py", ".txt", ".GO", "")]), (k % 5 + 1).cast("int"))
    body = F.concat(F.when(k % 11 == 0, F.lit(b"\x00")).otherwise(F.lit(b"")), F.col("text").cast("binary"))
    files = docs.select(F.concat(F.lit("d/"), k.cast("string"), ext).alias("path"), F.when(k % 7 == 0, 20_000_000).otherwise(F.col("n_chars")).alias("size"), body.alias("content"))
    return ingest_filter(files).select("path", "verdict")


@query
def html_convert(s, d):
    return c.table(s, d, "pages").select("page_id", strip_html(F.col("html")).alias("text"))


def _hard_pages(s, d):
    """Each page behind markup with a > in a comment, in a value and in a script, tags in text, an open quote of a script, and references of all kinds."""
    head = """<!-- a > b --><a title="x > y" href='<b>'>1 < 2</a><SCRIPT>if (a<b) "</b>"</SCRIPT ><title>a <b>bold</b></title>&eacute;&#233;&#xE9;&hellip;&notareference;"""
    return c.table(s, d, "pages").select("page_id", F.concat(F.lit(head), F.coalesce("html", F.lit(""))).alias("html"))


@query
def html_text_pages(s, d):
    return c.table(s, d, "pages").select("page_id", html_texts(F.col("html")).alias("text"))


@query
def html_text_hard(s, d):
    return _hard_pages(s, d).select("page_id", html_texts(F.col("html")).alias("text"))


@query
def hash_embed(s, d):
    """The embedder of tests over whole texts: dimensions, the sum of the vector, and the sum weighted by place."""
    v = c.table(s, d, "documents").select("doc_id", embed(F.col("text")).alias("v"))
    return v.select("doc_id", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")).cast("long").alias("total"), F.aggregate(F.transform("v", lambda x, i: x.cast("double") * i), F.lit(0.0), lambda a, x: a + x).cast("long").alias("weighted"))


@query
def knn_join(s, d):
    """The nearest of all vectors to every hundredth, by the join of pivots."""
    v = c.table(s, d, "embeddings")
    q = v.filter(F.col("vec_id") % c.EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return knn.knn_join(v.select(F.col("vec_id").alias("para_id"), "embedding"), q, K).select("query_id", F.col("para_id").alias("vec_id"), "rank", "distance")


@query
def bm25_from_postings(s, d):
    """Scores from places in postings alone, which are built and read in one pass, and not kept."""
    return rank.bm25(c.paragraphs(s, d), c.text_queries(s, d), postings=postings.build(c.paragraphs(s, d)), together=True)


@query
def text_topk_from_postings(s, d):
    return rank.text_topk(c.paragraphs(s, d), c.text_queries(s, d), K, postings=postings.build(c.paragraphs(s, d)), together=True).first()


@query
def get_paragraph_context_wide(s, d):
    """Every paragraph is asked for, with fifty on both sides."""
    paras = split_paragraphs(c.corpus_lines(s, d))
    return retrieve.get_paragraphs(paras, paras.select("path", F.col("seq").alias("para")), 50).select("path", "para", F.md5("content").alias("digest"))


def _index(s, d):
    """An index of the first snapshot, brought to the second: upserts, growth of buckets, prune."""
    old, new = c.snapshots(s, d)
    cat = catalog.Catalog(s, new_path(s, "index"), buckets=2, load=max(64, old.count() // 12))
    cat.upsert(old)
    cat.upsert(new)
    return cat, new


@query
def catalog_state(s, d):
    """Documents of an index after two snapshots and a prune, with the number of their paragraphs and of the places of their trigrams."""
    cat, new = _index(s, d)
    cat.prune(new, ["d"])
    paras = cat.table("paragraphs").groupBy("path").agg(F.count("*").alias("paragraphs"))
    places = cat.table("postings").filter("gram <> ''").groupBy("path").agg(F.sum(F.size("places")).alias("places"))
    docs = cat.table("documents").select("path", "mtime", "hash")
    return docs.join(paras, "path", "left").join(places, "path", "left").fillna(0, ["paragraphs", "places"])


@query
def catalog_statuses(s, d):
    """What an upsert of the second snapshot says about its documents."""
    old, new = c.snapshots(s, d)
    cat = catalog.Catalog(s, new_path(s, "index"))
    cat.upsert(old)
    return cat.upsert(new)


@query
def track_listings(s, d):
    """Both snapshots as a stream of sightings, the second one's first: the statuses of its time."""
    at, old = new_path(s, "listings"), {k: s.conf.get(k, None) for k in track.STORE}
    for k, x in enumerate((*reversed(c.snapshots(s, d)), None, None)):
        seen = F.timestamp_seconds(F.lit(3600 * (101, 100, 150, 151)[k]))
        rows = _hashed(x).select("path", "mtime", "hash") if x is not None else s.range(1).select(F.lit("end").alias("path"), F.lit(0).cast("long").alias("mtime"), F.lit("").alias("hash"))
        rows.withColumn("seen", seen).write.mode("append").parquet(f"{at}/in/k={k}")
    for k, v in track.STORE.items():
        s.conf.set(k, v)
    try:
        rows = s.readStream.schema(track.LISTING + ", k int").parquet(f"{at}/in").drop("k")
        out = track.track(rows, 3_600_000, "2 hours").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in old.items():
            s.conf.set(k, v) if v is not None else s.conf.unset(k)
    return s.read.schema(track.STATUS).parquet(f"{at}/out").filter((F.col("path") != "end") & (F.unix_timestamp("seen") == 3600 * 101)).select("path", "status")
