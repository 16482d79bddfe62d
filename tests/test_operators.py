"""Ranking, fusion, retrieval, the catalog, sources and streaming."""

import json
import os
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner.operators import catalog, postings, rank, retrieve
from gleaner.operators.catalog import Catalog
from gleaner.plans.oracle import ORACLE
from gleaner.plans.queries import QUERIES
from gleaner.sources import files
from gleaner.streaming import ingest as stream
from gleaner.workspace import Workspace


def paras(spark, texts):
    rows = [(i, i, f"d{i}", 0, 1, 1, t, "") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "para_id long, doc_id long, path string, seq int, start_line int, end_line int, text string, heading string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


@pytest.mark.parametrize("words", [512, 2])
def test_bm25_like_sqlite(spark, monkeypatch, words):
    monkeypatch.setattr(rank, "MAX_WORDS", words)  # 2: in several passes
    texts = ["the config file is parsed at startup", "zzzzzz zzz", "Config config CONFIG", "", "x", "nothing here", "parsed parsed"]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(t, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no trigram tokenizer")
    db.executemany("insert into f(rowid, t) values (?, ?)", list(enumerate(texts)))
    queries = ["parse config", "zzz", "config config", "ab", "absent"]
    got = {}
    for r in rank.bm25(paras(spark, texts), asked(spark, *queries)).collect():
        got.setdefault(r.query_id, {})[r.para_id] = r.score
    stored = postings.build(paras(spark, texts))
    some = postings.matches(stored, rank.query_words(asked(spark, "parse zzz absent")))
    assert sorted(map(tuple, some.select("para_id", "word", "tf").collect())) == [(0, "parse", 1), (1, "zzz", 5), (6, "parse", 2)]
    plan = rank.bm25(paras(spark, texts), asked(spark, *queries), postings=spark.createDataFrame(stored.collect(), stored.schema))._jdf.queryExecution().optimizedPlan().toString()
    assert "heading" not in plan and "start_line" not in plan  # texts are not read
    assert sorted(map(tuple, rank.bm25(paras(spark, texts), asked(spark, *queries), postings=stored).collect())) == sorted(map(tuple, rank.bm25(paras(spark, texts), asked(spark, *queries)).collect()))
    for i, q in enumerate(queries):
        match = " OR ".join(f'"{w}"' for w in q.split())
        want = {a: -b for a, b in db.execute("select rowid, bm25(f) from f where f match ?", (match,))}
        assert got.get(i, {}) == pytest.approx(want, abs=1e-6), q


def test_fusion(spark):
    t = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "query_id long, para_id long, rank int")
    v = spark.createDataFrame([(0, 3, 1), (0, 1, 2)], "query_id long, para_id long, rank int")
    got = rank.fuse(t, v, 10).orderBy("rank").collect()
    assert [r.para_id for r in got] == [3, 1, 2]
    assert [r.score for r in got] == pytest.approx([0.024330, 0.024326, 0.008065], abs=1e-6)


def test_tags_and_modes(spark):
    p = paras(spark, ["keyword one", "keyword two", "keyword three"])
    tags = spark.createDataFrame([(0, "d0", "design"), (0, "d0", "api"), (1, "d1", "design")], "doc_id long, path string, tag string")
    q = asked(spark, "keyword").withColumn("qvec", F.array(F.lit(1.0), F.lit(0.0)))
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5])], "para_id long, embedding array<float>")
    for mode in ("text", "vector", "hybrid"):
        n = lambda t: {r.para_id for r in rank.search(mode, p, q, 10, v, tags, t).collect()}  # noqa: B023, E731
        assert (n(None), n(["design"]), n(["design", "API", "api"]), n(["missing"])) == ({0, 1, 2}, {0, 1}, {0}, set())
    assert rank.search("vector", p, q, 1, v).head().score == 1.0
    assert rank.search("text", p, q, 0).count() == 0
    for bad in (lambda: rank.search("text", p, q, -1), lambda: rank.search("other", p, q), lambda: rank.search("vector", p, q)):
        with pytest.raises(ValueError):
            bad()


def test_get_and_expand(spark):
    docs = spark.createDataFrame([("f", "l1\r\nl2\r\nl3\r\nl4\r\nl5"), ("p", "p0\n\np1\n\np2\n\np3")], "path string, content string")
    ps = spark.createDataFrame([("p", i, f"p{i}") for i in range(4)], "path string, seq int, text string")
    get = lambda *a, **k: retrieve.get_content(docs, ps, *a, **k)
    assert [get("p", para=1), get("p", para=1, context=1), get("p", para=0, context=5), get("p", para=99)] == ["p1", "p0\n\np1\n\np2", "p0\n\np1\n\np2\n\np3", None]
    assert [get("f", lines=x) for x in ((2, 3), (4, 100), (100, 200))] == ["l2\nl3", "l4\nl5", None]
    assert get("none") is None
    for bad in ((0, 3), (3, 2)):
        with pytest.raises(ValueError):
            get("f", lines=bad)
    p = spark.createDataFrame([("a", 0, "あいう"), ("b", 0, "😀def"), ("c", 0, "x")], "path string, seq int, text string")
    hits = spark.createDataFrame([(0, 1, "a", 0), (0, 2, "b", 0), (0, 3, "c", 0)], "query_id long, rank int, doc string, para int")
    got = retrieve.expand_bodies(hits, p, 2, 4).orderBy("rank").collect()
    assert [(r.body, r.body_truncated) for r in got] == [("あいう", False), ("😀", True), (None, False)]


def test_catalog(spark, tmp_path):
    cat = Catalog(spark, f"file://{tmp_path}/ix", lambda t: __import__("gleaner.functions.embedding", fromlist=["x"]).hash_embedder(t, 8))
    put = lambda *r: {x.path: x.status for x in cat.upsert(spark.createDataFrame(list(r), "path string, content string, mtime long")).collect()}
    assert put(("a.md", "---\ntags: [x]\n---\none\n\ntwo", 1), ("b/c.md", "three", 1)) == {"a.md": "new", "b/c.md": "new"}
    assert cat.table("paragraphs").count() == cat.table("vectors").count() == 3
    assert put(("a.md", "---\ntags: [x]\n---\none\n\ntwo", 2), ("b/c.md", "three", 1)) == {"a.md": "touched", "b/c.md": "unchanged"}
    assert cat.table("documents").filter("path = 'a.md'").head().mtime == 2
    assert put(("a.md", "four", 3)) == {"a.md": "changed"}
    assert {(r.path, r.tag) for r in cat.table("doc_tags").collect()} == {("a.md", "md"), ("b/c.md", "b"), ("b/c.md", "md")}
    cat.touch("a.md", 9)
    assert cat.table("documents").filter("path = 'a.md'").head().mtime == 9
    with pytest.raises(KeyError):
        cat.delete(["none"])
    listing = spark.createDataFrame([("a.md",)], "path string")
    assert cat.prune(listing, ["a.md"]).count() == 0 and [r.path for r in cat.prune(listing, ["b"]).collect()] == ["b/c.md"]
    assert [r.path for r in cat.list_paths().collect()] == ["a.md"] and cat.table("vectors").count() == 1
    assert cat.doc_hash("none") == "" and len(cat.doc_hash("a.md")) == 64
    # a change writes its own buckets alone, and a lost writer's manifest doesn't count
    put(*((f"d/{i}.md", f"text {i}", 1) for i in range(40)))
    before = cat.current()["tables"]
    put(("d/3.md", "other", 2))
    after = cat.current()["tables"]
    assert all(sum(after[t][b] != f for b, f in before[t].items()) == 1 for t in before)
    (tmp_path / "ix/CURRENT-00000099").write_text("{half")
    assert cat.current()["tables"] == after and put(("d/4.md", "again", 2)) == {"d/4.md": "changed"}
    assert cat.table("documents").count() == 41 == cat.table("paragraphs").select("path").distinct().count() and cat.table("vectors").count() == 41
    folders = {str(f.parent.relative_to(tmp_path / "ix")) for f in (tmp_path / "ix").glob("data-*/*/bucket=*/*.parquet")}
    assert {f for x in cat.current()["tables"].values() for f in x.values()} <= folders


def test_stale(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, mtime long")
    now = spark.createDataFrame([("a", 1), ("b", 2)], "path string, mtime long")
    got = retrieve.mark_stale(docs.select(F.col("path").alias("doc")), docs, now)
    assert {r.doc: r.stale for r in got.collect()} == {"a": False, "b": True, "c": True}


def test_workspace(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    Workspace.init(".")
    (tmp_path / "docs").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/x.md").write_text("hidden")
    (tmp_path / "docs/a.md").write_text("# Auth\n\nretry the config\n")
    (tmp_path / "docs/b.bin").write_bytes(b"a\0b")
    (tmp_path / "docs/c.py").write_text("code")
    (tmp_path / "docs/d.up").write_text("upper words")
    (tmp_path / ".gleaner/config.json").write_text(json.dumps({"converters": {".up": ["tr", "a-z", "A-Z"], ".bad": ["false"]}}))
    (tmp_path / "docs/e.bad").write_text("x")
    (tmp_path / ".gleaner/config.json").write_text(json.dumps({"converters": {".up": ["cat", "{input}"], ".bad": ["false"]}}))
    ws = Workspace(spark)
    assert ws.root == str(tmp_path)
    n = ws.index(["docs"])
    assert (n["indexed"], n["skipped"], n["excluded"]) == (2, 2, 1)
    assert ws.index(["docs"])["unchanged"] == 2
    hit = ws.search("retry", "text", expand_top=1, expand_budget=100).head()
    assert (hit.doc, hit.para, hit.lines, hit.heading, hit.stale, hit.body) == ("docs/a.md", 1, "3-3", "Auth", False, "retry the config")
    assert ws.get("docs/a.md", para=0) == "# Auth" and ws.get("docs/none.md") is None
    ws.add("new/n.md", "fresh words", ["t"])
    assert ws.search("fresh", "text", tags=["t", "new"]).count() == 1
    with pytest.raises(FileExistsError):
        ws.add("new/n.md", "again")
    with pytest.raises(ValueError):
        ws.index([str(tmp_path.parent)])
    (tmp_path / "cases.jsonl").write_text('{"query": "retry", "doc": "docs/a.md"}\n\n{"query": "retry", "doc": "docs/a.md", "para": 1}\n{"query": "fresh", "doc": "docs/a.md"}\n')
    recall, hits, cases, missed = ws.eval("cases.jsonl", "text")
    assert (round(recall, 3), hits, cases, missed) == (0.667, 2, 3, [("fresh", "docs/a.md", None)])
    os.remove(tmp_path / "docs/d.up")
    assert ws.index(["docs"], prune=True)["pruned"] == 1
    from gleaner.__main__ import run

    capsys.readouterr()
    assert run(["search", "--json", "retry", "-mode=text"], spark) == 0 and run(["get", "docs/none"], spark) == 2
    assert [h["doc"] for h in json.loads(capsys.readouterr().out)] == ["docs/a.md"]
    assert run(["search", "--mode", "text", "--", "retry"], spark) == 0
    assert capsys.readouterr().out == "docs/a.md#1 (lines 3-3, score 1.0000) | Auth\n  retry the config\n"
    os.utime(tmp_path / "docs/a.md", (1, 1))
    assert run(["search", "retry", "--mode", "text", "-k", "1"], spark) == 0
    said = capsys.readouterr()
    assert " [stale] | Auth" in said.out and said.err.startswith("warning: 1 ")
    for flags in ([], ["--json"]):
        assert run(["search", "absent", "--mode", "text", *flags], spark) == 2
        assert capsys.readouterr() == ("", "no hits\n")
    assert run([]) == run(["bogus"]) == 1 and run(["search", "-h"]) == run(["--help"]) == 0
    for bad in (["search"], ["search", "two", "words"], ["search", "--bogus", "x"], ["search", "x", "--mode", "no"], ["search", "x", "--expand-top", "1"], ["get", "x", "--para", "y"]):
        with pytest.raises(ValueError):
            run(bad, spark)
    os.symlink(tmp_path / "nowhere", tmp_path / "docs/link.md")  # a link to nothing is passed over
    assert ws.index(["docs"])["indexed"] == 0 and files.gone(str(tmp_path / "docs/link.md"))
    with pytest.raises(NotADirectoryError):
        files.gone(str(tmp_path / "docs/a.md/x"))


def test_usage_errors_exit_1():
    import subprocess
    import sys

    for argv, code in (([], 1), (["bogus"], 1), (["search", "a", "b"], 1), (["-h"], 0)):
        assert subprocess.run([sys.executable, "-m", "gleaner", *argv], capture_output=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == code


def test_bad_cases(spark, tmp_path):
    for bad, what in (("{", ":1:"), ('{"query": "x"}', ":1:"), ('{"query": "x", "doc": "d"}\n{"doc": "d"}', ":2:"), ("", "no cases")):
        (tmp_path / "c").write_text(bad)
        with pytest.raises(ValueError, match=what):
            files.read_cases(spark, str(tmp_path / "c"))


def test_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = lambda *r: spark.createDataFrame(list(r), stream.SCHEMA).coalesce(1).write.mode("append").parquet(src)
    cat = Catalog(spark, f"file://{tmp_path}/ix")
    for step in ([("a.md", "one", 1), ("a.md", "old", 0)], [("a.md", "two", 2), ("b.md", "three", 1)]):
        rows(*step)
        stream.ingest(stream.stream_documents(spark, src), cat, str(tmp_path / "cp")).awaitTermination()
    assert {(r.path, r.content) for r in cat.table("documents").collect()} == {("a.md", "two"), ("b.md", "three")}


def test_classify(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")], "path string, mtime long, hash string")
    new = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 1, "y"), ("e", 1, "x")], "path string, mtime long, hash string")
    assert {r.path: r.status for r in catalog.classify(old, new).collect()} == {"a": "unchanged", "b": "touched", "c": "changed", "d": "absent", "e": "new"}


def test_requests_are_not_broadcast(spark):
    from gleaner.operators import retrieve
    from gleaner.plans.queries import QUERIES

    docs = spark.createDataFrame([("a", "x")], "path string, content string")
    paras = spark.createDataFrame([("a", i, f"t{i}") for i in range(4)], "path string, seq int, text string")
    wanted = paras.select("path", paras["seq"].alias("para"))
    for df in (retrieve.get_documents(docs, docs), retrieve.get_paragraphs(paras, wanted, 1), retrieve.get_paragraphs(paras, wanted, 1000)):
        assert "broadcast" not in df._jdf.queryExecution().logical().toString().lower()
    got = {r.para: r.content for r in retrieve.get_paragraphs(paras, wanted, 1).collect()}
    assert got == {0: "t0\n\nt1", 1: "t0\n\nt1\n\nt2", 2: "t1\n\nt2\n\nt3", 3: "t2\n\nt3"}
    assert {"get_document", "get_paragraph_context"} <= set(QUERIES)


def test_passages_in_documents(spark, monkeypatch):
    from gleaner.operators import evaluate

    docs = spark.createDataFrame([("a", "one two three"), ("b", "two three"), ("c", None), ("d", "")], "doc string, text string")
    passages = spark.createDataFrame([(1, "two"), (2, "two three"), (3, "two"), (4, ""), (5, None), (6, "e two t")], "item_id long, passage string")
    for size in (100, 1):
        monkeypatch.setattr(evaluate, "MAX_PASSAGES", size)
        assert {(r.doc, r.item_id) for r in evaluate.containing(docs, passages).collect()} == {("a", 1), ("a", 2), ("a", 3), ("a", 6), ("b", 1), ("b", 2), ("b", 3)}


def test_vectors_are_floats_before_they_are_normalised(spark, tmp_path):
    """Three times a float is a float, as in the SQL: in double the first component rounds to another fifth place."""
    spark.createDataFrame([(1, [0.402, 0.647])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = QUERIES["l2_normalize_vectors"](spark, str(tmp_path)).select("vec_id", "norm", "first", "weighted").first()
    assert tuple(got) == c.execute(ORACLE["l2_normalize_vectors"]).fetchone()
