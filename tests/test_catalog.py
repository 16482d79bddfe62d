"""Snapshots of the index: growth, writers at the same time, clearing, pruning."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from gleaner.functions.embedding import hash_embedder, prepared, truncated
from gleaner.operators import catalog, postings
from gleaner.operators.catalog import Catalog, Conflict, bucket_of, parent_of
from gleaner.workspace import Workspace

DOC = "path string, content string, mtime long"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def consistent(cat):
    """Every row is in its bucket, in all tables; children are those of the documents."""
    now = cat.current()
    paths = {r.path for r in cat.table("documents").collect()}
    for t in now["tables"]:
        assert {r.path for r in cat.table(t).select("path").distinct().collect()} == paths, t
        for b, folder in now["tables"][t].items():
            wrong = cat._read(t, [folder]).filter(bucket_of("path", now["buckets"], now["base"]) != int(b)).count()
            assert wrong == 0 and int(b) < now["buckets"]
    assert sum(now["rows"].values()) == len(paths)
    want = {tuple(map(str, r)) for r in postings.build(cat.table("paragraphs"), ("path",)).collect()}
    assert {tuple(map(str, r)) for r in cat.table("postings").collect()} == want
    assert cat.table("vectors").count() == cat.table("paragraphs").count()


def test_addresses(spark):
    """A new bucket takes rows from its parent alone."""
    paths = spark.createDataFrame([(f"p{i}",) for i in range(300)], "path string")
    at = lambda n: {r[0]: r[1] for r in paths.select("path", bucket_of("path", n, 3)).collect()}
    before = at(3)
    for n in range(4, 15):
        after = at(n)
        moved = {p for p in before if before[p] != after[p]}
        assert moved and all(after[p] == n - 1 and before[p] == parent_of(n - 1, 3) for p in moved)
        before = after


def test_growth(spark, tmp_path):
    cat = Catalog(spark, f"file://{tmp_path}/ix", lambda t: hash_embedder(t, 4), buckets=2, load=10)
    assert cat.upsert(docs(spark, [(f"d/{i}.md", f"text {i}\n\nmore", 1) for i in range(95)])).filter("status = 'new'").count() == 95
    assert cat.current()["buckets"] == 10
    consistent(cat)
    before = cat.current()
    cat.upsert(docs(spark, [("one/more.md", "x", 1)]))
    same = lambda a, b: {t: {k for k in a["tables"][t] if a["tables"][t][k] != b["tables"][t].get(k)} for t in a["tables"]}
    assert all(len(x) <= 1 for x in same(before, cat.current()).values()) and cat.current()["buckets"] == 10
    cat.upsert(docs(spark, [(f"n/{i}.md", "y", 1) for i in range(5)]))
    before = cat.current()
    assert before["buckets"] == 11
    cat.delete([f"d/{i}.md" for i in range(50)])
    assert cat.current()["buckets"] == 11
    consistent(cat)


def test_writers_at_the_same_time(spark, tmp_path, monkeypatch):
    """What two writers change in different buckets survives; who meets another's bucket begins anew; who can't is told."""
    cat, other = (Catalog(spark, f"file://{tmp_path}/ix", lambda t: hash_embedder(t, 4), buckets=4) for _ in range(2))
    paths = [f"d/{i}.md" for i in range(12)]
    cat.upsert(docs(spark, [(p, "old", 1) for p in paths]))
    at = {r[0]: r[1] for r in cat.table("documents").select("path", bucket_of("path", 4, 4)).collect()}
    a = paths[0]
    b = next(p for p in paths if at[p] != at[a])
    c = next(p for p in paths[1:] if at[p] == at[a])
    rewrite, began = Catalog._rewrite, []

    def meanwhile(path):
        def run(self, base, *rest):
            change = rewrite(self, base, *rest)
            began.append(path)
            if self is cat and began.count(path) == 1:
                other.upsert(docs(spark, [(path, "other", 2)]))
            return change

        return run

    for path, times in ((b, 1), (c, 2)):
        began.clear()
        monkeypatch.setattr(Catalog, "_rewrite", meanwhile(path))
        cat.upsert(docs(spark, [(a, f"mine {path}", 3)]))
        assert len(began) == times + 1  # the other's one, and mine: again only where the buckets met
        monkeypatch.setattr(Catalog, "_rewrite", rewrite)
        got = {r.path: r.content for r in cat.table("documents").collect()}
        assert (got[a], got[path], len(got)) == (f"mine {path}", "other", 12)
    consistent(cat)
    monkeypatch.setattr(catalog, "TRIES", 1)
    monkeypatch.setattr(Catalog, "_rewrite", meanwhile(a))
    began.clear()
    with pytest.raises(Conflict):
        cat.touch(c, 9)
    monkeypatch.setattr(Catalog, "_rewrite", rewrite)
    monkeypatch.setattr(catalog, "PATIENCE", 0.1)
    n = cat._manifests()[-1]
    (tmp_path / f"ix/CURRENT-{n + 1:08d}").write_text("{half")  # a writer that was lost
    cat.touch(c, 9)
    assert cat._newest()[0] == n + 2
    assert cat.table("documents").filter(F.col("path") == c).head().mtime == 9


def test_threads(spark, tmp_path):
    cat = Catalog(spark, f"file://{tmp_path}/ix", lambda t: hash_embedder(t, 4), buckets=3, load=4)
    failed = []

    def put(k):
        try:
            Catalog(spark, f"file://{tmp_path}/ix", lambda t: hash_embedder(t, 4), buckets=3, load=4).upsert(docs(spark, [(f"{k}/{i}.md", f"t{i}", 1) for i in range(3)]))
        except Conflict as e:
            failed.append(e)

    threads = [threading.Thread(target=put, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert cat.table("documents").count() == 3 * (3 - len(failed))
    consistent(cat)


def test_clearing(spark, tmp_path):
    """Old snapshots stay for the time to keep; then what no snapshot names is removed, reports and what failed writers left too."""
    cat = Catalog(spark, f"file://{tmp_path}/ix", buckets=2)
    for k in range(3):
        cat.upsert(docs(spark, [("a.md", f"v{k}", k)]))
    assert len(cat._manifests()) == 3
    (tmp_path / "ix/data-lost/documents").mkdir(parents=True)
    reader = cat.table("documents")
    cat.keep = -5
    cat.touch("a.md", 7)
    assert len(cat._manifests()) == 1 and reader.schema
    named = {f.split("/")[0] for x in cat.current()["tables"].values() for f in x.values()}
    assert {f.name for f in (tmp_path / "ix").iterdir() if f.name.startswith("data-")} == named
    assert cat.table("documents").head().mtime == 7 and cat.table("paragraphs").head().text == "v2"


def test_absolute_keys_are_refused(spark, tmp_path):
    cat = Catalog(spark, f"file://{tmp_path}/ix")
    for bad in ("/a.md", "C:/a.md"):
        with pytest.raises(ValueError):
            cat.upsert(docs(spark, [("b.md", "x", 1), (bad, "x", 1)]))
    assert cat.table("documents").count() == 0 and cat.checked() is cat


def test_prune_looks_at_files(spark, tmp_path, monkeypatch):
    """Files that the walk passes over but that are there stay; links to nothing go; what can't be looked at stops the run."""
    monkeypatch.chdir(tmp_path)
    Workspace.init(".")
    (tmp_path / "docs/.notes").mkdir(parents=True)
    (tmp_path / "docs/.notes/b.md").write_text("hidden but there")
    (tmp_path / "docs/a.md").write_text("plain")
    (tmp_path / "docs/l.md").write_text("link")
    (tmp_path / "docs/sub").mkdir()
    (tmp_path / "docs/sub/c.md").write_text("below")
    ws = Workspace(spark)
    ws.index(["docs/.notes"])
    ws.index(["docs"])
    said = []
    assert ws.index(["docs"], prune=True, say=lambda *x: said.append(x))["pruned"] == 0 and ws.get("docs/.notes/b.md")
    os.remove("docs/l.md")
    os.symlink("nowhere", "docs/l.md")
    os.remove("docs/.notes/b.md")
    assert ws.index(["docs"], prune=True, say=lambda *x: said.append(x))["pruned"] == 2
    assert said == [("pruned", "docs/.notes/b.md"), ("pruned", "docs/l.md")]
    os.remove("docs/sub/c.md")
    os.rmdir("docs/sub")
    (tmp_path / "docs/sub").write_text("now a file, so its place can't be looked into")
    with pytest.raises(Exception, match="NotADirectory|Not a directory"):
        ws.index(["docs/a.md", "docs"], prune=True)
    assert ws.get("docs/sub/c.md")


def test_converters_notes_and_limits(spark, tmp_path):
    from gleaner.sources import files

    f = str(tmp_path / "x")
    (tmp_path / "x").write_text("text")
    assert files.convert(["cat", "{input}"], f) == ("text", None)
    assert files.convert(["sh", "-c", "echo out; echo err >&2"], f) == ("out\n", "err")
    assert files.convert(["sh", "-c", "echo bad >&2; exit 3"], f) == (None, "bad") and files.convert(["false"], f) == (None, "exit code 1")
    assert files.convert(["sleep", "5"], f, 0.2)[0] is None and "stopped" in files.convert(["sleep", "5"], f, 0.2)[1]
    assert files.convert(["no-such-program"], f)[0] is None


def test_prepared_embedder():
    assert truncated("one, two three", 3) == "one, two" and truncated("a b", 5) == "a b" and truncated("x" * 50, 3) == "x" * 50
    v = prepared(lambda t: hash_embedder(t, 8), 2)(["abc def ghi", "abc def", ""])
    assert v[0].tolist() == v[1].tolist() and abs((v[0] ** 2).sum() - 1) < 1e-5 and not v[2].any() and prepared(lambda t: hash_embedder(t, 8))([]).shape[0] == 0
