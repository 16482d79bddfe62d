"""Listings as streams against batches, and folders as a data source."""

import os
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from gleaner.operators import catalog, retrieve
from gleaner.operators.catalog import Catalog
from gleaner.plans import corpora
from gleaner.sources import files, folder
from gleaner.streaming import track

START, HOUR = datetime(2024, 1, 1, tzinfo=timezone.utc), timedelta(hours=1)


@pytest.fixture
def store(spark):
    for k, v in track.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in track.STORE:
        spark.conf.unset(k)


def run(spark, tmp_path, batches, name, period=HOUR):
    src = str(tmp_path / name)
    for k, b in enumerate(batches):
        spark.createDataFrame(b, track.LISTING).coalesce(1).write.mode("append").parquet(src)
        os.utime(next(f for f in sorted((tmp_path / name).glob("*.parquet"), key=os.path.getmtime, reverse=True)), (1000 + k, 1000 + k))
    rows = spark.readStream.schema(track.LISTING).option("maxFilesPerTrigger", 1).parquet(src)
    out = track.track(rows, int(period.total_seconds() * 1000), "10 hours")
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.path, r.seen.astimezone(timezone.utc) if r.seen.tzinfo else r.seen, r.status) for r in spark.table(name).filter("path <> 'end'").collect())


def end(hours):
    return [("end", 0, "x", START + timedelta(hours=hours))]


def plain(rows, until):
    """Statuses of sightings in order of time."""
    out, by = set(), {}
    for p, m, h, s in rows:
        by.setdefault(p, {})
        by[p][s] = max(by[p].get(s, (m, h)), (m, h))
    for p, seen in by.items():
        last = None
        for s, (m, h) in sorted(seen.items()):
            if last and last[0] + HOUR < s:
                out.add((p, last[0] + HOUR, "absent"))
                last = None
            out.add((p, s, "new" if not last else "changed" if last[2] != h else "touched" if last[1] != m else "unchanged"))
            last = s, m, h
        if last[0] + HOUR <= until:
            out.add((p, last[0] + HOUR, "absent"))
    return sorted(out)


def test_tracks_in_any_order(spark, store, tmp_path):
    """Rows in any order and dealt to any files give the statuses that rows in order do."""
    rng = random.Random(1)
    rows = []
    for i in range(30):
        for k in range(6):
            if rng.random() < 0.7:
                rows.append((f"p{i}", rng.randint(0, 1), rng.choice("ab"), START + k * HOUR))
    rows += rows[:10]  # repeats
    want = plain(rows, START + timedelta(hours=25))
    naive = [(p, s.replace(tzinfo=None), x) for p, s, x in want]
    for seed, n in ((1, 3), (2, 1)):
        random.Random(seed).shuffle(rows)
        got = run(spark, tmp_path, [*(rows[i::n] for i in range(n)), end(36), end(37)], f"any{seed}")
        assert [(p, s.replace(tzinfo=None), x) for p, s, x in got] == naive


@pytest.mark.parametrize("step", [None, 7, 10, 25])
def test_tracks_without_python(spark, tmp_path, step):
    """Statuses are told by aggregations alone, no path is passed to Python; for any step they are those of the sightings in order."""
    rng = random.Random(step)
    rows = [(f"p{i}", rng.randint(0, 1), rng.choice("ab"), START + rng.randint(0, 24) * HOUR / 4) for i in range(40) for _ in range(8)]
    spark.createDataFrame(rows, track.LISTING).write.parquet(str(tmp_path / "in"))
    as_ = lambda df: track.track(df, 3_600_000, "1 hour", step and step * 60_000)
    plan = as_(spark.readStream.schema(track.LISTING).parquet(str(tmp_path / "in")))._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and plan.count("Aggregate") == 2
    got = as_(spark.read.schema(track.LISTING).parquet(str(tmp_path / "in"))).collect()  # as a table, all windows are over
    assert sorted((r.path, r.seen.replace(tzinfo=None), r.status) for r in got) == [(p, s.replace(tzinfo=None), x) for p, s, x in plain(rows, START + timedelta(days=9))]


def test_tracks_like_classify(spark, store, tmp_path):
    """The last statuses of two snapshots of the documents are those of the batch classification."""
    d = "/root/testdata/sf0.001"
    old, new = (x.withColumn("hash", F.xxhash64("content").cast("string")).select("path", "mtime", "hash") for x in corpora.snapshots(spark, d))
    want = {r.path: r.status for r in catalog.classify(old, new).collect()}
    rows = [(r.path, r.mtime, r.hash, START + k * HOUR) for k, s in enumerate((old, new)) for r in s.collect()]
    random.Random(3).shuffle(rows)
    got = run(spark, tmp_path, [rows[::2], rows[1::2], end(11.5), end(11.6)], "snapshots")
    assert {p: x for p, s, x in got if s.replace(tzinfo=None) == (START + HOUR).replace(tzinfo=None)} == want and set(want.values()) == {"new", "changed", "touched", "unchanged", "absent"}


def test_follow(spark, store, tmp_path):
    cat = Catalog(spark, f"file://{tmp_path}/ix")
    cat.upsert(spark.createDataFrame([(p, "x", 1) for p in ("a", "b", "c")], "path string, content string, mtime long"))
    src = str(tmp_path / "src")
    sight = lambda *x: spark.createDataFrame([(p, 1, "h", START + k * HOUR) for p, k in x], track.LISTING).coalesce(1).write.mode("append").parquet(src)
    sight(("a", 0), ("b", 0), ("a", 1), ("a", 2))
    sight(("end", 30))
    sight(("end", 31))
    rows = spark.readStream.schema(track.LISTING).option("maxFilesPerTrigger", 1).parquet(src)
    track.follow(track.track(rows.filter("path <> 'a' OR seen < '2024-01-01 03:00:00'"), 3_600_000, "27 hours"), cat, str(tmp_path / "cp")).awaitTermination()
    left = {r.path for r in cat.list_paths().collect()}
    assert "b" not in left and "c" in left


def tree(tmp_path):
    for f in ("a.md", "x/b.md", "x/y/c.md", "x/y/z/d.md", "x/y/z/w/e.md", ".hid/f.md", "x/.hid/g.md"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text(f)
    os.symlink("nowhere", tmp_path / "x/dangling")
    (tmp_path / "empty").mkdir()


@pytest.mark.parametrize("depth", [0, 1, 5])
def test_folder_source(spark, tmp_path, monkeypatch, depth):
    tree(tmp_path)
    monkeypatch.setattr(folder, "DEPTH", depth)
    got = files.listing(spark, [str(tmp_path), str(tmp_path / "x"), str(tmp_path / "a.md")], str(tmp_path))
    assert sorted(r.path for r in got.collect()) == ["a.md", "x/b.md", "x/y/c.md", "x/y/z/d.md", "x/y/z/w/e.md"]
    r = got.filter("path = 'x/b.md'").head()
    assert (r.file, r.size, r.mtime) == (str(tmp_path / "x/b.md"), 6, int(os.stat(tmp_path / "x/b.md").st_mtime))
    with pytest.raises(FileNotFoundError):
        files.listing(spark, [str(tmp_path / "none")], str(tmp_path))
    with pytest.raises(ValueError):
        files.listing(spark, [str(tmp_path.parent)], str(tmp_path))


def test_folder_stream(spark, tmp_path):
    """Each change of a file comes once, over restarts."""
    at = tmp_path / "in"
    at.mkdir()
    tree(at)
    now = int(datetime.now().timestamp()) - 100
    for k, f in enumerate(sorted(at.rglob("*.md"))):
        os.utime(f, (now + k, now + k))

    def batch():
        q = files.listing(spark, [str(at)], str(at), stream=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.path, r.mtime) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = batch()
    assert [p for p, _ in first] == ["a.md", "x/b.md", "x/y/c.md", "x/y/z/d.md", "x/y/z/w/e.md"]
    os.utime(at / "a.md", (now + 9999, now + 9999))
    assert batch() == first  # not before its time
    changed = int(time.time())
    os.utime(at / "a.md", (changed, changed))
    time.sleep(folder.BEHIND + 1.1)
    assert batch() == sorted([*first, ("a.md", changed)]) == batch()


@pytest.mark.parametrize("context", [0, 1, 7, 1000])
def test_contexts_like_a_range_join(spark, context):
    rng = random.Random(context)
    rows = [(p, i, f"{p}{i}") for p, n in (("a", 40), ("b", 1), ("c", 300)) for i in range(n) if rng.random() < 0.9 or n == 1]
    wanted = [(p, i) for p, i, _ in rows if rng.random() < 0.5] + [("a", 999), ("none", 0), ("b", 0), ("b", 0), ("c", -1)]
    paras = spark.createDataFrame(rows, "path string, seq int, text string")
    got = retrieve.get_paragraphs(paras, spark.createDataFrame(wanted, "path string, para int"), context)
    there = {(p, i) for p, i, _ in rows}
    want = {w: "\n\n".join(t for p, i, t in sorted(rows, key=lambda r: (r[0], r[1])) if p == w[0] and abs(i - w[1]) <= context) for w in set(wanted) if w in there}
    assert {(r.path, r.para): r.content for r in got.collect()} == want
    bands = len({(p, b) for p, i in set(wanted) for b in range(max(i - context, 0) // (context + 1), (i + context) // (context + 1) + 1)})
    assert bands <= 3 * len(set(wanted))


def test_contexts_are_cut_where_their_band_lies(spark):
    """No text is shuffled for each paragraph that wants it: one exchange, by band, whose rows are few more than those given."""
    rows = [("a", i, f"t{i}") for i in range(1000)] + [("b", 0, "x")]
    paras = spark.createDataFrame(rows, "path string, seq int, text string")
    got = retrieve.get_paragraphs(paras, paras.select("path", F.col("seq").alias("para")), 50)
    text = {r.para: r.content for r in got.filter("path = 'a'").collect()}
    assert text == {i: "\n\n".join(f"t{j}" for j in range(max(0, i - 50), min(1000, i + 51))) for i in range(1000)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning(path") == 1


def test_paragraphs_are_passed_on_in_pieces(spark, monkeypatch):
    """What a task holds of paragraphs is bounded, however many a batch of documents has."""
    import pyarrow as pa

    from gleaner.operators import segment

    docs = spark.createDataFrame([(i, "\n\n".join(f"line {i} {k}" for k in range(50))) for i in range(100)], "id long, content string").coalesce(1)
    whole = sorted(map(tuple, segment.split_paragraphs(docs).collect()))
    runs, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: runs.append(f) or plain(self, f, schema))
    batch = pa.RecordBatch.from_pydict({"id": [*range(300)], "t": ["\n\n".join("x" * 500)] * 300})
    for pieces, gathered, most in ((1000, 10**9, 1500), (10**9, 3000, 1500), (10**9, 1, 500)):
        monkeypatch.setattr(segment, "PIECES", pieces)
        monkeypatch.setattr(segment, "GATHERED", gathered)
        assert sorted(map(tuple, segment.split_paragraphs(docs).collect())) == whole and len(whole) == 5000
        sizes = [b.num_rows for b in runs[-1](iter([batch]))]
        assert max(sizes) <= most and sum(sizes) == 150_000
