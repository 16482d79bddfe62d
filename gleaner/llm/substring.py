"""Substring dedup with a log-structured fingerprint index.

A window is WINDOW consecutive words of a document.  Each window is filed under
its minimiser, the least of the hashes of its SEED_WORDS-word runs: equal
windows have equal minimisers, and neighbouring windows mostly share one, so one
row carries the hashes of several windows.  Rows are dealt to buckets by
minimiser.  The index is a table for each level, bucketed and sorted by
minimiser; each batch appended is an immutable run, a sorted file in each
bucket.  A batch of documents is dealt to the same buckets and merge-joined with
the runs of each level where they lie, so that history is read but never
shuffled.  A bucket is merged in slices by minimiser, more of them as history
grows, so that what a task holds doesn't grow with it.  Runs of one level are compacted into one of the next, bucket by
bucket, when there are FANOUT of them.

A window whose minimiser and hash are found again is a candidate, with the place
where it was found.  Candidates are verified: the words of both places, from
the documents themselves, must have the same 128-bit digest.  Hashes for which
that fails are settled by digests of all their windows.

Repeats inside one task are settled there, word by word, before anything is
shuffled, so that a passage in a third of all documents reaches the shuffle once
a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, drop_path, new_path, only, stage, strings

WINDOW = 20
SEED_WORDS = 8
#: Bytes kept of the hash of a window.
TAG = 6
FANOUT = 3
#: Texts whose windows a task sorts at once.
TEXTS = 400
#: Repeated windows, and words, that a task remembers between Arrow batches.
REMEMBER = 100_000
#: Bytes of text for each bucket, about.
BUCKET = 12 << 20
#: Bytes, of a batch's texts or of the files of a level, that a task takes into Python at once, about.
SLICE = 24 << 20
#: A null doc_id comes after all others.
AFTER = (1 << 63) - 1
#: Odd multipliers of the two hashes.
_M, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Of each byte, whether it is white space.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _bytes(col: pa.Array) -> list[bytes]:
    """The UTF-8 of texts; nulls become empty."""
    return [x if x is not None else b"" for x in col.cast(pa.binary()).to_pylist()]


def _bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: its first byte, and the byte after its last."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def _split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and how many each text has."""
    data = b"\n".join(texts)
    first, end = _bounds(data)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)  # of each text, past the white space after it
    ends_at = np.r_[0, np.cumsum(end - first)].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends_at), pa.py_buffer(buf[~_SPACE[buf]])])
    return words, np.diff(np.searchsorted(first, np.r_[0, ends]))


def _hashes(words: pa.Array) -> np.ndarray:
    """Of each word of a large_binary array without nulls, that begins its buffers: the hash that _Words gives."""
    data = words.buffers()[2].to_pybytes()
    ends = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1].tolist()
    return np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)), np.uint64, len(words))


class _Words(dict):
    """Numbers of words, and their hashes by number."""

    def __init__(self) -> None:
        self.hashes = np.empty(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty(n, np.uint64)])
        self.hashes[n] = xxhash.xxh3_64_intdigest(word)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C
    return h ^ (h >> np.uint64(29))


def windows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the hashes of words, for each window start: minimiser hash, place of the minimiser, window hash."""
    n = len(h)
    with np.errstate(over="ignore"):
        m2 = _M * _M
        m4 = m2 * m2
        h2 = h[:-1] * _M + h[1:]
        h4 = h2[:-2] * m2 + h2[2:]
        h8 = h4[:-4] * m4 + h4[4:]
        h16 = h8[:-8] * (m4 * m4) + h8[8:]
        whole = _mix(h16[: n - WINDOW + 1] * m4 + h4[16 : 16 + n - WINDOW + 1])
        runs = _mix(h8 * _C)
    view = np.lib.stride_tricks.sliding_window_view(runs, WINDOW - SEED_WORDS + 1)
    at = view.argmin(1) + np.arange(len(view))
    return runs[at], at, whole


def _runs(flags: np.ndarray, *breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the stretches of set flags, cut where any of breaks changes."""
    idx = np.flatnonzero(flags)
    if not len(idx):
        return idx, idx
    new = np.r_[True, (idx[1:] != idx[:-1] + 1)]
    for b in breaks:
        new[1:] |= b[idx[1:]] != b[idx[:-1]]
    first = np.flatnonzero(new)
    return idx[first], np.diff(np.r_[first, len(idx)])


def _tag_bytes(whole: np.ndarray, tag: int) -> np.ndarray:
    return whole.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :tag]


def _blobs(tags: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The rows of tags (bytes) as binary values of so many tags each."""
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32) * tags.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(tags).tobytes())])


_ROWS = "mini long, doc_id long, start int, n int, tags binary"
#: Columns of hashes don't repeat: no dictionaries are tried when they are written.
_PLAIN = {f"parquet.enable.dictionary#{c}": "false" for c in ("mini", "tags")}
_NAMES = ["mini", "doc_id", "start", "n", "tags"]


class _Task:
    """The windows of one task's documents, less those that it can itself tell are repeated."""

    def __init__(self, tag: int) -> None:
        self.tag = tag
        self.forget()

    def forget(self) -> None:
        none = np.empty(0, np.uint64)
        self.words = pa.array([], pa.large_binary())  # those of hot
        # repeated windows, sorted by hash: hash, minimiser, doc, start, the places of the words in words
        self.hot = (none, none, np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, WINDOW), np.int32))

    def batch(self, ids: np.ndarray, texts: list[bytes]) -> pa.RecordBatch | None:
        """Rows of windows not known to be repeated, and of stretches (tags null, n windows) that are."""
        if len(self.words) > 2 * REMEMBER:
            self.forget()
        by_id = np.argsort(ids, kind="stable")
        words, many = _split([texts[i] for i in by_id])
        if len(words) < WINDOW:
            return None
        coded = words.dictionary_encode()
        said, numbers = coded.dictionary, coded.indices.to_numpy()
        mini, at, whole = windows(_hashes(said)[numbers])
        row, ends = np.repeat(np.arange(len(many)), many)[: len(whole)], np.cumsum(many)
        place = np.flatnonzero(np.arange(len(whole)) + WINDOW <= ends[row])  # windows of one text
        if not len(place):
            return None
        mini, at, whole, row = mini[place], at[place], whole[place], row[place]
        doc, start = ids[by_id][row], place - (ends - many)[row]
        view = np.lib.stride_tricks.sliding_window_view(numbers, WINDOW)
        code = pa.compute.index_in(said, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).copy()  # places in words
        order = np.argsort(whole, kind="stable")
        s = whole[order]
        same = np.r_[False, s[1:] == s[:-1]]
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(s))))  # in sorted order, of each group
        head = order[first]
        later = np.flatnonzero(same & ((doc[order] > doc[head]) | (start[order] > start[head])))
        later = later[(view[place[order[later]]] == view[place[head[later]]]).all(1)]
        repeated = np.zeros(len(whole), bool)
        repeated[order[later]] = True
        hw, hm, hd, hs, hv = self.hot
        if len(hw):
            p = np.minimum(np.searchsorted(hw, whole), len(hw) - 1)
            known = np.flatnonzero((hw[p] == whole) & ((doc > hd[p]) | (doc == hd[p]) & (start > hs[p])))
            repeated[known[(code[view[place[known]]] == hv[p[known]]).all(1)]] = True
        lead = np.unique(head[later])
        lead = lead[~repeated[lead]]
        if len(lead):
            fresh = np.unique(view[place[lead]])
            fresh = fresh[code[fresh] < 0]
            code[fresh] = len(self.words) + np.arange(len(fresh))
            self.words = pa.concat_arrays([self.words, said.take(pa.array(fresh))])
            hot = [np.concatenate(x) for x in zip((whole[lead], mini[lead], doc[lead], start[lead].astype(np.int64), code[view[place[lead]]]), self.hot, strict=True)]
            keep = np.lexsort((hot[3], hot[2], hot[0]))  # by hash, the earliest first
            hot = [x[keep] for x in hot]
            keep = np.r_[True, hot[0][1:] != hot[0][:-1]]
            hot = [x[keep] for x in hot]
            if len(hot[0]) > REMEMBER:
                hot = [x[len(x) - REMEMBER :] for x in hot]
            self.hot = tuple(hot)
        p, n = _runs(~repeated, row, at)
        q, m = _runs(repeated, row)
        spread = _mix(doc[q].astype(np.uint64) + q.astype(np.uint64))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([mini[p], spread]).view(np.int64)),
                pa.array(np.concatenate([doc[p], doc[q]])),
                pa.array(np.concatenate([start[p], start[q]]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(len(n)), m]).astype(np.int32)),
                pa.concat_arrays([_blobs(_tag_bytes(whole, self.tag)[~repeated], n), pa.nulls(len(q), pa.binary())]),
            ],
            _NAMES,
        )


def _scan(tag: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(tag)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                if (out := task.batch(b.column(0).fill_null(AFTER).to_numpy(), _bytes(b.column(1)))) is not None:
                    yield out

    return run


class _Flat:
    """The windows of rows, one each: of a bucket's batch, or of its runs."""

    def __init__(self, table: pa.Table, shared: np.ndarray, size: int) -> None:
        """shared: minimisers that count.  size: bytes of a tag."""
        mini = table.column("mini").to_numpy()
        keep = np.isin(mini, shared)
        table, mini = table.filter(pa.array(keep)), mini[keep]
        blobs = table.column("tags").combine_chunks()
        blobs = blobs if isinstance(blobs, pa.Array) else pa.concat_arrays(blobs.chunks)
        ends = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1] if len(blobs) else np.zeros(1, np.int32)
        data = np.frombuffer(blobs.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(blobs) and blobs.buffers()[2] is not None else np.empty(0, np.uint8)
        many = np.diff(ends) // size
        self.bytes = data.reshape(-1, size)
        wide = np.zeros((len(self.bytes), 8), np.uint8)
        wide[:, :size] = self.bytes
        self.tag, self.row = wide.view("<u8").ravel(), np.repeat(np.arange(len(many)), many)
        within = np.arange(len(self.row)) - np.repeat(np.cumsum(many) - many, many)
        self.mini, self.doc = mini[self.row], table.column("doc_id").to_numpy()[self.row]
        self.start = table.column("start").to_numpy()[self.row].astype(np.int64) + within


_SPANS = "kind int, mini long, doc_id long, start int, n int, doc0 long, start0 int, tags binary"


def _spans(doc=(), start=(), n=(), doc0=None, start0=None, kind=0, mini=None, tags=None) -> pa.Table:
    """kind 0: told by the task; 1: a candidate, found at doc0, start0; 2: rows of a run."""
    k = len(doc)
    fill = lambda v, t: pa.nulls(k, t) if v is None else pa.array(v, t) if not isinstance(v, pa.Array) else v
    cols = [pa.array(np.full(k, kind), pa.int32()), fill(mini, pa.int64()), fill(doc, pa.int64()), fill(start, pa.int32()), fill(n, pa.int32()), fill(doc0, pa.int64()), fill(start0, pa.int32()), fill(tags, pa.binary())]
    return pa.Table.from_arrays(cols, [c.split()[0] for c in _SPANS.split(", ")])


def _found(new: _Flat, old: _Flat | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of windows of new with a key that comes earlier (in old, or in new): where, whether in old, and of what."""
    j = lambda c: np.concatenate([getattr(old, c), getattr(new, c)]) if old is not None else getattr(new, c)
    mini, tag, doc, start = (j(c) for c in ("mini", "tag", "doc", "start"))
    k = len(old.tag) if old is not None else 0
    keys = tag ^ _mix(mini.view(np.uint64))
    twice = np.sort(keys)
    twice = twice[1:][twice[1:] == twice[:-1]]
    again = np.zeros(len(new.tag), bool)
    some = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys) if len(twice) else np.empty(0, np.int64)
    mini, tag, doc, start, of_new = mini[some], tag[some], doc[some], start[some], some >= k  # only these are put in order
    order = np.lexsort((start, doc, of_new, tag, mini))
    same = np.r_[False, (mini[order[1:]] == mini[order[:-1]]) & (tag[order[1:]] == tag[order[:-1]])][: len(order)]
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))] if len(order) else order
    at = of_new[order] & same & (~of_new[head] | (doc[order] != doc[head]) | (start[order] != start[head]))
    if old is not None:
        at &= ~of_new[head]
    i, h = some[order[at]] - k, head[at]
    again[i] = True
    return i, doc[h], start[h], again


def _as_spans(new: _Flat, i: np.ndarray, doc0: np.ndarray, start0: np.ndarray) -> pa.Table:
    """Candidates as stretches that go on in both places."""
    order = np.lexsort((new.start[i], new.doc[i]))
    i, doc0, start0 = i[order], doc0[order], start0[order]
    d, s = new.doc[i], new.start[i]
    if not len(i):
        return _spans()
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1) | (doc0[1:] != doc0[:-1]) | (start0[1:] != start0[:-1] + 1)])
    n = np.diff(np.r_[first, len(i)])
    return _spans(d[first], s[first].astype(np.int32), n.astype(np.int32), doc0[first], start0[first].astype(np.int32), 1)


def _shared(mini: np.ndarray) -> np.ndarray:
    u, n = np.unique(mini, return_counts=True)
    return u[n > 1]


def _own(append: bool, tag: int):
    """Over the rows of a bucket: repeats within the batch, and if append the rows of its run."""

    def run(table: pa.Table) -> pa.Table:
        told = table.filter(pa.compute.is_null(table.column("tags")))
        rows = table.filter(pa.compute.is_valid(table.column("tags")))
        out = [_spans(*(told.column(c).to_numpy() for c in ("doc_id", "start", "n")))]
        many = _shared(rows.column("mini").to_numpy())
        new = _Flat(rows, many, tag)
        i, doc0, start0, again = _found(new, None)
        out.append(_as_spans(new, i, doc0, start0))
        if append:
            lone = rows.filter(pa.array(~np.isin(rows.column("mini").to_numpy(), many)))
            out.append(_spans(lone.column("doc_id").to_numpy(), lone.column("start").to_numpy(), None, kind=2, mini=lone.column("mini").to_numpy(), tags=pa.concat_arrays(lone.column("tags").chunks) if lone.num_rows else None))
            p, n = _runs(~again, new.row)
            out.append(_spans(new.doc[p], new.start[p].astype(np.int32), None, kind=2, mini=new.mini[p], tags=_blobs(new.bytes[~again], n)))
        return pa.concat_tables(out)

    return run


def _own_with_level(append: bool, tag: int):
    """Both over a bucket of the batch and of a level: what _own and _with_level tell, of a batch that is passed on once."""
    own, with_level = _own(append, tag), _with_level(tag)

    def run(batch: pa.Table, runs: pa.Table) -> pa.Table:
        return pa.concat_tables([own(batch), with_level(batch, runs)]) if batch.num_rows else _spans()

    return run


def _with_level(tag: int):
    """Over a bucket of the batch and of a level: windows of the batch that are in a run."""

    def run(batch: pa.Table, runs: pa.Table) -> pa.Table:
        batch = batch.filter(pa.compute.is_valid(batch.column("tags")))
        both = np.intersect1d(batch.column("mini").to_numpy(), runs.column("mini").to_numpy())
        if not len(both):
            return _spans()
        new = _Flat(batch, both, tag)
        i, doc0, start0, _ = _found(new, _Flat(runs, both, tag))
        return _as_spans(new, i, doc0, start0)

    return run


@contextmanager
def slices_stay(spark: SparkSession) -> Iterator[None]:
    """While a plan is made: what is dealt by bucket needn't be dealt again by bucket and slice, and a task writes its two parts side by side, unsorted."""
    names = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.maxConcurrentOutputFileWriters": "2"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


class FingerprintIndex:
    """Sorted immutable runs of the windows of earlier batches, bucketed, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, tag: int = TAG) -> None:
        """buckets: of a new index; an existing one keeps its own (about BUCKET bytes of text for each suit).  tag: bytes of a hash, the same each time."""
        self.spark, self.path, self.tag = spark, path.rstrip("/"), tag
        have = [int(n[8:]) for n in self._list() if n.startswith("buckets-")]
        self.buckets = have[0] if have else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _list(self, at: str = "") -> list[str]:
        fs, path = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(path(self.path + at))] if fs.exists(path(self.path + at)) else []

    def levels(self) -> list[int]:
        return sorted(int(n[6:]) for n in self._list(f"/buckets-{self.buckets}") if n.startswith("level-"))

    def _name(self, level: int) -> str:
        return f"gleaner_windows_{hashlib.md5(self.path.encode()).hexdigest()}_{level}"

    def table(self, level: int) -> DataFrame:
        """The runs of a level, read where they lie: bucketed and sorted."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name(level)} (bucket INT, run STRING, mini BIGINT, doc_id BIGINT, start INT, tags BINARY) "
            f"USING parquet OPTIONS ({', '.join(f"'{k}' '{v}'" for k, v in _PLAIN.items())}) CLUSTERED BY (bucket) SORTED BY (bucket, mini) INTO {self.buckets} BUCKETS LOCATION '{self.path}/buckets-{self.buckets}/level-{level}'"
        )
        return self.spark.table(self._name(level))

    def runs(self, level: int) -> list[str]:
        return sorted(r[0] for r in self.table(level).select("run").distinct().collect())  # FANOUT at most

    def _append(self, rows: DataFrame, level: int) -> None:
        """A new run: rows (bucket, mini, doc_id, start, tags), dealt by bucket already."""
        run = new_path(self.spark, "run").rsplit("/", 1)[1]
        self.table(level)
        rows.select("bucket", F.lit(run).alias("run"), "mini", "doc_id", "start", "tags").write.insertInto(self._name(level))
        self.spark.catalog.refreshTable(self._name(level))

    def _bucket(self, mini: str = "mini") -> Column:
        return F.pmod(F.xxhash64(mini), F.lit(self.buckets)).cast("int")

    def _slices(self, size: int) -> int:
        return max(1, -(-size // (self.buckets * SLICE)))

    def _level_bytes(self, level: int) -> int:
        fs, path = self._fs()
        at = path(f"{self.path}/buckets-{self.buckets}/level-{level}")
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0

    def merged(self, docs: DataFrame, append: bool = True, size: int | None = None) -> DataFrame:
        """The windows of docs against themselves and each level: spans, and with append the rows of a run."""
        if size is None:
            size = docs.select(F.octet_length(F.col("text").cast("string")).alias("n")).agg(F.sum("n")).head()[0] or 0
        sliced = lambda df, n: df.withColumn("slice", F.pmod(F.xxhash64("mini", F.lit(1)), F.lit(n)).cast("int")).groupBy("bucket", "slice")
        rows = arrow_map(only(docs, doc_id="long", text="string"), _scan(self.tag), _ROWS).withColumn("bucket", self._bucket())
        rows = rows.repartition(self.buckets, "bucket")  # as the runs lie, so that slices of both need no further shuffle
        out = None
        for level in reversed(self.levels()):
            n = self._slices(max(size, self._level_bytes(level)))
            both = sliced(rows, n).cogroup(sliced(self.table(level), n)).applyInArrow(_with_level(self.tag) if out is not None else _own_with_level(append, self.tag), _SPANS)
            out = both if out is None else out.unionByName(both)
        return out if out is not None else sliced(rows, self._slices(size)).applyInArrow(_own(append, self.tag), _SPANS)

    def candidates(self, docs: DataFrame, append: bool = True, size: int | None = None) -> DataFrame:
        """Spans of windows of docs that seem to occur earlier, in the index or in docs, and where (see verified).

        With append, the windows that are new to the batch become a run.  size:
        bytes of the texts of docs, about; counted if not given.
        """
        own = self.merged(docs, append, size)
        out = new_path(self.spark, "substring-merge")
        with slices_stay(self.spark):
            own.withColumn("part", F.when(F.col("kind") == 2, "run").otherwise("spans")).write.options(**_PLAIN).partitionBy("part").parquet(out)
        fs, path = self._fs()
        read = lambda part: self.spark.read.schema(_SPANS).parquet(f"{out}/part={part}") if fs.exists(path(f"{out}/part={part}")) else self.spark.createDataFrame([], _SPANS)
        if append:  # what a task wrote is of few buckets: no need to deal it again
            self._append(read("run").withColumn("bucket", self._bucket()), 0)
            drop_path(self.spark, f"{out}/part=run")
            self.compact()
        return read("spans")

    def repeated(self, docs: DataFrame, corpus: DataFrame, append: bool = True) -> DataFrame:
        """doc_id, start, n: the windows of docs (n from word start on) that occur earlier, in the index or in docs.

        corpus: doc_id, text of docs and of all documents in the index, against
        which candidates are verified.  A null doc_id comes back as the greatest
        long.
        """
        return self.verified(self.candidates(docs, append), corpus)

    def verified(self, spans: DataFrame, corpus: DataFrame, packed: DataFrame | None = None) -> DataFrame:
        """doc_id, start, n of the spans whose words are those of the places where they were found.

        packed: packed_texts of corpus, if there is such a table.
        """
        texts = only(corpus, doc_id="long", text="string")
        told, new = spans.filter("kind = 0").select("doc_id", "start", "n"), spans.filter("kind = 1").select("doc_id", "start", "n", "doc0", "start0")
        wanted = new.select("doc_id", "start", "n").union(new.select("doc0", "start0", "n")).distinct()
        wanted = wanted.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("sizes"))  # no more than a document's places

        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z = zstandard.ZstdDecompressor()
            for b in batches:
                out = []
                for key, packed, starts, sizes in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                    words = z.decompress(packed).split()
                    out += [(key, s, n, xxhash.xxh3_128_digest(b" ".join(words[s : s + n + WINDOW - 1]))) for s, n in zip(starts, sizes, strict=True) if s + n + WINDOW - 1 <= len(words)]
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "start", "n", "words"])

        pieces = arrow_map((packed if packed is not None else packed_texts(texts)).join(wanted, "key").select("key", "packed", "starts", "sizes"), digests, "doc_id long, start int, n int, words binary")
        pieces = stage(pieces.groupBy("doc_id", "start", "n").agg(F.collect_set("words").alias("words")), "window-words")  # several where a doc_id repeats
        there = pieces.select(F.col("doc_id").alias("doc0"), F.col("start").alias("start0"), "n", F.col("words").alias("words0"))
        checked = new.join(pieces, ["doc_id", "start", "n"], "left").join(there, ["doc0", "start0", "n"], "left")
        checked = stage(checked.select("doc_id", "start", "n", F.coalesce(F.arrays_overlap("words", "words0"), F.lit(False)).alias("ok")), "window-checks")
        out = told.unionByName(checked.filter("ok").drop("ok"))
        bad = checked.filter("NOT ok").select("doc_id", "start", "n")
        return out if not bad.head(1) else out.unionByName(self._settled(bad, texts, new.select("doc_id").distinct()))

    def _settled(self, bad: DataFrame, texts: DataFrame, batch: DataFrame) -> DataFrame:
        """Of windows whose hash stands for several sequences of words: those with the words of an earlier one."""

        size = self.tag

        def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Words()
            for b in batches:
                for doc, t in zip(b.column(0).fill_null(AFTER).to_pylist(), strings(b.column(1)), strict=True):
                    words = t.encode().split()
                    if len(words) < WINDOW:
                        continue
                    numbers = known.numbers(words)
                    m, _, w = windows(known.hashes[numbers])
                    of = [xxhash.xxh3_128_digest(b" ".join(words[i : i + WINDOW])) for i in range(len(w))]
                    tags = _tag_bytes(w, size)
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array([x.tobytes() for x in tags], pa.binary()), pa.array(of, pa.binary()), pa.array([doc] * len(w), pa.int64()), pa.array(np.arange(len(w), dtype=np.int32))], ["mini", "tag", "words", "doc_id", "start"])

        every = arrow_map(texts, exploded, "mini long, tag binary, words binary, doc_id long, start int")
        spots = bad.select("doc_id", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("start")).distinct()
        keys = every.join(spots, ["doc_id", "start"], "left_semi").select("mini", "tag").distinct()
        some = stage(every.join(keys, ["mini", "tag"], "left_semi").select("words", "doc_id", "start"), "window-collisions")
        least = some.groupBy("words").agg(F.min(F.struct("doc_id", "start")).alias("least"))
        again = some.join(least, "words").filter(F.struct("doc_id", "start") > F.col("least"))
        return again.join(batch, "doc_id", "left_semi").select("doc_id", "start", F.lit(1).alias("n"))

    def compact(self) -> None:
        """Merge the runs of a level into one of the next wherever there are FANOUT of them; buckets stay where they are."""
        for level in range(64):
            if level not in self.levels():
                return
            if len(self.runs(level)) >= FANOUT:
                self._append(self.table(level), level + 1)  # a crash here leaves windows twice, which does no harm
                self.spark.sql(f"DROP TABLE {self._name(level)}")
                drop_path(self.spark, f"{self.path}/buckets-{self.buckets}/level-{level}")

    def close(self) -> None:
        """Forget the tables' names; the runs stay."""
        for level in self.levels():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(level)}")


def packed_texts(docs: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """doc_id, key (doc_id, or the greatest long for null), packed (the compressed text) and extra."""
    extra = extra or {}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(1)
        for b in batches:
            packed = pa.array([z.compress(t) for t in _bytes(b.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(0).fill_null(AFTER), packed, *b.columns[2:]], ["doc_id", "key", "packed", *extra])

    return arrow_map(only(docs, doc_id="long", text="string", **extra), pack, "doc_id long, key long, packed binary" + "".join(f", {c} {t}" for c, t in extra.items()))


def cut_words(text: str, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Words, removed words, and the text without the words that spans (first window, windows) cover."""
    n, removed, kept = _cut(text.encode(), spans)
    return n, removed, kept.decode()


def _cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    at, _ = _bounds(data)
    n = len(at)
    if not spans:
        return n, 0, data
    step = np.zeros(n + 1, np.int64)
    for s, k in spans:
        if s < n:
            step[s] += 1
            step[min(n, s + k + WINDOW - 1)] -= 1
    gone = np.cumsum(step[:n]) > 0
    removed = int(gone.sum())
    if removed == n:
        return n, n, b""
    out, first, size = [], *_runs(~gone)
    for f, k in zip(first.tolist(), size.tolist(), strict=True):
        out.append(data[at[f] : at[f + k] if f + k < n else len(data)])
    return n, removed, b"".join(out)


def remove_spans(docs: DataFrame, spans: DataFrame, extra: dict[str, str] | None = None, packed: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, text (what is kept, with its own white space) and extra for every row of docs.

    extra: further columns of docs that come along, name -> type.  packed: packed_texts of docs with extra, if there is such a table.
    """
    extra = extra or {}
    tail = "".join(f", {c} {t}" for c, t in extra.items())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            starts, sizes = b.column(2).to_pylist(), b.column(3).to_pylist()
            rows = [_cut(z.decompress(t), list(zip(s or [], k or [], strict=True))) for t, s, k in zip(b.column(1).to_pylist(), starts, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), *b.columns[4:]], ["doc_id", "n_words", "n_removed", "text", *extra])

    by_doc = spans.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("sizes"))  # no more than a document's words
    return arrow_map((packed if packed is not None else packed_texts(docs, extra)).join(by_doc, "key", "left").select("doc_id", "packed", "starts", "sizes", *extra), cut, "doc_id long, n_words long, n_removed long, text string" + tail)


def dedup_corpus(docs: DataFrame, batches: int = 4, extra: dict[str, str] | None = None, tag: int = TAG) -> DataFrame:
    """doc_id, n_words, n_removed, text (and extra): docs without the words of windows that occur earlier.

    Earlier: in a document with a smaller doc_id, or earlier in the same one.
    The documents go through an empty index in about `batches` batches of like
    size, by doc_id; each is appended for those after it.  Null texts have no
    words; a null doc_id comes after all others; rows with one doc_id count as one
    document, a word being removed from each row if its place is removed in any.
    One row out for each row in.
    """
    spark = docs.sparkSession
    size, ends = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.col("text").cast("string")).alias("n")).agg(
        F.sum("n"), F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [1.0], 1000)).head()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // BUCKET)
    index = FingerprintIndex(spark, new_path(spark, "window-index"), buckets, tag)
    cuts = sorted(set(ends or [])) if batches > 1 else []
    key, spans = F.col("doc_id").cast("long"), None
    for k in range(len(cuts) + 1):
        low, high = (key > cuts[k - 1]) if k else F.lit(True), (key <= cuts[k]) if k < len(cuts) else F.lit(True)
        part = docs.filter((low & high) if k < len(cuts) else (low | key.isNull()))
        got = index.candidates(part, k < len(cuts), (size or 0) // (len(cuts) + 1))
        spans = got if spans is None else spans.unionByName(got)
    index.close()
    drop_path(spark, index.path)
    packed = stage(packed_texts(docs, extra), "window-texts")
    return remove_spans(docs, index.verified(spans, docs, packed), extra, packed)
