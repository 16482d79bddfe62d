"""Incremental maintenance: which documents are new, changed, touched or unchanged, and snapshots of the tables.

Every table is dealt to buckets by document, each a folder of Parquet files.  A
snapshot is a manifest: a file CURRENT-n that names the folder of each bucket.
A change writes only the buckets of the documents that it concerns, and then a
manifest that names these in place of the old ones, so readers never see half a
change, and what is written grows with the change and not with the index.

Buckets grow in number by linear hashing: with each LOAD documents more, the rows
of one bucket are dealt to it and a new one, and no others move.  Writers don't
lock: one that finds that others have committed since it began puts its buckets
into the newest snapshot if they changed none of these, and begins anew if they did.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import embed
from ..functions.markup import merged_tags
from ..functions.text import content_hash, embed_text, is_absolute_key
from ..schemas import TABLES
from .postings import build
from .segment import split_paragraphs

#: Buckets of a new index, and documents a bucket (on average) from which on their number grows.
BUCKETS, LOAD = 8, 20_000
#: How files of the index are compressed.
CODEC = "zstd"
#: Seconds for which snapshots that are no longer the newest, and folders that none names, are kept: longer than any reader or writer is at work.
KEEP = 3600
#: Seconds that a writer waits for another that has begun to write a manifest, and how often it begins anew.
PATIENCE, TRIES = 5, 5


class Conflict(RuntimeError):
    """Another writer has changed the same buckets."""


class Change(NamedTuple):
    """Buckets written anew, the folders of those that aren't empty for each table, documents in each bucket, and how many buckets there are then."""

    buckets: list[int]
    tables: dict[str, dict[str, str]]
    rows: dict[str, int]
    n: int


def bucket_of(path: str, n: int, base: int) -> Column:
    """Linear hashing: base * 2^level buckets, of which the first have been split in two."""
    size = base
    while size * 2 <= n:
        size *= 2
    h = doc_key(path)
    low = F.pmod(h, F.lit(size))
    return F.when(low < n - size, F.pmod(h, F.lit(2 * size))).otherwise(low).cast("int")


def parent_of(bucket: int, base: int) -> int:
    """The bucket that was split to make this one."""
    size = base
    while size * 2 <= bucket:
        size *= 2
    return bucket - size


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status of every path: new, changed, touched (only the mtime differs), unchanged, or absent (only in old).

    old: path, mtime, hash; new: path, mtime, hash.
    """
    j = old.select("path", F.col("mtime").alias("m0"), F.col("hash").alias("h0")).join(new.select("path", F.col("mtime").alias("m1"), F.col("hash").alias("h1")), "path", "full")
    status = F.when(F.col("h1").isNull(), "absent").when(F.col("h0").isNull(), "new").when(F.col("h0") != F.col("h1"), "changed").when(F.col("m0") != F.col("m1"), "touched").otherwise("unchanged")
    return j.select("path", status.alias("status"))


def merge_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """The documents after an upsert: content and hash are replaced where the hash differs, mtime always."""
    n = new.select("path", F.col("content").alias("c1"), F.col("mtime").alias("m1"), F.col("hash").alias("h1"))
    j = old.select("path", "content", "mtime", "hash").join(n, "path", "full")
    changed = F.col("h1").isNotNull() & (F.col("hash").isNull() | (F.col("hash") != F.col("h1")))
    return j.select("path", F.when(changed, F.col("c1")).otherwise(F.col("content")).alias("content"), F.coalesce("m1", "mtime").alias("mtime"), F.when(changed, F.col("h1")).otherwise(F.col("hash")).alias("hash"))


def without_paths(table: DataFrame, paths: DataFrame) -> DataFrame:
    """Delete: the rows of a table whose path isn't in paths."""
    return table.join(paths.select("path"), "path", "left_anti")


def missing_under(indexed: DataFrame, listing: DataFrame, roots: list[str]) -> DataFrame:
    """Prune: indexed paths under the roots that the listing doesn't have.  A root is a file, a folder, or '.' for all."""
    under = reduce(lambda a, b: a | b, [F.lit(True) if r == "." else (F.col("path") == r) | F.startswith("path", F.lit(r + "/")) for r in roots], F.lit(False))
    return indexed.filter(under).select("path").join(listing.select("path"), "path", "left_anti")


def absolute_keys(documents: DataFrame) -> DataFrame:
    """Paths that are absolute, which an index must not have."""
    return documents.filter(is_absolute_key(F.col("path"))).select("path")


def doc_key(path: str) -> Column:
    """Id of a document: a hash of its path, so the same in every run and never used again for another."""
    return F.xxhash64(path)


def para_key(path: str, seq: str) -> Column:
    return F.xxhash64(path, seq)


def _names(table: str) -> list[str]:
    return [c.split()[0] for c in TABLES[table].split(", ")]


class Catalog:
    """The tables of one index in a folder that Hadoop's file systems can reach."""

    def __init__(self, spark: SparkSession, path: str, embedder: Callable | None = None, buckets: int = BUCKETS, load: int = LOAD, keep: float = KEEP) -> None:
        """buckets: of a new index; an existing one keeps its own and those that it has grown to."""
        self.spark, self.path, self.embedder, self._buckets, self.load, self.keep = spark, path.rstrip("/"), embedder, buckets, load, keep

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        fs_path = jvm.org.apache.hadoop.fs.Path
        return fs_path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), fs_path

    def _manifests(self) -> list[int]:
        fs, p = self._fs()
        found = [f.getPath().getName() for f in fs.listStatus(p(self.path))] if fs.exists(p(self.path)) else []
        return sorted(int(n[8:]) for n in found if n.startswith("CURRENT-"))

    def _manifest(self, n: int) -> dict | None:
        """None if its writer was lost half way, or isn't done."""
        fs, p = self._fs()
        stream = fs.open(p(f"{self.path}/CURRENT-{n:08d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def _newest(self) -> tuple[int, dict]:
        for n in reversed(self._manifests()):
            if found := self._manifest(n):
                return n, found
        return 0, {"buckets": self._buckets, "base": self._buckets, "rows": {}, "tables": {t: {} for t in TABLES}}

    def current(self) -> dict:
        """The snapshot that counts: buckets, documents in each, and the folder of each bucket of each table."""
        return self._newest()[1]

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        at = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(TABLES[name]).parquet(*at) if at else self.spark.createDataFrame([], TABLES[name])

    def table(self, name: str, buckets: list[int] | None = None, of: dict | None = None) -> DataFrame:
        """All of a table, or some of its buckets, in the newest snapshot or another."""
        folders = (of or self.current())["tables"][name]
        return self._read(name, [f for b, f in sorted(folders.items()) if buckets is None or int(b) in buckets])

    def _put(self, name: str, rows: DataFrame, bucket: Column, *by: str, dealt: bool = False) -> dict[str, str]:
        """Write rows to a new folder; the folder of each bucket that has any.

        dealt: the rows come from files of one bucket each, and are written where they are, without a shuffle.
        """
        fs, p = self._fs()
        at = f"data-{uuid.uuid4().hex}/{name}"
        rows = rows.select(*_names(name), bucket.alias("bucket"))
        rows = rows if dealt else rows.repartition("bucket")
        rows.sortWithinPartitions("bucket", *by).write.partitionBy("bucket").option("compression", CODEC).parquet(f"{self.path}/{at}")
        found = [f.getPath().getName() for f in fs.listStatus(p(f"{self.path}/{at}"))]
        return {n[7:]: f"{at}/{n}" for n in found if n.startswith("bucket=")}

    def _commit(self, n: int, base: dict, change: Change) -> None:
        """Make the snapshot after n, which was base; Conflict if another writer has changed what this one changes."""
        fs, p = self._fs()
        newest, mine = base, set(map(str, change.buckets))
        while True:
            n += 1
            tables = {t: {b: f for b, f in newest["tables"][t].items() if t not in change.tables or b not in mine} | change.tables.get(t, {}) for t in TABLES}
            rows = {b: c for b, c in newest["rows"].items() if b not in mine} | change.rows
            after = {"buckets": max(newest["buckets"], change.n), "base": base["base"], "rows": rows, "relative": True, "tables": tables}
            try:
                out = fs.create(p(f"{self.path}/CURRENT-{n:08d}"), False)
            except Exception as e:  # another writer was first
                found = self._patient(n)
                if found is None:
                    continue  # it was lost: what it wrote counts for nothing
                if any(found["tables"][t].get(b) != base["tables"][t].get(b) for t in TABLES for b in mine):
                    raise Conflict("another writer has changed the same buckets") from e
                if found["buckets"] != base["buckets"] and change.n != base["buckets"]:
                    raise Conflict("another writer has made new buckets too") from e
                newest = found
                continue
            out.write(bytearray(json.dumps(after).encode()))
            out.close()
            return self._clear(n, after)

    def _patient(self, n: int) -> dict | None:
        until = time.time() + PATIENCE
        while not (found := self._manifest(n)) and time.time() < until:
            time.sleep(0.1)
        return found

    def _clear(self, n: int, newest: dict) -> None:
        """Remove snapshots that are older than the time to keep, and folders of that age that none of the others names."""
        fs, p = self._fs()
        files = {f.getPath().getName(): f.getModificationTime() / 1000 for f in fs.listStatus(p(self.path))}
        old = time.time() - self.keep
        gone = [k for k in self._manifests() if k < n and files.get(f"CURRENT-{k:08d}", old + 1) < old]
        named = lambda m: {f for x in ((m or {}).get("tables") or {}).values() for f in x.values()}
        used = named(newest).union(*(named(self._manifest(k)) for k in self._manifests() if k not in gone))
        for k in gone:
            for f in named(self._manifest(k)) - used:
                fs.delete(p(f"{self.path}/{f}"), True)
            fs.delete(p(f"{self.path}/CURRENT-{k:08d}"), False)
        tops = {f.split("/")[0] for f in used}
        for name, at in files.items():
            if name.startswith("data-") and name not in tops and at < old:
                fs.delete(p(f"{self.path}/{name}"), True)

    def _transact(self, work: Callable[[dict], Change | None]) -> None:
        for k in range(TRIES):
            n, base = self._newest()
            change = work(base)
            if change is None:
                return
            try:
                return self._commit(n, base, change)
            except Conflict:
                if k == TRIES - 1:
                    raise

    def tags_of(self, docs: DataFrame) -> DataFrame:
        return docs.select(doc_key("path").alias("doc_id"), "path", F.explode(merged_tags(F.col("content"), F.col("path"))).alias("tag"))

    def paragraphs_of(self, docs: DataFrame) -> DataFrame:
        paras = split_paragraphs(docs.select(doc_key("path").alias("doc_id"), "path", "content"))
        return paras.select(para_key("path", "seq").alias("para_id"), "doc_id", "path", "seq", "start_line", "end_line", "text", "heading")

    def _rewrite(self, base: dict, documents: DataFrame, moved: list[int], gone: DataFrame | None, docs: DataFrame | None, children: list[int], more: int = 0) -> Change:
        """Write buckets of all tables: documents those in moved; the others those in children, without paths in gone and with the children of docs.

        If there are then (`more` than before) over LOAD documents a bucket, new buckets are made, and those that are split for them are written too.
        """
        old = base["buckets"]
        n = max(old, -(-(sum(base["rows"].values()) + more) // self.load))
        split = sorted({b for new in range(old, n) for b in self._ancestors(new, old, base["base"])})
        bucket = bucket_of("path", n, base["base"])
        tables: dict[str, dict[str, str]] = {}
        whole = sorted({*moved, *split})
        rows = self.table("documents", [b for b in whole if b not in moved], base).select(_names("documents")).unionByName(documents.select(_names("documents")))
        tables["documents"] = self._put("documents", rows, bucket)
        dealt = {str(r["bucket"]): r["count"] for r in self.spark.read.parquet(f"{self.path}/{next(iter(tables['documents'].values())).rsplit('/', 1)[0]}").groupBy("bucket").count().collect()} if tables["documents"] else {}
        of = sorted({*children, *split})
        if of:
            kept = lambda t: self.table(t, of, base) if gone is None else without_paths(self.table(t, of, base), gone)
            with_ = lambda t, new: (kept(t).select(_names(t)) if new is None else kept(t).select(_names(t)).unionByName(new.select(_names(t))))
            tables["paragraphs"] = self._put("paragraphs", with_("paragraphs", None if docs is None else self.paragraphs_of(docs)), bucket)
            tables["doc_tags"] = self._put("doc_tags", with_("doc_tags", None if docs is None else self.tags_of(docs)), bucket)
            written = self._read("paragraphs", list(tables["paragraphs"].values()))
            fresh = None if docs is None else written.join(docs.select("path"), "path", "left_semi")  # as written
            # postings are several times as large as their paragraphs, so those of kept ones are built again too, where these lie, and none is shuffled
            tables["postings"] = self._put("postings", build(written, ("path",)), bucket, "gram", dealt=True)
            vectors = None if fresh is None or not self.embedder else fresh.select("para_id", embed(embed_text(F.col("heading"), F.col("text")), self.embedder).alias("embedding"), "path")
            tables["vectors"] = self._put("vectors", with_("vectors", vectors), bucket)
        written = sorted({*whole, *range(old, n)})
        for t in TABLES:  # buckets that this table did not have to write stay as they are
            here = set(map(str, {*(whole if t == "documents" else of), *range(old, n)}))
            tables[t] = {b: f for b, f in base["tables"][t].items() if int(b) in written and b not in here} | tables.get(t, {})
        return Change(written, tables, {str(b): dealt.get(str(b), 0) for b in written}, n)

    @staticmethod
    def _ancestors(bucket: int, old: int, base: int) -> list[int]:
        """The existing bucket from which a new one gets its rows, be it by several splits."""
        while bucket >= old:
            bucket = parent_of(bucket, base)
        return [bucket]

    def _buckets_of(self, base: dict, paths: DataFrame) -> list[int]:
        return sorted(r[0] for r in paths.select(bucket_of("path", base["buckets"], base["base"]).alias("b")).distinct().collect())  # no more than there are buckets

    def upsert(self, docs: DataFrame) -> DataFrame:
        """Merge docs (path, content, mtime, and source_hash if their hash isn't that of the content); path, status of each.

        One row a path, which must be relative.  Only new and changed documents are split, indexed and embedded.
        """
        if bad := absolute_keys(docs).head():
            raise ValueError(f"{bad[0]} is an absolute key")
        hashed = F.coalesce("source_hash", content_hash(F.col("content"))) if "source_hash" in docs.columns else content_hash(F.col("content"))
        new = docs.select("path", "content", F.col("mtime").cast("long").alias("mtime"), hashed.alias("hash"))
        reports: list[DataFrame] = []

        def work(base: dict) -> Change | None:
            at = f"{self.path}/data-{uuid.uuid4().hex}/report"
            theirs = self.table("documents", self._buckets_of(base, new), base)
            classify(theirs, new).filter("status <> 'absent'").write.parquet(at)
            report = self.spark.read.schema("path string, status string").parquet(at)
            reports.append(report)
            moved, fresh = self._buckets_of(base, report.filter("status <> 'unchanged'")), report.filter("status IN ('new', 'changed')").select("path")
            if not moved:
                return None
            mine = new.join(report.filter("status <> 'unchanged'"), "path", "left_semi")
            merged = merge_documents(self.table("documents", moved, base), mine).select(doc_key("path").alias("doc_id"), "path", "content", "mtime", "hash")
            return self._rewrite(base, merged, moved, fresh, new.join(fresh, "path", "left_semi"), self._buckets_of(base, fresh), report.filter("status = 'new'").count())

        self._transact(work)
        return reports[-1]

    def touch(self, path: str, mtime: int) -> None:
        def work(base: dict) -> Change:
            of = self._buckets_of(base, self.spark.createDataFrame([(path,)], "path string"))
            rows = self.table("documents", of, base).withColumn("mtime", F.when(F.col("path") == path, F.lit(mtime).cast("long")).otherwise(F.col("mtime")))
            return self._rewrite(base, rows, of, None, None, [])

        self._transact(work)

    def delete(self, paths: list[str] | DataFrame) -> None:
        """Remove documents and their children; KeyError if a listed path isn't there."""
        df = self.spark.createDataFrame([(p,) for p in paths], "path string") if isinstance(paths, list) else paths

        def work(base: dict) -> Change | None:
            of = self._buckets_of(base, df)
            if isinstance(paths, list) and (gone := df.join(self.table("documents", of, base), "path", "left_anti").head()):
                raise KeyError(gone[0])
            return self._rewrite(base, without_paths(self.table("documents", of, base), df), of, df, None, of) if of else None

        self._transact(work)

    def prune(self, listing: DataFrame, roots: list[str], gone: Callable[[Column], Column] | None = None) -> DataFrame:
        """Delete the documents under the roots that the listing doesn't have and (with gone, a column function of the path) that are gone; their paths."""
        missing = missing_under(self.table("documents"), listing, roots)
        at = f"{self.path}/data-{uuid.uuid4().hex}/pruned"
        (missing.filter(gone(F.col("path"))) if gone else missing).write.parquet(at)
        pruned = self.spark.read.schema("path string").parquet(at)
        self.delete(pruned)
        return pruned

    def doc_hash(self, path: str) -> str:
        base = self.current()
        of = self._buckets_of(base, self.spark.createDataFrame([(path,)], "path string"))
        row = self.table("documents", of, base).filter(F.col("path") == path).select("hash").head()
        return row[0] if row else ""

    def checked(self) -> Catalog:
        """This index; ValueError if it has an absolute key, which only one whose writer didn't refuse them can have."""
        now = self.current()
        if not now.get("relative") and (bad := absolute_keys(self.table("documents", of=now)).head()):
            raise ValueError(f"the index has an absolute key ({bad[0]}); make it anew")
        return self

    def list_paths(self) -> DataFrame:
        return self.table("documents").select("path").orderBy("path")

    def first_path(self) -> str | None:
        row = self.table("documents").select("path").limit(1).head()
        return row[0] if row else None
