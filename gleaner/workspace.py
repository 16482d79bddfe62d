"""A workspace: a folder of files and its index, with the operations index, search, get, add and eval."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.embedding import hash_embedder, prepared
from .functions.text import embed_query
from .operators import evaluate, rank, retrieve
from .operators.catalog import Catalog
from .session import ship
from .sources import files
from .staging import stage


class Workspace:
    def __init__(self, spark: SparkSession, db: str | None = None, embedder: Callable | None = hash_embedder) -> None:
        ship(spark)
        self.spark = spark
        self.db = os.path.abspath(db or files.default_db(os.environ.get("GLEANER_DB"), os.getcwd()))
        self.root = files.workspace_root(self.db)
        self.config = files.load_config(self.root)
        self.embedder = embedder and prepared(embedder)
        self.catalog = Catalog(spark, f"file://{self.db}", self.embedder)

    @staticmethod
    def init(root: str) -> str:
        """Make the workspace's folder and configuration; an existing configuration stays as it is."""
        at = Path(root, files.FOLDER)
        at.mkdir(parents=True, exist_ok=True)
        if not (at / files.CONFIG_NAME).exists():
            (at / files.CONFIG_NAME).write_text(json.dumps({"db": files.DEFAULT_DB, "converters": {}}, indent=2) + "\n")
        return str(at)

    def index(self, roots: list[str], include_code: bool = False, prune: bool = False, say: Callable[[str, str], None] | None = None) -> dict[str, int]:
        """Counts of indexed, skipped, excluded, unchanged and pruned files.

        say gets ("pruned", key) for each key that is pruned, and ("note", text) for what converters wrote to their standard error.
        """
        found = files.listing(self.spark, roots, self.root)
        cat = self.catalog.checked()
        old = cat.table("documents")
        known = found.join(old.select("path", F.col("hash").alias("known")), "path", "left") if self.config.converters else found
        seen = Observation()
        verdicts = ("indexed", "skipped", "excluded")
        rows = stage(files.read_files(known, self.config, include_code).observe(seen, *[F.count_if(F.col("verdict") == v).alias(v) for v in verdicts], F.count("note").alias("notes")), "files")
        docs = rows.filter("verdict = 'indexed'").join(old.select("path", F.col("content").alias("_old")), "path", "left").select("path", F.coalesce("content", "_old").alias("content"), "mtime", "source_hash")
        status = {r.status: r["count"] for r in cat.upsert(docs).groupBy("status").count().collect()}
        n = seen.get
        out = {"indexed": status.get("new", 0) + status.get("changed", 0), "unchanged": status.get("touched", 0) + status.get("unchanged", 0), "skipped": n["skipped"], "excluded": n["excluded"], "pruned": 0}
        if say and n["notes"]:
            for r in rows.filter("note IS NOT NULL").select("path", "note").toLocalIterator():
                say("note", f"{r.path}: {r.note}")
        if prune:
            pruned = cat.prune(found, [files.normalize_path(r, self.root) for r in roots], lambda path: files.is_gone(path, self.root))
            out["pruned"] = pruned.count()
            if say and out["pruned"]:
                for r in pruned.orderBy("path").toLocalIterator():
                    say("pruned", r.path)
        return out

    def queries(self, texts: list[str]) -> DataFrame:
        """query_id, query, and qvec if there is an embedder."""
        df = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
        if self.embedder is None:
            return df
        vecs = self.embedder([r[0] for r in df.orderBy("query_id").select(embed_query(F.col("query"))).collect()])
        rows = [(i, t, [float(x) for x in v]) for i, (t, v) in enumerate(zip(texts, vecs, strict=True))]
        return self.spark.createDataFrame(rows, "query_id long, query string, qvec array<float>")

    def search(self, texts: str | list[str], mode: str = "hybrid", k: int = 10, tags: list[str] | None = None, expand_top: int = 0, expand_budget: int = 0) -> DataFrame:
        """Hits of one or many queries: query_id, rank, score, doc, para, lines, snippet, heading, stale (and body)."""
        if (expand_top, expand_budget) != (0, 0) and (expand_top <= 0 or expand_budget <= 0):
            raise ValueError("expand_top and expand_budget must both be positive")
        cat = self.catalog.checked()
        paras = cat.table("paragraphs")
        q = self.queries([texts] if isinstance(texts, str) else texts)
        hits = retrieve.hydrate(rank.search(mode, paras, q, k, cat.table("vectors"), cat.table("doc_tags"), tags, postings=cat.table("postings")), paras)
        hits = retrieve.stale_by(hits, cat.table("documents"), files.modified(F.col("doc"), self.root))
        return retrieve.expand_bodies(hits, paras, expand_top, expand_budget) if expand_top else hits

    def get(self, key: str, lines: tuple[int, int] | None = None, para: int | None = None, context: int = 0) -> str | None:
        """By the key as it stands, else by its path within the workspace."""
        cat = self.catalog.checked()
        docs, paras = cat.table("documents"), cat.table("paragraphs")
        got = retrieve.get_content(docs, paras, files.clean_key(key), lines, para, context)
        if got is None and (rel := files.normalize_path(key, self.root)) != files.clean_key(key):
            got = retrieve.get_content(docs, paras, rel, lines, para, context)
        return got

    def add(self, key: str, content: str, tags: list[str] | None = None) -> None:
        at = files.add_file(self.root, key, content, tags)
        self.index([at], include_code=True)

    def eval(self, cases_file: str, mode: str = "hybrid", k: int = 10) -> tuple[float, int, int, list[tuple[str, str, int | None]]]:
        """recall@k, hits, cases, and the cases that were missed."""
        cases = files.read_cases(self.spark, cases_file).withColumn("query_id", F.col("case_id"))
        texts = [r.query for r in cases.orderBy("case_id").collect()]  # the case file was read on the driver
        judged = evaluate.recalled(self.search(texts, mode, k), cases)
        r = evaluate.recall(judged).head()
        missed = judged.filter("NOT recalled").join(cases.select("case_id", "query"), "case_id").orderBy("case_id").collect()
        return r.recall, r.hits, r.cases, [(m.query, m.doc, m.para) for m in missed]
