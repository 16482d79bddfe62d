"""Files of a workspace: walking, filtering, converting, and keys relative to its root."""

from __future__ import annotations

import json
import os
import posixpath
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from .convert import BUILT_IN
from .folder import NAME, FolderSource

#: Source code, left out unless asked for.
CODE_EXTENSIONS = (".go", ".py", ".js", ".ts", ".java", ".c", ".cpp", ".h", ".rs")
MAX_FILE_BYTES = 10 * 1024 * 1024
SNIFF_BYTES = 8192
#: Seconds after which a converter is stopped.
CONVERT_SECONDS = 300
CONFIG_NAME = "config.json"
FOLDER = ".gleaner"
DEFAULT_DB = "index"


@dataclass
class Config:
    db: str = DEFAULT_DB
    converters: dict[str, list[str]] = field(default_factory=dict)

    def converter_for(self, ext: str) -> list[str] | None:
        return self.converters.get(ext.lower())


def load_config(root: str) -> Config:
    """The workspace's configuration; defaults if there is none, ValueError if it can't be read."""
    at = Path(root, FOLDER, CONFIG_NAME)
    if not at.exists():
        return Config()
    try:
        raw = json.loads(at.read_text())
        return Config(raw.get("db") or DEFAULT_DB, dict(raw.get("converters") or {}))
    except (ValueError, AttributeError, TypeError) as e:
        raise ValueError(f"{at}: {e}") from e


def workspace_root(db: str) -> str:
    """The folder above the index, or above its .gleaner folder."""
    parent = os.path.dirname(os.path.abspath(db))
    return os.path.dirname(parent) if os.path.basename(parent) == FOLDER else parent


def default_db(env: str | None, cwd: str) -> str:
    """Environment before the db of the nearest ancestor with a configuration before the default place."""
    if env:
        return env
    for d in [Path(cwd), *Path(cwd).parents]:
        if (d / FOLDER).is_dir():
            db = load_config(str(d)).db
            return db if os.path.isabs(db) else str(d / FOLDER / db)
    return os.path.join(cwd, FOLDER, DEFAULT_DB)


def normalize_path(path: str, root: str) -> str:
    """Slash-separated and relative to root ('.': root itself); ValueError outside it."""
    rel = os.path.relpath(os.path.abspath(path), os.path.abspath(root)).replace(os.sep, "/")
    if rel == ".." or rel.startswith("../"):
        raise ValueError(f"{path} is outside the workspace {root}")
    return rel


def clean_key(arg: str) -> str:
    return posixpath.normpath(arg.replace(os.sep, "/"))


def extension(path: str) -> str:
    """From the last dot of the name on, so that of .env is .env."""
    name = path.rsplit("/", 1)[-1]
    return name[name.rindex(".") :].lower() if "." in name else ""


def gone(file: str) -> bool:
    """Whether a file isn't there; any other reason that it can't be looked at is raised, for it may well be there."""
    try:
        os.stat(file)
        return False
    except FileNotFoundError:
        return True


def is_gone(path: Column, root: str) -> Column:
    """gone for the files that keys stand for, looked at by the executors."""

    @F.pandas_udf("boolean")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series([gone(os.path.join(root, k)) for k in keys], dtype=bool)

    return run(path)


def modified(path: Column, root: str) -> Column:
    """mtime (seconds) of the files that keys stand for, null for those that can't be looked at: only these are, not the tree."""

    @F.pandas_udf("long")
    def run(keys: pd.Series) -> pd.Series:
        def of(key: str) -> int | None:
            try:
                return int(os.stat(os.path.join(root, key)).st_mtime)
            except OSError:
                return None

        return pd.Series([of(k) for k in keys], dtype="Int64")

    return run(path)


def listing(spark: SparkSession, roots: list[str], root: str, stream: bool = False) -> DataFrame:
    """path (the key), file, mtime in seconds, size of all files; folders that start with a dot are passed over.

    The executors list and look at the files.  As a stream: files as they are changed.
    """
    for r in roots:  # all of them before anything is read
        normalize_path(r, root)
        if not os.path.exists(r):
            raise FileNotFoundError(r)
    spark.dataSource.register(FolderSource)
    reader = (spark.readStream if stream else spark.read).format(NAME).option("roots", "\n".join(map(os.path.abspath, roots))).option("root", os.path.abspath(root))
    return reader.load() if stream else reader.load().dropDuplicates(["path"])


def is_code(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*CODE_EXTENSIONS)


def too_large(size: Column) -> Column:
    return size > MAX_FILE_BYTES


def is_text(content: Column) -> Column:
    """Not empty, and no NUL among the first bytes."""
    return (F.length(content) > 0) & (F.position(F.lit(b"\x00"), F.substring(content, 1, SNIFF_BYTES)) == 0)


def ingest_filter(files: DataFrame, include_code: bool = False) -> DataFrame:
    """files (path, size, content binary) with verdict: excluded (code), skipped (size or binary) or indexed."""
    code = F.lit(False) if include_code else is_code(F.col("path"))
    verdict = F.when(code, "excluded").when(too_large(F.col("size")), "skipped").when(~F.coalesce(is_text(F.col("content")), F.lit(False)), "skipped").otherwise("indexed")
    return files.withColumn("verdict", verdict)


def convert(argv: list[str], file: str, seconds: float = CONVERT_SECONDS) -> tuple[str | None, str | None]:
    """What the converter writes for a file (None if it fails or takes too long), and to its standard error; {input} in its arguments is the file, a name of BUILT_IN stands for a converter of our own."""
    if argv[0] in BUILT_IN:
        try:
            return BUILT_IN[argv[0]](Path(file).read_bytes()), None
        except OSError as e:
            return None, str(e)
    try:
        done = subprocess.run([argv[0], *[a.replace("{input}", file) for a in argv[1:]]], capture_output=True, timeout=seconds)
    except subprocess.TimeoutExpired as e:
        return None, ((e.stderr or b"").decode("utf-8", "replace") + f"stopped after {seconds} s").strip()
    except OSError as e:
        return None, str(e)
    said = done.stderr.decode("utf-8", "replace").strip()
    if done.returncode:
        return None, said or f"exit code {done.returncode}"
    return done.stdout.decode("utf-8", "replace"), said or None


def read_files(files: DataFrame, config: Config | None = None, include_code: bool = False) -> DataFrame:
    """path, content, mtime, source_hash, verdict, note of listed files, read by the executors.

    Files with a converter are converted, whatever their size; their hash is
    that of the source bytes, and those whose hash is known (a column of files) are not converted
    again (content null).  A converter that fails skips its file alone; what it
    writes to its standard error is the note.
    """
    settings = config or Config()
    code = () if include_code else CODE_EXTENSIONS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            rows = []
            for path, file, mtime, size, known in b[["path", "file", "mtime", "size", "known"]].itertuples(index=False):
                ext = extension(path)
                content = digest = note = None
                verdict = "indexed"
                if ext in code:
                    verdict = "excluded"
                elif argv := settings.converter_for(ext):
                    with open(file, "rb") as f:
                        digest = hashlib.sha256(b"v4\0" + f.read()).hexdigest()
                    if known != digest:
                        content, note = convert(argv, file)
                        verdict = "skipped" if content is None else verdict
                elif size > MAX_FILE_BYTES:
                    verdict = "skipped"
                else:
                    with open(file, "rb") as f:
                        raw = f.read()
                    if not raw or b"\0" in raw[:SNIFF_BYTES]:
                        verdict = "skipped"
                    else:
                        content = raw.decode("utf-8", "replace")
                rows.append((path, content, mtime, digest, verdict, note))
            yield pd.DataFrame(rows, columns=["path", "content", "mtime", "source_hash", "verdict", "note"])

    known = F.col("known") if "known" in files.columns else F.lit(None).cast("string").alias("known")
    out = files.select("path", "file", "mtime", "size", known).mapInPandas(run, "path string, content string, mtime long, source_hash string, verdict string, note string")
    return out.withColumn("source_hash", F.coalesce("source_hash", content_hash(F.col("content"))))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id, query, doc, para of a JSONL file; ValueError with the line number of a bad line."""
    rows = []
    with open(path, encoding="utf-8") as f:
        for n, line in enumerate(f, 1):
            if not line.strip():
                continue
            try:
                x = json.loads(line)
                query, doc, para = x.get("query"), x.get("doc"), x.get("para")
            except (ValueError, AttributeError) as e:
                raise ValueError(f"{path}:{n}: {e}") from e
            if not query or not doc:
                raise ValueError(f"{path}:{n}: query and doc are both needed")
            rows.append((len(rows), query, doc, para))
    if not rows:
        raise ValueError(f"{path}: no cases")
    return spark.createDataFrame(rows, "case_id long, query string, doc string, para int")


def add_file(root: str, key: str, content: str, tags: list[str] | None = None) -> str:
    """Write a new file of the workspace, under a frontmatter block with the tags; the path.  An existing one is refused."""
    rel = normalize_path(os.path.join(root, key), root)
    at = Path(root, rel)
    if at.exists():
        raise FileExistsError(str(at))
    if not content:
        raise ValueError("nothing to add")
    if tags and not content.startswith("---"):
        content = f"---\ntags: [{', '.join(tags)}]\n---\n{content}"
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(content)
    return str(at)
