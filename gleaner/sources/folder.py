"""Folders as a data source: files are listed by the executors, and read as a table or as a stream of changes."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "gleaner_files"
SCHEMA = "path string, file string, mtime long, size long"
#: Levels of folders that the driver looks at to make partitions; what lies below, it does not.
DEPTH = 2
#: Seconds that a stream stays behind the clock, so that files of a second that isn't over are not cut in two.
BEHIND = 2


class Folder(InputPartition):
    """A file, the files of a folder, or (whole) all below it."""

    def __init__(self, at: str, whole: bool, after: int | None = None, until: int | None = None) -> None:
        self.at, self.whole, self.after, self.until = at, whole, after, until


def _abort(e: OSError) -> None:
    raise e


def _folders(roots: list[str], depth: int) -> Iterator[tuple[str, bool]]:
    level = [r for r in roots if not os.path.isfile(r)]
    yield from ((r, False) for r in roots if os.path.isfile(r))
    for d in range(depth + 1):
        below = []
        for at in level:
            yield at, d == depth
            if d < depth:
                with os.scandir(at) as entries:
                    below += sorted(e.path for e in entries if not e.name.startswith(".") and e.is_dir(follow_symlinks=False))
        level = below


def _files(at: str, whole: bool) -> Iterator[str]:
    if os.path.isfile(at):
        yield at
        return
    for d, dirs, names in os.walk(at, onerror=_abort):
        dirs[:] = sorted(x for x in dirs if whole and not x.startswith("."))
        yield from (os.path.join(d, n) for n in sorted(names))


class _Read:
    def __init__(self, options: dict[str, str]) -> None:
        self.roots = options["roots"].split("\n")
        self.root = os.path.abspath(options.get("root", "."))
        self.depth = int(options.get("depth", DEPTH))

    def rows(self, p: Folder) -> Iterator[tuple]:
        for f in _files(p.at, p.whole):
            try:
                st = os.stat(f)
            except FileNotFoundError:  # a link to nothing, or removed meanwhile
                continue
            mtime = int(st.st_mtime)
            if (p.after is None or mtime > p.after) and (p.until is None or mtime <= p.until):
                yield os.path.relpath(os.path.abspath(f), self.root).replace(os.sep, "/"), os.path.abspath(f), mtime, st.st_size


class FolderReader(_Read, DataSourceReader):
    def partitions(self) -> list[Folder]:
        return [Folder(at, whole) for at, whole in _folders(self.roots, self.depth)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self.rows(partition)


class FolderStream(_Read, DataSourceStreamReader):
    """Files by the second in which they were changed: an offset is a second, a batch the files changed after one and up to another."""

    def initialOffset(self) -> dict:
        return {"second": -1}

    def latestOffset(self) -> dict:
        return {"second": int(time.time()) - BEHIND}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return [Folder(at, whole, start["second"], end["second"]) for at, whole in _folders(self.roots, self.depth)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class FolderSource(DataSource):
    """Options: roots (files and folders, one a line), root (keys are relative to it), depth."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(self.options)
