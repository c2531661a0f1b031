"""``spark.read.format("workspace")``: a directory tree on a file system all workers share, hidden files included.

The driver lists directories and counts their files; tasks list again what is theirs and read contents. Conditions on path and length
are met before a file is opened. Columns and errors are those of ``read_workspace``.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith)

from textquarry.functions.text import MAX_FILE_BYTES
from textquarry.sources.workspace import READ_BYTES, shared_folder, too_large

SCHEMA = "path string, length bigint, content binary, error string"
# Files that one task reads, about.
FILES = 2_000

_TESTS = {
    EqualTo: lambda x, v: x == v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v, In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x}


class Share(InputPartition):
    """Directories of one task as (relative path, part, parts): of a large directory the files whose name falls into the part."""

    def __init__(self, folders: list[tuple[str, int, int]], after: int = -1, upto: int | None = None):
        super().__init__(None)
        self.folders, self.after, self.upto = folders, after, upto


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with conditions handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkspaceSource)


class WorkspaceSource(DataSource):
    """Options: ``path``, the root; ``maxFileBytes``, beyond which a file other than Go source has an error and no content; ``contents``, "false" for a
    listing. As a stream, every micro-batch holds the files changed since the last one, by modification time."""

    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WorkspaceReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return WorkspaceStream(dict(self.options))


class _Tree:
    def __init__(self, options: dict[str, str]):
        named = {k.lower(): v for k, v in options.items()}
        if "path" not in named:
            raise ValueError("the workspace format needs a path")
        self.root = shared_folder(named["path"])
        self.most = int(named.get("maxfilebytes", MAX_FILE_BYTES))
        self.contents = named.get("contents", "true").lower() != "false"
        self.tests: list[tuple[str, type, object]] = []

    def take(self, condition: Filter) -> bool:
        """Take over a condition on path or length, if it is one that ``_TESTS`` knows."""
        column = getattr(condition, "attribute", None)
        if column not in (("path",), ("length",)):
            return False
        if isinstance(condition, IsNotNull):  # neither is ever null
            return True
        if type(condition) not in _TESTS:
            return False
        self.tests.append((column[0], type(condition), condition.value))
        return True

    def wanted(self, path: str, length: int) -> bool:
        at = {"path": path, "length": length}
        return all(_TESTS[kind](at[column], value) for column, kind, value in self.tests)

    def may_hold(self, folder: str) -> bool:
        """Whether a path below the folder can meet the conditions on the path's start."""
        below = f"{folder}/" if folder else ""
        starts = [(v, kind) for c, kind, v in self.tests if c == "path" and kind in (StringStartsWith, EqualTo)]
        return all(v.startswith(below) or kind is StringStartsWith and below.startswith(v) for v, kind in starts)

    def folders(self) -> Iterator[tuple[str, int, int]]:
        """(relative path, files, latest change in nanoseconds) of every directory. One that cannot be listed ends the job."""
        waiting = [""]
        while waiting:
            folder = waiting.pop()
            files = latest = 0
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for entry in entries:
                    path = f"{folder}/{entry.name}" if folder else entry.name
                    if entry.is_dir(follow_symlinks=False):
                        if self.may_hold(path):
                            waiting.append(path)
                    else:
                        files += 1
                        latest = max(latest, _changed(entry))
            yield folder, files, latest

    def shares(self, folders: Iterable[tuple[str, int, int]], after: int = -1, upto: int | None = None) -> list[Share]:
        """Tasks of about FILES files: small directories together, large ones in parts."""
        out, held, n = [], [], 0
        for folder, files, _ in sorted(folders):
            if files > FILES:
                parts = -(-files // FILES)
                out += [Share([(folder, part, parts)], after, upto) for part in range(parts)]
            elif files:
                held.append((folder, 0, 1))
                n += files
                if n >= FILES:
                    out.append(Share(held, after, upto))
                    held, n = [], 0
        return out + ([Share(held, after, upto)] if held else [])

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for folder, part, parts in share.folders:
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for entry in entries:
                    if entry.is_dir(follow_symlinks=False) or parts > 1 and zlib.crc32(os.fsencode(entry.name)) % parts != part:
                        continue
                    if share.upto is not None and not share.after < _changed(entry) <= share.upto:
                        continue
                    path = f"{folder}/{entry.name}" if folder else entry.name
                    length = _length(entry)
                    if not self.wanted(path, length):
                        continue
                    content, error = self.open(path, length)
                    rows.append((path, length, content, error))
                    held += len(content or b"") + 100
                    if held >= READ_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    def open(self, path: str, length: int) -> tuple[bytes | None, str | None]:
        if length > self.most and not path.endswith(".go"):
            return None, too_large(path, self.most)
        if not self.contents:
            return None, None
        try:
            with open(os.path.join(self.root, path), "rb") as f:
                return f.read(), None
        except OSError as e:
            return None, f"failed to read file {path}: {e.strerror}"


def _changed(entry: os.DirEntry) -> int:
    try:
        return entry.stat().st_mtime_ns
    except OSError:  # a dangling link
        return entry.stat(follow_symlinks=False).st_mtime_ns


def _length(entry: os.DirEntry) -> int:
    try:
        return entry.stat().st_size
    except OSError:  # a dangling link: reading it will say so in its row
        return 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["path", "length", "content", "error"])


class WorkspaceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.tree = _Tree(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            if not self.tree.take(condition):
                yield condition

    def partitions(self) -> list[Share]:
        return self.tree.shares(self.tree.folders()) or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class WorkspaceStream(DataSourceStreamReader):
    """Offsets are modification times: a file that arrives with an older time than one already seen is not noticed."""

    def __init__(self, options: dict[str, str]):
        self.tree = _Tree(options)

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        return {"changed": max((latest for _, files, latest in self.tree.folders() if files), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        after, upto = start["changed"], end["changed"]
        changed = [f for f in self.tree.folders() if f[2] > after]
        return self.tree.shares(changed, after, upto) or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)
