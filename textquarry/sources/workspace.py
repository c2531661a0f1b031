"""Directory trees on a file system all workers share, hidden files included.

``binaryFile`` skips names starting with a dot or underscore; these functions
do not. Directories are listed by tasks, level by level, so the driver holds no
listing; file contents are read after an even redistribution of the paths.
For object stores use ``spark.read.format('binaryFile')``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from textquarry.functions.text import MAX_FILE_BYTES
from textquarry.session import cut_lineage

LISTING_ROWS = 10_000
READ_BYTES = 64 * 1024 * 1024


def shared_folder(root: str) -> str:
    """A plain absolute path; other file systems are not readable this way."""
    root = root.removeprefix("file://").removeprefix("file:")
    if "://" in root:
        raise ValueError(f"{root} is not on a mounted file system; read it with binaryFile")
    return os.path.abspath(root)


def _list_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    # An unreadable directory raises and so stops the scan.
    def rows(root: str, rel: str):
        with os.scandir(os.path.join(root, rel)) as entries:
            for entry in entries:
                path = f"{rel}/{entry.name}" if rel else entry.name
                is_dir = entry.is_dir(follow_symlinks=False)
                try:
                    length = 0 if is_dir else entry.stat().st_size
                except OSError:  # a dangling link: reading it will say so in its row
                    length = 0
                yield root, path, is_dir, length

    names = ["root", "path", "is_dir", "length"]
    for batch in batches:
        for root, rel in zip(batch["root"], batch["path"]):
            chunk = []
            for row in rows(root, rel):
                chunk.append(row)
                if len(chunk) == LISTING_ROWS:
                    yield pd.DataFrame(chunk, columns=names)
                    chunk = []
            if chunk:
                yield pd.DataFrame(chunk, columns=names)


def list_workspace(spark: SparkSession, root: str) -> DataFrame:
    """Every non-directory below ``root``: root, path (relative), length."""
    schema = "root string, path string, is_dir boolean, length bigint"
    frontier = spark.createDataFrame([(shared_folder(root), "")], "root string, path string")
    files = None
    while True:
        level = cut_lineage(frontier.mapInPandas(_list_level, schema))
        found = level.filter("not is_dir").drop("is_dir")
        files = found if files is None else files.unionByName(found)
        frontier = level.filter("is_dir").select("root", "path")
        if frontier.isEmpty():
            return files
        frontier = frontier.repartition(spark.sparkContext.defaultParallelism)


def too_large(path: str, most: int) -> str:
    limit = f"{most >> 20}MB" if most >= 1 << 20 else f"{most} bytes"
    return f"file too large (>{limit}): {path}"


def _read_contents(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    names = ["path", "length", "content", "error"]
    for batch in batches:
        out, held = [], 0
        for root, path, length in zip(batch["root"], batch["path"], batch["length"]):
            content = error = None
            if length > most and not path.endswith(".go"):
                error = too_large(path, most)
            else:
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        content = f.read()
                    held += len(content)
                except OSError as e:
                    error = f"failed to read file {path}: {e.strerror}"
            out.append((path, length, content, error))
            if held >= READ_BYTES:
                yield pd.DataFrame(out, columns=names)
                out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)


def read_workspace(spark: SparkSession, root: str, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """FILE rows plus ``error``: a file that cannot be used, or is larger than ``max_file_bytes``, has an error and no content. Its rows go into
    ``snippets``, ``file_errors`` and ``index_summary`` as they are."""
    listed = list_workspace(spark, root).repartition(spark.sparkContext.defaultParallelism)
    return listed.mapInPandas(lambda batches: _read_contents(batches, max_file_bytes), "path string, length bigint, content binary, error string")


def write_workspace(files: DataFrame, root: str) -> DataFrame:
    """Write FILE rows below ``root``, creating parents; returns path and bytes written.

    Each file appears under its name in one step, so a retried task does no harm.
    Lazy, like any transformation: an action on the result writes the files.
    """
    root = shared_folder(root)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, target)
            yield pd.DataFrame({"path": batch["path"], "bytes": batch["content"].map(len)})

    return files.select("path", "content").mapInPandas(write, "path string, bytes bigint")


def workspace_files(files: DataFrame) -> DataFrame:
    """Usable rows of ``read_workspace``."""
    return files.filter(F.col("error").isNull()).drop("error")
