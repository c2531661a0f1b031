"""Requests against a file table: read, list, create, edit.

``files`` is FILE-shaped (``path`` cleaned and relative, ``content`` binary).
Requests carry a unique ``seq`` and a raw ``path``. Results carry ``error``,
null where the request succeeded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from textquarry.functions.paths import clean_path, escapes_workspace, traversal_error, workspace_path
from textquarry.functions.text import count_occurrences


def _keyed(requests: DataFrame) -> DataFrame:
    return requests.withColumn("key", workspace_path(F.col("path")))


def _said(template: str, *columns: str | Column) -> Column:
    return F.format_string(template, *columns)


def _entries(files: DataFrame) -> DataFrame:
    """Every (parent, name) of the tree, one row for each file below it."""
    parts = F.split("path", "/")
    depth = F.size(parts)
    row = lambda i: F.struct(
        F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("parent"),
        F.get(parts, i).alias("name"), (i < depth - 1).alias("is_dir"))
    return files.select(F.inline(F.transform(F.sequence(F.lit(0), depth - 1), row)))


def directories(files: DataFrame) -> DataFrame:
    """Distinct directories that hold a file at any depth, '.' included."""
    return _entries(files).select(F.col("parent").alias("key")).distinct().withColumn("is_dir", F.lit(True))


def directory_entries(files: DataFrame, asked: DataFrame) -> DataFrame:
    """Distinct immediate children of the ``asked`` directories (key): key, name, is_dir."""
    of_asked = _entries(files).withColumnRenamed("parent", "key").join(asked.select("key"), "key", "left_semi")
    return of_asked.groupBy("key", "name").agg(F.max("is_dir").alias("is_dir"))


def _rejection(tool: str) -> Column:
    """What is wrong with a request's path before any file is looked at. Rejected requests share few keys, so they are
    answered before the joins."""
    return (F.when(F.col("path") == "", F.lit(f"path is required for {tool}"))
            .when(escapes_workspace(F.col("path")), traversal_error(F.col("path"))))


def read_files(requests: DataFrame, files: DataFrame) -> DataFrame:
    """``requests``: seq, path. Adds content and error."""
    found = files.select(F.col("path").alias("key"), "content")
    asked = _keyed(requests).withColumn("rejected", _rejection("read_file"))
    error = (
        F.when(F.col("is_dir"), _said("path '%s' is a directory, not a file", "path"))
        .when(F.col("content").isNull(), _said("file not found at path '%s' within workspace", "path")))
    looked = (asked.filter("rejected is null").join(found, "key", "left").join(directories(files), "key", "left")
              .withColumn("error", error))
    return looked.select(*requests.columns, F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error").unionByName(
        asked.filter("rejected is not null").select(
            *requests.columns, F.lit(None).cast("binary").alias("content"), F.col("rejected").alias("error")))


def list_dir(requests: DataFrame, files: DataFrame) -> DataFrame:
    """``requests``: seq, path ('' is the root). One row per entry, or one row with an error."""
    every = _keyed(requests.withColumn("path", F.when(F.col("path") == "", F.lit(".")).otherwise(F.col("path"))))
    every = every.withColumn("rejected", _rejection("list_files"))
    asked = every.filter("rejected is null")
    names = files.select(F.col("path").alias("key"), F.lit(True).alias("is_file"))
    entries = directory_entries(files, asked)
    error = (
        F.when(F.col("is_file"), _said("path '%s' is not a directory", "path"))
        .when(F.col("name").isNull() & (F.col("key") != "."),
              _said("directory not found at path '%s' within workspace", "path")))
    out = asked.join(entries, "key", "left").join(names, "key", "left").withColumn("error", error)
    entry = F.when(F.col("error").isNull(), clean_path(F.concat("path", F.lit("/"), "name")))
    return out.select("seq", entry.alias("entry"), "is_dir", "error").unionByName(
        every.filter("rejected is not null").select(
            "seq", F.lit(None).cast("string").alias("entry"), F.lit(None).cast("boolean").alias("is_dir"),
            F.col("rejected").alias("error")))


def create_files(creates: DataFrame, files: DataFrame) -> DataFrame:
    """``creates``: seq, path, content (string). The first seq on a free path wins.

    Adds key, error and message.
    """
    asked = _keyed(creates)
    taken = (files.select(F.col("path").alias("key")).unionByName(directories(files).select("key"))
             .withColumn("taken", F.lit(True)))
    # Rejected requests share a key and so stay out of the joins; of equal seq the lower call, then content, comes first.
    asked = asked.withColumn("invalid", _rejection("create_file"))
    tie = [c for c in ("call_id", "content") if c in creates.columns]
    first = Window.partitionBy("key").orderBy("seq", *tie)
    valid = asked.filter("invalid is null").withColumn("nth", F.row_number().over(first)).join(taken, "key", "left")
    exists = F.coalesce("taken", F.lit(False)) | (F.col("nth") > 1) | (F.col("key") == ".")
    valid = valid.withColumn("error", F.when(exists, _said("file already exists at path '%s'", "path")))
    columns = [*creates.columns, "key", "error"]
    judged = valid.select(*columns).unionByName(
        asked.filter("invalid is not null").withColumn("error", F.col("invalid")).select(*columns))
    return (judged.withColumn("message", F.coalesce("error", _said("Successfully created file '%s'", "path")))
            .select(*creates.columns, "key", "error", "message"))


def apply_creates(files: DataFrame, created: DataFrame) -> DataFrame:
    """The file table with the successful creates added."""
    body = F.coalesce("content", F.lit("")).cast("binary")
    new = created.filter("error is null").select(
        F.col("key").alias("path"), F.octet_length(body).cast("long").alias("length"), body.alias("content"))
    return files.unionByName(new)


_EDIT_FIELDS = "seq", "path", "old_str", "new_str"


def _rejected_edit() -> Column:
    """What is wrong with an edit before any file is looked at."""
    return (
        F.when((F.col("path") == "") | (F.col("old_str") == ""), F.lit("path and old_str are required for edit_file"))
        .when(escapes_workspace(F.col("path")), traversal_error(F.col("path"))))


def _not_a_file(missing: Column) -> Column:
    return (F.when(F.col("is_dir"), _said("path '%s' is a directory, cannot edit", "path"))
            .when(missing, _said("file not found at path '%s' within workspace", "path")))


def edit_once(edits: DataFrame, files: DataFrame) -> DataFrame:
    """Exactly-once replacement, at most one edit per file in the batch.

    Adds key, new content (null on error), error and message.
    """
    found = files.select(F.col("path").alias("key"), "content")
    every = _keyed(edits.select(*_EDIT_FIELDS)).withColumn("rejected", _rejected_edit())
    asked = (every.filter("rejected is null").join(found, "key", "left").join(directories(files), "key", "left"))
    text = F.col("content").cast("string")
    counted = asked.withColumn("n", count_occurrences(text, F.col("old_str")))
    error = F.coalesce(
        _not_a_file(F.col("content").isNull()),
        F.when(F.col("n") == 0, _said("string '%s' not found in file '%s'", "old_str", "path")),
        F.when(F.col("n") > 1, _said(
            "string '%s' found multiple times (%d) in file '%s', expected exactly one", "old_str", "n", "path")))
    replaced = F.replace(text, F.col("old_str"), F.col("new_str")).cast("binary")
    judged = counted.withColumn("error", error).select(
        *_EDIT_FIELDS, "key", F.when(F.col("error").isNull(), replaced).alias("content"), "error")
    rejected = every.filter("rejected is not null").select(
        *_EDIT_FIELDS, "key", F.lit(None).cast("binary").alias("content"), F.col("rejected").alias("error"))
    return judged.unionByName(rejected).withColumn(
        "message", F.coalesce("error", _said("Successfully edited file '%s'", "path")))


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Apply edits in order; rows arrive sorted by key, the file itself before its edits."""
    key, content, changed = None, None, False

    def apply(edit) -> str | None:
        nonlocal content, changed
        old, n = edit.old_str.encode(), content.count(edit.old_str.encode())
        if n == 0:
            return f"string '{edit.old_str}' not found in file '{edit.path}'"
        if n > 1:
            return (f"string '{edit.old_str}' found multiple times ({n}) in file '{edit.path}',"
                    " expected exactly one")
        content, changed = content.replace(old, edit.new_str.encode(), 1), True
        return None

    columns = ["seq", "call_id", "key", "content", "error"]
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.is_file:
                if changed:
                    out.append((None, None, key, content, None))
                key, content, changed = row.key, row.content, False
            else:
                out.append((row.seq, row.call_id, row.key, None, row.error or apply(row)))
        if out:
            yield pd.DataFrame(out, columns=columns).astype({"seq": "Int64"})
    if changed:
        yield pd.DataFrame([(None, None, key, content, None)], columns=columns).astype({"seq": "Int64"})


def edit_sequence(edits: DataFrame, files: DataFrame) -> DataFrame:
    """Any number of edits per file, applied in seq order, each seeing the ones before.

    Edits of one file depend on each other and so share a task, but they stream
    through it sorted: memory holds one file and one batch, however many edits
    there are. ``call_id`` is carried along if the edits have one. Returns one
    row per edit (seq, call_id, key, null, error) and one row per changed file
    (null, null, key, final content, null).
    """
    call_id = F.col("call_id") if "call_id" in edits.columns else F.lit(None).cast("string")
    every = _keyed(edits.select(*_EDIT_FIELDS, call_id.alias("call_id"))).withColumn("rejected", _rejected_edit())
    valid = every.filter("rejected is null").drop("rejected")
    names = files.select(F.col("path").alias("key"), F.lit(True).alias("exists"))
    asked = (valid.join(directories(files), "key", "left").join(names, "key", "left")
             .select("key", *_EDIT_FIELDS, "call_id", _not_a_file(F.col("exists").isNull()).alias("error"),
                     F.lit(None).cast("binary").alias("content"), F.lit(False).alias("is_file")))
    wanted = valid.select(F.col("key").alias("path")).distinct()
    nothing = F.lit(None).cast("string")
    touched = files.join(wanted, "path", "left_semi").select(
        F.col("path").alias("key"), F.lit(None).cast("long").alias("seq"), nothing.alias("path"),
        nothing.alias("old_str"), nothing.alias("new_str"), nothing.alias("call_id"), nothing.alias("error"),
        "content", F.lit(True).alias("is_file"))
    # Hashing the key first makes this shuffle differ from any the two sides may
    # already have; a union of equally partitioned sides would otherwise stand in
    # for it, and adaptive execution may coalesce those sides unequally.
    # An edit that is answered already needs no file and goes anywhere.
    place = F.when(F.col("error").isNull(), F.xxhash64("key")).otherwise(F.xxhash64("seq", "call_id"))
    stream = (touched.unionByName(asked).repartition(place)
              .sortWithinPartitions("key", F.desc("is_file"), "seq", "call_id"))
    folded = stream.mapInPandas(_fold, "seq bigint, call_id string, key string, content binary, error string")
    return folded.unionByName(every.filter("rejected is not null").select(
        F.col("seq").cast("long").alias("seq"), "call_id", "key", F.lit(None).cast("binary").alias("content"),
        F.col("rejected").alias("error")))


def apply_edits(files: DataFrame, edited: DataFrame) -> DataFrame:
    """The file table with final contents put in; ``edited`` has at most one content per key."""
    new = edited.filter("content is not null").select(F.col("key").alias("path"), F.col("content").alias("edited"))
    content = F.coalesce("edited", "content")
    return files.join(new, "path", "left").select(
        "path", F.octet_length(content).cast("long").alias("length"), content.alias("content"))
