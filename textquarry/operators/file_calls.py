"""Calls that read, create and edit files, each seeing what the calls before it did.

What a call finds at its path is told by facts per path: was there a file or a directory at the start, and which call made one first. Only the contents
of edited files need a fold: the calls of one path in order, as a native ``aggregate``. Paths are folded side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from textquarry.functions.paths import escapes_workspace, traversal_error, workspace_path
from textquarry.functions.text import count_occurrences
from textquarry.operators.mutations import directories
from textquarry.session import stored

READ, CREATE, EDIT = "read_file", "create_file", "edit_file"
FIELDS = ("call_id", "seq", "tool", "path", "content", "old_str", "new_str")
# A path with more calls, or more bytes of answers, is folded by a sorted stream, which holds one file and one batch.
FOLD_CALLS, FOLD_BYTES = 512, 32 * 1024 * 1024


@dataclass
class Done:
    """``answers``: call_id, tool, content, error. ``contents``: path, content of every file made or changed."""

    answers: DataFrame
    contents: DataFrame


def _said(template: str, *columns: str | Column) -> Column:
    return F.format_string(template, *columns)


def _rejection() -> Column:
    """What is wrong with a call before any file is looked at."""
    tool, path = F.col("tool"), F.col("path")
    return (F.when((tool == EDIT) & ((path == "") | (F.col("old_str") == "")), F.lit(f"path and old_str are required for {EDIT}"))
            .when(path == "", F.concat(F.lit("path is required for "), tool))
            .when(escapes_workspace(path), traversal_error(path)))


def _turn() -> Column:
    """Order of the calls: by seq; of one seq reads come first, then creates, then edits, each by call_id."""
    place = F.when(F.col("tool") == READ, 0).when(F.col("tool") == CREATE, 1).otherwise(2)
    return F.struct("seq", place.alias("place"), "call_id")


def _ancestors(key: Column) -> Column:
    """The directories above a path, the root left out."""
    parts = F.split(key, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                       lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, F.lit(1), n), "/")))


def _facts(valid: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per path that calls or their files' directories name: ``is_file``, ``is_dir`` at the start, ``born``, the call that made the file, and
    ``below``, the first call that made a file under the path. And the keys of created files.

    The first create on a path wins, unless a file was made below it before (it is a directory then) or above it (it can have no directory). Only
    the first call below and those above that no call below precedes need to be looked at: any other is refused for their sake.
    """
    start = files.select(F.col("path").alias("key"), F.lit(True).alias("is_file"))
    folders = directories(files)
    taken = start.select("key").unionByName(folders.select("key"))
    firsts = (valid.filter(F.col("tool") == CREATE).filter("key <> '.'").groupBy("key").agg(F.min("turn").alias("first"))
              .join(taken, "key", "left_anti"))
    above = firsts.select("key", "first", F.explode(_ancestors(F.col("key"))).alias("parent")).filter("parent is not null")
    below = above.groupBy(F.col("parent").alias("key")).agg(F.min("first").alias("below"))
    standing = firsts.join(below, "key", "left").filter("below is null or first < below").select(
        F.col("key").alias("parent"), F.col("first").alias("stands"))
    over = above.join(standing, "parent").filter("stands < first").select("key").unionByName(
        above.join(start.select(F.col("key").alias("parent")), "parent", "left_semi").select("key"))
    blocked = over.distinct().withColumn("blocked", F.lit(True))
    born = (firsts.join(below, "key", "left").join(blocked, "key", "left").filter("blocked is null and (below is null or first < below)")
            .select("key", F.col("first").alias("born")))
    made_folders = born.select("born", F.explode(_ancestors(F.col("key"))).alias("key")).groupBy("key").agg(F.min("born").alias("below"))
    facts = valid.select("key").distinct()
    for part in (start, folders, made_folders, born):
        facts = facts.join(part, "key", "left")
    return facts, born


def _count_and_replace(content: Column, event: Column) -> tuple[Column, Column]:
    n = count_occurrences(content, event["old_str"])
    return n, F.when(n == 1, F.replace(content, event["old_str"], event["new_str"])).otherwise(content)


def _aggregated(paths: DataFrame, events: DataFrame) -> DataFrame:
    """Fold each path's calls over its content: key, content after them, and the calls with matches and content seen."""
    ordered = events.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("turn", "tool", "old_str", "new_str"))).alias("events"))
    found = "array<struct<call_id:string,n:bigint,seen:string>>"

    def step(state: Column, event: Column) -> Column:
        is_edit = event["tool"] == EDIT
        n, after = _count_and_replace(state["content"], event)
        row = F.struct(event["turn"]["call_id"].alias("call_id"), F.when(is_edit, n).alias("n"),
                       F.when(~is_edit, state["content"]).alias("seen"))
        return F.struct(F.when(is_edit, after).otherwise(state["content"]).alias("content"),
                        (state["changed"] | F.coalesce(is_edit & (n == 1), F.lit(False))).alias("changed"),
                        F.concat(state["found"], F.array(row)).cast(found).alias("found"))

    begin = F.struct(F.col("content").cast("string").alias("content"), F.lit(False).alias("changed"), F.array().cast(found).alias("found"))
    return paths.join(ordered, "key").select("key", F.aggregate("events", begin, step).alias("end"))


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same over rows sorted by path and turn, the file before its calls; a row per call and one per changed file."""
    key, content, changed = None, b"", False

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["call_id", "key", "n", "seen"]).astype({"n": "Int64"})

    for batch in batches:
        out: list[tuple] = []
        held = 0
        for row in batch.itertuples(index=False):
            if row.tool is None:
                if changed:
                    out.append((None, key, None, content))
                key, content, changed = row.key, row.content, False
            elif row.tool == READ:
                out.append((row.call_id, row.key, None, content))
                held += len(content)
            else:
                old = row.old_str.encode()
                n = content.count(old)
                if n == 1:
                    content, changed = content.replace(old, row.new_str.encode(), 1), True
                out.append((row.call_id, row.key, n, None))
            if held > FOLD_BYTES:
                yield frame(out)
                out, held = [], 0
        if out:
            yield frame(out)
    if changed:
        yield frame([(None, key, None, content)])


def _folded(paths: DataFrame, events: DataFrame, fold_calls: int, fold_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Calls on files (call_id, n, seen) and files changed (key, content). ``paths``: key, content, n_calls, n_edits."""
    still = paths.filter("n_edits = 0")
    looked = events.join(still.select("key", "content"), "key").select("call_id", F.lit(None).cast("long").alias("n"), F.col("content").alias("seen"))
    moving = paths.filter("n_edits > 0").withColumn(
        "short", (F.col("n_calls") <= fold_calls) & (F.col("n_calls") * F.octet_length("content") <= fold_bytes))
    short, long = moving.filter("short"), moving.filter("not short")
    ends = stored(_aggregated(short, events.join(short.select("key"), "key", "left_semi")), "folded")
    answered = ends.select(F.inline("end.found")).select("call_id", "n", F.col("seen").cast("binary").alias("seen"))
    changed = ends.filter("end.changed").select("key", F.col("end.content").cast("binary").alias("content"))

    nothing = F.lit(None).cast("string")
    rows = events.join(long.select("key"), "key", "left_semi").select(
        "key", "turn", "tool", "call_id", "old_str", "new_str", F.lit(None).cast("binary").alias("content"))
    first = long.select("key", F.lit(None).cast(dict(events.dtypes)["turn"]).alias("turn"), nothing.alias("tool"), nothing.alias("call_id"),
                        nothing.alias("old_str"), nothing.alias("new_str"), "content")
    # Hashed once more, so that the union of equally partitioned sides cannot stand in for this shuffle.
    stream = rows.unionByName(first).repartition(F.xxhash64("key")).sortWithinPartitions("key", "turn").drop("turn")
    out = stored(stream.mapInPandas(_streamed, "call_id string, key string, n long, seen binary"), "streamed")
    answered = answered.unionByName(out.filter("call_id is not null").select("call_id", "n", "seen"))
    changed = changed.unionByName(out.filter("call_id is null").select("key", F.col("seen").alias("content")))
    return looked.unionByName(answered), changed


def run(calls: DataFrame, files: DataFrame, fold_calls: int = FOLD_CALLS, fold_bytes: int = FOLD_BYTES) -> Done:
    """Answer file calls in the order of ``_turn``, each seeing the files as the calls before it left them.

    ``calls``: ``FIELDS``, call_id unique; fields a tool does not use may be null. ``files``: FILE rows at the start. A read answers the content,
    the others a message. Every call is answered once.

    A path with many calls or long answers (``fold_calls``, ``fold_bytes``) is folded by a sorted stream in one task, since its edits depend on each
    other; it holds one file and one batch. Other calls of such a path, and files that no one edits, meet their facts by joins.
    """
    every = stored(calls.select(*FIELDS).withColumns({
        "key": workspace_path(F.col("path")), "rejected": _rejection(), "turn": _turn()}), "calls")
    rejected = every.filter("rejected is not null").select("call_id", "tool", F.lit(None).cast("string").alias("content"), F.col("rejected").alias("error"))
    valid = every.filter("rejected is null")
    facts, born = _facts(valid, files)
    tool, is_born = F.col("tool"), F.coalesce(F.col("turn") == F.col("born"), F.lit(False))
    has_file = F.coalesce(F.col("is_file"), F.col("born") < F.col("turn"), F.lit(False))
    has_dir = F.coalesce(F.col("is_dir"), F.col("below") < F.col("turn"), F.lit(False)) | (F.col("key") == ".")
    met = stored(valid.join(facts, "key", "left").withColumns({"is_born": is_born, "has_file": has_file, "has_dir": has_dir}).drop(
        "is_file", "is_dir", "below", "born", "rejected"), "met")
    error = (
        F.when((tool == CREATE) & F.col("is_born"), F.lit(None))
        .when((tool == CREATE) & (F.col("has_file") | F.col("has_dir")), _said("file already exists at path '%s'", "path"))
        .when(tool == CREATE, _said("failed to create parent directory for '%s'", "path"))
        .when(F.col("has_file"), F.lit(None))
        .when(F.col("has_dir"), F.when(tool == READ, _said("path '%s' is a directory, not a file", "path"))
              .otherwise(_said("path '%s' is a directory, cannot edit", "path")))
        .otherwise(_said("file not found at path '%s' within workspace", "path")))
    judged = met.withColumn("error", error)

    made = met.filter((tool == CREATE) & F.col("is_born")).select("key", F.coalesce("content", F.lit("")).cast("binary").alias("content"))
    events = judged.filter((tool != CREATE) & F.col("error").isNull())
    asked = events.groupBy("key").agg(F.count("*").alias("n_calls"), F.sum((tool == EDIT).cast("long")).alias("n_edits"))
    begin = files.select(F.col("path").alias("key"), "content").unionByName(made)
    paths = stored(begin.join(asked, "key"), "paths")
    found, changed = _folded(paths, events.drop("content"), fold_calls, fold_bytes)

    matches = (F.when(F.col("n") == 0, _said("string '%s' not found in file '%s'", "old_str", "path"))
               .when(F.col("n") > 1, _said("string '%s' found multiple times (%d) in file '%s', expected exactly one", "old_str", "n", "path")))
    edited = events.filter(tool == EDIT).join(found.select("call_id", "n"), "call_id").select(
        "call_id", "tool", F.when(matches.isNull(), _said("Successfully edited file '%s'", "path")).alias("content"), matches.alias("error"))
    no_error = F.lit(None).cast("string")
    read = found.filter("n is null").select("call_id", F.lit(READ).alias("tool"), F.make_valid_utf8(F.col("seen").cast("string")).alias("content"), no_error.alias("error"))
    others = judged.filter((tool == CREATE) | F.col("error").isNotNull()).select(
        "call_id", "tool", F.when(F.col("error").isNull(), _said("Successfully created file '%s'", "path")).alias("content"), "error")
    answers = rejected.unionByName(others).unionByName(edited).unionByName(read)
    contents = made.join(changed.select("key"), "key", "left_anti").unionByName(changed).withColumnRenamed("key", "path")
    return Done(answers, contents)


def apply(files: DataFrame, contents: DataFrame) -> DataFrame:
    """The file table with made and changed files put in."""
    new = contents.select("path", F.octet_length("content").cast("long").alias("length"), "content")
    return files.select("path", "length", "content").join(contents.select("path"), "path", "left_anti").unionByName(new)
