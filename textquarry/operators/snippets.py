"""Files to snippets: routing, whole-file snippets, declaration spans, statistics."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from textquarry.functions import paths, text
from textquarry.session import stored

Parser = Callable[[DataFrame], DataFrame]

# Patterns for Go code without its strings and comments: a declaration starts in column 0.
GO_START = r"^func[ (]"
GO_TOKEN = r"""\"(?:[^"\\\n]++|\\.)*+"|`[^`]*+`|'(?:[^'\\\n]++|\\.)++'|//[^\n]*+|(?s:/\*.*?\*/)"""
GO_SYMBOL = (r"^func\s*(?:\(\s*(?:[\p{L}_][\p{L}\p{N}_]*\s+)?\*?\s*([\p{L}_][\p{L}\p{N}_]*)(\[[^)]*\])?\s*\)\s*)?"
             r"([\p{L}_][\p{L}\p{N}_]*)")


def with_kind(files: DataFrame, max_file_bytes: int = text.MAX_FILE_BYTES) -> DataFrame:
    """Add ``ext``, ``error`` (null if usable) to FILE rows that take the whole-file way."""
    ext = paths.extension(F.col("path"))
    known = ext.isin(text.TEXT_EXTENSIONS)
    limit = f"{max_file_bytes >> 20}MB" if max_file_bytes >= 1 << 20 else f"{max_file_bytes} bytes"
    error = (
        F.when(F.col("length") > max_file_bytes, F.concat(F.lit(f"file too large (>{limit}): "), "path"))
        .when(~known & text.is_binary(text.binary_profile(F.col("content"))),
              F.concat(F.lit("skipping binary file: "), "path")))
    return files.withColumn("ext", ext).withColumn("error", error)


def _pieces(content: Column, start: str) -> Column:
    """The text from each start line to the next one: array of (n, piece), n the 1-based line."""
    lines = F.transform(F.split(content, "\n"), lambda line, i: F.struct(
        line.rlike(f"^(?:{start})").alias("hit"), (i + 1).cast("long").alias("n")))
    starts = F.transform(F.filter(lines, lambda s: s["hit"]), lambda s: s["n"])
    # A leading newline makes part 0 the text before the first start, always.
    parts = F.split(F.concat(F.lit("\n"), content), f"\n(?={start})")
    return F.arrays_zip(starts.alias("n"), F.slice(parts, F.lit(2), F.size(parts)).alias("piece"))


def _first_end(lines: Column, end: str) -> Column:
    """1-based place of the first line that matches ``end``, 0 if none does."""
    return F.array_position(F.transform(lines, lambda line: line.rlike(end)), True).cast("int")


def split_spans(docs: DataFrame, start: str, end: str) -> DataFrame:
    """Cut each text into line spans, within its row: no shuffle, no window.

    ``docs``: path, text. A span runs from a line matching ``start`` at its
    beginning to the first line matching ``end`` before the next start; an
    unclosed span is dropped. Returns path, start_line, end_line, content.
    """
    span = docs.select("path", F.inline(_pieces(F.col("text"), start))).select(
        "path", F.col("n").alias("start_line"), F.split("piece", "\n").alias("lines"))
    return span.withColumn("size", _first_end(F.col("lines"), end)).filter(F.col("size") > 0).select(
        "path", "start_line", (F.col("start_line") + F.col("size") - 1).alias("end_line"),
        F.array_join(F.slice("lines", F.lit(1), F.col("size")), "\n").alias("content"))


def go_symbol(content: Column) -> Column:
    """``Name`` or ``Receiver.Name``; a generic receiver is left out."""
    part = lambda group: F.regexp_extract(content, GO_SYMBOL, group)
    return F.when((part(1) != "") & (part(2) == ""), F.concat(part(1), F.lit("."), part(3))).otherwise(part(3))


def go_shape(source: Column) -> Column:
    """Go source with strings, runes and comments blanked, line breaks kept."""
    between = F.split(source, GO_TOKEN)
    tokens = F.regexp_extract_all(source, F.lit(GO_TOKEN), F.lit(0))
    blank = lambda token: F.coalesce(F.regexp_replace(token, r"[^\n]", " "), F.lit(""))
    return F.array_join(F.zip_with(between, tokens, lambda code, token: F.concat(code, blank(token))), "")


def _go_broken(shape: Column) -> Column:
    """No package clause, an open string or comment, or brackets that do not balance."""
    count = lambda char: F.regexp_count(shape, F.lit(re.escape(char)))
    return (~shape.rlike(r"^\s*package\s") | shape.rlike("[`\"']") | F.contains(shape, F.lit("/*"))
            | (count("{") != count("}")) | (count("(") != count(")")) | (count("[") != count("]")))


def _closed(depths: Column) -> Column:
    """1-based place where the brackets opened so far are closed again, 0 if they never are."""
    state = lambda place, depth, end: F.struct(place.alias("place"), depth.alias("depth"), end.alias("end"))
    step = lambda s, change: state(s["place"] + 1, s["depth"] + change, F.when(
        (s["end"] == 0) & (s["depth"] + change == 0), s["place"] + 1).otherwise(s["end"]))
    return F.aggregate(depths, state(F.lit(0), F.lit(0), F.lit(0)), step, lambda s: s["end"])


def go_declarations(rows: DataFrame) -> DataFrame:
    """The built-in parser: functions that start in column 0, up to where their brackets are closed, with a body or none.

    A parser takes rows with ``source`` (null for files that are not parsed) and adds ``declarations``: an array of
    (start_line, end_line, content, symbols), null for a file with an error.
    """
    shaped = rows.withColumn("shape", go_shape(F.col("source")))
    lines = shaped.withColumn("lines", F.split("source", "\n")).withColumn(
        "shape", F.when(~_go_broken(F.col("shape")), F.split("shape", "\n")))
    depth = lambda line: F.regexp_count(line, F.lit(r"[({\[]")) - F.regexp_count(line, F.lit(r"[)}\]]"))
    found = lines.withColumn("depths", F.transform("shape", depth)).withColumn("starts", F.filter(
        F.transform("shape", lambda line, i: F.when(line.rlike(GO_START), i + 1)), lambda n: n.isNotNull()))
    upto = lambda i: F.coalesce(F.get("starts", i + 1), F.size("lines") + 1)
    sized = found.withColumn("starts", F.transform("starts", lambda n, i: F.struct(
        n.alias("n"), _closed(F.slice("depths", n, upto(i) - n)).alias("size"))))
    closed = F.filter("starts", lambda s: s["size"] > 0)
    content = lambda s: F.array_join(F.slice("lines", s["n"], s["size"]), "\n")
    return sized.withColumn("declarations", F.transform(closed, lambda s: F.struct(
        s["n"].cast("long").alias("start_line"), (s["n"] + s["size"] - 1).cast("long").alias("end_line"),
        content(s).alias("content"), F.array(go_symbol(content(s))).alias("symbols")))).drop("shape", "lines", "depths", "starts")


def _whole(rows: DataFrame, max_bytes: int, truncate: bool) -> DataFrame:
    """Add ``whole``: the snippets of a file that is not parsed, as (start_line, end_line, content, at), ``at`` the byte.

    A file above ``max_bytes`` goes on in further snippets, cut between characters, so that all snippets together are the
    file. Line numbers add up the line breaks before; that work grows with the square of the number of snippets.
    """
    span = lambda start, content, at: F.struct(
        start.cast("long").alias("start_line"), (start + F.size(F.split(content, "\n")) - 1).cast("long").alias("end_line"),
        content.alias("content"), at.cast("long").alias("at"))
    if truncate:
        only = text.truncated_text(F.col("content"), max_bytes)
        return rows.withColumn("whole", F.array(span(F.lit(1), only, F.lit(0))))
    step = max_bytes - 3
    size = F.octet_length("content")
    inside = lambda at: F.substr("content", at + 1, F.lit(1)).between(F.lit(b"\x80"), F.lit(b"\xbf"))
    moved = lambda at: F.when(at == 0, 0).when(~inside(at), at).when(~inside(at + 1), at + 1).when(
        ~inside(at + 2), at + 2).otherwise(at + 3)
    starts = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / step).cast("int")), lambda i: moved(i * step))
    cut = rows.withColumn("starts", F.when(size <= max_bytes, F.array(F.lit(0))).otherwise(starts))
    piece = lambda at, i: F.substr("content", at + 1, F.coalesce(F.get("starts", i + 1), size) - at)
    cut = cut.withColumn("pieces", F.filter(F.transform("starts", lambda at, i: F.struct(
        at.alias("at"), text.decode_text(piece(at, i)).alias("content"))), lambda p: (p["at"] == 0) | (p["content"] != "")))
    cut = cut.withColumn("breaks", F.transform("pieces", lambda p: F.size(F.split(p["content"], "\n")) - 1))
    first = lambda i: F.aggregate(F.slice("breaks", F.lit(1), i), F.lit(1), lambda total, n: total + n)
    return cut.withColumn("whole", F.transform("pieces", lambda p, i: span(first(i), p["content"], p["at"]))).drop(
        "starts", "pieces", "breaks")


def _parsed(files: DataFrame, parser: Parser, max_file_bytes: int) -> DataFrame:
    """FILE rows with ext, error, is_go and declarations. A file that came with an error of its own, as one that could not be read, keeps it."""
    given = F.lit(None).cast("string")
    if "error" in files.columns:
        given, files = F.col("read_error"), files.withColumnRenamed("error", "read_error")
    kinds = with_kind(files, max_file_bytes).withColumn("is_go", paths.is_go_file(F.col("path")))
    rows = parser(kinds.withColumn("source", F.when(F.col("is_go"), text.decode_text(F.col("content")))))
    broken = F.when(F.col("declarations").isNull(), F.concat(F.lit("failed to parse file: "), "path"))
    return rows.withColumn("error", F.coalesce(given, F.when(F.col("is_go"), broken).otherwise(F.col("error"))))


def _cut(files: DataFrame, parser: Parser, max_bytes: int, truncate: bool, max_file_bytes: int) -> tuple[DataFrame, Column]:
    """Parsed FILE rows, and their snippets as an array, null for files that have none."""
    usable = F.when(~F.col("is_go") & F.col("error").isNull(), F.col("content"))
    rows = _whole(_parsed(files, parser, max_file_bytes).withColumn("content", usable), max_bytes, truncate)
    metadata = F.create_map(F.lit("file_type"), F.regexp_replace("ext", r"^\.", ""),
                            F.lit("file_name"), paths.base_name(F.col("path")))
    declared = F.transform("declarations", lambda d: F.struct(
        d["start_line"].alias("start_line"), d["end_line"].alias("end_line"), d["content"].alias("content"),
        F.lit(0).cast("long").alias("at"), d["symbols"].alias("symbols"), F.lit(None).cast("map<string,string>").alias("metadata")))
    whole = F.transform("whole", lambda w: F.struct(
        w["start_line"].alias("start_line"), w["end_line"].alias("end_line"), w["content"].alias("content"),
        w["at"].alias("at"), F.array().cast("array<string>").alias("symbols"), metadata.alias("metadata")))
    return rows, F.when(F.col("is_go"), declared).otherwise(whole)


def snippets(files: DataFrame, parser: Parser = go_declarations, max_bytes: int = text.MAX_SNIPPET_BYTES,
             truncate: bool = False, max_file_bytes: int = text.MAX_FILE_BYTES) -> DataFrame:
    """FILE rows to SNIPPET rows in one scan: Go files by declaration, all others whole.

    A whole file of more than ``max_bytes`` goes on in further snippets; with ``truncate`` it is cut there, with a mark.
    Unusable files are left out (see ``file_errors``), as are those that come with an ``error``. Go files are neither cut nor tested for being binary.
    """
    rows, cut = _cut(files, parser, max_bytes, truncate, max_file_bytes)
    # A filter on the arrays would be pushed below all the columns they are made of, and repeat their work.
    found = rows.select("path", F.inline_outer(cut)).filter("content is not null")
    return found.select(
        text.snippet_id(F.col("path"), F.col("start_line"), F.col("content"), F.col("at")).alias("id"), "content",
        F.col("path").alias("file_path"), "start_line", "end_line", "symbols",
        F.lit(None).cast("array<float>").alias("embedding"), "metadata")


def file_errors(files: DataFrame, parser: Parser = go_declarations, max_file_bytes: int = text.MAX_FILE_BYTES) -> DataFrame:
    """Files that ``snippets`` leaves out, with the reason."""
    reason = F.explode_outer(F.array("error")).alias("error")  # as in snippets
    return _parsed(files, parser, max_file_bytes).select("path", reason).filter("error is not null")


def index_summary(files: DataFrame, parser: Parser = go_declarations, max_file_bytes: int = text.MAX_FILE_BYTES) -> DataFrame:
    """What indexing does with the files: kind, name, n. Files by extension and in all, snippets made, files left out. Rows of ``read_workspace``
    also tell of files that could not be read. The files are parsed once; what is stored of each is its path, error and number of snippets."""
    rows, cut = _cut(files, parser, text.MAX_SNIPPET_BYTES, False, max_file_bytes)
    made = F.aggregate(F.transform(cut, lambda s: s["content"].isNotNull().cast("long")), F.lit(0).cast("long"), lambda n, one: n + one)
    facts = stored(rows.select("path", "error", F.coalesce(made, F.lit(0)).alias("made")), "summary")
    row = lambda kind, name, n: [F.lit(kind).alias("kind"), name.alias("name"), n.alias("n")]
    made = facts.agg(F.coalesce(F.sum("made"), F.lit(0)).alias("n"))
    return (extension_stats(facts).select(row("files", F.col("ext"), F.col("n_files")))
            .unionByName(made.select(row("snippets", F.lit("(all)"), F.col("n"))))
            .unionByName(facts.filter("error is not null").select(row("left out", F.col("error"), F.lit(1).cast("long")))))


def with_embedding_text(snips: DataFrame) -> DataFrame:
    return snips.withColumn("embedding_text", text.embedding_text(
        F.col("file_path"), F.col("symbols"), F.col("content")))


def extension_stats(files: DataFrame) -> DataFrame:
    """Files per extension plus one total row (``(all)``), counted before any parsing."""
    ext = paths.extension(F.col("path"))
    shown = F.when(ext == "", F.lit("(no extension)")).otherwise(ext)
    return (files.select(shown.alias("ext")).rollup("ext").agg(F.count("*").alias("n_files"))
            .select(F.coalesce("ext", F.lit("(all)")).alias("ext"), "n_files"))
