"""Requests made from table rows, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textquarry.plans.tables import doc_path


def go_source() -> Column:
    """A document row as a Go file: a function, a method, and a method of a generic type."""
    id_, n = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    return F.concat(
        F.lit("package "), "source", F.lit("\n\n// Make returns a size.\nfunc Make"), id_,
        F.lit("(a int) int {\n\treturn "), n, F.lit("\n}\n\nfunc (s *Source) "), "lang",
        F.lit("() string { return \""), "lang", F.lit("\" }\n\nfunc (b Box[T]) Get() T {\n\tf := func() {\n\t}\n"
                                                     "\tf()\n\treturn b.v\n}\n"))


def go_text_source() -> Column:
    """A document's text in comments and raw strings of a Go file; every fifth file leaves its last brace open."""
    id_, line = F.col("doc_id").cast("string"), F.lit("\n")
    body = F.replace(F.replace(F.col("text"), F.lit("`"), F.lit("'")), F.lit("*/"), F.lit("* /"))
    return F.concat(
        F.lit("package main\n\n/*\n"), body, F.lit("\n*/\nfunc Doc"), id_, F.lit("() string { return `"), body,
        F.lit("` } // {\n\nfunc bare"), id_, F.lit("(a int, b interface{}) int\n\n// func not() {\nfunc (r *Run) Multi"), id_,
        F.lit("(\n\ta int,\n) string {\n\ts := \"} \\\" func (\" + `\n"), body,
        F.lit("\nfunc notReal() {\n}\n`\n\tc := '{'\n\treturn s\n"), F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.lit("}")), line)


def path_variants(url: Column) -> Column:
    path = F.regexp_extract(url, r"^https?://[^/]+(.*)$", 1)
    return F.array(path, F.concat(F.lit("a/../.."), path), F.concat(F.lit("."), path, F.lit("/../x//y/.")),
                   F.concat(F.lit("/../.."), path, F.lit("/../../..")), F.concat(F.lit(".."), F.ltrim(path, F.lit("/"))))


def _request(seq: Column, path: Column) -> Column:
    return F.struct(seq.alias("seq"), path.alias("path"))


def read_requests() -> Column:
    id_ = F.col("doc_id").cast("string")
    return F.array(
        _request(F.concat(F.lit("file:"), id_), F.concat(F.lit("./x/..//"), doc_path())),
        _request(F.concat(F.lit("root:"), id_), F.concat(F.lit("/"), doc_path())),
        _request(F.concat(F.lit("none:"), id_), doc_path(".gone")),
        _request(F.concat(F.lit("dir:"), "source"), F.col("source")),
        _request(F.concat(F.lit("out:"), "lang"), F.concat(F.lit("x/../../"), "lang")),
        _request(F.lit("empty"), F.lit("")))


def list_requests() -> Column:
    return F.array(
        F.lit(""), F.lit("."), F.col("source"), F.concat("source", F.lit("//"), "lang", F.lit("/")),
        F.concat(F.lit("/"), "source"), doc_path(), F.col("lang"), F.concat(F.lit("../"), "lang"))


def fold_edits() -> Column:
    tail, path = F.expr("right(text, 12)"), doc_path()
    edit = lambda n, old, new: F.struct(
        (F.col("doc_id") * 3 + n).alias("seq"), path.alias("path"), old.alias("old_str"), new.alias("new_str"))
    return F.array(edit(0, tail, F.lit("<<one>>")), edit(1, F.lit("<<one>>"), F.lit("<<two>>")),
                   edit(2, F.lit(" the "), F.lit(" a ")))


def event_input() -> Column:
    """Event properties as a search input; the event type decides what is wrong with it."""
    kind, props = F.col("event_type"), F.col("props")
    inside = F.regexp_replace(props, r"^\{|\}$", "")
    return (
        F.when(kind == "error", F.concat(F.lit('{"query": "q", '), inside))
        .when(kind == "signup", F.concat(F.lit('{"query": 5, '), inside, F.lit("}")))
        .when(kind == "view", F.concat(F.lit('{"query": "q", "k": -'),
                                       F.regexp_extract(props, r"\d+", 0), F.lit("}")))
        .when(kind == "purchase", F.concat(F.lit('{"query": "q", '), inside, F.lit("}")))
        .otherwise(props))


def event_tool() -> Column:
    """A tool name for every event type, one of them unknown."""
    kind = F.col("event_type")
    return (F.when(kind == "click", F.lit("read_file")).when(kind == "view", F.lit("vector_search"))
            .when(kind == "purchase", F.lit("edit_file")).when(kind == "signup", F.lit("vector_upsert"))
            .otherwise(kind))


def mixed_calls() -> Column:
    """Seven calls on two paths of a document: its own file read, edited, read again and created in vain, a new one read too early, then
    created, edited and read. Every third document's new file lies under its old one and so cannot be made."""
    tail, id_ = F.expr("right(text, 12)"), F.col("doc_id").cast("string")
    new = F.when(F.col("doc_id") % 3 == 0, F.concat(doc_path(), F.lit("/notes"))).otherwise(F.concat(F.lit("notes/"), id_))
    nothing = F.lit(None).cast("string")

    def call(n: int, tool: str, path: Column, content: Column = nothing, old: Column = nothing, new: Column = nothing) -> Column:
        return F.struct(F.concat(id_, F.lit(f":{n}")).alias("call_id"), (F.col("doc_id") * 10 + n).alias("seq"), F.lit(tool).alias("tool"),
                        path.alias("path"), content.alias("content"), old.alias("old_str"), new.alias("new_str"))

    return F.array(
        call(0, "read_file", new), call(1, "edit_file", doc_path(), old=tail, new=F.lit("<<end>>")), call(2, "read_file", doc_path()),
        call(3, "create_file", doc_path(), F.lit("")), call(4, "create_file", new, F.col("source")),
        call(5, "edit_file", new, old=F.col("source"), new=F.col("lang")), call(6, "read_file", new))
