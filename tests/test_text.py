"""Byte and path expressions against plain Python models."""

import posixpath

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from textquarry.functions import paths, text
from textquarry.operators.snippets import extension_stats, file_errors, index_summary, snippets, with_embedding_text, with_kind
from textquarry.schemas import FILE

FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def model_is_binary(data: bytes) -> bool:
    head = data[:1000]
    if data[:3] == b"\xef\xbb\xbf" or len(head) < 32:
        return False
    nul = head.count(0)
    ctrl = sum(1 for b in head if 1 <= b <= 8 or 14 <= b <= 26 or 28 <= b <= 31)
    ext = sum(1 for b in head if 128 <= b <= 159)
    start = data[:100].decode("latin-1").lower()
    if any(m.lower() in start for m in text.TEXT_MARKERS):
        return nul > len(head) // 50
    return nul > len(head) // 1000 or ctrl > len(head) // 100 or ext > len(head) // 50


def spark_is_binary(spark, rows):
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(rows)], "i int, content binary")
    out = df.select("i", text.is_binary(text.binary_profile(F.col("content"))).alias("b")).collect()
    return [r.b for r in sorted(out, key=lambda r: r.i)]


def test_binary_boundaries(spark):
    a = b"a"
    rows = [
        b"\xef\xbb\xbf" + b"\0" * 100, b"\0" * 31, b"\0" * 32, a * 998 + b"\0", a * 999 + b"\0", a * 998 + b"\0\0",
        b"\x1b" * 100, "é".encode() * 100, "à".encode() * 100, a * 99 + b"{" + b"\x01" * 50,
        a * 100 + b"{" + b"\x01" * 50, b"# " + b"\0" * 3 + a * 95, b"# " + b"\0" * 2 + a * 96, b"",
    ]
    want = [False, False, True, True, False, True, False, model_is_binary("é".encode() * 100),
            model_is_binary("à".encode() * 100), False, True, True, False, False]
    assert [model_is_binary(r) for r in rows] == want
    assert spark_is_binary(spark, rows) == want


@FEW
@given(st.lists(st.binary(max_size=1200) | st.binary(min_size=30, max_size=40)
                | st.text("ab{\n\x00\x01é", max_size=1100).map(lambda s: s.encode()), min_size=5, max_size=40))
def test_binary_model(spark, rows):
    assert spark_is_binary(spark, rows) == [model_is_binary(r) for r in rows]


def file_rows(spark, rows):
    return spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in rows], FILE)


def test_size_and_kind(spark):
    big = b"a" * 10485760
    rows = [("a/ok.bin", big), ("a/big.bin", big + b"a"), ("a/nul.bin", b"\0" * 100), ("a/nul.TXT", b"\0" * 100)]
    got = {r.path: r.error for r in with_kind(file_rows(spark, rows)).collect()}
    assert got == {"a/ok.bin": None, "a/big.bin": "file too large (>10MB): a/big.bin",
                   "a/nul.bin": "skipping binary file: a/nul.bin", "a/nul.TXT": None}
    assert {r.path for r in file_errors(file_rows(spark, rows)).collect()} == {"a/big.bin", "a/nul.bin"}


def test_truncation(spark):
    rows = [("a.txt", b"a" * 10000), ("b.txt", b"a" * 10001), ("c.txt", b"a" * 9999 + "é".encode()),
            ("d.txt", b"a" * 9998 + b"\n" + b"b\nc"), ("e.txt", b""), ("README", b"x\ny\n")]
    got = {r.file_path: r for r in snippets(file_rows(spark, rows), truncate=True).collect()}
    mark = "... [content truncated]"
    assert got["a.txt"].content == "a" * 10000
    assert got["b.txt"].content == "a" * 10000 + mark
    assert got["c.txt"].content == "a" * 9999 + "�" + mark
    assert got["d.txt"].content == "a" * 9998 + "\nb" + mark and got["d.txt"].end_line == 2
    assert got["e.txt"].end_line == 1 and got["README"].end_line == 3
    assert got["README"].metadata == {"file_type": "", "file_name": "README"} and got["README"].symbols == []


def test_long_files_go_on(spark):
    texts = {"a.txt": "", "b.txt": "é" * 10 + "\n" + "x" * 30, "c.txt": "ab\n" * 12, "d.txt": "aaaaaaaaa" * 9, "e.txt": "x" * 16,
             "f.txt": "€" * 40, "g.txt": "𐍈\n" * 21, "h.txt": "x" * 26 + "€"}
    rows = [(p, t.encode()) for p, t in texts.items()] + [("i.txt", b"\x80" * 31)]
    got = sorted(snippets(file_rows(spark, rows), max_bytes=16).collect(), key=lambda r: (r.file_path, r.start_line))
    assert len({r.id for r in got}) == len(got) and all(len(r.content.encode()) <= 16 for r in got if r.file_path != "i.txt")
    assert {r.file_path for r in got} == {p for p, _ in rows}
    for path, t in texts.items():
        mine = [r for r in got if r.file_path == path]
        assert sorted("".join(r.content for r in mine)) == sorted(t) and (len(mine) == 1) == (len(t.encode()) <= 16)
        lines = t.split("\n")
        for r in mine:
            span = r.content.split("\n")
            assert r.end_line - r.start_line + 1 == len(span)
            assert all(part in lines[r.start_line - 1 + i] for i, part in enumerate(span))


def test_extension(spark):
    cases = {".gitignore": ".gitignore", "README": "", "a.tar.gz": ".gz", "foo.": ".", "A.GO": ".go", "dir.d/file": ""}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    got = {r.path: r.e for r in df.select("path", paths.extension(F.col("path")).alias("e")).collect()}
    assert got == cases
    assert not df.filter(paths.is_go_file(F.col("path"))).count()
    stats = {r.ext: r.n_files for r in extension_stats(df).collect()}
    assert stats == {".gitignore": 1, "(no extension)": 2, ".gz": 1, ".": 1, ".go": 1, "(all)": 6}


def model_clean(p: str) -> str:
    if p == "":
        return "."
    cleaned = posixpath.normpath(p)
    return cleaned[1:] if cleaned.startswith("//") else cleaned


def spark_clean(spark, rows):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(rows)], "i int, p string")
    out = df.select("i", paths.clean_path(F.col("p")).alias("c"), paths.workspace_path(F.col("p")).alias("k"),
                    paths.escapes_workspace(F.col("p")).alias("e")).collect()
    return sorted(out)


def test_paths(spark):
    rows = [".", "a/../b", "../x", "..foo", "/etc/x", "a//b", "a/../../x", "", "/", "/..", "a/b/../../..", "a/./", "..."]
    got = spark_clean(spark, rows)
    assert [r.c for r in got] == [model_clean(p) for p in rows]
    assert [r.e for r in got] == [False, False, True, True, False, False, True, False, False, False, True, False, True]
    assert [r.k for r in got][4] == "etc/x" and [r.k for r in got][8] == "."


@FEW
@given(st.lists(st.lists(st.sampled_from(["a", "b.c", ".", "..", "", "..foo", "/"]), max_size=8).map("/".join),
                min_size=5, max_size=60))
def test_paths_model(spark, rows):
    assert [r.c for r in spark_clean(spark, rows)] == [model_clean(p) for p in rows]


@FEW
@given(st.lists(st.tuples(st.text("ab é\n", max_size=30), st.text("abé", min_size=1, max_size=3)), min_size=5, max_size=50))
def test_count_model(spark, rows):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    got = sorted(df.select("i", text.count_occurrences(F.col("a"), F.col("b")).alias("n")).collect())
    assert [r.n for r in got] == [a.count(b) for a, b in rows]


GO = b'''package main

// Doc comment.
func Plain(a int) int {
\tf := func() {
\t}
\treturn a
}

func (t T) Value() string { return "x" }
func (t *T) Pointer(
\ta int,
) error {
\treturn nil
}

type T struct {
}

func (m Map[K, V]) Generic() {
}

func (T) Unnamed() {}
func Last() {
}'''


def test_go_files(spark):
    files = file_rows(spark, [("m.go", GO), ("none.go", b"package x\n"), ("first.go", b"package x;\nfunc A() {\n}\n"),
                              ("open.go", b"func A() {\n")])
    got = [(r.file_path, r.symbols[0], r.start_line, r.end_line) for r in snippets(files).collect()]
    assert sorted(got) == sorted([
        ("m.go", "Plain", 4, 8), ("m.go", "T.Value", 10, 10), ("m.go", "T.Pointer", 11, 15), ("m.go", "Generic", 20, 21),
        ("m.go", "T.Unnamed", 23, 23), ("m.go", "Last", 24, 25), ("first.go", "A", 2, 3)])
    plain = with_embedding_text(snippets(files)).filter("get(symbols, 0) = 'Plain'").first()
    assert plain.content.startswith("func Plain") and plain.content.endswith("return a\n}")
    assert plain.metadata is None and plain.embedding_text.startswith("File: m.go\nSymbols: Plain\nfunc Plain")


def test_snippet_ids_repeat(spark):
    files = file_rows(spark, [("m.go", GO), ("a.txt", b"x")])
    first, second = ({r.id for r in snippets(files).collect()} for _ in range(2))
    assert first == second and len(first) == 7


def test_query_terms(spark):
    df = spark.createDataFrame([("  The the CAT\n",), ("",), (" \t",)], "q string")
    assert [r.t for r in df.select(text.query_terms(F.col("q")).alias("t")).collect()] == [["the", "the", "cat"], [], []]


GO_QUOTES = b"""// Package x {
package x

func A() int { return 1 } // one

type T struct{}

func bare(a int) int
func many(
\ta interface{},
) (
\tint)

func raw() string {
\treturn `
}
func notReal() {
}
`
}
/* func no() {
} */
func quoted() string { return "} \\" {" + string('"') }
"""


def test_go_strings_and_comments(spark):
    files = file_rows(spark, [("q.go", GO_QUOTES), ("open.go", b"package x\nfunc A() {\n\tx := 1\n"),
                              ("string.go", b"package x\nvar s = `a\n"), ("empty.go", b""), ("bytes.go", b"package x\n\xff\x00")])
    got = sorted((r.start_line, r.end_line, r.symbols[0]) for r in snippets(files).collect())
    assert got == [(4, 4, "A"), (8, 8, "bare"), (9, 12, "many"), (14, 20, "raw"), (23, 23, "quoted")]
    errors = {r.path: r.error for r in file_errors(files).collect()}
    assert errors == {p: f"failed to parse file: {p}" for p in ("open.go", "string.go", "empty.go")}
    summary = {(r.kind, r.name): r.n for r in index_summary(files).collect()}
    assert summary["snippets", "(all)"] == 5 and summary["files", ".go"] == 5 and len(summary) == 6


def test_own_parser(spark):
    def one_line(rows):
        span = F.struct(F.lit(1).cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line"),
                        F.col("source").alias("content"), F.array(F.lit("s")).alias("symbols"))
        return rows.withColumn("declarations", F.when(F.col("source") != "bad", F.array(span)))

    files = file_rows(spark, [("a.go", b"x"), ("b.go", b"bad"), ("c.txt", b"t")])
    assert {(r.file_path, r.content) for r in snippets(files, one_line).collect()} == {("a.go", "x"), ("c.txt", "t")}
    assert [r.path for r in file_errors(files, one_line).collect()] == ["b.go"]
