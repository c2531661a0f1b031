"""The summary of files reads and parses them once."""

from textquarry.operators.snippets import go_declarations, index_summary
from textquarry.schemas import FILE


def test_files_are_parsed_once(spark):
    files = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in (
        ("a.go", b"package a\nfunc A() {\n}\nfunc B() {\n}\n"), ("b.go", b"func {"), ("b.go", b"func {"), ("c.txt", b"x" * 25_000), ("d", b""),
        ("e.bin", b"\0" * 100), ("f.txt", b"y" * 40_000))], FILE)
    calls = []

    def parser(rows):
        calls.append(1)
        return go_declarations(rows)

    got = sorted(map(tuple, index_summary(files, parser, 30_000).collect()))
    assert len(calls) == 1
    assert got == sorted([("files", "(all)", 7), ("files", "(no extension)", 1), ("files", ".bin", 1), ("files", ".go", 3), ("files", ".txt", 2),
                          ("left out", "failed to parse file: b.go", 1), ("left out", "failed to parse file: b.go", 1),
                          ("left out", "file too large (>30000 bytes): f.txt", 1), ("left out", "skipping binary file: e.bin", 1), ("snippets", "(all)", 6)])
    assert sorted(map(tuple, index_summary(files.limit(0)).collect())) == [("snippets", "(all)", 0)]
