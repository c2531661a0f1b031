"""Parsers as table functions."""

import pytest

from textquarry.operators.parsers import parsed_snippets, register_parser
from textquarry.schemas import FILE, SNIPPET


@pytest.fixture
def sections():
    """A parser of its own, as a notebook's: tasks cannot import it."""
    def sections(path, source):
        for i, line in enumerate(source.split("\n")):
            if line == "boom":
                raise RuntimeError("no more")
            if line.startswith("#"):
                yield i + 1, i + 1, [line.strip("# ")], line

    return sections


def test_called_by_name_in_sql(spark, sections):
    register_parser(spark, "sections_of", sections)
    spark.createDataFrame([("a", "# one\ntext\n## two"), ("b", "none"), ("c", None), ("d", "# x\nboom\n# y")], "p string, t string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT p, d.start_line, d.symbols, d.error FROM texts, LATERAL sections_of(p, t) AS d").collect()
    assert sorted((r.p, r.start_line or 0, r.symbols, r.error) for r in got) == [
        ("a", 1, ["one"], None), ("a", 3, ["two"], None), ("d", 0, None, "failed to parse file: d: RuntimeError: no more"), ("d", 1, ["x"], None)]
    with pytest.raises(Exception, match="takes a string as source"):
        spark.sql("SELECT * FROM sections_of('a', 5)").collect()


def test_snippets_of_a_registered_parser(spark, sections):
    register_parser(spark, "sections_of", sections)
    files = spark.createDataFrame([("a", 5, bytearray(b"# \xff")), ("b", 4, bytearray(b"boom")), ("c", 0, None)], FILE)
    found, failed = parsed_snippets(files, "sections_of")
    assert found.columns == SNIPPET.fieldNames()
    assert [(r.file_path, r.symbols, r.content, len(r.id)) for r in found.collect()] == [("a", ["�"], "# �", 64)]
    assert [(r.path, r.error) for r in failed.collect()] == [("b", "failed to parse file: b: RuntimeError: no more")]
    assert parsed_snippets(files.limit(0), "sections_of")[0].count() == 0
