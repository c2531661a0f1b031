"""A user's parser as a table function, called by name in SQL beside the files it reads."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from textquarry.functions.text import snippet_id
from textquarry.schemas import SNIPPET

# (first line, last line, symbols, text) of what a parser finds in a file.
Found = tuple[int, int, list[str], str]
DECLARATION = T.StructType([
    T.StructField("start_line", T.LongType()), T.StructField("end_line", T.LongType()), T.StructField("symbols", T.ArrayType(T.StringType())),
    T.StructField("content", T.StringType()), T.StructField("error", T.StringType())])


def register_parser(spark: SparkSession, name: str, parse: Callable[[str, str], Iterable[Found]]) -> None:
    """Make ``parse(path, source)`` a table function for SQL: ``FROM files, LATERAL name(path, source)``.

    Columns are those of DECLARATION. A null source gives nothing; a file that the parser fails on gives what was found before, and a row with
    the ``error``. Files are parsed where they lie, one at a time.
    """

    class Parser:
        @staticmethod
        def analyze(path: AnalyzeArgument, source: AnalyzeArgument) -> AnalyzeResult:
            for argument, what in ((path, "path"), (source, "source")):
                if not isinstance(argument.dataType, (T.StringType, T.NullType)):
                    raise ValueError(f"{name} takes a string as {what}, not {argument.dataType.simpleString()}")
            return AnalyzeResult(DECLARATION)

        def eval(self, path: str, source: str):
            if source is None:
                return
            try:
                for start, end, symbols, content in parse(path, source):
                    yield start, end, list(symbols), content, None
            except Exception as e:  # whatever the user's parser raises
                yield None, None, None, None, f"failed to parse file: {path}: {type(e).__name__}: {e}"

    spark.udtf.register(name, F.udtf(Parser))


def parsed_snippets(files: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """FILE rows through a registered parser: SNIPPET rows, and the files it fails on (path, error)."""
    texts = files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("source"))
    found = files.sparkSession.sql(f"SELECT f.path, d.* FROM {{files}} AS f, LATERAL {name}(f.path, f.source) AS d", files=texts)
    rows = found.filter("error is null").select(
        snippet_id(F.col("path"), F.col("start_line"), F.col("content")).alias("id"), "content", F.col("path").alias("file_path"), "start_line",
        "end_line", "symbols", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return rows.select(*SNIPPET.fieldNames()), found.filter("error is not null").select("path", "error")
