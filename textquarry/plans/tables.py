"""The given tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def doc_path(suffix: str = ".txt") -> Column:
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(suffix))


def as_files(rows: DataFrame, path: Column, text: Column) -> DataFrame:
    return rows.select(path.alias("path"), F.octet_length(text).cast("long").alias("length"),
                       text.cast("binary").alias("content"))


def doc_files(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    return as_files(load(spark, folder, "documents"), doc_path(suffix), F.col("text"))


def _snippet(id: Column, content: Column, path: Column, start: Column, end: Column) -> list[Column]:
    return [id.alias("id"), content.alias("content"), path.alias("file_path"),
            start.cast("long").alias("start_line"), end.cast("long").alias("end_line"),
            F.array().cast("array<string>").alias("symbols"),
            F.lit(None).cast("array<float>").alias("embedding"),
            F.lit(None).cast("map<string,string>").alias("metadata")]


def line_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Every non-empty document line as a snippet."""
    docs = load(spark, folder, "documents")
    lines = docs.select("doc_id", doc_path().alias("path"),
                        F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter("line <> ''")
    n = F.col("pos") + 1
    return lines.select(*_snippet(F.format_string("%012d:%06d", "doc_id", n), F.col("line"), F.col("path"), n, n))


def turn_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation message as a snippet."""
    turns = load(spark, folder, "conversations")
    path = F.format_string("conversation/%d", "conv_id")
    return turns.select(*_snippet(F.format_string("%012d:%06d", "conv_id", "turn"), F.col("text"), path,
                                  F.col("turn"), F.col("turn")))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
