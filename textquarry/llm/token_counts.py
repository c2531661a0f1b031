"""Exact token length histogram with suffix sums: totals, quantiles and truncated totals for any context limit."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textquarry.llm.common import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Longer white space is taken out before the pattern, which would recurse at every character of it.
LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
# Lengths are summed in blocks of this many before the blocks are.
BLOCK = 1024

_encoders: dict = {}


def _encoder(vocabulary):
    """One encoder per Python worker."""
    import tiktoken

    if vocabulary.id not in _encoders:
        _encoders[vocabulary.id] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks,
                                                     special_tokens={})
    return _encoders[vocabulary.id]


def encoded_length(encoder, text: str) -> int:
    """Tokens of a text. The pattern takes white space as one piece but for its last character, which goes with what follows."""
    total = at = 0
    for m in LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        total += len(encoder.encode_ordinary(text[at:m.start()])) + len(encoder._encode_single_piece(text[m.start():end]))
        at = end
    return total + len(encoder.encode_ordinary(text[at:] if at else text))


class Vocabulary:
    """Ranks of a byte-pair vocabulary file, read once on the driver and sent to the workers (size fixed by the file)."""

    def __init__(self, spark: SparkSession, path: str = VOCABULARY):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.id = f"{path}:{len(ranks)}"
        self._ranks = spark.sparkContext.broadcast(ranks)

    @property
    def ranks(self) -> dict[bytes, int]:
        return self._ranks.value


def encoded_lengths(texts: DataFrame, column: str, vocabulary: Vocabulary) -> DataFrame:
    """One row ``length`` per row: tokens of the whole text, however long, 0 for null and empty. Other columns are left aside; an empty table
    gives no rows."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            found = [encoded_length(encoder, x) if x else 0 for x in (y.as_py() for y in batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["length"])

    return texts.select(F.col(column)).mapInArrow(lengths, "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """Documents by exact length, with what every context limit asks for.

    Input: rows with ``length`` (long, no nulls). Per distinct length L: ``n_docs`` of that length, ``n_tokens`` in them,
    ``docs_upto`` / ``tokens_upto`` of at most L, ``docs_from`` / ``tokens_from`` of at least L (the suffix sums),
    ``truncated_tokens``, the total after cutting every document to L, and ``quantile``, the share of documents of at
    most L. An empty table gives no rows.

    Sums run in two levels, within blocks of lengths and over the blocks, so no task sees all lengths.
    """
    counts = lengths.groupBy("length").agg(F.count("*").alias("n_docs")).withColumn(
        "n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.expr(f"length div {BLOCK}"))
    counts = stored(counts, "lengths")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt"))
    # One row per 1,024 lengths: bounded by the longest document, not by the number of documents.
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("d0"),
                           F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("t0"),
                           F.sum("bd").over(everything).alias("d"), F.sum("bt").over(everything).alias("t"))
    inside = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    each = (counts.withColumn("di", F.sum("n_docs").over(inside)).withColumn("ti", F.sum("n_tokens").over(inside))
            .join(blocks, "block")
            .withColumn("docs_upto", F.col("d0") + F.col("di")).withColumn("tokens_upto", F.col("t0") + F.col("ti"))
            .withColumn("docs_from", F.col("d") - F.col("docs_upto") + F.col("n_docs"))
            .withColumn("tokens_from", F.col("t") - F.col("tokens_upto") + F.col("n_tokens")))
    return each.select("length", "n_docs", "n_tokens", "docs_upto", "tokens_upto", "docs_from", "tokens_from",
                       (F.col("tokens_upto") + F.col("length") * (F.col("d") - F.col("docs_upto")))
                       .alias("truncated_tokens"),
                       (F.col("docs_upto") / F.col("d")).alias("quantile"))


def truncated_total(table: DataFrame, limits: list[int]) -> DataFrame:
    """Total tokens and cut documents for each context limit, also for limits no document has as its length."""
    asked = F.explode(F.array(*[F.lit(int(x)) for x in sorted(set(limits))]).cast("array<bigint>"))
    return (table.withColumn("context_limit", asked).groupBy("context_limit").agg(
        F.sum(F.least("length", "context_limit") * F.col("n_docs")).alias("tokens"),
        F.sum(F.when(F.col("length") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("cut_docs")))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least each share of the documents does not exceed."""
    return table.agg(*[F.min(F.when(F.col("quantile") >= s, F.col("length"))).alias(f"q{s:g}") for s in shares])
