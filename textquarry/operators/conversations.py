"""Conversations: history before each turn, and turns grouped by user message.

A conversation may hold a third of all rows, so it is cut into chunks of equally
many rows, whatever the turn numbers are. Windows run inside a chunk; what a
chunk needs from earlier ones is a small summary per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textquarry.operators.ranks import ranked

# Rows per chunk, and chunks whose summaries are added up together.
CHUNK = 1024


def _chunked(turns: DataFrame, chunk: int) -> DataFrame:
    """Adds place and chunk; messages of one turn number are ordered by role and text."""
    rows = ranked(turns, ["conv_id"], ["turn", "role", "text"])
    return rows.withColumn("chunk", F.floor(F.col("place") / chunk))


def _last(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), F.lit(n))


def _by_chunk(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """Rows with the columns of their chunk, if it has any; a null conversation is one like any other."""
    carried = carried.withColumnsRenamed({"conv_id": "c_conv", "chunk": "c_chunk"})
    same = F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("chunk") == F.col("c_chunk"))
    return rows.join(carried, same, "left").drop("c_conv", "c_chunk")


def history_before_turn(turns: DataFrame, n: int, chunk: int = CHUNK) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with ``history``: the n messages before each turn, oldest first."""
    size = max(chunk, n)  # so that the chunk before holds all a chunk needs
    rows = _chunked(turns, size)
    message = F.struct("turn", "role", "text")
    tails = rows.filter(F.pmod("place", F.lit(size)) >= size - n).groupBy("conv_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("place", message.alias("message")))).alias("tail"))
    carried = tails.select("conv_id", (F.col("chunk") + 1).alias("chunk"), F.col("tail.message").alias("carry"))
    inside = F.collect_list(message).over(Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(-n, -1))
    joined = _by_chunk(rows.withColumn("inside", inside), carried)
    history = _last(F.when(F.col("carry").isNull(), F.col("inside")).otherwise(F.concat("carry", "inside")), n)
    return joined.withColumn("history", history).drop("place", "chunk", "carry", "inside")


def with_turn_group(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Number of user messages up to and including each turn: 0 before the first one."""
    rows = _chunked(turns, chunk).withColumn("is_user", F.when(F.col("role") == "user", 1).otherwise(0))
    before = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    # Sums over chunks come in two levels, so that no window sees a long conversation's chunks one by one.
    chunks = rows.groupBy("conv_id", "chunk").agg(F.sum("is_user").alias("users")).withColumn("level", F.floor(F.col("chunk") / chunk))
    levels = chunks.groupBy("conv_id", "level").agg(F.sum("users").alias("users")).select(
        F.col("conv_id").alias("l_conv"), F.col("level").alias("l_level"),
        F.coalesce(F.sum("users").over(before("conv_id", by="level")), F.lit(0)).alias("above"))
    inside = F.coalesce(F.sum("users").over(before("conv_id", "level", by="chunk")), F.lit(0))
    same = F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("level") == F.col("l_level"))
    offsets = chunks.withColumn("inside", inside).join(levels, same).select(
        "conv_id", "chunk", (F.col("inside") + F.col("above")).alias("offset"))
    in_chunk = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return (_by_chunk(rows.withColumn("turn_group", F.sum("is_user").over(in_chunk)), offsets)
            .withColumn("turn_group", F.col("turn_group") + F.col("offset")).drop("place", "chunk", "is_user", "offset"))


def turn_groups(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per user message with what follows it, until the next user message."""
    return with_turn_group(turns, chunk).groupBy("conv_id", "turn_group").agg(
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n_messages"),
        F.count_if(F.col("role") == "assistant").alias("n_replies"),
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user_text"))
