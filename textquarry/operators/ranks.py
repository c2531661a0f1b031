"""Places of rows within a key, for keys that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from textquarry.session import cut_lineage


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``place``: 0 for a key's first row by ``order``, 1 for the next.

    Rows are spread by ranges of key and order, so a large key lies in many tasks; windows over a whole key only see one
    number per task. Rows equal in keys and order come in any order, the same at every later use. Runs a job.
    """
    parted = cut_lineage(rows.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy(*keys, "part").agg(F.count("*").alias("n")).withColumn(
        "offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    same = F.col("part") == F.col("o_part")
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"o_{key}"))
    offsets = offsets.select(F.col("part").alias("o_part"), "offset", *[F.col(k).alias(f"o_{k}") for k in keys])
    inside = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order)) - 1
    return (parted.withColumn("place", inside).join(offsets, same)
            .withColumn("place", F.col("place") + F.col("offset")).drop("part", "offset", "o_part", *[f"o_{k}" for k in keys]))
