"""Mix sources to target weights: hash-random order, prefix sums of sizes, a cut at each source's exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textquarry.llm.common import n_words, stored

WEIGHTS = (3, 1, 2)
# The mix holds SHARE[0] / SHARE[1] times all words; no source gives more than EPOCHS times its words.
SHARE = (3, 2)
EPOCHS = 2
# Documents per bucket of the hash order; a source with more gets more buckets.
BUCKET_DOCS = 4096


def hash_key(doc_id: Column) -> Column:
    """60 random bits that rest on the id alone, so that reruns agree; null ids share one key."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Words each source is to give.

    Input: one row per source with ``source`` and ``source_size``. Sources take their weights in turn by code point,
    null last. A source reaches at most ``epochs`` times its size; the excess goes to the others by weight until none is
    above. That fixed point is found at once: sources are filled in the order of cap per weight, and a prefix of that
    order is capped. Adds ``target`` (double); sources without words get 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    caps = sources.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    by_cap = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    num, den = share
    caps = (caps.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
            .withColumn("w_left", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0)))
            .withColumn("total", F.sum("source_size").over(all_rows)))
    # Over den: what is left for this source and those behind it.
    left = F.col("total") * num - F.col("capped") * den
    caps = caps.withColumn("left", left).withColumn("is_capped", F.col("cap") * den * F.col("w_left") <= F.col("w") * left)
    rest = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.min(F.when(~F.col("is_capped"), F.struct(F.col("capped"), F.col("left"), F.col("w_left")))).over(rest)
    caps = caps.withColumn("first", first)
    return caps.select("source", "source_size", F.when(F.col("is_capped"), F.col("cap").cast("double")).otherwise(
        (F.col("w") * F.col("first.left")).cast("double") / (F.col("first.w_left") * den).cast("double")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs: int = EPOCHS) -> DataFrame:
    """How much of each document the mix takes.

    Input: ``doc_id``, ``text``, ``source``; more columns are left aside. Returns doc_id, source, size, source_size,
    target, taken. Whole passes over a source come first, then documents in hash order until the budget (the target
    rounded to words) is met; the last one gives the part that is left. Null text has size 0, a null source is a source
    of its own, rows with equal ids are taken one after the other, an empty table gives no rows.

    Texts are read once and left behind; sums run per hash bucket, then over a source's buckets, then within a bucket,
    so the largest source is as many tasks as its buckets.
    """
    slim = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                              hash_key(F.col("doc_id")).alias("key")), "sizes")
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # Buckets are a power of two, at most 65,536 a source.
    bits = F.least(F.lit(16), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BUCKET_DOCS)))).cast("int")
    targets = stored(source_targets(sources, weights, share, epochs).alias("t").join(
        sources.select(F.col("source").alias("s"), bits.alias("bits")), F.col("t.source").eqNullSafe(F.col("s")))
        .select("source", "source_size", "target", "bits"), "targets")
    t = targets.select(F.col("source").alias("s"), "source_size", "target", "bits")
    keyed = slim.join(F.broadcast(t) if targets.count() <= 100_000 else t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    keyed = keyed.withColumn("bucket", F.expr("shiftright(key, 60 - bits)"))
    groups = [F.coalesce("source", F.lit("")).alias("g"), F.col("source").isNull().alias("gn"), F.col("bucket")]
    sums = keyed.groupBy(*groups).agg(F.sum("size").alias("b"))
    ahead = Window.partitionBy("g", "gn").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("g", "gn", "bucket", F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("ahead"))
    keyed = keyed.select("*", *groups[:2]).join(sums, ["g", "gn", "bucket"])
    inside = (Window.partitionBy("g", "gn", "bucket").orderBy("key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)
    rest = budget - passes * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return keyed.select("doc_id", "source", "size", "source_size", "target", (passes * F.col("size") + part).alias("taken"))
