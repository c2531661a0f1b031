"""Histories from a stream in many micro-batches against the batch answer."""

import random

from pyspark.sql import functions as F

from textquarry.operators.conversations import history_before_turn
from textquarry.streaming.jobs import history_stream

SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(df):
    return sorted(((r["conv_id"], r["turn"], r["role"], r["text"], [tuple(m) for m in r["history"]]) for r in df.collect()), key=str)


def run(spark, tmp_path, parts, n, starts):
    """The stream over the parts as one file each; ``starts``: after how many parts it is stopped and started again."""
    source, out, offsets = (str(tmp_path / x) for x in ("turns", "out", "offsets"))
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if i + 1 in starts:
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            history_stream(stream, n, out, offsets).awaitTermination()
    return spark.read.parquet(out)


def test_micro_batches_give_the_batch_answer(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3]), turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", None, "b"])) for turn in range(60)]
    rows += [(4, None, "user", "first"), (4, 0, "user", "second")]
    rows.sort(key=lambda r: (r[1] is not None, r[1] or 0))
    parts = [rows[i:i + 13] for i in range(0, len(rows), 13)]
    want = rows_of(history_before_turn(spark.createDataFrame(rows, SCHEMA), 3))
    got = rows_of(run(spark, tmp_path, parts, 3, {2, len(parts)}))
    assert got == want and len(got) == len(rows)


def test_late_turns_see_what_is_kept(spark, tmp_path):
    parts = [[(1, 1, "u", "a"), (1, 5, "u", "e")], [(1, 3, "u", "c"), (1, 6, "u", "f")], [(1, 0, "u", "z"), (1, 6, "u", "f")]]
    got = run(spark, tmp_path, parts, 2, {3})
    seen = sorted((r["turn"], "".join(m["text"] for m in r["history"])) for r in got.collect())
    assert seen == [(0, ""), (1, ""), (3, "a"), (5, "a"), (6, "ce"), (6, "ef")]
