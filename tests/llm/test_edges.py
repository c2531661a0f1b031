"""Inputs that once ended a job or lost rows."""

import base64

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from textquarry.llm import decontamination, language_id, ngram_join, quality_classifier, shingles, text_stats, token_counts

CLASHES = ("_key", "gone", "twice", "host", "path", "c", "spoken", "d0", "text_", "_key_", "n_words")


@pytest.fixture(scope="module")
def docs(spark):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [(i, " ".join(words[(i * k) % 12] for k in range(1, 31)), "en", "s") for i in range(12)]
    rows += [(50, rows[3][1], "en", "s"), (60, "a b c", "en", "s"), (60, "a b c", "en", "s"), (61, "leaked passage of a benchmark item here", "en", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(c) for c in CLASHES})


def test_short_chunks_have_no_shingle_windows():
    for n in range(6):
        assert len(text_stats.window_hashes(np.arange(n, dtype=np.uint64), 5)) == max(0, n - 4)
    assert [len(s) for s in shingles.shingle_sets([b"a b c"])] == [1]
    assert [len(s) for s in shingles.shingle_sets([b"a", b"", b"a b"])] == [1, 0, 1]


def test_one_text_per_partition(spark):
    rows = [(i, " ".join("abcdefg"[:i])) for i in range(8)] + [(9, None)]
    one_each = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = {r["doc_id"]: r["n_shingles"] for r in ngram_join.join(one_each).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 3, 9: 0}
    counted = one_each.select("doc_id", text_stats.counted(F.col("text")).alias("c")).collect()
    assert {r["doc_id"]: r["c"]["n_words"] for r in counted} == {**{i: i for i in range(8)}, 9: 0}


def test_user_columns_stay(spark, docs):
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [*range(12), 60, 61]
    item = spark.createDataFrame([(1, "leaked passage of a benchmark item here")], "item_id long, text string")
    clean = decontamination.decontaminate(docs, item)
    rows = clean.collect()
    assert clean.columns == docs.columns and len(rows) == docs.count() - 1 and all(r[c] == c for r in rows for c in CLASHES)
    spoken = language_id.keep_spoken(docs, language_id.fit(docs))
    assert spoken.columns == docs.columns and spoken.count() == docs.count()
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    good = quality_classifier.keep_good(docs, labels, F.col("source"), F.col("lang"))
    assert good.columns == docs.columns and all(r[c] == c for r in good.collect() for c in CLASHES)


def test_very_long_items(spark):
    """Counters hold as many shingles as there are."""
    for most in (200, 1 << 19, 1 << 21):
        lane = decontamination._lane_bits(most)
        assert most < 1 << (lane - 1) and decontamination.BITS % lane == 0
    values = [3, 5, 1 << 61, 7, 7]
    df = spark.createDataFrame([(values,)], "h array<bigint>")
    prints = {df.select(decontamination.fingerprint("h", lane).alias("f")).first()["f"] for lane in (9, 21, 63)}
    assert prints == {7}


def test_long_white_space_keeps_its_tokens():
    with open(token_counts.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoder = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in (" " * 5_000, "a" + " " * 5_000, " " * 5_000 + "b", "x" + "\n" * 3_000 + "y  z", ("\t \n" * 900 + "q") * 3, "é" + "　" * 1_200 + " 7", " " * 999 + "."):
        assert token_counts.encoded_length(encoder, text) == len(encoder.encode_ordinary(text))
    assert token_counts.encoded_length(encoder, " " * 2_000_000 + "x") > 0


def test_few_training_words(spark):
    rows = [("en", "the house and the tree"), ("de", "das haus und der baum")] * 2
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
    asked = spark.createDataFrame([("the tree and the house",), ("der baum und das haus",)], "text string")
    assert [r["lang_pred"] for r in language_id.predict(asked, model, []).collect()] == ["en", "de"]
    rng = np.random.default_rng(1)
    windows = [(0, [b"a"] * 24), (1, [b"b"] * 24), (0, [b"c"] * 7)]
    flat = [w for s in language_id.spliced(windows, rng) for w in s]
    assert {w for _, w in flat} == {b"a", b"b", b"c"}
