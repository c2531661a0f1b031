"""Top-k search, keyword search and the cascade against brute force."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from textquarry.functions.embedding import WordBuckets, checked_dim, embed_with, hashed, hashed_unit, normalised
from textquarry.operators.keyword_search import TermCounts, keyword_search
from textquarry.operators.topk import DenseVectors, HashedText, cell_scan, keep_best, top_k
from textquarry.operators.vector_search import search, search_buckets, search_text
from textquarry.plans.search import cascade, nearest
from textquarry.schemas import SNIPPET

FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def brute(q, rows, k):
    """(query, rank, id) by cosine, ties to the lower id."""
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
    scores = np.round(unit(q) @ unit(rows).T, 9)
    out = []
    for i in range(len(q)):
        best = sorted(range(len(rows)), key=lambda j: (-scores[i, j], j))[:k]
        out += [(i, r + 1, j) for r, j in enumerate(best)]
    return out


def vector_frames(spark, q, rows):
    frame = lambda m, name: spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, embedding array<float>")
    return frame(q, "query_id"), frame(rows, "id")


def ranked(hits):
    return sorted((r.query_id, r["rank"], r.id) for r in hits.collect())


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((300, 8)).astype(np.float32)
    rows[::3] = rows[0]  # a third of all rows are copies
    return rng.standard_normal((40, 8)).astype(np.float32), rows


def test_dense_matches_brute_force(spark, cloud):
    q, rows = cloud
    queries, table = vector_frames(spark, q, rows)
    want = brute(q.astype(float), rows.astype(float), 5)
    assert ranked(search(queries, table, 5)) == want
    # Beyond the broadcast limit the blocks give the same hits.
    assert ranked(top_k(queries, table, DenseVectors(), 5, broadcast_bytes=0)) == want


def test_own_k_per_query(spark, cloud):
    q, rows = cloud
    queries, table = vector_frames(spark, q, rows)
    every = brute(q.astype(float), rows.astype(float), len(rows))
    want = [(i, r, j) for i, r, j in every if r <= (400 if i == 3 else i % 4)]
    own = F.when(F.col("query_id") == 3, 400).otherwise(F.col("query_id") % 4)
    for limit in (10 ** 9, 0):
        assert ranked(top_k(queries.withColumn("k", own), table, DenseVectors(), 5, broadcast_bytes=limit)) == want


def test_small_cells_give_the_same(spark, cloud):
    q, rows = cloud
    queries, table = vector_frames(spark, q, rows)
    scorer = DenseVectors()
    scorer.queries_per_cell = 7
    cell = F.lit(0)
    queries = queries.withColumn("k", F.lit(5))
    hits = cell_scan(queries.withColumn("cell", cell), table.withColumn("cell", cell), scorer, rows_per_cell=23)
    assert ranked(keep_best(hits, queries)) == brute(q.astype(float), rows.astype(float), 5)


def test_edges(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, embedding array<float>")
    table = spark.createDataFrame([(7, [0.0, 1.0]), (5, [0.0, 2.0]), (6, [1.0, 1.0]), (8, None), (4, [-1.0, 0.0])],
                                  "id long, embedding array<float>")
    got = ranked(search(queries, table, 10))
    assert got == [(1, 1, 6), (1, 2, 5), (1, 3, 7), (1, 4, 4), (2, 1, 4), (2, 2, 5), (2, 3, 6), (2, 4, 7)]
    assert ranked(search(queries, table, 0)) == []
    per_query = queries.withColumn("k", F.col("query_id").cast("int"))
    assert ranked(search(per_query, table)) == [(1, 1, 6), (2, 1, 4), (2, 2, 5)]
    assert ranked(search(queries.limit(0), table, 3)) == []


def test_buckets_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    rows = np.repeat(centres, 20, axis=0) + 0.1 * rng.standard_normal((400, 16))
    q = centres + 0.1 * rng.standard_normal((20, 16))
    queries, table = vector_frames(spark, q, rows)
    got = ranked(search_buckets(queries, table, 5))
    want = set((i, j) for i, _, j in brute(q.astype(np.float32).astype(float), rows.astype(np.float32).astype(float), 5))
    found = set((i, j) for i, _, j in got)
    assert len(found & want) / len(want) > 0.9
    assert len(got) == len(set((i, j) for i, _, j in got))


def test_hashed_text(spark):
    docs = ["The cat sat", "the cat", "cat cat the", "dog", "", "..."]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, text string")
    queries = spark.createDataFrame([(1, "the CAT"), (2, "bird"), (3, "")], "query_id long, text string")
    hits = sorted(search_text(queries, rows, 2).collect(), key=lambda r: (r.query_id, r["rank"]))
    assert [(r.query_id, r.id, round(r.score, 6)) for r in hits] == [(1, 1, 1.0), (1, 2, round(3 / 10 ** 0.5, 6))]
    e = rows.select("id", hashed(F.col("text")).alias("e")).orderBy("id").collect()
    assert e[2].e.norm2 == 5 and sorted(e[2].e.cnt) == [1, 2] and e[4].e.idx == []
    u = rows.select("id", hashed_unit(F.col("text"), 16).alias("u")).orderBy("id").collect()
    assert u[4].u is None and len(u[0].u) == 16 and abs(sum(x * x for x in u[0].u) - 1) < 1e-6


def test_large_counts_stay_exact(spark):
    # Products beyond single precision.
    rows = spark.createDataFrame([(1, "a " * 5000 + "b"), (2, "a " * 5000 + "b b")], "id long, text string")
    queries = spark.createDataFrame([(1, "a " * 5001 + "b")], "query_id long, text string")
    got = search_text(queries, rows, 2).orderBy("rank").collect()
    cos = lambda x, y: (x[0] * y[0] + x[1] * y[1]) / ((x[0] ** 2 + x[1] ** 2) * (y[0] ** 2 + y[1] ** 2)) ** 0.5
    assert [r.id for r in got] == [1, 2]
    assert [r.score for r in got] == pytest.approx([cos((5001, 1), (5000, 1)), cos((5001, 1), (5000, 2))], abs=1e-15)


def model_keyword(query, docs, k=5):
    terms = query.lower().split()
    found = []
    for name, content in docs:
        total, best, line = 0, 0, None
        for candidate in content.split("\n"):
            n = sum(candidate.lower().count(t) for t in terms)
            total += n
            if n > best:
                best, line = n, candidate
        if total:
            found.append((-total, name, line))
    return [(i + 1, name, -n, line) for i, (n, name, line) in enumerate(sorted(found)[:k])]


def keyword_rows(spark, queries, docs):
    q = spark.createDataFrame([(i, s) for i, s in enumerate(queries)], "query_id long, query string")
    d = spark.createDataFrame(docs, "filename string, content string")
    hits = keyword_search(q, d).collect()
    return sorted((r.query_id, r["rank"], r.filename, r.relevance, r.matched_line) for r in hits)


def test_keyword_edges(spark):
    docs = [(f"f{i}", "aaaa\naa aa\nxaax") for i in range(6)] + [("g", "THE cat\nthe the"), ("h", "nothing")]
    queries = ["aa aa", "The", "zzz", "", "   "]
    want = [(i, *hit) for i, q in enumerate(queries) for hit in model_keyword(q, docs)]
    got = keyword_rows(spark, queries, docs)
    assert got == want and len([g for g in got if g[0] == 0]) == 5 and got[0][3] == 10.0


words = st.text("abAB", min_size=1, max_size=4)


@FEW
@given(st.lists(st.lists(words, max_size=4).map(" ".join), min_size=1, max_size=6),
       st.lists(st.lists(words | st.just("\n"), max_size=12).map(" ".join), min_size=1, max_size=12))
def test_keyword_model(spark, queries, texts):
    docs = [(f"f{i:03d}", t) for i, t in enumerate(texts)]
    want = [(i, *hit) for i, q in enumerate(queries) for hit in model_keyword(q, docs)]
    assert keyword_rows(spark, queries, docs) == want


def test_keyword_in_cells(spark):
    docs = [(f"f{i:02d}", f"term{i % 7} x\nterm{i % 3} term") for i in range(40)]
    queries = [f"term{i} x{i}" for i in range(9)] + ["term"]
    terms = spark.createDataFrame([(i, q.split(), 5) for i, q in enumerate(queries)],
                                  "query_id long, terms array<string>, k int")
    rows = spark.createDataFrame([(n, c, c) for n, c in docs], "id string, content string, terms string")
    scorer = TermCounts()
    scorer.queries_per_cell = 3
    cell = F.lit(0)
    hits = keep_best(cell_scan(terms.withColumn("cell", cell), rows.withColumn("cell", cell), scorer,
                               rows_per_cell=11), terms)
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in hits.collect())
    assert got == [(i, r, n, s) for i, q in enumerate(queries) for r, n, s, _ in model_keyword(q, docs)]


def snippet_rows(spark, texts):
    return spark.createDataFrame([(f"s{i}", t, f"p{i}", 1, 1, [], None, None) for i, t in enumerate(texts)], SNIPPET)


def test_cascade(spark):
    queries = spark.createDataFrame([(1, "alpha"), (2, "amm"), (3, "nowhere")], "query_id long, query string")
    docs = spark.createDataFrame([("f", "gamma\ndelta"), ("g", "alpha")], "filename string, content string")
    vector, keyword = cascade(queries, snippet_rows(spark, ["alpha beta", "beta"]), docs)
    assert [(r.query_id, r.id) for r in vector.collect()] == [(1, "s0")]
    assert [(r.query_id, r.filename, r.matched_line) for r in keyword.collect()] == [(2, "f", "gamma")]
    by_model, _ = cascade(queries.filter("query_id = 1"),
                          snippet_rows(spark, ["a"]).withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")),
                          docs, model=lambda texts: [[1.0, 1.0] for _ in texts])
    assert round(by_model.first().score, 6) == round(0.5 ** 0.5, 6)


def test_model_failures(spark, tmp_path):
    calls = tmp_path / "calls"

    def model(texts):
        with open(calls, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        if "boom" in texts:
            raise RuntimeError("down")
        return [[float(t.count("a")), float(t.count("b"))] for t in texts]

    snips = snippet_rows(spark, ["aa", "bb"]).withColumn("embedding", F.when(F.col("content") == "aa", F.array(
        F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>"))
    docs = spark.createDataFrame([("f", "a boom"), ("g", "bb")], "filename string, content string")
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (4, "aab")], "query_id long, query string").coalesce(1)
    vector, keyword = cascade(queries, snips, docs, model, k=1)
    assert {(r.query_id, r.id) for r in vector.collect()} == {(1, "s0"), (2, "s1"), (4, "s0")} and not keyword.count()
    assert sorted(calls.read_text().split()) == ["a", "aab", "b"]  # one call per text
    failing = spark.createDataFrame([(1, "a"), (3, "boom"), (5, None)], "query_id long, query string").coalesce(1)
    vector, keyword = cascade(failing, snips, docs, model, k=1)
    assert [(r.query_id, r.id) for r in vector.collect()] == [(1, "s0")]
    assert [(r.query_id, r.filename) for r in keyword.collect()] == [(3, "f")]


def test_approximate_plan(spark):
    texts = [f"alpha{i} beta{i} gamma{i}" for i in range(30)]
    snips = snippet_rows(spark, texts).withColumn("embedding", hashed_unit(F.col("content")))
    queries = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "query_id long, query string, k int")
    hits = nearest(queries, snips, 5, approximate=True).collect()
    assert sorted((r.query_id, r.id, r.content) for r in hits) == [(i, f"s{i}", t) for i, t in enumerate(texts)]


def test_embedding_batches(spark):
    df = spark.range(250).coalesce(1).select(F.col("id").cast("string").alias("t"))
    sizes = df.select(embed_with(lambda texts: [[float(len(texts))] for _ in texts], F.col("t"))[0].alias("n"))
    assert {r.n for r in sizes.collect()} == {100.0, 50.0}
    with pytest.raises(Exception, match="mismatch between number of batch texts"):
        df.select(embed_with(lambda texts: [], F.col("t")).alias("v")).collect()


def test_dimension_check(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<float>")
    assert df.select(checked_dim(F.col("v"), 2).alias("v")).count() == 2
    with pytest.raises(Exception, match="dimensions"):
        df.select(checked_dim(F.col("v"), 3).alias("v")).collect()
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(normalised(F.col("v")).alias("u"))
    assert [[round(x, 6) for x in r.u] for r in unit.collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_word_memory_is_bounded():
    buckets = WordBuckets(16, remember=3)
    first = buckets.of("a b c d e f")
    assert len(buckets.bucket) <= 3 and buckets.of("a b c d e f") == first


def test_hashed_texts_stay_sparse(spark, monkeypatch):
    import hashlib
    import random
    from collections import Counter

    from textquarry.operators import topk
    from textquarry.operators.vector_search import search_text
    # Vectors of so many numbers would not fit; shared columns and several blocks of queries are met.
    monkeypatch.setattr(topk, "TEXT_QUERIES", 3)
    monkeypatch.setattr(topk, "OWN_COLUMNS", 2)
    monkeypatch.setattr(topk, "SHARED_COLUMNS", 3)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "of", *[f"w{i}" for i in range(40)]], k=rng.randrange(20))) for _ in range(150)] + ["w1 w2"] * 5
    asked = [" ".join(rng.choices(["the", *[f"w{i}" for i in range(40)]], k=rng.randrange(8))) for _ in range(10)] + ["zzz"]
    bag = lambda t: Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % (1 << 31) for w in t.split())
    want = set()
    for q, text in enumerate(asked):
        a, scores = bag(text), []
        for i, b in enumerate(map(bag, texts)):
            if dot := sum(n * b[w] for w, n in a.items()):
                scores.append((-round(dot / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5, 9), i))
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:3])}
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    scorer = lambda: topk.HashedText("text", 1 << 31, 16)
    for got in (search_text(queries, rows, 3, dim=1 << 31), topk.top_k(queries, rows, scorer(), 3), topk.top_k(queries, rows, scorer(), 3, broadcast_bytes=0)):
        assert {(r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in got.collect()} == want


def scanned(asked, texts, k):
    """Query, score and row by brute force; ties to the lower id."""
    from collections import Counter
    import hashlib
    bag = lambda t: Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 1536 for w in t.split())
    want, bags = [], [bag(t) for t in texts]
    for q, a in enumerate(map(bag, asked)):
        hits = [(dot, sum(n * n for n in b.values()), i) for i, b in enumerate(bags) if (dot := sum(n * b[w] for w, n in a.items()))]
        length = sum(n * n for n in a.values())
        want += [(q, -s, i) for s, i in sorted((-dot / np.sqrt(float(length * norm2)), i) for dot, norm2, i in hits)[:k]]
    return want


@pytest.mark.parametrize("sizes", [{}, {"FIRST_ROWS": 3, "MEET_ROWS": 40, "GROWTH": 2, "PAIRS": 5, "SCORED": 3, "FINE_COLUMNS": 2, "TEXT_QUERIES": 4},
                                   {"MEET_ENTRIES": 20, "FINE_COLUMNS": 0}, {"BYTE_WORDS": 0}, {"BYTE_WORDS": 9}, {"BYTE_CELLS": 10}])
def test_bytes_give_the_exact_hits(monkeypatch, sizes):
    import random

    from textquarry.operators import topk
    for name, value in sizes.items():
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(7)
    words = ["the"] * 30 + ["of"] * 15 + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(700)] + ["the of w1", "w1 of the"] * 9 + ["the " * 400, "w2"] + [f"w3 x{i}" for i in range(50)]
    asked = [" ".join(rng.choices(words, k=rng.randrange(1, 64))) for _ in range(25)] + ["w3", "the the the", "", "zzz", "w2 " * 63, "the of w1", texts[0] or "w9"]
    scorer = topk.HashedText()
    table = pd.DataFrame({"id": [f"{i:04d}" for i in range(len(texts))], "text": texts})
    best = scorer.holder(scorer.queries(pd.DataFrame({"text": asked})), np.arange(len(asked)), np.full(len(asked), 3))
    # Few words, and no more buckets than a table holds: then no matrix is made.
    few = [q for b in getattr(best, "bytes", []) for q in b.query_ids]
    limit = sizes.get("BYTE_WORDS", 64) if sizes.get("BYTE_CELLS") != 10 else 0
    assert sorted(few) == [q for q, t in enumerate(asked) if 0 < len(t.split()) <= limit]
    for part in (table[500:], table[:200], table[200:500]):
        best.add(part)
    got = sorted((r.query_id, -r.score, int(r.id)) for hits in best.hits() for r in hits.itertuples())
    want = sorted((q, -s, i) for q, s, i in scanned(asked, texts, 3))
    assert [(q, i) for q, _, i in got] == [(q, i) for q, _, i in want]
    assert np.allclose([s for _, s, _ in got], [s for _, s, _ in want], rtol=1e-12, atol=0)


def test_queries_beyond_a_broadcast_go_in_shares(spark, monkeypatch):
    from textquarry.operators import topk
    texts = [f"w{i % 7} w{i % 11} w{i}" for i in range(90)]
    asked = [f"w{i} w{i % 5}" for i in range(40)] + [None]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string").withColumn("k", (F.col("query_id") % 3).cast("int"))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = ranked(topk.top_k(queries, rows, topk.HashedText(), 3))
    monkeypatch.setattr(topk, "cell_scan", None)  # no text is shuffled
    assert ranked(topk.top_k(queries, rows, topk.HashedText(), 3, broadcast_bytes=1000)) == want and want


def test_texts_are_counted_in_parts(monkeypatch):
    from textquarry.functions import embedding
    texts = ["a b a", None, "", "c", "b b b a", "..."]
    want = [x.tolist() for x in WordBuckets(1536).counts(texts)]
    assert want[0] == [0, 0, 3, 4, 4] and sorted(want[2]) == [1, 1, 1, 2, 3]
    monkeypatch.setattr(embedding, "COUNT_WORDS", 2)
    assert [x.tolist() for x in WordBuckets(1536).counts(texts)] == want and [len(x) for x in WordBuckets(9).counts([])] == [0, 0, 0]
