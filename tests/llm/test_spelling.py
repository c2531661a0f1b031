"""Spelling variants against neighbours made one by one."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

import numpy as np
import pyarrow as pa

from textquarry.llm import spelling


def damaged(doc_id, word):
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word if h % 97 else word[:h % len(word)] + word[h % len(word) + 1:]


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            counts[damaged(doc_id, "".join(c.lower() if c.isascii() else c for c in run))] += 1
    return grouped({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def grouped(words):
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def collected(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@given(st.lists(st.text("abé", min_size=1, max_size=5), max_size=40, unique=True), st.integers(0, 3))
@settings(max_examples=150, deadline=None)
def test_scan_meets_every_near_word_once(words, whole):
    words = {w: 1 + zlib.crc32(w.encode()) % 5 for w in sorted(words)}
    places = {w: i for i, w in enumerate(words)}
    kept, spelling.WHOLE = spelling.WHOLE, whole
    try:
        rows = sorted((key, kind, places[w], n) for w, n in words.items() for key, kind, _ in spelling.rotations(w))
    finally:
        spelling.WHOLE = kept
    columns = [np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3)]
    near, best = Counter(), {}
    for place, n, best_n, best_place in zip(*spelling.scan(pa.array([r[0] for r in rows], pa.binary()), *columns)):
        near[place] += n
        best[place] = max(best.get(place, (0, 0)), (best_n, -best_place))
    by = list(words)
    for w in words:
        others = [x for x in words if one_apart(w, x)]
        assert near[places[w]] == len(others)
        if others:
            assert by[-best[places[w]][1]] == min(others, key=lambda x: (-words[x], x))


def test_against_brute_force(spark):
    rows = [(i, f"Shelf shelfs sheff; éclair eclair Éclair HOUSE houses house's housed {'tabelle ' * (i % 4)}tabele") for i in range(60)]
    rows += [(None, "shelf " * 3), (7, None), (8, ""), (8, "  \n"), (9, "x" * 200 + " " + "x" * 199 + "y "), (None, None)]
    rows += [(i, "x" * 200 + " " + "x" * 199 + " " + "x" * 100 + "z" + "x" * 99) for i in range(200, 205)]
    rows += [(1, "shelf " * 50)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = collected(spelling.variants(spelling.word_counts(docs)))
    assert found == brute(rows) and found["shelfs"][0] == "shelf"


def test_long_words_meet_across_the_digest_bound(spark):
    words = {"a" * 64: 9, "a" * 65: 4, "a" * 66: 2, "a" * 30 + "b" + "a" * 34: 30, "ab" * 5_000: 8, "ab" * 5_000 + "a": 3,
             "ab" * 2_000 + "c" + "ba" * 2_999 + "b": 1}
    found = collected(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert found == grouped(words)


def test_ties_chains_and_awkward_columns(spark):
    words = {"caves": 4, "cover": 1, "coves": 2, "cares": 4, "raves": 8, "raven": 16, "rave": 8}
    rows = [(w, n, 0, "x") for w, n in words.items()] + [(None, 3, 0, "x"), ("lost", None, 0, "x")]
    table = spark.createDataFrame(rows, "word string, n long, place int, form string")
    assert collected(spelling.variants(table)) == grouped(words)
    assert spelling.variants(table.limit(0)).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string, word string, n int, id string")
    assert spelling.variants(spelling.word_counts(docs)).count() == 0


def test_a_lower_ratio_could_run_in_circles(spark):
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([("abcde", 3)], "word string, n long"), ratio=1)
