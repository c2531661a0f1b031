"""Keyword search: term-frequency relevance, best line, top hits."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from textquarry.functions.embedding import Remembered
from textquarry.functions.text import query_terms
from textquarry.operators.topk import TASKS_PER_CORE, _Best, top_k

# Fixed value: hits per query.
KEYWORD_K = 5

# Any split at characters no term holds is safe; terms hold no whitespace at all.
_GAP = re.compile(r"[ \t\r\n]+")


class TermCounts:
    """Sum over the query's terms of their non-overlapping counts as substrings.

    Terms hold no whitespace, so a text's count is the sum over its words, and
    a word's counts are worked out once per task with one automaton pass.
    """

    positive_only = True
    slack = 0.5
    queries_per_cell = 500
    shares, tasks_per_core = 1, TASKS_PER_CORE

    def __init__(self, column: str = "terms", text: str = "content"):
        self.column = column
        self.text = text
        self.vocabulary = self.automaton = self.terms_in = None

    def query_bytes(self) -> Column:
        return F.sum(F.size(self.column)) * F.count("*") * 8

    def copies(self, rows: pd.DataFrame) -> pd.Series:
        return rows[self.column]

    def queries(self, rows: pd.DataFrame):
        vocabulary = sorted({t for terms in rows[self.column] for t in terms})
        place = {t: i for i, t in enumerate(vocabulary)}
        weights = np.zeros((len(rows), max(1, len(vocabulary))))
        for i, terms in enumerate(rows[self.column]):
            for term, times in Counter(terms).items():
                weights[i, place[term]] = times
        return weights, vocabulary

    def rows(self, q, rows: pd.DataFrame):
        self.fit(q[1])
        counts = np.zeros((len(rows), q[0].shape[1]))
        for i, text in enumerate(rows[self.column]):
            found = [term for word in _GAP.split(text) for term in self.terms_in[word]]
            if found:
                counts[i] = np.bincount(found, minlength=counts.shape[1])
        return (counts,)

    def rough(self, q, m) -> np.ndarray:
        return m[0] @ q[0].T

    def exact(self, q, m, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", q[0][qi], m[0][ri])

    def holder(self, prepared, query_ids: np.ndarray, k: np.ndarray) -> _Best:
        return _Best(self, prepared, query_ids, k)

    def fit(self, vocabulary: list[str]) -> None:
        """Build the automaton, once per block of queries."""
        if vocabulary is self.vocabulary:
            return
        self.vocabulary, self.automaton = vocabulary, ahocorasick.Automaton()
        for i, term in enumerate(vocabulary):
            self.automaton.add_word(term, (i, len(term)))
        if vocabulary:
            self.automaton.make_automaton()
        self.terms_in = Remembered(self._terms_in)

    def _terms_in(self, word: str) -> list[int]:
        """Vocabulary places found in a lowered word, repeated per occurrence."""
        found, ends = [], {}
        if word and len(self.automaton):
            for end, (term, length) in self.automaton.iter(word):
                if end - length >= ends.get(term, -1):
                    ends[term] = end
                    found.append(term)
        return found


def word_scores(terms: list[str]) -> Remembered:
    """Lowered word -> summed counts of the terms in it."""
    counter = TermCounts()
    weights, vocabulary = counter.queries(pd.DataFrame({"terms": [terms]}))
    counter.fit(vocabulary)
    return Remembered(lambda word: sum(weights[0, t] for t in counter.terms_in[word]))


def best_line(content: Column, terms: Column) -> Column:
    """First line with the strictly highest score, null if none scores."""

    @F.pandas_udf("string")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        asked, score_of = None, None
        for contents, term_lists in batches:
            out = []
            for text, words in zip(contents, term_lists):
                if asked != tuple(words):
                    asked, score_of = tuple(words), word_scores(words)
                best, found = 0, None
                for line in text.split("\n"):
                    score = sum([score_of[word] for word in _GAP.split(line.lower())])
                    if score > best:
                        best, found = score, line
                out.append(found)
            yield pd.Series(out, index=contents.index, dtype=object)

    return find(content, terms)


def keyword_search(queries: DataFrame, docs: DataFrame, k: int = KEYWORD_K) -> DataFrame:
    """Top documents per query by term frequency, with their best line.

    ``queries``: query_id, query. ``docs``: filename, content.
    Returns query_id, rank, filename, content, relevance, matched_line.
    """
    terms = queries.select("query_id", query_terms(F.col("query")).alias("terms")).filter(F.size("terms") > 0)
    rows = docs.select(F.col("filename").alias("id"), "content", F.lower("content").alias("terms"))
    hits = top_k(terms, rows, TermCounts(), k, payload=["content"])
    # The survivors, at most k per query, meet their terms again for the line to show.
    shown = hits.join(terms, "query_id").repartition(hits.sparkSession.sparkContext.defaultParallelism)
    return shown.select(
        "query_id", "rank", F.col("id").alias("filename"), "content", F.col("score").alias("relevance"),
        best_line(F.col("content"), F.col("terms")).alias("matched_line"))
