"""Learned decision lists: sequential covering over thresholds, given out as ordered Spark conditions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from textquarry.llm.common import stored
from textquarry.llm.text_stats import features, labelled_sample, with_counts

# Rows the list is learned from, at most; thresholds tried per measure; rules per list; conditions per rule.
SAMPLE_ROWS = 20_000
CUTS, RULES, CONDITIONS = 64, 16, 4
# A rule must be right on this share of the rows it covers in the part kept for pruning.
PRECISION = 0.9
MIN_WORDS, REPEAT_PERCENT = 20, 30


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c, t = F.col(self.measure), F.lit(self.threshold)
        return c > t if self.above else c <= t

    def mask(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        c = x[:, names.index(self.measure)]
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Condition, ...]


def _mask(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    return reduce(np.logical_and, (c.mask(x, names) for c in rule), np.ones(len(x), bool))


def _cuts(column: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring quantiles."""
    values = np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 1)))
    return (values[1:] + values[:-1]) / 2


def _best(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[float, Condition | None]:
    """The condition with the largest information gain over the rows still covered."""
    p, n = y.sum(), len(y) - y.sum()
    base = np.log2(max(p, 1e-9) / (p + n))
    best, found = 0.0, None
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        values, hits = x[order, j], np.concatenate([[0], np.cumsum(y[order])])
        cuts = _cuts(values)
        upto = np.searchsorted(values, cuts, side="right")
        for above, pos, covered in ((False, hits[upto], upto), (True, p - hits[upto], len(y) - upto)):
            gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1e-9) / np.maximum(covered, 1)) - base), 0)
            if len(gain) and gain.max() > best + 1e-9:
                k = int(gain.argmax())
                best, found = float(gain[k]), Condition(name, above, float(cuts[k]))
    return best, found


def _grow(x: np.ndarray, y: np.ndarray, names: list[str]) -> Rule:
    rule: Rule = ()
    while len(rule) < CONDITIONS and 0 < y.sum() < len(y):
        _, condition = _best(x, y, names)
        if condition is None:
            break
        rule += (condition,)
        inside = condition.mask(x, names)
        x, y = x[inside], y[inside]
    return rule


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray, names: list[str]) -> Rule:
    """The prefix of the rule with the best (right - wrong) / covered on rows it was not grown on; the shorter on a tie."""
    def value(r: Rule) -> float:
        m = _mask(r, x, names)
        return (2 * y[m].sum() - m.sum()) / m.sum() if m.any() else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (value(r), -len(r)))


def learn(x: np.ndarray, rejected: np.ndarray, names: list[str]) -> list[Rule]:
    """Rules that reject, in order. Each is grown on two thirds of the rows still uncovered and pruned on the rest."""
    rules: list[Rule] = []
    for k in range(RULES):
        if not 0 < rejected.sum() < len(rejected):
            break
        prune = np.random.default_rng(k).random(len(x)) < 1 / 3
        rule = _grow(x[~prune], rejected[~prune], names)
        if not rule or not prune.any():
            break
        rule = _prune(rule, x[prune], rejected[prune], names)
        m = _mask(rule, x[prune], names)
        if not m.any() or rejected[prune][m].mean() < PRECISION:
            break
        rules.append(rule)
        left = ~_mask(rule, x, names)
        x, rejected = x[left], rejected[left]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the first rule that holds rejects, none keeps."""
    out = F.when(F.lit(False), False)
    for rule in rules:
        out = out.when(reduce(lambda a, b: a & b, (c.column() for c in rule)), False)
    return out.otherwise(True)


def first_rule(rules: list[Rule]) -> Column:
    """Number of the rule that holds first, from 1; null for none."""
    out = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules, 1):
        out = out.when(reduce(lambda a, b: a & b, (c.column() for c in rule)), F.lit(i))
    return out


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts, base verdict and the learned verdict of every document.

    Input: ``docs`` (doc_id, text) and ``labels`` (doc_id, quality; 0 is to be rejected). One row per row of ``docs``.
    Null and empty texts have no words and fail the base rule; without usable labels the list is empty and keeps all
    that the base rule keeps. The list is learned on up to about ``sample_rows`` labelled rows; counts cover all rows.
    """
    measures = features()
    names = list(measures)
    rows = stored(with_counts(docs, ["doc_id"]), "counts")
    measured = rows.select("*", *[c.alias(n) for n, c in measures.items()])
    x, y = labelled_sample(measured, labels, "quality", names, sample_rows)
    rules = learn(x, (y == 0).astype(int), names)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (measured.withColumn("base_failed", failed).withColumn("rule", first_rule(rules).cast("int"))
            .withColumn("kept", ~F.col("base_failed") & verdict(rules)))
