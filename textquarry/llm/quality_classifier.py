"""Hierarchical empirical Bayes: a document's own evidence, moved by what its path and host are like."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from textquarry.llm.common import small_side, stored
from textquarry.llm.text_stats import counted, features, labelled_sample, with_counts

# Labelled rows the document classifier is fitted on, at most.
SAMPLE_ROWS = 20_000
# Bounds of the pseudo-counts a level gives its parent; limits on the evidence of one document and of one site.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
EVIDENCE, SITE = 8.0, 3.0


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's method; returns means, scales and weights (the constant last)."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def strength(rate: str, n: str, parent: Column) -> Column:
    """Pseudo-counts of the prior, by moments: how much more rates differ between groups than chance alone would make
    them. An aggregate over groups; groups that agree give much weight to the parent, groups that differ little."""
    spread = F.sum(F.col(n) * F.pow(F.col(rate) - parent, 2))
    chance = F.sum(parent * (1 - parent))
    excess = F.greatest(F.lit(0.0), (spread - chance) / F.greatest(F.sum(F.col(n)) - F.count("*"), F.lit(1)))
    within = F.sum(F.col(n) * parent * (1 - parent)) / F.sum(n)
    return F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), F.coalesce(
        F.when(excess > 0, within / excess - 1), F.lit(MOST_STRENGTH))))


def _shrunk(groups: DataFrame, parent: str) -> DataFrame:
    """Adds ``posterior``: the group's rate, drawn to its parent's by the level's strength."""
    prior = float(groups.agg(strength("rate", "n", F.col(parent)).alias("strength")).first()["strength"])
    return groups.withColumn(
        "posterior", (F.col("rate") * F.col("n") + F.col(parent) * prior) / (F.col("n") + prior))


@dataclass
class Classifier:
    """What is learned: log odds as an expression over ``features``, and the sites with their posteriors."""

    evidence: Column
    sites: DataFrame | None

    def judged(self, rows: DataFrame, threshold: float) -> DataFrame:
        """Adds evidence, host_posterior, path_posterior, score and kept to rows with host, path and features."""
        if self.sites is None:
            half = F.lit(0.5)
            return rows.withColumns({"evidence": F.lit(0.0), "host_posterior": half, "path_posterior": half, "score": half,
                                     "kept": F.lit(True)})
        rows = rows.withColumn("evidence", self.evidence).join(
            self.sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
        site = F.greatest(F.lit(-SITE), F.least(F.lit(SITE), _logit(F.col("path_posterior")) - _logit(F.col("global"))))
        score = 1 / (1 + F.exp(-(F.col("evidence") + site)))
        return rows.withColumn("score", score).withColumn("kept", F.col("score") >= threshold).drop("h", "p", "global")


def _measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    rows = with_counts(docs, [*keep, "host", "path"])
    return rows.select(*keep, "host", "path", *[c.alias(n) for n, c in features().items()])


def fit(rows: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Learn from stored rows with doc_id, host, path and features. Site sums are combined in the tasks before the
    shuffle, so a host with a third of all rows is one row per task and path."""
    names = list(features())
    x, y = labelled_sample(rows, labels, "quality", names, sample_rows)
    if not 0 < (y > 0).sum() < len(y):
        return Classifier(F.lit(0.0), None)
    mean, scale, w = fit_logistic(x, (y > 0).astype(float))
    odds = sum(((F.col(n) - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(v))
                for n, m, s, v in zip(names, mean, scale, w)), F.lit(float(w[-1])))
    evidence = F.greatest(F.lit(-EVIDENCE), F.least(F.lit(EVIDENCE), odds))
    known = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
             .agg(F.avg("quality").alias("quality")).select(F.col("doc_id").alias("labelled"), "quality"))
    good = F.coalesce(F.col("quality"), 1 / (1 + F.exp(-evidence)))
    paths = stored(rows.join(known, F.col("doc_id") == F.col("labelled"), "left").groupBy("host", "path").agg(
        F.sum(good).alias("good"), F.count("*").cast("double").alias("n")), "paths")
    rate = (F.sum("good") / F.sum("n")).alias("rate")
    overall = paths.agg(rate).first()["rate"]
    hosts = (paths.groupBy("host").agg(rate, F.sum("n").alias("n"))
             .withColumn("global", F.lit(0.5 if overall is None else float(overall))))
    hosts = _shrunk(hosts, "global").select(F.col("host").alias("h"), F.col("posterior").alias("host_posterior"), "global")
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).withColumn("rate", F.col("good") / F.col("n"))
    sites = _shrunk(sites, "host_posterior").select(
        "h", F.col("path").alias("p"), "host_posterior", F.col("posterior").alias("path_posterior"), "global")
    return Classifier(evidence, small_side(stored(sites, "sites")))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5,
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Quality of every document.

    Input: ``docs`` with doc_id, text and what ``host`` and ``path`` (within the host) are made of; ``labels`` with doc_id
    and quality (1 good). One row per row of ``docs``: doc_id, host, path, evidence (log odds of the text alone),
    host_posterior, path_posterior, score and kept.

    The document classifier is fitted on up to about ``sample_rows`` labelled rows. A labelled document counts as its
    label at its site, any other as its probability, over all documents; a host is shrunk to the global rate, a path to
    its host. The score joins the document's log odds with how the path's differ from the global ones. Null hosts and
    paths are sites of their own; empty and null texts have the evidence of a text without words; labels that disagree
    are left out of the fit and count as their mean. Without labels of both kinds everything is kept with score 0.5.
    """
    rows = docs.select("doc_id", "text", host.alias("host"), path.alias("path"))
    rows = stored(_measured(rows, ["doc_id"]), "measures")
    return fit(rows, labels, sample_rows).judged(rows, threshold).select(
        "doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "score", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, all columns whatever their names. Texts are read once more instead of being shuffled to
    their verdicts, and only they pass through Python. A score equal to the threshold keeps the row."""
    measures = [c.alias(n) for n, c in features().items()]
    slim = docs.select("doc_id", host.alias("host"), path.alias("path"), counted(F.col("text")).alias("c")).select("doc_id", "host", "path", "c.*")
    learned = fit(stored(slim.select("doc_id", "host", "path", *measures), "measures"), labels)
    columns = [F.col(c).alias(f"d{i}") for i, c in enumerate(docs.columns)]
    names = [f"d{i}" for i in range(len(docs.columns))]
    wide = docs.select(*columns, host.alias("host"), path.alias("path"), counted(F.col("text")).alias("c")).select(*names, "host", "path", "c.*")
    wide = wide.select(*names, "host", "path", *measures)
    judged = learned.judged(wide, threshold).where("kept")
    return judged.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(docs.columns)])
