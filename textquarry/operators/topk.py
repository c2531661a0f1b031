"""Exact top-k of many queries against a large table.

The table is scanned once. Each task scores its rows against a block of
queries with a matrix product and keeps the k best rows per query, so no
(query, row) pair is ever emitted: a task hands on at most k rows per query,
and one ranked window merges them.

A scorer turns queries and rows into matrices. The product of the first
matrices ranks roughly; pairs within ``slack`` of a query's k-th score are
scored again exactly, and only exact scores decide.

The query side travels in one of three ways:

* up to ``BROADCAST_BYTES`` (checked) it is broadcast;
* queries on hashed texts go in up to ``SHARES`` such broadcasts, each with a
  scan of its own, so no text is shuffled;
* beyond that both sides are cut into blocks and meet cell by cell in a
  co-grouped job, where a block's size is bounded from counted rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from textquarry.functions.embedding import DEFAULT_DIM, WordBuckets
from textquarry.session import spread

BROADCAST_BYTES = 256 * 1024 * 1024
SCORE_CELLS = 8_000_000
ROWS_PER_CELL = 50_000
TASKS_PER_CORE = 16
SCORE_DECIMALS = 9
EXACT_PAIRS = 4096
HIT_BYTES = 256
# Queries and rows of hashed texts that meet at once; the most frequent buckets of a block are columns of their own, all others share columns.
TEXT_QUERIES, TEXT_ROWS = 2048, 1024
OWN_COLUMNS, SHARED_COLUMNS = 64, 320
# Queries of up to so many words meet rows in bytes: rows and entries at once, the first rows, whose number then grows, and bytes of the table.
BYTE_WORDS = 64
MEET_ROWS, MEET_ENTRIES, FIRST_ROWS, GROWTH, BYTE_CELLS = 32_768, 2_000_000, 1024, 8, 1 << 26
# Scales of the bytes are powers of this. Floors are lowered, and bounds raised, by so much against rounding.
SCALE_STEP, FLOOR_SLACK, BYTE_SLACK = 1.4, 1e-5, 1e-3
# So many most frequent buckets have what their bytes were rounded up by; pairs that are looked at more closely at once, and scored at once.
FINE_COLUMNS, PAIRS, SCORED = 48, 32_768, 2048
# Broadcasts that one search may take.
SHARES = 64


class DenseVectors:
    """Cosine of two array<float> columns.

    Exact scores are rounded so that equal vectors tie whatever the summation
    order; ties go to the lower id.
    """

    positive_only = False
    slack = 1e-4
    queries_per_cell = 20_000
    shares, tasks_per_core = 1, TASKS_PER_CORE

    def __init__(self, column: str = "embedding"):
        self.column = column

    def query_bytes(self) -> Column:
        return F.sum(F.size(self.column)) * 12

    def copies(self, rows: pd.DataFrame) -> pd.Series:
        return rows[self.column].map(lambda v: np.asarray(v).tobytes())

    def queries(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return self.rows(None, rows)

    def rows(self, q, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        m = np.stack([np.asarray(v, dtype=np.float64) for v in rows[self.column]])
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        unit = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
        return unit.astype(np.float32), unit

    def rough(self, q, m) -> np.ndarray:
        return m[0] @ q[0].T

    def exact(self, q, m, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
        return np.round(np.einsum("ij,ij->i", q[1][qi], m[1][ri]), SCORE_DECIMALS)

    def holder(self, prepared, query_ids: np.ndarray, k: np.ndarray) -> "_Best":
        return _Best(self, prepared, query_ids, k)


class Counts(NamedTuple):
    """Word counts of texts: entries in order of text and bucket, and each text's squared length."""

    at: np.ndarray
    bucket: np.ndarray
    n: np.ndarray
    norm2: np.ndarray

    def part(self, start: int, end: int) -> "Counts":
        first, last = np.searchsorted(self.at, [start, end])
        return Counts(self.at[first:last] - start, self.bucket[first:last], self.n[first:last], self.norm2[start:end])

    def take(self, texts: np.ndarray) -> "Counts":
        """The texts numbered so, in ascending order."""
        place = np.full(len(self.norm2), -1, dtype=np.int32)
        place[texts] = np.arange(len(texts), dtype=np.int32)
        here = place[self.at] >= 0
        return Counts(place[self.at[here]], self.bucket[here], self.n[here], self.norm2[texts])

    @staticmethod
    def joined(parts: list["Counts"]) -> "Counts":
        if len(parts) == 1:
            return parts[0]
        first = np.cumsum([0, *[len(c.norm2) for c in parts[:-1]]]).astype(np.int32)
        return Counts(np.concatenate([c.at + f for c, f in zip(parts, first)]), *(np.concatenate(x) for x in list(zip(*parts))[1:]))


class HashedText:
    """Cosine of hashed word counts.

    Counts are whole numbers, so exact products and squared lengths hold no
    rounding and equal texts tie exactly. A row sharing no bucket is no hit.
    Texts stay sparse, so any ``dim`` will do; see ``_ByteBest`` and ``_HashedBest``.
    """

    queries_per_cell = 20_000
    shares, tasks_per_core = SHARES, 4

    def __init__(self, column: str = "text", dim: int = DEFAULT_DIM, step: int = MEET_ROWS):
        self.column, self.step = column, step
        self.buckets = WordBuckets(dim)

    def query_bytes(self) -> Column:
        # A word and the gap behind it are two bytes at least; its entry takes 20.
        return F.count("*") * 64 + F.sum(F.octet_length(self.column)) * 10

    def copies(self, rows: pd.DataFrame) -> pd.Series:
        return rows[self.column]

    def queries(self, rows: pd.DataFrame) -> Counts:
        at, bucket, n = self.buckets.counts(rows[self.column])
        n = n.astype(np.float64)
        return Counts(at.astype(np.int32), bucket, n.astype(np.float32), np.bincount(at, weights=n * n, minlength=len(rows)))

    def holder(self, prepared: Counts, query_ids: np.ndarray, k: np.ndarray) -> "_HashedBlocks":
        return _HashedBlocks(self, prepared, query_ids, k)


class _Best:
    """The k best rows per query a task has seen: score descending, then id. Each query has its own k."""

    def __init__(self, scorer, prepared, query_ids: np.ndarray, k: np.ndarray):
        self.scorer, self.q, self.query_ids, self.k = scorer, prepared, query_ids, k
        self.floor = np.full(len(query_ids), -np.inf)
        self.at = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.ids = np.empty(0, dtype=object)

    def add(self, rows: pd.DataFrame) -> None:
        # Of rows with one and the same content only the k lowest ids can place.
        rows = rows.sort_values("id")
        rows = rows[rows.groupby(self.scorer.copies(rows), sort=False).cumcount() < self.k.max()]
        step = max(64, SCORE_CELLS // max(1, *self.q[0].shape))
        for start in range(0, len(rows), step):
            self._add_part(rows.iloc[start:start + step])

    def _add_part(self, rows: pd.DataFrame) -> None:
        m = self.scorer.rows(self.q, rows)
        rough = self.scorer.rough(self.q, m)
        bound = self.floor - self.scorer.slack
        n = len(rows)
        cold = np.isneginf(self.floor) & (self.k < n)
        for k in np.unique(self.k[cold]):
            some = cold & (self.k == k)
            kth = np.partition(np.ascontiguousarray(rough[:, some].T), n - k, axis=1)[:, n - k]
            bound[some] = kth - 2 * self.scorer.slack
        hit = rough >= bound.astype(rough.dtype)
        if self.scorer.positive_only:
            hit &= rough > 0
        ri, qi = np.nonzero(hit)
        if not len(qi):
            return
        score = np.concatenate([
            self.scorer.exact(self.q, m, qi[i:i + EXACT_PAIRS], ri[i:i + EXACT_PAIRS])
            for i in range(0, len(qi), EXACT_PAIRS)])
        keep = score >= self.floor[qi]
        qi, ri, score = qi[keep], ri[keep], score[keep]
        self.ids = np.concatenate([self.ids, rows["id"].to_numpy(dtype=object)[ri]])
        self.at = np.concatenate([self.at, qi])
        self.score = np.concatenate([self.score, score])
        self._prune()

    def _prune(self) -> None:
        id_rank = np.unique(self.ids, return_inverse=True)[1]
        order = np.lexsort((id_rank, -self.score, self.at))
        at = self.at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < self.k[at]
        last = place[kept] == self.k[at[kept]] - 1
        order = order[kept]
        self.at, self.score, self.ids = self.at[order], self.score[order], self.ids[order]
        self.floor = np.full(len(self.floor), -np.inf)
        self.floor[self.at[last]] = self.score[last]

    def hits(self) -> Iterator[pd.DataFrame]:
        if len(self.at):
            yield pd.DataFrame({"query_id": self.query_ids[self.at], "score": self.score, "id": self.ids})


class _HashedBest(_Best):
    """The k best texts of a block of queries.

    All counts are positive, so summing buckets into fewer columns can only raise a product: the product of the narrow matrices is an
    upper bound. Only pairs whose bound reaches the query's k-th score so far are scored, exactly. Buckets that only one side has
    are left out, and of the others the most frequent have a column of their own.
    """

    slack = 1e-4

    def add_counts(self, ids: np.ndarray, m: Counts) -> None:
        q = self.q
        common = np.intersect1d(q.bucket, m.bucket)
        if not len(common):
            return
        q, m = (Counts(*(x[np.isin(c.bucket, common)] for x in c[:3]), c.norm2) for c in (q, m))
        place = [np.searchsorted(common, c.bucket) for c in (q, m)]
        often = np.bincount(place[0], minlength=len(common)) * np.bincount(place[1], minlength=len(common))
        column = np.empty(len(common), dtype=np.int64)
        order = np.argsort(-often, kind="stable")
        column[order] = np.where(np.arange(len(common)) < OWN_COLUMNS, np.arange(len(common)), OWN_COLUMNS + np.arange(len(common)) % SHARED_COLUMNS)
        width = int(column.max()) + 1
        narrow = np.ascontiguousarray(self._narrow(q, column[place[0]], width).T)
        starts = np.searchsorted(q.at, np.arange(len(q.norm2) + 1))
        step = min(TEXT_ROWS, self.scorer.step)
        for start in range(0, len(ids), step):
            end = min(start + step, len(ids))
            first, last = np.searchsorted(m.at, [start, end])
            part = Counts(m.at[first:last] - start, place[1][first:last], m.n[first:last], m.norm2[start:end])
            bound = self._narrow(part, column[part.bucket], width) @ narrow
            self._meet(ids[start:end], bound, (place[0], q.n, starts), part, len(common))

    @staticmethod
    def _narrow(c: Counts, column: np.ndarray, width: int) -> np.ndarray:
        weight = c.n / np.sqrt(c.norm2)[c.at]
        return np.bincount(c.at * np.int64(width) + column, weights=weight, minlength=len(c.norm2) * width).reshape(-1, width).astype(np.float32)

    def _meet(self, ids: np.ndarray, bound: np.ndarray, q: tuple, m: Counts, width: int) -> None:
        cold = np.flatnonzero(np.isneginf(self.floor))
        scored = np.zeros(bound.shape, dtype=bool) if len(cold) else None
        if len(cold) and self.k[cold].max() < len(ids):
            # Promising rows first: their scores give a floor.
            k = int(self.k[cold].max())
            some = np.argpartition(-bound[:, cold], k - 1, axis=0)[:k]
            ri, qi = some.ravel(), np.broadcast_to(cold, some.shape).ravel()
            good = bound[ri, qi] > 0
            ri, qi = ri[good], qi[good]
            scored[ri, qi] = True
            self._keep(ids, ri, qi, self._scores(ri, qi, q, m, width))
            self._prune()
        hit = bound >= np.maximum(self.floor - self.slack, 1e-12).astype(np.float32)
        if scored is not None:
            hit &= ~scored
        found = np.flatnonzero(hit)
        ri, qi = found // bound.shape[1], found % bound.shape[1]
        self._keep(ids, ri, qi, self._scores(ri, qi, q, m, width))
        if len(self.at) > 2 * self.k.sum():
            self._prune()

    def _keep(self, ids: np.ndarray, ri: np.ndarray, qi: np.ndarray, score: np.ndarray) -> None:
        keep = (score > 0) & (score >= self.floor[qi])
        self.ids = np.concatenate([self.ids, ids[ri[keep]]])
        self.at = np.concatenate([self.at, qi[keep]])
        self.score = np.concatenate([self.score, score[keep]])

    def _scores(self, ri: np.ndarray, qi: np.ndarray, q: tuple, m: Counts, width: int) -> np.ndarray:
        """Exact scores of pairs that are in order of row, or few."""
        place, n, starts = q
        out = np.zeros(len(ri))
        rows = max(1, SCORE_CELLS // width)
        for low in range(0, len(m.norm2), rows):
            here = np.flatnonzero((ri >= low) & (ri < low + rows)) if rows < len(m.norm2) else np.arange(len(ri))
            if not len(here):
                continue
            part = m.part(low, min(low + rows, len(m.norm2)))
            wide = np.zeros((len(part.norm2), width), dtype=np.float32)
            wide[part.at, part.bucket] = part.n
            for i in range(0, len(here), 16 * EXACT_PAIRS):
                some = here[i:i + 16 * EXACT_PAIRS]
                first, size = starts[qi[some]], starts[qi[some] + 1] - starts[qi[some]]
                ends = np.cumsum(size)
                entry = np.arange(ends[-1]) + np.repeat(first - ends + size, size)
                flat = place[entry] + np.repeat((ri[some] - low) * width, size)
                # Whole numbers: running sums are exact.
                total = np.concatenate([[0.0], np.cumsum(wide.reshape(-1)[flat].astype(np.float64) * n[entry])])
                out[some] = total[ends] - total[ends - size]
        scale = np.sqrt(self.q.norm2[qi] * m.norm2[ri])
        return np.divide(out, scale, out=np.zeros_like(out), where=scale > 0)


class _Listed:
    """Rows by bucket, of the buckets that queries have."""

    def __init__(self, ids: np.ndarray, m: Counts, buckets: np.ndarray):
        at = np.minimum(np.searchsorted(buckets, m.bucket), len(buckets) - 1)
        asked = buckets[at] == m.bucket
        self.ids, self.norm2, self.at, n = ids, m.norm2, m.at[asked], m.n[asked].astype(np.float64)
        # The most frequent buckets come first and lie together.
        size = np.bincount(at[asked], minlength=len(buckets))
        order = np.argsort(-size, kind="stable")[:np.count_nonzero(size)]
        self.of = np.full(len(buckets), -1, dtype=np.int32)
        self.of[order] = np.arange(len(order), dtype=np.int32)
        column = self.of[at[asked]]
        self.asked, self.column, self.n, self.width = buckets, column, n, len(order)
        self.starts = np.searchsorted(self.at, np.arange(len(ids) + 1))
        # Ties go to the lower id.
        place = pd.factorize(ids, sort=True)[0]
        self.place = np.where(place < 0, len(ids), place)
        self.weight = n / np.sqrt(m.norm2)[self.at]
        # A row that counts several times is longer than its squares say.
        self.longest = max(1.0, float(np.sqrt(np.bincount(self.at, weights=self.weight ** 2).max()))) if len(n) else 1.0
        self.cell = column.astype(np.int64) * len(ids) + self.at
        self.fine = np.flatnonzero(column < FINE_COLUMNS)

    def table(self, room: np.ndarray, scale: float) -> tuple[list[np.ndarray], np.ndarray]:
        """Per bucket the rows' weights times ``scale``, rounded up to bytes; per row, by how much those of the first buckets were."""
        cells = room[:self.width * len(self.ids)]
        whole = self.weight * scale
        up = np.ceil(whole)
        cells[self.cell] = up
        fine = np.zeros((len(self.ids), min(self.width, FINE_COLUMNS)), dtype=np.float32)
        fine[self.at[self.fine], self.column[self.fine]] = up[self.fine] - whole[self.fine]
        return list(cells.reshape(self.width, len(self.ids))), fine


class _ByteBest(_Best):
    """The k best texts of a block of queries of few words.

    The rows' weights are bytes, rounded up, and a query is the sum of its words' columns: an upper bound, at a small part of a matrix product's
    time. The scale leaves room for the rounding, so no sum runs over. Pairs whose bound reaches the query's k-th score so far get a closer bound, without
    the rounding of the frequent buckets; those that it leaves are scored, exactly.
    """

    def __init__(self, scorer: HashedText, prepared: Counts, query_ids: np.ndarray, k: np.ndarray, scale: float):
        super().__init__(scorer, prepared, query_ids, k)
        self.scale, self.length = scale, np.sqrt(prepared.norm2)

    def meet(self, rows: _Listed, table: list[np.ndarray], fine: np.ndarray, scale: float) -> None:
        q, n_queries = self.q, len(self.q.norm2)
        column = rows.of[np.searchsorted(rows.asked, q.bucket)]
        order = np.lexsort((column, q.at))
        order = order[column[order] >= 0]
        at, column, n = q.at[order], column[order], q.n[order].astype(np.int64)
        counts = np.zeros((n_queries, rows.width), dtype=np.uint8)
        counts[at, column] = n
        cuts = np.searchsorted(np.repeat(at, n), np.arange(n_queries + 1)).tolist()
        numbers = np.repeat(column, n).tolist()
        least = np.where(self.floor > 0, scale * self.length * self.floor * (1 - FLOOR_SLACK), 0)
        bounds, k = np.ceil(least).astype(np.int64).tolist(), self.k.tolist()
        sums, hit = np.empty(len(rows.ids), dtype=np.uint8), np.empty(len(rows.ids), dtype=bool)
        add, reaches = np.add, np.greater_equal
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0
        for i in range(n_queries):
            mine = numbers[cuts[i]:cuts[i + 1]]
            if not mine:
                continue
            total = table[mine[0]]
            for w in mine[1:]:
                total = add(total, table[w], sums)
            bound = bounds[i]
            if not bound:
                # No floor yet: a sum is above the weight by less than one a word.
                bound = max(1, int(np.partition(total, -k[i])[-k[i]]) - len(mine)) if len(total) > k[i] else 1
            ri = reaches(total, bound, hit).nonzero()[0]
            if len(ri):
                found.append((i, ri, total[ri]))
                size += len(ri)
            if size > PAIRS:
                self._settle(found, rows, fine, scale, counts)
                found, size = [], 0
        if found:
            self._settle(found, rows, fine, scale, counts)

    def _settle(self, found: list, rows: _Listed, fine: np.ndarray, scale: float, counts: np.ndarray) -> None:
        """Scores pairs (in order of query) and keeps the best."""
        qi = np.repeat([i for i, _, _ in found], [len(ri) for _, ri, _ in found])
        ri, total = (np.concatenate([f[x] for f in found]) for x in (1, 2))
        often = counts[:, :fine.shape[1]].astype(np.float32)
        bound = total - np.einsum("ij,ij->i", fine[ri], often[qi]) + BYTE_SLACK
        # Promising rows first: their scores give a floor, or raise it.
        order = np.lexsort((-bound, qi))
        at = qi[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < 2 * self.k[at]
        for some in (order[first], order[~first]):
            least = scale * self.length * np.maximum(self.floor, 0) * (1 - FLOOR_SLACK)
            some = some[bound[some] >= least[qi[some]]]
            self._take(qi[some], ri[some], rows, counts)

    def _take(self, qi: np.ndarray, ri: np.ndarray, rows: _Listed, counts: np.ndarray) -> None:
        score = np.concatenate([self._scores(qi[i:i + SCORED], ri[i:i + SCORED], rows, counts) for i in range(0, len(qi), SCORED)] or [np.empty(0)])
        keep = score >= np.maximum(self.floor[qi], np.finfo(float).tiny)
        qi, ri, score = qi[keep], ri[keep], score[keep]
        # Of these rows a query's first k can place.
        order = np.lexsort((rows.place[ri], -score, qi))
        at = qi[order]
        order = order[np.arange(len(at)) - np.searchsorted(at, at) < self.k[at]]
        self.ids = np.concatenate([self.ids, rows.ids[ri[order]]])
        self.at = np.concatenate([self.at, qi[order]])
        self.score = np.concatenate([self.score, score[order]])
        # Floors need no order of ids.
        order = np.lexsort((-self.score, self.at))
        at = self.at[order]
        last = order[np.arange(len(at)) - np.searchsorted(at, at) == self.k[at] - 1]
        self.floor[self.at[last]] = self.score[last]
        keep = self.score >= self.floor[self.at]
        self.ids, self.at, self.score = self.ids[keep], self.at[keep], self.score[keep]
        if len(self.at) > 2 * self.k.sum():
            self._prune()

    def _scores(self, qi: np.ndarray, ri: np.ndarray, rows: _Listed, counts: np.ndarray) -> np.ndarray:
        """Exact scores."""
        entry, pair = _ragged(rows.starts[ri], rows.starts[ri + 1])
        # Whole numbers: sums are exact.
        dot = np.bincount(pair, weights=counts[qi[pair], rows.column[entry]] * rows.n[entry], minlength=len(qi))
        return dot / np.sqrt(self.q.norm2[qi] * rows.norm2[ri])


def _ragged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start up to its end, and whose they are."""
    size = ends - starts
    last = np.cumsum(size)
    whose = np.repeat(np.arange(len(size)), size)
    return np.arange(len(whose)) + (starts - last + size)[whose], whose


class _TextBlocks:
    """Blocks of queries on texts; each keeps its own best."""

    def add(self, rows: pd.DataFrame) -> None:
        # As in _Best: of copies only the k lowest ids can place.
        rows = rows.sort_values("id")
        rows = rows[rows.groupby(self.scorer.copies(rows), sort=False).cumcount() < self.most]
        self.add_counts(rows["id"].to_numpy(dtype=object), self.scorer.queries(rows))

    def add_counts(self, ids: np.ndarray, m) -> None:
        for block in self.blocks:
            block.add_counts(ids, m)

    def hits(self) -> Iterator[pd.DataFrame]:
        for block in self.blocks:
            if len(block.at):
                block._prune()
            yield from block.hits()


class _HashedBlocks(_TextBlocks):
    """Queries of few words are ordered by the scale of their bytes; rows are gathered for them until a table is filled. The others are met by matrix products."""

    def __init__(self, scorer: HashedText, q: Counts, query_ids: np.ndarray, k: np.ndarray):
        self.scorer, self.most = scorer, int(k.max()) if len(k) else 0
        words = np.bincount(q.at, weights=q.n, minlength=len(query_ids))
        few = (words > 0) & (words <= BYTE_WORDS)
        self.buckets = np.unique(q.bucket[few[q.at]])
        self.room = BYTE_CELLS // max(1, len(self.buckets))
        if self.room < min(MEET_ROWS, scorer.step) // 4:
            few[:] = False
        step = np.full(len(words), -1)
        step[few] = np.floor(np.log((255 - words[few]) / np.sqrt(q.norm2[few])) / np.log(SCALE_STEP))
        self.bytes, self.blocks = [], []
        for value in np.unique(step):
            mine = np.flatnonzero(step == value)
            for some in (mine[i:i + TEXT_QUERIES] for i in range(0, len(mine), TEXT_QUERIES)):
                if value < 0:
                    self.blocks.append(_HashedBest(scorer, q.take(some), query_ids[some], k[some]))
                else:
                    self.bytes.append(_ByteBest(scorer, q.take(some), query_ids[some], k[some], SCALE_STEP ** value))
        self.room = min(self.room, MEET_ROWS, scorer.step)
        self.table = np.empty(0, dtype=np.uint8)
        self.rows, self.entries, self.waiting, self.full = 0, 0, [], min(self.room, FIRST_ROWS)

    def add_counts(self, ids: np.ndarray, m: Counts) -> None:
        super().add_counts(ids, m)
        starts = np.searchsorted(m.at, np.arange(len(ids) + 1))
        low = 0
        while self.bytes and low < len(ids):
            high = min(low + self.full - self.rows, int(np.searchsorted(starts, starts[low] + MEET_ENTRIES - self.entries)), len(ids))
            high = max(high, low + 1)
            self.waiting.append((ids[low:high], m.part(low, high)))
            self.rows, self.entries = self.rows + high - low, self.entries + int(starts[high] - starts[low])
            if self.rows >= self.full or self.entries >= MEET_ENTRIES:
                self._meet()
            low = high

    def _meet(self) -> None:
        rows = _Listed(np.concatenate([ids for ids, _ in self.waiting]), Counts.joined([m for _, m in self.waiting]), self.buckets)
        self.rows, self.entries, self.waiting, self.full = 0, 0, [], min(self.room, self.full * GROWTH)
        if not rows.width:
            return
        if len(self.table) < rows.width * len(rows.ids):
            self.table = np.empty(rows.width * len(rows.ids), dtype=np.uint8)
        self.table.fill(0)
        scale = None
        for block in self.bytes:
            if block.scale != scale:
                scale = block.scale
                table, fine = rows.table(self.table, scale / rows.longest)
            block.meet(rows, table, fine, scale / rows.longest)

    def hits(self) -> Iterator[pd.DataFrame]:
        if self.waiting:
            self._meet()
        yield from super().hits()
        self.blocks = self.bytes
        yield from super().hits()


def _hit_schema(queries: DataFrame, rows: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("score", T.DoubleType()),
        T.StructField("id", rows.schema["id"].dataType)])


def keep_best(hits: DataFrame, k: int | DataFrame) -> DataFrame:
    """Rank hits per query, score descending then id, and keep the first k.

    ``k`` is one number, or a table with each query's own (query_id, k).
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    ranked = hits.withColumn("rank", F.row_number().over(order))
    if isinstance(k, int):
        return ranked.filter(F.col("rank") <= k)
    return ranked.join(k.select("query_id", "k"), "query_id").filter(F.col("rank") <= F.col("k")).drop("k")


def top_k(queries: DataFrame, rows: DataFrame, scorer, k: int, payload: list[str] | None = None,
          broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k best rows for every query.

    ``queries``: ``query_id``, the scorer's column, optionally a per-query ``k``.
    ``rows``: a unique ``id``, the scorer's column, payload columns.
    Returns ``query_id, rank, score, id, <payload>``.
    """
    own = "k" in queries.columns
    queries = (queries.select("query_id", scorer.column, (F.col("k") if own else F.lit(k)).cast("int").alias("k"))
               .filter(F.col(scorer.column).isNotNull() & (F.col("k") > 0)))
    table, rows = rows, rows.select("id", scorer.column).filter(F.col(scorer.column).isNotNull())
    size = queries.agg(scorer.query_bytes().alias("bytes"), F.count("*").alias("n"), F.sum("k").alias("hits")).first()
    if not size["n"]:
        none = queries.sparkSession.createDataFrame([], _hit_schema(queries, rows)).withColumn("rank", F.lit(1))
        return with_payload(none, table, payload, 0)
    shares = -(-size["bytes"] // max(1, broadcast_bytes))
    if shares <= 1:
        hits = _broadcast_scan(queries, rows, scorer)
    elif shares <= scorer.shares:
        share = F.pmod(F.xxhash64("query_id"), F.lit(shares))
        hits = reduce(DataFrame.unionByName, [_broadcast_scan(queries.filter(share == i), rows, scorer) for i in range(shares)])
    else:
        cell = F.lit(0)
        hits = cell_scan(queries.withColumn("cell", cell), rows.withColumn("cell", cell), scorer)
    return with_payload(keep_best(hits, queries if own else k), table, payload, size["hits"])


def with_payload(hits: DataFrame, table: DataFrame, payload: list[str] | None, at_most: int) -> DataFrame:
    """Fetch the hits' other columns by id, after ranking.

    There are at most ``at_most`` hits; if so many fit a broadcast, the table is
    only scanned and never shuffled.
    """
    if not payload:
        return hits
    small = at_most * HIT_BYTES <= BROADCAST_BYTES
    return table.select("id", *payload).join(F.broadcast(hits) if small else hits, "id")


def _broadcast_scan(queries: DataFrame, rows: DataFrame, scorer) -> DataFrame:
    small = queries.toPandas()
    shared = queries.sparkSession.sparkContext.broadcast(
        (scorer.queries(small), small["query_id"].to_numpy(), small["k"].to_numpy()))

    def scan(batches):
        best = scorer.holder(*shared.value)
        for rows_batch in batches:
            best.add(rows_batch)
        yield from best.hits()

    # Every task hands on up to k rows per query, so a large table is read by a
    # bounded number of longer tasks; coalescing needs no shuffle.
    tasks = scorer.tasks_per_core * queries.sparkSession.sparkContext.defaultParallelism
    return spread(rows).coalesce(tasks).mapInPandas(scan, _hit_schema(queries, rows))


def cell_scan(queries: DataFrame, rows: DataFrame, scorer, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """k best rows per query within each ``cell``; both sides carry the cell key, queries their k.

    A cell is cut by its counted rows into even parts by id hash, and every
    query part meets every row part, so a hot cell becomes many bounded tasks.
    The cost is copies of both sides, never scored pairs.
    """
    n_q = queries.groupBy("cell").agg(F.ceil(F.count("*") / scorer.queries_per_cell).cast("int").alias("q_parts"))
    n_r = rows.groupBy("cell").agg(F.ceil(F.count("*") / rows_per_cell).cast("int").alias("r_parts"))
    # One row per cell, and cells are few: one, or as many as a caller's buckets.
    parts = F.broadcast(n_q.join(n_r, "cell"))
    part_of = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = (queries.join(parts, "cell").withColumn("q_part", part_of("query_id", "q_parts"))
         .withColumn("r_part", every("r_parts")).drop("q_parts", "r_parts"))
    r = (rows.join(parts, "cell").withColumn("r_part", part_of("id", "r_parts"))
         .withColumn("q_part", every("q_parts")).drop("q_parts", "r_parts"))
    # Fresh column identities: both sides may come from one table.
    r = r.select(*[F.col(c).alias(c) for c in r.columns])
    schema = _hit_schema(queries, rows)
    names = schema.fieldNames()

    def scan(query_part: pd.DataFrame, row_part: pd.DataFrame) -> pd.DataFrame:
        if query_part.empty or row_part.empty:
            return pd.DataFrame(columns=names)
        best = scorer.holder(scorer.queries(query_part), query_part["query_id"].to_numpy(), query_part["k"].to_numpy())
        best.add(row_part)
        found = [hits[names] for hits in best.hits()]
        return pd.concat(found) if found else pd.DataFrame(columns=names)

    key = ["cell", "q_part", "r_part"]
    return q.groupBy(key).cogroup(r.groupBy(key)).applyInPandas(scan, schema)
