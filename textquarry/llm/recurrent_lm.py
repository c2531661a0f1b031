"""Gated recurrent language model with a class-factored softmax, and whole-document scores by it.

Word counts come from all training documents and stay distributed: only the most frequent words go to the workers, the
others meet their counts in a join. The network knows VOCABULARY words; a word outside is scored by the network's
probability of such a word, times the word's share among them by smoothed counts, so that probabilities add up to one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from textquarry.llm.common import stored
from textquarry.llm.shingles import hashed_words
from textquarry.llm.text_stats import chunks, give_back

# Words whose counts are sent to the workers, and words of the network, at most.
HEAVY, VOCABULARY = 1 << 17, 4096
CLASSES, EMBED, HIDDEN = 64, 16, 24
# Training documents are learned from whole, in blocks of BLOCK tokens; windows of backpropagation, blocks side by side.
BLOCK, WINDOW, BATCH = 512, 16, 128
# Rounds between which the trainers' weights are averaged; tokens a trainer is made for.
ROUNDS, TRAINER_TOKENS = 4, 2_000_000
RATE = 0.05
CACHED = 1 << 14  # values updated at a time
END = int(xxhash.xxh3_64_intdigest(b"\n"))  # no word is a line feed
# Documents the network runs on side by side, the longest first; taken from so much text.
SIDE_BY_SIDE, SCORED_BYTES = 1024, 16_000_000
WIDE = 1 << 16  # states kept until their outputs are worked out together
# Text whose words a worker holds at a time: they take some forty times as much.
COUNTED_BYTES = 2_000_000
PARTS = 16
OTHER, STOP = 0, 1
NUMBER = np.uint16  # two bytes hold any number below VOCABULARY


@dataclass
class Weights:
    """Biases are the weights of a unit that is always 1: the last row of ``inputs1`` and ``classes1``, the last column of ``words1``."""

    embed: np.ndarray
    inputs1: np.ndarray
    recurrent: np.ndarray
    classes1: np.ndarray
    words1: np.ndarray

    inputs = property(lambda self: self.inputs1[:-1])
    bias = property(lambda self: self.inputs1[-1])
    classes = property(lambda self: self.classes1[:-1])
    class_bias = property(lambda self: self.classes1[-1])
    words = property(lambda self: self.words1[:, :-1])
    word_bias = property(lambda self: self.words1[:, -1])

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    def on(self, flat: np.ndarray) -> "Weights":
        """Weights of these shapes that lie in ``flat``."""
        out, at = {}, 0
        for f in fields(self):
            a = getattr(self, f.name)
            out[f.name] = flat[at:at + a.size].reshape(a.shape)
            at += a.size
        return Weights(**out)

    def like(self, flat: np.ndarray) -> "Weights":
        return self.on(flat.astype(np.float32))


@dataclass
class Vocabulary:
    """Frequent words by hash (sorted) with counts and number in the network (0: outside); class of each number."""

    hashes: np.ndarray
    counts: np.ndarray
    numbers: np.ndarray
    class_of: np.ndarray
    starts: np.ndarray  # where each class begins among the numbers; one more at the end
    tokens: int
    distinct: int
    other_mass: float  # smoothed count of all words outside the network
    number_mass: np.ndarray

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the frequent words, and whether the word is one of them."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)


def make_vocabulary(hashes: np.ndarray, counts: np.ndarray, tokens: int, distinct: int, size: int = VOCABULARY) -> Vocabulary:
    rank = np.lexsort((hashes, -counts))
    rank = rank[hashes[rank] != END][:size - 2]
    numbers = np.zeros(len(hashes), np.int32)
    numbers[rank] = np.arange(2, 2 + len(rank))
    numbers[hashes == END] = STOP
    n = 2 + len(rank)
    mass = np.ones(n)
    mass[numbers[numbers > 0]] = counts[numbers > 0] + 1
    mass[OTHER] = max(1.0, tokens + distinct + 1 - mass[1:].sum())
    cuts = np.unique(np.concatenate([[0, 1], np.linspace(2, n, min(CLASSES - 2, max(1, n - 2)) + 1).astype(int)]))
    class_of = np.searchsorted(cuts, np.arange(n), side="right") - 1
    return Vocabulary(hashes, counts, numbers, class_of.astype(np.int32), cuts, tokens, distinct, float(mass[OTHER]), mass)


def initial(v: Vocabulary, seed: int = 11) -> Weights:
    """Small random weights; the biases make it the count model to begin with."""
    rng = np.random.default_rng(seed)
    n, k = len(v.number_mass), len(v.starts) - 1
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    share = np.log(v.number_mass / v.number_mass.sum())
    by_class = np.logaddexp.reduceat(share, v.starts[:-1])
    embed, inputs, recurrent, classes, words = draw(n, EMBED), draw(EMBED, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN), draw(HIDDEN, k), draw(n, HIDDEN)
    return Weights(embed, np.vstack([inputs, np.zeros(3 * HIDDEN, np.float32)]), recurrent,
                   np.vstack([classes, by_class.astype(np.float32)]), np.column_stack([words, share.astype(np.float32)]))


class Room:
    """Arrays that are used again under their names: fresh memory for every window takes longer than what is worked out in it. A name is
    asked for again when what it held is no longer needed, so that all of it fits a cache."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


def _by_class(v: Vocabulary, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """Order of the targets by class, their classes in it, and of every class of several words where its targets and its words begin and end."""
    cls = v.class_of.take(target).astype(np.min_scalar_type(len(v.starts)))
    order = np.argsort(cls, kind="stable")
    cls = cls.take(order)
    cuts, starts = np.searchsorted(cls, np.arange(len(v.starts), dtype=cls.dtype)).tolist(), v.starts.tolist()
    return order, cls.astype(np.int64), [x for x in zip(cuts[2:], cuts[3:], starts[2:], starts[3:]) if x[0] < x[1] and x[3] - x[2] > 1]


def _picked(h1: np.ndarray, weights1: np.ndarray, target: np.ndarray, out: np.ndarray) -> None:
    """Add the log softmax at the targets alone, in blocks that fit a cache. A column of ``h1`` is a token, so that maxima and sums run along
    the tokens; biases are in the weights."""
    for a in range(0, len(target), 1024):
        t = target[a:a + 1024]
        x = weights1 @ h1[:, a:a + 1024]
        _shift(x)
        out[a:a + 1024] += x.reshape(-1).take(t * len(t) + np.arange(len(t)))
        out[a:a + 1024] -= np.log(np.exp(x, out=x).sum(0))


def _shift(x: np.ndarray) -> None:
    """Take the columns' maxima off where float32 would not hold the exponentials."""
    top = x.max(0)
    if max(top.max(), -top.min()) > 60:
        x -= top


def output(w: Weights, v: Vocabulary, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of every target after state h (tokens x units): of its class, then of the word within the class. And the classes."""
    h1 = np.column_stack([h, np.ones(len(h), np.float32)]).T
    return _output(w, v, h1, target, np.arange(len(h))), v.class_of[target]


def _output(w: Weights, v: Vocabulary, h1: np.ndarray, target: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``output``, of the states in the columns ``at`` of ``h1``, whose last unit is 1."""
    order, cls, inside = _by_class(v, target)
    h1 = h1.take(at.take(order), axis=1)
    logs = np.zeros(len(order), np.float32)
    _picked(h1, w.classes1.T, cls, logs)
    target = target.take(order).astype(np.int64)
    for i, j, a, b in inside:
        _picked(h1[:, i:j], w.words1[a:b], target[i:j] - a, logs[i:j])
    out = np.empty_like(logs)
    out[order] = logs
    return out


def _errors(x: np.ndarray, target: np.ndarray) -> None:
    """Turn every column into the gradient of its log softmax at its target."""
    _shift(x)
    np.exp(x, out=x)
    x *= np.float32(-1) / x.sum(0)
    x.reshape(-1)[target * len(target) + np.arange(len(target))] += 1


def _outputs_back(w: Weights, v: Vocabulary, states1: np.ndarray, target: np.ndarray, grad: Weights, room: Room) -> np.ndarray:
    """Write the outputs' gradients; return that of the states after every step (units x steps x batch). ``states1`` is units x
    (steps + 1) x batch, targets step by step, -1 where there is none."""
    n, rows = HIDDEN, states1.shape[2]
    live = np.flatnonzero(target >= 0)
    target = target.take(live)
    order, cls, inside = _by_class(v, target)
    target, live, tokens = target.take(order), live.take(order), len(order)
    h1 = np.take(states1.reshape(n + 1, -1), live + rows, axis=1, out=room("h1", n + 1, tokens), mode="clip")
    x = np.matmul(w.classes1.T, h1, out=room("wide", w.classes1.shape[1], tokens))
    _errors(x, cls)
    np.matmul(h1, x.T, out=grad.classes1)
    dh = room("dh", n, tokens + 1)  # the last column is for where there is no target
    dh[:, -1] = 0
    np.matmul(w.classes, x, out=dh[:, :-1])
    if inside:
        # a class narrower than the widest: what it has not got is impossible
        first, widths = inside[0][0], np.diff(v.starts)[2:]
        x = room("wide", widths.max(), tokens - first)
        x[0] = 0  # of a class of one word
        x[widths.min():] = -np.inf
        for i, j, a, b in inside:
            np.matmul(w.words1[a:b], h1[:, i:j], out=x[:b - a, i - first:j - first])
        _errors(x, target[first:] - v.starts[cls[first:]])
        by_state = room("narrow", n, tokens - first)
        if widths.min() == 1:
            by_state.fill(0)
        for i, j, a, b in inside:
            part = x[:b - a, i - first:j - first]
            np.matmul(part, h1[:, i:j].T, out=grad.words1[a:b])
            np.matmul(w.words[a:b].T, part, out=by_state[:, i - first:j - first])
        dh[:, first:-1] += by_state
    back = np.full(states1.shape[1] * rows - rows, tokens)
    back[live] = np.arange(tokens)
    return np.take(dh, back, axis=1, out=room("narrow", n, len(back)), mode="clip").reshape(n, -1, rows)


def _window(w: Weights, v: Vocabulary, ids: np.ndarray, h: np.ndarray, grad: Weights, room: Room | None = None) -> tuple[np.ndarray, int]:
    """Truncated backpropagation through one window: ids is batch x (steps + 1), -1 after the end; the gradients go into ``grad``,
    which is all 0. Returns the state that goes on to the next window and the tokens learned from.

    Arrays are steps x units x batch, those of the states units x steps x batch. What needs no other step is worked out for all steps at once.
    """
    rows, steps, n = len(ids), ids.shape[1] - 1, HIDDEN
    room = room or Room()
    half, one = np.float32(0.5), np.float32(1)
    came = np.maximum(ids[:, :-1].T.ravel(), OTHER)  # after the end any word will do: it has no gradient
    x = room("x", steps, rows, EMBED + 1)
    x[..., :-1] = w.embed.take(came, axis=0).reshape(steps, rows, EMBED)
    x[..., -1] = 1
    inputs, recurrent = w.inputs1.T.copy(), w.recurrent.T.copy()
    inputs[:2 * n] *= half
    recurrent[:2 * n] *= half
    a = np.matmul(inputs, x.transpose(0, 2, 1), out=room("wide", steps, 3 * n, rows))
    c = room("c", steps, n, rows)
    u = room("u", steps, 3 * n, rows)  # the two gates, and what the state adds to the candidate
    states, gap = room("states", n + 1, steps + 1, rows), room("gap", n, rows)
    states[-1] = 1
    states[:-1, 0] = h.T
    for t in range(steps):
        before, after, both, new, add = states[:-1, t], states[:-1, t + 1], u[t], c[t], a[t]
        np.matmul(recurrent, before, out=both)
        zr = both[:2 * n]
        zr += add[:2 * n]
        np.tanh(zr, out=zr)
        zr *= half
        zr += half
        np.multiply(both[2 * n:], zr[n:], out=new)
        new += add[2 * n:]
        np.tanh(new, out=new)
        np.subtract(before, new, out=gap)
        gap *= zr[:n]
        np.add(gap, new, out=after)
    target = ids[:, 1:].T.ravel()
    dh = _outputs_back(w, v, states, target, grad, room)
    # by how much the state's gradient passes the candidate, the gates, and the candidate by way of the state
    z, r, un, before = u[:, :n], u[:, n:2 * n], u[:, 2 * n:], states[:-1, :-1].transpose(1, 0, 2)
    passes = room("wide", steps, 4, n, rows)
    fc, fz, fr, fu = (passes[:, i] for i in range(4))
    np.subtract(one, z, out=fz)
    np.multiply(c, c, out=fc)
    np.subtract(one, fc, out=fc)
    fc *= fz
    fz *= z
    np.subtract(before, c, out=c)
    fz *= c
    np.multiply(fc, r, out=fu)
    np.subtract(one, r, out=fr)
    fr *= un
    fr *= fu
    now, passed = np.zeros((n, rows), np.float32), room("passed", n, rows)
    for t in range(steps - 1, -1, -1):
        now += dh[:, t]
        part = passes[t]
        part *= now
        np.multiply(now, z[t], out=passed)
        np.matmul(w.recurrent, part[1:].reshape(3 * n, rows), out=now)
        now += passed
    da, du = passes[:, :3].reshape(steps, 3 * n, rows), passes[:, 1:].reshape(steps, 3 * n, rows)
    by_input = np.matmul(da, x).sum(0).T  # the candidate's columns come first
    grad.inputs1[:, 2 * n:] += by_input[:, :n]
    grad.inputs1[:, :2 * n] += by_input[:, n:]
    grad.recurrent += np.matmul(before, du.transpose(0, 2, 1)).sum(0)
    dx = np.matmul(da.transpose(0, 2, 1), np.roll(w.inputs, n, axis=1).T, out=room("h1", steps, rows, EMBED))
    some, place = _distinct(came, len(w.embed))
    into = place.take(came)[:, None] * EMBED + np.arange(EMBED)
    grad.embed[some] += np.bincount(into.ravel(), dx.ravel(), len(some) * EMBED).reshape(-1, EMBED)
    return states[:-1, -1].T, len(target) - int((target < 0).sum())


def _distinct(ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of numbers below ``most``, sorted, and the place of each among them."""
    came = np.zeros(most, bool)
    came[ids] = True
    return np.flatnonzero(came), came.cumsum() - 1


def train(w: Weights, v: Vocabulary, blocks: list[np.ndarray], seed: int) -> Weights:
    """One pass of Adagrad over every token of the blocks (numbers, the first one only read), state carried from window to
    window. Blocks of about the same length run side by side, in random order."""
    values = w.flat()
    w = w.on(values)
    squares, steps = np.full_like(values, 1e-3), np.zeros_like(values)
    grad, room = w.on(steps), Room()
    embed_squares = w.on(squares).embed
    rng = np.random.default_rng(seed)
    windows = np.array([-(-(len(x) - 1) // WINDOW) for x in blocks], np.int64)
    order = rng.permutation(len(blocks))
    order = order[np.argsort(windows[order], kind="stable")]
    for at in rng.permutation(np.arange(0, len(order), BATCH)):
        rows = order[at:at + BATCH]
        batch = np.full((len(rows), int(windows[rows].max()) * WINDOW + 1), -1, np.int32)
        for i, row in enumerate(rows):
            batch[i, :len(blocks[row])] = blocks[row]
        h = np.zeros((len(batch), HIDDEN), np.float32)
        for start in range(0, batch.shape[1] - 1, WINDOW):
            live = batch[:, start + 1] >= 0
            if not live.all():
                batch, h = batch[live], h[live]
            ids = batch[:, start:start + WINDOW + 1]
            h, n = _window(w, v, ids, h, grad, room)
            # the embeddings come first in the values; those of words that did not come have no gradient
            some, _ = _distinct(ids[:, :-1], len(w.embed))
            x, s = w.embed.take(some, axis=0), embed_squares.take(some, axis=0)
            _adagrad(x, s, grad.embed.take(some, axis=0), n, np.empty_like(x))
            w.embed[some], embed_squares[some] = x, s
            for a in range(w.embed.size, len(values), CACHED):
                part = steps[a:a + CACHED]
                _adagrad(values[a:a + CACHED], squares[a:a + CACHED], part, n, room("root", len(part)))
            steps.fill(0)
    return w


def _adagrad(values: np.ndarray, squares: np.ndarray, grad: np.ndarray, n: int, root: np.ndarray) -> None:
    """One step by the gradient of n tokens, which is overwritten, as is ``root``."""
    grad *= np.float32(1 / np.sqrt(n))
    np.multiply(grad, grad, out=root)
    squares += root
    np.sqrt(squares, out=root)
    grad *= np.float32(RATE)
    grad /= root
    values += grad


def score_ids(w: Weights, v: Vocabulary, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log probability of whole documents (numbers one after the other). Documents run side by side, the longest
    first; outputs are computed window by window, the state goes on to the next window."""
    order = np.argsort(-lengths, kind="stable")
    offsets = np.cumsum(lengths) - lengths
    # what a word adds to gates and candidate, and the recurrent weights; the gates' are halved, the gate the candidate's meets is twice itself
    table, u = (w.embed @ w.inputs + w.bias).T.copy(), w.recurrent.T * np.float32(0.5)
    table[:2 * HIDDEN] *= np.float32(0.5)
    out = np.empty(len(lengths))
    for at in range(0, len(order), SIDE_BY_SIDE):
        some = order[at:at + SIDE_BY_SIDE]
        out[some] = _score_some(w, v, ids, offsets[some], lengths[some], table, u)
    return out


def _score_some(w: Weights, v: Vocabulary, ids: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, table: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of documents in falling length. Columns are tokens: a step writes the states after it behind those before it, and takes what they begin
    with, as many as there are documents that still run."""
    total = np.zeros(len(lengths))
    active = int((lengths > 0).sum())
    if not active:
        return total
    n, t = HIDDEN, 0
    half, one = np.float32(0.5), np.float32(1)
    falling, offsets = -lengths, offsets[:active]
    room = Room()
    states = np.empty((n + 1, (WIDE + 2 * active) // 32 * 32 + 16), np.float32)  # rows an odd number of cache lines apart
    states[n] = 1
    states[:n, :active] = 0
    last = np.full(active, STOP, ids.dtype)
    while active:
        at, end, first, targets = 0, active, active, []
        while end < WIDE and active:
            before, gap = states[:n, at:at + active], room("gap", n, active)
            word, added = table.take(last, axis=1), np.matmul(u, before, out=room("added", 3 * n, active))
            zr, c = added[:2 * n], added[2 * n:]
            zr += word[:2 * n]
            np.tanh(zr, out=zr)
            zr += one
            c *= zr[n:]
            c += word[2 * n:]
            np.tanh(c, out=c)
            z = zr[:n]
            z *= half
            np.subtract(before, c, out=gap)
            gap *= z
            np.add(gap, c, out=states[:n, end:end + active])
            last = ids.take(offsets + t)
            targets.append(last)
            at, end = end, end + active
            t += 1
            if lengths[active - 1] <= t:
                active = int(falling[:active].searchsorted(-t))
                last, offsets = last[:active], offsets[:active]
        logs = _output(w, v, states, np.concatenate(targets), np.arange(first, end))
        done = 0
        for k in map(len, targets):
            total[:k] += logs[done:done + k]
            done += k
        states[:n, :active] = states[:n, at:at + active]
    return total


def blocks_of(line: np.ndarray) -> list[np.ndarray]:
    """A text's tokens in consecutive blocks; each begins with the token before, so that every token but the first is
    learned once."""
    return [line[a:a + BLOCK + 1] for a in range(0, len(line) - 1, BLOCK)]


def _gathered(docs: DataFrame) -> DataFrame:
    """Of the training documents: word counts per batch (hash, n), and all their tokens in blocks (shard, span). Equal texts
    have shards of their own, by id and, where that is equal too, by their place in the batch."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "n", "span", "shard"]
        for batch in batches:
            found, seen = [], Counter()
            for part, texts in chunks(batch):
                spans, shards = [], []
                ids, words, lengths = hashed_words(texts)
                hashes = words[ids]
                found.append((np.append(words, np.uint64(END)), np.append(np.bincount(ids, minlength=len(words)), len(texts))))
                at = 0
                for doc, text, k in zip(part.column("doc_id").to_pylist(), texts, lengths):
                    line = np.concatenate([[np.uint64(END)], hashes[at:at + k], [np.uint64(END)]])
                    name = xxhash.xxh3_64_intdigest(text, xxhash.xxh3_64_intdigest(str(doc).encode()))
                    for i, span in enumerate(blocks_of(line)):
                        spans.append(span.tobytes())
                        shards.append(xxhash.xxh3_64_intdigest(f"{name} {seen[name]} {i}".encode()) >> 40)
                    seen[name] += 1
                    at += k
                gone = pa.nulls(len(spans), pa.int64())
                give_back()
                yield pa.RecordBatch.from_arrays([gone, gone, pa.array(spans, pa.binary()), pa.array(shards, pa.int64())], names)
            if not found:
                continue
            words, where = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
            n = np.bincount(where, np.concatenate([c for _, c in found])).astype(np.int64)
            none = pa.nulls(len(words), pa.binary()), pa.nulls(len(words), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n), *none], names)

    return docs.select("doc_id", "text").mapInArrow(gather, "hash long, n long, span binary, shard long")


def frequent(counts: DataFrame, most: int = HEAVY) -> pd.DataFrame:
    """The most frequent words, at most ``most``: all above a count chosen so that they fit."""
    level = F.floor(F.log2("n") * 64).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).toPandas()  # a few thousand rows
    levels = levels.sort_values("level", ascending=False)
    fits = levels["words"].cumsum() <= most
    least = int(levels["level"][fits].min()) if fits.any() else 1 << 30
    return counts.where(level >= least).toPandas().sort_values("hash")


def fit(spans: DataFrame, v: Vocabulary, tokens: int) -> Weights:
    """One pass over all blocks at every size: rounds of training in tasks, each on its share of the blocks, weights
    averaged in between. Trainers grow in number with the tokens."""
    spark = spans.sparkSession
    trainers = int(max(1, min(4096, tokens // TRAINER_TOKENS)))
    inside = v.numbers != OTHER  # other words need not be looked up
    vocabulary = spark.sparkContext.broadcast(replace(v, hashes=v.hashes[inside], counts=v.counts[inside], numbers=v.numbers[inside]))
    w = initial(v)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                spans = part.column("span").to_pylist()
                place, known = v.look_up(np.frombuffer(b"".join(spans), np.uint64))
                numbers = np.full(len(place), OTHER, NUMBER)
                numbers[known] = v.numbers[place[known]]
                cuts = np.cumsum([0, *map(len, spans)]) // 8
                yield pa.RecordBatch.from_arrays([pa.array([numbers[i:j].tobytes() for i, j in pairwise(cuts.tolist())], pa.binary()),
                                                  part.column("shard")], ["numbers", "shard"])

    numbered = stored(spans.mapInArrow(number, "numbers binary, shard long"), "numbered")
    for turn in range(ROUNDS if tokens else 0):
        now = spark.sparkContext.broadcast(w)

        def run(rows: pd.DataFrame) -> pd.DataFrame:  # used up within this turn
            v = vocabulary.value
            rows = rows.sort_values(["shard", "numbers"])
            lengths = rows["numbers"].map(len).to_numpy() // 2
            numbers = np.frombuffer(b"".join(rows["numbers"]), NUMBER).astype(np.int32)
            start = now.value.like(now.value.flat())
            flat = train(start, v, np.split(numbers, np.cumsum(lengths)[:-1]), 1000 * turn + int(rows["trainer"].iloc[0])).flat()
            return pd.DataFrame({"part": np.arange(PARTS), "weight": float((lengths - 1).sum()),
                                 "values": [p.tobytes() for p in np.array_split(flat, PARTS)]})

        def average(rows: pd.DataFrame) -> pd.DataFrame:
            total = sum(weight * np.frombuffer(values, np.float32).astype(float) for weight, values in zip(rows["weight"], rows["values"]))
            return pd.DataFrame({"part": rows["part"].iloc[:1], "values": [(total / rows["weight"].sum()).astype(np.float32).tobytes()]})

        mine = numbered.where(F.col("shard") % ROUNDS == turn)
        trained = mine.withColumn("trainer", F.floor(F.col("shard") / ROUNDS) % trainers).groupBy("trainer").applyInPandas(
            run, "part int, weight double, values binary")
        found = trained.groupBy("part").applyInPandas(average, "part int, values binary").toPandas().sort_values("part")
        if len(found):
            w = w.like(np.concatenate([np.frombuffer(x, np.float32) for x in found["values"]]))
    return w


def _scored(docs: DataFrame, w: Weights, v: Vocabulary) -> DataFrame:
    """Per document what frequent words and the network give, and its other words as (hash, times)."""
    rows = docs.select("doc_id", "held_out", "text")
    shared = docs.sparkSession.sparkContext.broadcast((w, v))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, texts in chunks(batch, most=SCORED_BYTES):
                found = score_texts(texts, *shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(texts))), part.column("doc_id"), part.column("held_out"),
                                                  *found.values()], ["row", "doc_id", "held_out", *found])
                row += len(texts)
                del part, texts, found
                give_back()

    id_type = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(score, f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_rare long, base double, network double, "
                                  "outside double, n_outside long, rare array<bigint>, times array<int>")


def score_texts(texts: list[bytes], w: Weights, v: Vocabulary) -> dict[str, pa.Array]:
    """What ``_scored`` gives of every text. Only COUNTED_BYTES of text at a time become words; the network runs on all texts' numbers."""
    found, at, held = [], 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= COUNTED_BYTES or i + 1 == len(texts):
            found.append(_counted(texts[at:i + 1], v))
            at, held = i + 1, 0
    numbers = np.concatenate([n for n, _ in found])
    out = {name: pa.concat_arrays([f[name] for _, f in found]) for name in found[0][1]}
    out["network"] = pa.array(score_ids(w, v, numbers, out["n_tokens"].to_numpy()) / np.log(10))
    return out


def _counted(texts: list[bytes], v: Vocabulary) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The texts' words and ends as numbers, and what needs no network. A distinct word is looked up once; the end comes after all words."""
    ids, table, lengths = hashed_words(texts)
    table = np.append(table, np.uint64(END))
    at, known = v.look_up(table)
    numbers, logs = np.full(len(table), OTHER, NUMBER), np.zeros(len(table))
    numbers[known], logs[known] = v.numbers[at[known]], np.log10(v.counts[at[known]] + 1.0)
    with_end = lengths + 1
    ends = np.cumsum(with_end) - 1
    line = np.insert(ids, np.cumsum(lengths), len(table) - 1)
    base = np.add.reduceat(logs.take(line), ends - lengths)
    numbers = numbers.take(line)
    outside = np.flatnonzero(numbers == OTHER)  # few; the others need no sums of their own
    text, word = np.searchsorted(ends, outside), line.take(outside)
    sums = lambda at, x=None: np.bincount(text[at], x, len(texts))
    is_rare = ~known.take(word)
    rare, times = np.unique(word[is_rare] + text[is_rare] * len(table), return_counts=True)
    offsets = pa.array(np.searchsorted(rare, np.arange(len(texts) + 1) * len(table)), pa.int32())
    return numbers, {
        "n_tokens": pa.array(with_end), "n_rare": pa.array(sums(is_rare)), "base": pa.array(base), "network": pa.nulls(len(texts), pa.float64()),
        "outside": pa.array(sums(slice(None), logs.take(word)), pa.float64()), "n_outside": pa.array(sums(slice(None))),
        "rare": pa.ListArray.from_arrays(offsets, pa.array(table[rare % len(table)].view(np.int64))),
        "times": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))}


def score(docs: DataFrame) -> DataFrame:
    """Log10 probabilities of whole texts by smoothed counts and by the network.

    Input: doc_id, text, ``held_out`` (not learned from); more columns are left aside. One row per row: doc_id, held_out,
    n_tokens (words and one end), n_known (seen in training), train_tokens, base_score, score. Null text is empty: one
    token, the end. Words are split at ASCII white space, A-Z lower-cased. Without training documents every word is
    unknown and the network has its first weights.
    """
    gathered = stored(_gathered(docs.where("not held_out")), "gathered")
    counts = stored(gathered.where("hash is not null").groupBy("hash").agg(F.sum("n").alias("n")), "counts")
    tokens, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    heavy = frequent(counts)
    v = make_vocabulary(heavy["hash"].to_numpy(np.int64).view(np.uint64), heavy["n"].to_numpy(np.int64), tokens, distinct)
    order = np.argsort(v.hashes)
    v.hashes, v.counts, v.numbers = v.hashes[order], v.counts[order], v.numbers[order]
    spans = gathered.where("span is not null").select("span", "shard")
    w = fit(spans, v, tokens)
    scored = stored(_scored(docs, w, v), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("hash"), "x.times")
    # Rare words by definition have few training documents each; unknown ones that are frequent elsewhere AQE splits.
    found = rare.join(counts, "hash").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_log"), F.sum("times").alias("rare_known"))
    joined = scored.drop("rare", "times").join(found, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    all_mass, other = float(np.log10(tokens + distinct + 1)), float(np.log10(v.other_mass))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_tokens") - F.col("n_rare") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n_tokens") * all_mass).alias("base_score"),
        (F.col("network") + F.col("outside") + rare_log - F.col("n_outside") * other).alias("score"))
