"""Language of every word by a linear-chain conditional random field, and of the whole text by its words.

Features of a word are hashed: affixes, character n-grams, the word itself (the learned lexicon) and what kind of
characters it has. Transitions between languages are learned from sequences spliced of texts in different languages.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textquarry.llm.common import document_hash, small_side, stored
from textquarry.llm.text_stats import chunks, slices, word_ids

# The training sample: documents per language, windows per document and words per window, at most.
DOCS, WINDOWS, WORDS = 400, 4, 24
BUCKETS = 1 << 17
EPOCHS, BATCH, RATE = 4, 64, 0.3
# Words whose emissions a worker remembers.
MEMO = 200_000
# Longer runs without white space are several positions of the chain, each of so many characters at most.
LONGEST = 40
LETTER = re.compile(r"[^\W\d_]")


def pieces(words: list[bytes]) -> tuple[list[bytes], list[int]]:
    """The words, those of over LONGEST characters cut into consecutive pieces, and the pieces of every word."""
    if max(map(len, words), default=0) <= LONGEST:
        return words, [1] * len(words)
    out: list[bytes] = []
    sizes = []
    for word in words:
        text = word.decode("utf-8", "replace") if len(word) > LONGEST else ""
        if len(text) <= LONGEST:
            out.append(word)
            sizes.append(1)
        else:
            cut = [text[i:i + LONGEST].encode() for i in range(0, len(text), LONGEST)]
            out += cut
            sizes.append(len(cut))
    return out, sizes


def word_features(word: bytes) -> list[int]:
    """Hashed features of one word."""
    text = word.decode("utf-8", "replace").lower()
    if not LETTER.search(text):
        return [0]
    framed = f"^{text}$"
    parts = [f"w{text}"]
    parts += [f"p{text[:k]}" for k in (1, 2, 3)] + [f"s{text[-k:]}" for k in (1, 2, 3, 4)]
    parts += [framed[i:i + 2] for i in range(len(framed) - 1)] + [framed[i:i + 3] for i in range(len(framed) - 2)]
    if not text.isascii():
        parts += [f"c{c}" for c in set(text) if ord(c) > 127]
    crc = zlib.crc32
    return [crc(p.encode()) % (BUCKETS - 1) + 1 for p in parts]


CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, CRC >> 1 ^ np.uint32(0xEDB88320), CRC >> 1).astype(np.uint32)


def _on(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """States of crc32 after one more byte each."""
    return CRC[(state ^ byte) & np.uint32(255)] ^ state >> np.uint32(8)


def _begun(lead: bytes, n: int) -> np.ndarray:
    return np.full(n, zlib.crc32(lead) ^ 0xFFFFFFFF, np.uint32)


def joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words one after the other, where each begins, and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths


def have_letter(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, bool)
    text, starts, _ = joined(words)
    out = np.logical_or.reduceat((text | 32) - np.uint8(97) < 26, starts)
    for i in np.flatnonzero(np.logical_or.reduceat(text > 127, starts)):
        out[i] = LETTER.search(words[i].decode("utf-8", "replace")) is not None
    return out


def ascii_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``word_features`` of ASCII words with a letter one after the other, and how many each has; made for all words at once."""
    text, starts, lengths = joined([w.lower() for w in words])
    n = len(words)
    sizes = 2 * lengths + 9  # the word, 3 beginnings, 4 ends, pairs and triples of the framed word
    base = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint32)
    state, order = _begun(b"w", n), np.argsort(-lengths, kind="stable")
    longer = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")  # words with more than t bytes
    for t, k in enumerate(longer):
        some = order[:k]
        state[some] = _on(state[some], text[starts[some] + t])
    out[base] = state
    state = _begun(b"p", n)
    for k in (1, 2, 3):
        some = np.flatnonzero(lengths >= k)
        state[some] = _on(state[some], text[starts[some] + k - 1])
        out[base + k] = state
    for k in (1, 2, 3, 4):
        state = _begun(b"s", n)
        for t in range(k, 0, -1):
            some = np.flatnonzero(lengths >= t)
            state[some] = _on(state[some], text[(starts + lengths)[some] - t])
        out[base + 3 + k] = state
    framed = np.full(len(text) + 2 * n, ord("$"), np.uint8)
    firsts = starts + 2 * np.arange(n)
    framed[firsts] = ord("^")
    owner = np.repeat(np.arange(n), lengths)
    framed[np.arange(len(text)) + 2 * owner + 1] = text
    pairs = _on(_on(_begun(b"", len(framed)), framed), np.append(framed[1:], np.uint8(0)))
    triples = _on(pairs, np.append(framed[2:], np.zeros(2, np.uint8))[:len(framed)])
    place = np.arange(len(text)) - starts[owner]  # of all pairs but the last, and of all triples
    at, to = firsts[owner] + place, base[owner] + 8 + place
    out[to] = pairs[at]
    out[base + 8 + lengths] = pairs[firsts + lengths]
    out[to + lengths[owner] + 1] = triples[at]
    return (out ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS - 1) + np.uint32(1), sizes


@dataclass
class Model:
    labels: list[str]
    emission: np.ndarray  # BUCKETS x labels
    transition: np.ndarray  # labels x labels
    start: np.ndarray


def _forward_backward(e: np.ndarray, t: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of words (batch x time x labels) and summed posteriors of transitions; scores e are logarithms."""
    batch, length, k = e.shape
    x = np.exp(e - e.max(2, keepdims=True))
    tr = np.exp(t)
    a = np.empty_like(x)
    b = np.ones_like(x)
    a[:, 0] = x[:, 0] * np.exp(start)
    a[:, 0] /= a[:, 0].sum(1, keepdims=True)
    for i in range(1, length):
        a[:, i] = (a[:, i - 1] @ tr) * x[:, i]
        a[:, i] /= a[:, i].sum(1, keepdims=True)
    for i in range(length - 2, -1, -1):
        b[:, i] = (b[:, i + 1] * x[:, i + 1]) @ tr.T
        b[:, i] /= b[:, i].sum(1, keepdims=True)
    p = a * b
    p /= p.sum(2, keepdims=True)
    right = b[:, 1:] * x[:, 1:]
    pair = a[:, :-1, :, None] * tr * right[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return p, pair.sum((0, 1))


def spliced(windows: list[tuple[int, list[bytes]]], rng: np.random.Generator) -> list[list[tuple[int, bytes]]]:
    """Sequences of 2 * WORDS words, or of all if there are fewer: runs of 3 words or more from windows in random order. The last
    sequence reaches back so that no word is left out."""
    words = []
    for i in rng.permutation(len(windows)):
        label, window = windows[i]
        cut = int(rng.integers(3, WORDS + 1))
        words += [[(label, w) for w in window[:cut]], [(label, w) for w in window[cut:]]]
    order = rng.permutation(len(words))
    flat = [w for i in order for w in words[i]]
    size = min(2 * WORDS, len(flat))
    starts = list(range(0, len(flat) - size + 1, size)) if size else []
    if starts and starts[-1] + size < len(flat):
        starts.append(len(flat) - size)
    return [flat[i:i + size] for i in starts]


def train(windows: list[tuple[str, list[bytes]]], labels: list[str], seed: int = 7) -> Model:
    """Stochastic gradient ascent (Adagrad) on the log-likelihood of the spliced sequences."""
    k = len(labels)
    model = Model(labels, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    rng = np.random.default_rng(seed)
    coded = [(labels.index(label), words) for label, words in windows]
    memo: dict[bytes, np.ndarray] = {}
    ge = np.full((BUCKETS, k), 1e-2, np.float32)
    gt, gs = np.full((k, k), 1e-2, np.float32), np.full(k, 1e-2, np.float32)
    for _ in range(EPOCHS):
        sequences = spliced(coded, rng)
        for at in range(0, len(sequences), BATCH):
            part = sequences[at:at + BATCH]
            flat = [w for s in part for _, w in s]
            for w in flat:
                if w not in memo:
                    memo[w] = np.array(word_features(w), np.int64)
            found = [memo[w] for w in flat]
            sizes = np.array([len(f) for f in found])
            ids = np.concatenate(found)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            e = np.add.reduceat(model.emission[ids], starts, axis=0).reshape(len(part), -1, k)
            gold = np.array([[label for label, _ in s] for s in part])
            p, pairs = _forward_backward(e, model.transition, model.start)
            error = np.eye(k, dtype=np.float32)[gold] - p
            rows, where = np.unique(ids, return_inverse=True)
            grad = np.zeros((len(rows), k), np.float32)
            np.add.at(grad, where, np.repeat(error.reshape(-1, k), sizes, axis=0))
            seen = np.zeros((k, k), np.float32)
            np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            for weights, squares, at_rows, g in ((model.emission, ge, rows, grad), (model.transition, gt, slice(None), seen - pairs),
                                                 (model.start, gs, slice(None), error[:, 0].sum(0))):
                squares[at_rows] += g * g
                weights[at_rows] += RATE * g / np.sqrt(squares[at_rows])
    return model


class Labeller:
    """Applies a model; remembers the emissions of the words it met first."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[bytes, int] = {}
        self.known = np.zeros((1024, len(model.labels)), np.float32)

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Sums of the emissions of every word's features."""
        out = np.empty((len(words), self.known.shape[1]), np.float32)
        plain = np.fromiter(map(bytes.isascii, words), bool, len(words)) & have_letter(words)
        at = np.flatnonzero(plain)
        for i in range(0, len(at), 1 << 13):
            some = at[i:i + (1 << 13)]
            ids, sizes = ascii_features([words[j] for j in some])
            out[some] = np.add.reduceat(self.model.emission.take(ids, axis=0), np.cumsum(sizes) - sizes, axis=0)
        at = np.flatnonzero(~plain)
        for i in range(0, len(at), 1 << 13):
            some = at[i:i + (1 << 13)]
            found = [word_features(words[j]) for j in some]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            out[some] = np.add.reduceat(self.model.emission[np.concatenate(found)], np.cumsum(sizes) - sizes, axis=0)
        return out

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Scores of distinct words."""
        get = self.memo.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        out = np.zeros((len(words), self.known.shape[1]), np.float32)
        old = at >= 0
        out[old] = self.known[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            scores = self.scores([words[i] for i in new])
            out[new] = scores
            room = max(0, min(MEMO - len(self.memo), len(new)))
            if room:
                base = len(self.memo)
                if base + room > len(self.known):
                    more = max(base + room, 2 * len(self.known))
                    self.known = np.concatenate([self.known, np.zeros((more - len(self.known), out.shape[1]), np.float32)])
                self.known[base:base + room] = scores[:room]
                for i in range(room):
                    self.memo[words[new[i]]] = base + i
        return out

    def posteriors(self, ids: np.ndarray, lengths: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Posterior of every word's label. Texts run side by side, the longest first, so that the texts still
        running at a step are always a prefix."""
        k = scores.shape[1]
        x = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
        order = np.argsort(-lengths, kind="stable")
        ordered = lengths[order]
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        steps = int(ordered[0]) if len(ordered) else 0
        active = np.searchsorted(-ordered, -np.arange(steps), side="left")  # texts with more than t words
        at = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
        words = np.concatenate([offsets[:n] + t for t, n in enumerate(active)]) if steps else np.zeros(0, np.int64)
        x = x[ids[words]]
        tr = np.exp(self.model.transition)
        a, back = np.empty((len(words), k), np.float32), tr.T.copy()
        for t in range(steps):
            now = x[at[t]:at[t + 1]]
            row = now * np.exp(self.model.start) if t == 0 else (a[at[t - 1]:at[t - 1] + len(now)] @ tr) * now
            a[at[t]:at[t + 1]] = row / row.sum(1, keepdims=True)
        b = np.ones((int(active[0]) if steps else 0, k), np.float32)
        for t in range(steps - 2, -1, -1):
            n = active[t + 1]
            row = (b[:n] * x[at[t + 1]:at[t + 2]]) @ back
            b[:n] = row / row.sum(1, keepdims=True)
            a[at[t]:at[t] + n] *= b[:n]
        out = np.empty((len(words), k), np.float32)
        out[words] = a / a.sum(1, keepdims=True) if len(words) else a
        return out

    def label(self, texts: list[bytes]) -> tuple[list[str], list[float], list[np.ndarray], list[np.ndarray]]:
        """Per text: the language with most posterior weight over its words with a letter, that weight's share, and
        the words' labels and whether they have a letter. A long word weighs as its pieces, and has their sum's label."""
        cut = [pieces(t.split()) for t in texts]
        split = [words for words, _ in cut]
        lengths = np.array([len(w) for w in split], np.int64)
        ids, words = word_ids(split)
        distinct = words.to_pylist()
        has_letter = have_letter(distinct)
        p = self.posteriors(ids, lengths, self.emissions(distinct))
        spoken = has_letter[ids] if len(ids) else np.zeros(0, bool)
        owner = np.repeat(np.arange(len(texts)), lengths)
        k = len(self.model.labels)
        mass = np.zeros((len(texts), k))
        for j in range(k):
            mass[:, j] = np.bincount(owner, p[:, j] * spoken, len(texts))
        total = mass.sum(1)
        best = mass.argmax(1)
        names = [self.model.labels[b] if n > 0 else "und" for b, n in zip(best, total)]
        share = [float(min(1.0, mass[i, b] / n)) if n > 0 else 0.0 for i, (b, n) in enumerate(zip(best, total))]
        sizes = np.fromiter((n for _, s in cut for n in s), np.int64)
        if len(sizes) < len(owner):
            first = np.cumsum(sizes) - sizes
            p, spoken = np.add.reduceat(p, first, axis=0), np.logical_or.reduceat(spoken, first)
        cuts = np.cumsum([len(s) for _, s in cut])[:-1]
        return names, share, np.split(p.argmax(1), cuts), np.split(spoken, cuts)


def training_windows(docs: DataFrame, lang: str = "lang", docs_per_label: int = DOCS) -> pd.DataFrame:
    """``label``, ``words``: up to WINDOWS windows of WORDS words, spread evenly over the whole text, from each of up to
    ``docs_per_label`` texts per label, those of the lowest hashes. Copies of a text count once."""
    usable = docs.where(F.col(lang).isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(
        F.col(lang).alias("label"), "text", F.xxhash64("text").alias("h"))
    # The rank filter is applied before the shuffle too.
    lowest = Window.partitionBy("label").orderBy("h")
    chosen = usable.select("label", "h").distinct().withColumn("rank", F.row_number().over(lowest)).where(
        F.col("rank") <= docs_per_label).drop("rank")
    rows = usable.join(small_side(stored(chosen, "chosen")), ["label", "h"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                labels, names, places, rows = [], [], [], []
                for label, h, text in zip(part.column("label").to_pylist(), part.column("h").to_pylist(), texts):
                    words, _ = pieces(text.split())
                    n = min(WINDOWS, max(1, len(words) // WORDS))
                    for i in range(n):
                        at = i * max(0, len(words) - WORDS) // max(1, n - 1)
                        if words[at:at + WORDS]:
                            labels.append(label)
                            names.append(h)
                            places.append(i)
                            rows.append(b" ".join(words[at:at + WORDS]))
                yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(names, pa.int64()), pa.array(places, pa.int32()),
                                                  pa.array(rows, pa.binary())], ["label", "h", "place", "words"])

    found = rows.mapInArrow(windows, "label string, h long, place int, words binary").distinct()
    return found.select("label", "words").toPandas()


def fit(docs: DataFrame, lang: str = "lang", docs_per_label: int = DOCS) -> Model | None:
    """Learn from labelled documents; None if there are none."""
    found = training_windows(docs, lang, docs_per_label).sort_values(["label", "words"])
    labels = sorted(found["label"].unique())
    if not labels:
        return None
    return train([(a, bytes(b).split()) for a, b in zip(found["label"], found["words"])], labels)


def predict(docs: DataFrame, model: Model | None, keep: list[str], spans: bool = False) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every whole text, from the text alone.

    ``und`` with score 0 if the text is null, empty or has no letter, or if there is no model. With ``spans`` also
    ``runs``: runs of words of one language as (first word, words, language), words without a letter joining the run
    they follow. One row per row; ties go to the label that sorts first.
    """
    kept = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))

    def runs(labels: np.ndarray, spoken: np.ndarray, names: list[str]) -> list[dict]:
        out: list[dict] = []
        for i, (label, s) in enumerate(zip(labels, spoken)):
            if out and (not s or out[-1]["lang"] == names[label]):
                out[-1]["words"] += 1
            else:
                out.append({"start": i, "words": 1, "lang": names[label] if s else "und"})
        return out

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value) if shared.value is not None else None
        for batch in batches:
            for part, texts in chunks(batch):
                if labeller:
                    names, share, words, spoken = labeller.label(texts)
                else:
                    names, share = ["und"] * len(texts), [0.0] * len(texts)
                columns = [part.column(k) for k in kept] + [pa.array(names, pa.string()), pa.array(share, pa.float64())]
                if spans:
                    columns.append(pa.array([runs(w, s, labeller.model.labels) for w, s in zip(words, spoken)] if labeller
                                            else [[]] * len(texts), run_type))
                yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score", *["runs"] * spans])

    schema = ", ".join([f"{k} {t}" for k, t in rows.dtypes if k != "text"] + ["lang_pred string, score double"]
                       + ["runs array<struct<start:bigint,words:bigint,lang:string>>"] * spans)
    return rows.mapInArrow(label, schema).toDF(*keep, "lang_pred", "score", *["runs"] * spans)


def spoken(spark: SparkSession, text: Column, model: Model | None) -> Column:
    """Struct of ``lang`` and ``score`` as ``predict`` gives them. Only the text goes to Python."""
    shared = spark.sparkContext.broadcast(model and (model.labels, model.emission, model.transition, model.start))

    @F.arrow_udf("lang string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(Model(*shared.value)) if shared.value else None
        for batch in batches:
            names, shares = [], []
            for texts in slices(batch):
                name, share, *_ = labeller.label(texts) if labeller else (["und"] * len(texts), [0.0] * len(texts))
                names += name
                shares += share
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["lang", "score"])

    return run(text)


def keep_spoken(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose text has a language: not ``und``, and at least ``least`` of its words'
    weight in one language."""
    columns = [f"d{i}" for i in range(len(docs.columns))]
    wide = docs.select(*[F.col(c).alias(d) for c, d in zip(docs.columns, columns)], spoken(docs.sparkSession, F.col("text"), model).alias("spoken"))
    judged = wide.where((F.col("spoken.lang") != "und") & (F.col("spoken.score") >= least))
    return judged.select(*[F.col(d).alias(c) for c, d in zip(docs.columns, columns)])


def held_out(doc_id: Column) -> Column:
    return document_hash(doc_id) % 5 == 0
