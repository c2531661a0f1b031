"""Embedders: the contract for a user's model, and a built-in hashed one."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F

# Texts per model call, and the declared vector size.
EMBED_BATCH = 100
DEFAULT_DIM = 1536
# Words of texts that are counted at once.
COUNT_WORDS = 500_000

_WORD = re.compile(r"[^\W_]+")

HASHED_TYPE = "struct<idx: array<int>, cnt: array<int>, norm2: bigint>"


def _vectors(model: Callable[[list[str]], list[list[float]]], texts: list[str]) -> list:
    got = model(texts)
    if len(got) != len(texts):
        raise ValueError(f"mismatch between number of batch texts ({len(texts)}) and embeddings ({len(got)})")
    return list(got)


def embed_with(model: Callable[[list[str]], list[list[float]]], text: Column) -> Column:
    """Apply a user's model to a text column, 100 texts per call; an error of the model ends the job.

    ``model`` takes a list of texts and returns one vector per text, in order.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            vectors: list = []
            for at in range(0, len(series), EMBED_BATCH):
                vectors.extend(_vectors(model, series.iloc[at:at + EMBED_BATCH].tolist()))
            yield pd.Series(vectors, index=series.index, dtype=object)

    return run(text)


def embed_or_reason(model: Callable[[list[str]], list[list[float]]], text: Column) -> Column:
    """Struct of ``embedding`` and ``reason``: a text the model fails on has no vector and the model's error as reason.

    The texts of a failed call are asked for again one by one, so that a text only fails on its own account. Null texts
    are not sent; an empty vector is none.
    """

    def one(asked: str) -> tuple:
        try:
            return _vectors(model, [asked])[0], None
        except Exception as e:  # whatever the user's model raises
            return None, f"{type(e).__name__}: {e}"

    @F.pandas_udf("struct<embedding: array<float>, reason: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            found: list = [(None, "no text")] * len(series)
            present = [i for i, t in enumerate(series) if isinstance(t, str)]
            for at in range(0, len(present), EMBED_BATCH):
                some = present[at:at + EMBED_BATCH]
                texts = [series.iloc[i] for i in some]
                try:
                    got = [(v, None) for v in _vectors(model, texts)]
                except Exception:  # asked again below
                    got = [one(t) for t in texts]
                for i, (vector, reason) in zip(some, got):
                    empty = reason is None and (vector is None or not len(vector))
                    found[i] = (None, "empty vector") if empty else (vector, reason)
            yield pd.DataFrame({"embedding": pd.Series([v for v, _ in found], dtype=object),
                                "reason": pd.Series([r for _, r in found], dtype=object)})

    return run(text)


class Remembered(dict):
    """A function's results by argument; forgets them all when full."""

    def __init__(self, work: Callable, room: int = 500_000):
        super().__init__()
        self.work, self.room = work, room

    def __missing__(self, key):
        if len(self) >= self.room:
            self.clear()
        value = self[key] = self.work(key)
        return value

    def __reduce__(self):
        return Remembered, (self.work, self.room)


class WordBuckets:
    """Words of a text as buckets, by md5."""

    def __init__(self, dim: int, remember: int = 500_000):
        self.dim = dim
        self.bucket = Remembered(lambda word: int.from_bytes(hashlib.md5(word.encode()).digest()[:4]) % dim, remember)

    def of(self, text: str | None) -> list[int]:
        return [self.bucket[word] for word in _WORD.findall(text.lower())] if text else []

    def counts(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the text, bucket and how often, in order of text and bucket."""
        done, some, words, first = [], [], 0, 0
        for text in texts:
            some.append(self.of(text))
            words += len(some[-1])
            if words >= COUNT_WORDS:
                done.append(self._counts(some, first))
                some, words, first = [], 0, first + len(some)
        done.append(self._counts(some, first))
        return tuple(np.concatenate(x) for x in zip(*done))

    def _counts(self, found: list[list[int]], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        bucket = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        key, n = np.unique(np.repeat(np.arange(len(found)), sizes) * self.dim + bucket, return_counts=True)
        at, bucket = np.divmod(key, self.dim)
        return at + first, bucket, n


def hashed(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Built-in embedder, sparse form: bucket numbers, word counts, squared length.

    One row in, one row out: no shuffle, whatever the length of the text.
    """

    @F.arrow_udf(HASHED_TYPE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = WordBuckets(dim)
        for texts in batches:
            at, idx, cnt = buckets.counts(texts.to_pylist())
            ends = np.searchsorted(at, np.arange(len(texts) + 1)).astype(np.int32)
            norm2 = np.bincount(at, weights=cnt.astype(np.float64) ** 2, minlength=len(texts)).astype(np.int64)
            lists = lambda flat: pa.ListArray.from_arrays(ends, flat.astype(np.int32))
            yield pa.StructArray.from_arrays([lists(idx), lists(cnt), pa.array(norm2)],
                ["idx", "cnt", "norm2"])

    return run(text)


def hashed_unit(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Built-in embedder, dense form: a unit vector, null for a text without words."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = WordBuckets(dim)
        for texts in batches:
            vectors = np.zeros((len(texts), dim), dtype=np.float32)
            for i, t in enumerate(texts.to_pylist()):
                counts = np.bincount(buckets.of(t), minlength=dim).astype(np.float64)
                length = np.sqrt((counts ** 2).sum())
                if length:
                    vectors[i] = counts / length
            ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim)
            wordless = pa.array(~vectors.any(axis=1))
            yield pa.ListArray.from_arrays(ends, vectors.ravel(), mask=wordless)

    return run(text)


def normalised(vector: Column) -> Column:
    """Unit length, so that cosine is a dot product; a zero vector stays as it is."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(as_double, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(length > 0, F.transform(as_double, lambda x: (x / length).cast("float"))).otherwise(vector)


def checked_dim(vector: Column, dim: int) -> Column:
    """The vector, or a job failure if its size is not ``dim``."""
    wrong = F.raise_error(F.format_string(
        "vector has %d dimensions, the table has %d", F.size(vector), F.lit(dim)))
    return F.when(vector.isNull() | (F.size(vector) == dim), vector).otherwise(wrong.cast("array<float>"))
