"""Counts of whole texts, made in Arrow batches: words, symbols, repeated lines and repeated word windows."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
WINDOW = 8
CHUNK_BYTES = 4_000_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits",
          "n_bangs", "n_bars", "n_distinct")


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch holding about ``most`` bytes of text each, with the texts as bytes (null as empty)."""
    texts = [b"" if t is None else t for t in batch.column(column).cast(pa.binary()).to_pylist()]
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most or i + 1 == len(texts):
            yield batch.slice(start, i + 1 - start), texts[start:i + 1]
            start, held = i + 1, 0


# Text that ``slices`` turns into Python values at a time; arrays of the words in it take some forty times as much.
SLICE_BYTES = 1_000_000


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The texts as bytes (null as empty), in runs of about ``most`` bytes. Only one run at a time becomes Python values, and what it took
    is given back to the system."""
    raw = texts.cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(raw):
        floor = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, floor + most, side="right")))
        yield [b"" if t is None else t for t in raw.slice(start, end - start).to_pylist()]
        start = end
        give_back()


def word_ids(words: list[list[bytes]]) -> tuple[np.ndarray, pa.Array]:
    """Words of several texts as numbers that stand for equal words, and the words by number."""
    if not any(words):
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    coded = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` neighbours; position matters."""
    n = max(0, len(values) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + values[k:k + n]
    return mixed(out)


def repeated_words(ids: np.ndarray, lengths: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per text, words inside a window of ``width`` words that the text holds twice or more.

    Windows are matched by hash, then by the words themselves.
    """
    texts = np.repeat(np.arange(len(lengths)), lengths)
    covered = np.zeros(len(ids) + 1, np.int64)
    if len(ids) >= width:
        hashes = window_hashes(mixed(ids + 1), width) ^ mixed(texts[:len(ids) - width + 1] + 0x5851F42D)
        inside = texts[:len(hashes)] == texts[width - 1:]
        at = np.flatnonzero(inside)
        order = at[np.argsort(hashes[at], kind="stable")]
        same = hashes[order[1:]] == hashes[order[:-1]]
        near = np.zeros(len(order), bool)
        near[1:] |= same
        near[:-1] |= same
        suspects = order[near]
        if len(suspects):
            rows = np.column_stack([texts[suspects], *(ids[suspects + k] for k in range(width))])
            _, group, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            hit = suspects[count[group.ravel()] > 1]
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + width, -1)
    marked = (np.cumsum(covered[:-1]) > 0).astype(np.int64)
    return np.bincount(texts, marked, len(lengths)).astype(np.int64)


def _duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those among them equal to an earlier one."""
    if b"\n" not in text:
        return int(bool(text.strip(SPACES))), 0
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines), len(lines) - len(set(lines))


def counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """``COUNTS`` of every text."""
    words = [t.split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    ids, _ = word_ids(words)
    lines = [_duplicate_lines(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), lengths)
    distinct = np.unique(owner * (int(ids.max()) + 1 if len(ids) else 1) + ids)
    each = lambda f: np.fromiter(map(f, texts), np.int64, len(texts))
    return {
        "n_words": lengths,
        "word_chars": each(lambda t: len(t.decode()) - (len(t) - len(t.translate(None, SPACES)))),
        "n_symbols": each(lambda t: len(t) - len(t.translate(None, SYMBOLS))),
        "n_dup_lines": np.array([d for _, d in lines], np.int64),
        "n_repeat_words": repeated_words(ids, lengths),
        "n_lines": np.array([n for n, _ in lines], np.int64),
        "n_upper": each(lambda t: len(t) - len(t.translate(None, UPPER))),
        "n_digits": each(lambda t: len(t) - len(t.translate(None, DIGITS))),
        "n_bangs": each(lambda t: t.count(b"!")),
        "n_bars": each(lambda t: t.count(b"|")),
        "n_distinct": np.bincount((distinct // (int(ids.max()) + 1)).astype(np.int64), minlength=len(texts))
        if len(ids) else np.zeros(len(texts), np.int64),
    }


def with_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of ``keep`` and ``COUNTS`` of the text (null: no words); one row per row."""
    kept = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                found = counts(texts)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + [pa.array(found[c]) for c in COUNTS],
                                                 [*kept, *COUNTS])

    schema = ", ".join([f"{k} {t}" for k, t in rows.dtypes if k != "text"] + [f"{c} long" for c in COUNTS])
    return rows.mapInArrow(count, schema).toDF(*keep, *COUNTS)


def counted(text: Column) -> Column:
    """``COUNTS`` of a text as a struct. Only the text goes to Python and only the counts come back; other columns stay where they are."""

    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [counts(some) for some in slices(texts)]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([f[c] for f in found]) if found else [], pa.int64()) for c in COUNTS],
                                             list(COUNTS))

    return run(text)


def features() -> dict[str, Column]:
    """Measures of a text that do not grow with it, from ``COUNTS``; 0 where there is no word."""
    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {"words": F.col("n_words").cast("double"), "word_length": per("word_chars", "n_words"),
            "symbol_share": per("n_symbols", "word_chars"), "bar_share": per("n_bars", "word_chars"),
            "upper_share": per("n_upper", "word_chars"), "digit_share": per("n_digits", "word_chars"),
            "bang_share": per("n_bangs", "n_words"), "line_words": per("n_words", "n_lines"),
            "repeat_share": per("n_repeat_words", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"),
            "distinct_share": per("n_distinct", "n_words")}


def labelled_sample(rows: DataFrame, labels: DataFrame, label: str, measures: list[str], most: int) -> "tuple[np.ndarray, np.ndarray]":
    """Measures and labels of up to about ``most`` labelled rows, chosen by a hash of their id; the fit's only bound.

    Labels of one doc_id that disagree leave it out, as do null ids and null labels.
    """
    agreed = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
              .agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2").select("doc_id", "y"))
    total = agreed.count()
    if total > most:
        agreed = agreed.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(most / total * (1 << 20)))
    found = rows.join(agreed, "doc_id").select("doc_id", "y", *measures).toPandas()
    found = found.sort_values(["doc_id", *measures], kind="stable")
    return found[measures].to_numpy(float), found["y"].to_numpy(int)
