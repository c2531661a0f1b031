"""Spelling variants of the corpus's words: neighbours one code point apart, found by sorting permuterm rotations.

A word w, marked by a terminator, has a rotation for each of its places. Two words that differ in one code point have
the same rotation behind it (the word read from after that place round to before it), and a word with a code point less
is that rotation whole. So all near words meet as runs of equal prefixes once the rotations are sorted, and a run holds at most one
word per code point of the alphabet plus one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from textquarry.llm.common import stored
from textquarry.llm.text_stats import CHUNK_BYTES, chunks

# Letters A-Z, a-z and U+00C0 to U+00FF in UTF-8; every 97th hash loses a code point.
RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
TYPO = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
# Sorts before every letter.
MARK = "\x00"
# Rotations of more code points are sorted by a digest that is carried on from place to place, so that a very long
# word costs as many steps as it has code points.
WHOLE = 64
# Words a task counts before it hands them on, and rotations a batch holds.
HELD, BATCH = 200_000, 50_000
# A rotation that is a word read whole; one that skips a code point; one that skips the first of equal code points.
FULL, SKIPS, SKIPS_FIRST = 0, 1, 2


def damaged(prefix: int, word: bytes) -> bytes:
    """The word as it stands in a document, ``prefix`` being the checksum of the document's part of the hash."""
    h = zlib.crc32(word, prefix)
    if h % TYPO:
        return word
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word``, ``n`` of all words of at least LEAST_LENGTH code points and LEAST_COUNT occurrences.

    Words are counted in the tasks first. A null doc_id hashes as the empty text; a null, empty or blank text has no words, a repeated row
    counts again, a very long one is read whole, other columns are left aside. An empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()),
                                                pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for part, texts in chunks(batch):
                for name, text in zip(part.column("id").to_pylist(), texts):
                    prefix = zlib.crc32(f"{name}:".encode())
                    # The words of a very long text are not held all at once.
                    lower = text.lower()
                    words = RUN.findall(lower) if len(lower) < CHUNK_BYTES else map(itemgetter(0), RUN.finditer(lower))
                    for word, n in Counter(words).items():
                        held[damaged(prefix, word)] += n
                    if len(held) >= HELD:
                        yield out()
        if held:
            yield out()

    found = rows.mapInArrow(count, "word string, n long")
    return (found.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


def rotations(word: str) -> Iterator[tuple[bytes, int, int]]:
    """Key and kind of every rotation of the marked word that ends at a place: the word whole, or without the code
    point at the place. Equal keys mean equal rotations: they are the text, or from WHOLE code points a digest with
    their length."""
    n = len(word)
    if n <= WHOLE:
        for i in range(n + 1):
            yield (word[i:] + MARK + word[:i]).encode(), FULL, i
    if n - 1 <= WHOLE:
        for i in range(n):
            yield (word[i + 1:] + MARK + word[:i]).encode(), SKIPS if i and word[i] == word[i - 1] else SKIPS_FIRST, i
    if n > WHOLE:
        yield from _long_rotations(word)


# Digests are polynomials of the code points modulo a prime of 127 bits at a fixed point.
_PRIME = (1 << 127) - 1
_POINT = int.from_bytes(hashlib.sha256(b"permuterm").digest()[:15], "big")


def _long_rotations(word: str) -> Iterator[tuple[bytes, int, int]]:
    n = len(word)
    before, powers = [0], [1]
    for c in word:
        before.append((before[-1] * _POINT + ord(c) + 1) % _PRIME)
        powers.append(powers[-1] * _POINT % _PRIME)

    def key(start: int, end: int) -> bytes:
        """word[start:] + mark + word[:end]"""
        tail = (before[n] - before[start] * powers[n - start]) % _PRIME
        whole = (tail * _POINT * powers[end] + before[end]) % _PRIME
        return b"\xff" + (n - start).to_bytes(8, "big") + end.to_bytes(8, "big") + whole.to_bytes(16, "big")

    for i in range(n + 1):
        yield key(i, i), FULL, i
    if n - 1 > WHOLE:
        for i in range(n):
            yield key(i + 1, i), SKIPS if i and word[i] == word[i - 1] else SKIPS_FIRST, i


def _rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rotations of the words of a batch: key, kind, and the word's place and count."""
    keys: list[bytes] = []
    kinds: list[int] = []
    places: list[int] = []
    counts: list[int] = []

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(kinds, pa.int8()), pa.array(places, pa.int64()),
                                            pa.array(counts, pa.int64())], ["key", "kind", "place", "n"])
        for x in (keys, kinds, places, counts):
            x.clear()
        return batch

    for batch in batches:
        for place, word, n in zip(*(batch.column(c).to_pylist() for c in ("place", "word", "n"))):
            for key, kind, _ in rotations(word):
                keys.append(key)
                kinds.append(kind)
                places.append(place)
                counts.append(n)
                if len(keys) >= BATCH:
                    yield out()
    if keys:
        yield out()


def _best(group: np.ndarray, n: np.ndarray, place: np.ndarray, chosen: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Per group the rows of the largest and second largest count (the lower place first) among those chosen, -1 if none."""
    rows = np.flatnonzero(chosen)
    rows = rows[np.lexsort((place[rows], -n[rows], group[rows]))]
    first, second = np.full(groups, -1), np.full(groups, -1)
    starts = np.flatnonzero(np.r_[True, group[rows][1:] != group[rows][:-1]]) if len(rows) else np.zeros(0, np.int64)
    first[group[rows[starts]]] = rows[starts]
    nexts = starts + 1
    nexts = nexts[(nexts < len(rows)) & ~np.isin(nexts, starts)]
    second[group[rows[nexts]]] = rows[nexts]
    return first, second


def scan(keys: pa.Array, kind: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """For sorted rotations: rows with near words in their run of equal keys, how many, and the best one's count and place.

    Rows that skip a code point are near all others that do (one replaced); those that skip the first of equal code
    points are near the word read whole (one inserted), so that every near word is met in one run only.
    """
    codes = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        codes[1:] = np.cumsum(pa.compute.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))
    groups = int(codes[-1]) + 1 if len(codes) else 0
    skips, firsts, full = kind >= SKIPS, kind == SKIPS_FIRST, kind == FULL
    n_skips, n_firsts = np.bincount(codes[skips], minlength=groups), np.bincount(codes[firsts], minlength=groups)
    n_full = np.bincount(codes[full], minlength=groups)
    near = np.where(full, n_firsts[codes], n_skips[codes] - 1 + np.where(firsts, n_full[codes], 0))
    top, after = _best(codes, n, place, skips, groups)
    top_first, _ = _best(codes, n, place, firsts, groups)
    top_full, _ = _best(codes, n, place, full, groups)
    rows = np.arange(len(keys))
    best = np.where(full, top_first[codes], np.where(top[codes] == rows, after[codes], top[codes]))
    other = np.where(firsts, top_full[codes], -1)
    better = (other >= 0) & ((best < 0) | (n[other] > n[best]) | ((n[other] == n[best]) & (place[other] < place[best])))
    best = np.where(better, other, best)
    met = np.flatnonzero(near > 0)
    return place[met], near[met], n[best[met]], place[best[met]]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run ``scan`` over sorted batches; a run that a batch may not hold whole is carried into the next."""
    carried: pa.Table | None = None

    def found(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        number = lambda c: table.column(c).to_numpy().astype(np.int64)
        keys = pa.concat_arrays(table.column("key").chunks) if table.num_rows else pa.array([], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in scan(keys, number("kind"), number("place"), number("n"))],
                                          ["place", "near", "best_n", "best_place"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        table = table if carried is None else pa.concat_tables([carried, table])
        last = table.column("key")[-1]
        held = pa.compute.equal(table.column("key"), last).to_numpy()
        cut = int(np.argmax(held))
        carried = table.slice(cut)
        if cut:
            yield found(table.slice(0, cut))
    if carried is not None:
        yield found(carried)


def nearest(words: DataFrame) -> DataFrame:
    """``place``, ``n_near`` and of the best near word ``best_n``, ``best_place``: the largest n, then the lowest place.

    Input: ``place`` (distinct, in the words' code-point order), ``word`` (distinct), ``n``. Words without a near word are left out.
    """
    turned = words.mapInArrow(_rotated, "key binary, kind tinyint, place long, n long")
    met = turned.orderBy("key").mapInArrow(_scanned, "place long, near long, best_n long, best_place long")
    best = F.max(F.struct(F.col("best_n"), (-F.col("best_place")).alias("back")))
    return met.groupBy("place").agg(F.sum("near").alias("n_near"), best.alias("best")).select(
        "place", "n_near", F.col("best.best_n").alias("best_n"), (-F.col("best.back")).alias("best_place"))


def variants(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """Groups of spelling variants among counted words.

    Input: ``word`` (distinct), ``n``; other columns are left aside, rows with a null are too. Returns every word with ``n``, ``n_near`` (words one code point
    apart), ``form`` (its near word of the largest n, ties by code points, if that n is at least ``ratio`` times its own, else null),
    ``form_n`` and ``root`` (the last word reached by forms; the word itself if it has none). An empty table gives no rows.

    A form has at least ``ratio`` (2 or more) times the count, so forms make no circle and paths are as long as the
    logarithm of the largest count; paths are halved in every round of the search for roots.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    # Places follow the sorted words and stay with them once written.
    ordered = counts.select("word", "n").where("word is not null and n is not null").orderBy("word")
    words = stored(ordered.withColumn("place", F.monotonically_increasing_id()), "words")
    near = nearest(words)
    linked = stored(words.join(near, "place", "left").select(
        "place", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_place")).alias("form_place"),
        F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_n")).alias("form_n")), "forms")
    ends = linked.where("form_place is not null").select("place", F.col("form_place").alias("to"))
    moving = not ends.isEmpty()
    while moving:
        onward = ends.select(F.col("place").alias("to"), F.col("to").alias("further"))
        ends = stored(ends.join(onward, "to", "left").select("place", F.coalesce("further", "to").alias("to"),
                                                             F.col("further").isNotNull().alias("moved")), "roots")
        moving = not ends.where("moved").isEmpty()
        ends = ends.select("place", "to")
    names = words.select(F.col("place").alias("form_place"), F.col("word").alias("form"))
    roots = ends.join(words.select(F.col("place").alias("to"), F.col("word").alias("root")), "to").select("place", "root")
    return (linked.join(names, "form_place", "left").join(roots, "place", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
