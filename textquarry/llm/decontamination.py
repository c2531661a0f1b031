"""Benchmark passages in documents: fingerprints of item-sized windows, a multi-index Hamming search, an exact test.

All of it is column expressions and joins. A window has as many words as the item; both are multisets of word shingles.
Only windows that hold a shingle of some item are fingerprinted: others share nothing with any item, so none is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from textquarry.llm.common import BROADCAST_ROWS, small_side, stored, unused

WIDTH, SIMILARITY = 5, 0.75
# Windows at the similarity differ in 11 of 63 bits (deviation 3); RADIUS leaves four deviations.
BITS, RADIUS = 63, 23


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _shingles(words: str, width: int) -> str:
    """Hashes of every ``width`` neighbouring words, in order."""
    parts = ", ".join(f"get({words}, i + {k})" for k in range(width))
    return (f"if(size({words}) >= {width}, transform(sequence(0, size({words}) - {width}), i -> xxhash64({parts})), "
            "cast(array() as array<bigint>))")


def _by_width(words: str, widths: list[int], width: str) -> Column:
    return F.expr("case " + " ".join(f"when {width} = {w} then {_shingles(words, w)}" for w in widths) + " end")


def _lane_bits(most: int) -> int:
    """Bits of a counter that ``most`` shingles leave the top bit of free."""
    return next(b for b in (9, 21, 63) if most < 1 << (b - 1))


def fingerprint(hashes: str, lane: int) -> Column:
    """SimHash: a bit is set if more than half of the hashes have it. ``hashes`` names a column.

    Bits are counted in lanes of ``lane`` bits, several to a whole number. Adding the same to every lane brings those over
    half to their top bit. The sign bit is never used, so that sums do not overflow.
    """
    ones = sum(1 << (lane * i) for i in range(BITS // lane))
    add = ", ".join(f"acc.c{k} + (shiftrightunsigned(h, {k}) & {ones}L) as c{k}" for k in range(lane))
    lift = f"({(1 << (lane - 1)) - 1}L - size({hashes}) div 2) * {ones}L"
    tops = " | ".join(f"shiftleft(shiftrightunsigned((acc.c{k} + {lift}) & {ones << (lane - 1)}L, {lane - 1}), {k})" for k in range(lane))
    return F.expr(f"coalesce(aggregate({hashes}, named_struct({', '.join(f'{chr(39)}c{k}{chr(39)}, 0L' for k in range(lane))}), "
                  f"(acc, h) -> struct({add}), acc -> {tops}), 0L)")


def blocks(fp: str, radius: int) -> Column:
    """The fingerprint in radius + 1 blocks: two fingerprints within the radius agree in one of them at least."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.expr("array(" + ", ".join(
        f"named_struct('block', {i}, 'bits', shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1}L)"
        for i, (a, b) in enumerate(zip(cuts, cuts[1:]))) + ")")


def _items(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id, n_words, w (words per shingle: all of them in a shorter item) and the shingles of every item with a word."""
    items = benchmark.select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    w = F.least(F.size("words"), F.lit(width)).alias("w")
    return items.select("item_id", "words", w).select(
        "item_id", F.size("words").alias("n_words"), "w", _by_width("words", list(range(1, width + 1)), "w").alias("shingles"))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two lists, a shingle's weight being how often it occurs."""
    common = F.array_intersect(a, b)
    once = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    both = F.when(once, F.size(common)).otherwise(
        F.aggregate(common, F.lit(0), lambda s, h: s + F.least(times(a, h), times(b, h))))
    return both / (F.size(a) + F.size(b) - both)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def matches(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """Documents with a window like an item: _key, doc_id, item_id, start (word, from 0), n_words, similarity, hamming.

    Input: ``docs`` with doc_id and text, ``benchmark`` with item_id and text; more columns are left aside. One row per
    document and item, for the most similar window, the first of equals. Texts are lower-cased; null and wordless texts
    and items match nothing; repeated rows give one row; an item of fewer words than ``width`` is one shingle. A document
    of fewer words than the item is one window, all of it; n_words is that of the window.

    The shingles of all items are broadcast as long as they are few by count, else joined by a shuffle. Documents meet
    items by fingerprint blocks within the radius, then by the exact similarity.
    """
    items = stored(_items(benchmark, width), "items")
    facts = items.agg(F.max(F.size("shingles")).alias("most"), F.collect_set("w").alias("widths")).first()
    widths = sorted(facts["widths"]) or [width]
    lane = _lane_bits(facts["most"] or 1)
    asked = items.select("w", "n_words", F.explode("shingles").alias("h")).groupBy("h", "w").agg(F.collect_set("n_words").alias("sizes"))
    asked = small_side(stored(asked, "asked"))
    keyed = _keyed(docs.select("doc_id", "text"))
    texts = keyed.select("_key", _words(F.col("text")).alias("words"))
    found = [texts.select("_key", F.size("words").alias("n"), F.posexplode(F.expr(_shingles("words", w))).alias("pos", "h"))
             .join(asked.where(F.col("w") == w), "h").select("_key", "n", "w", "pos", F.explode("sizes").alias("n_words")) for w in widths]
    # A document shorter than the item holds too few shingles below this bound, which similarity cannot pass.
    enough = F.col("n") - F.col("w") + 1 >= least * (F.col("n_words") - F.col("w") + 1) - 1e-6
    hits = reduce(DataFrame.unionByName, found).where(enough)
    # All windows of an item's size that hold the shingle found at pos.
    first = F.greatest(F.lit(0), F.col("pos") - (F.col("n_words") - F.col("w")))
    last = F.least(F.col("pos"), F.greatest(F.lit(0), F.col("n") - F.col("n_words")))
    spans = hits.where(first <= last).groupBy("_key", "n_words", "w").agg(F.collect_set(F.struct(first.alias("a"), last.alias("b"))).alias("spans"))
    starts = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"]))))
    spans = stored(spans.select(F.col("_key").alias("k"), "n_words", "w", starts.alias("starts")), "spans")
    spans = small_side(spans, BROADCAST_ROWS)
    again = keyed.join(spans, F.col("_key") == F.col("k")).select("_key", "doc_id", "w", "n_words", "starts", _words(F.col("text")).alias("words"))
    again = again.select("_key", "doc_id", "n_words", "w", _by_width("words", widths, "w").alias("h"), "starts")
    # The generator reads h; beside it, h would be made anew for every window.
    slices = F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice("h", s + 1, F.col("n_words") - F.col("w") + 1).alias("x")))
    windows = again.select("_key", "doc_id", "n_words", F.inline(slices))
    windows = windows.withColumn("fp", fingerprint("x", lane))
    marked = items.withColumn("item_fp", fingerprint("shingles", lane))
    index = marked.select(F.explode(blocks("item_fp", radius)).alias("b"), "n_words", "item_id", "item_fp", F.col("shingles").alias("y"))
    index = small_side(stored(index.select("n_words", "b.block", "b.bits", "item_id", "item_fp", "y"), "index"))
    asked_blocks = windows.select("*", F.explode(blocks("fp", radius)).alias("b")).select(
        "_key", "doc_id", "n_words", "start", "x", "fp", "b.block", "b.bits")
    near = asked_blocks.join(index, ["n_words", "block", "bits"])
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = near.withColumn("hamming", hamming.cast("int")).where(F.col("hamming") <= radius)
    tested = near.withColumn("similarity", similarity(F.col("x"), F.col("y"))).where(F.col("similarity") >= least)
    w_words = F.size("x") + F.least(F.col("n_words"), F.lit(width)) - 1
    best = F.max_by(F.struct("start", w_words.alias("n_words"), "similarity", "hamming", "doc_id"), F.struct("similarity", -F.col("start")))
    return tested.groupBy("_key", "item_id").agg(best.alias("m")).select(
        "_key", "m.doc_id", "item_id", F.col("m.start").cast("long").alias("start"), F.col("m.n_words").cast("long").alias("n_words"),
        "m.similarity", "m.hamming")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, in which no benchmark item is found."""
    key = unused(docs, "_key")
    leaks = stored(matches(docs, benchmark, least).select(F.col("_key").alias(key)).distinct(), "leaks")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(small_side(leaks), key, "left_anti").drop(key)
