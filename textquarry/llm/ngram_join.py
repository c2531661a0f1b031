"""Jaccard join of documents on word shingles by vertical partitioning.

The global order of shingles (by hash) is cut into fragments, and every document's set into segments, one per fragment.
A fragment sees the segments of all documents: it drops what no second document has and keeps how many have the rest.
Pairs are tested the same way: overlaps are counted per fragment and summed per pair.

Which pairs are tested follows from what is left, without losing a link:
- a document links only if three quarters of its set are left, and again after documents that cannot link are gone;
- linked documents share a shingle of both prefixes, the rarest shingles of what is left;
- overlap is at most what is left of either, which bounds the size of the other, less the bits that only one of two
  bitmaps of shingles has.
Groups of copies are not paired out. Equal sets are one node. Then documents that share a prefix shingle are tested with
one of them, in a few rounds; links join components, and only pairs still in different components are tested at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textquarry.llm.common import small_side, stored, unused
from textquarry.llm.components import components
from textquarry.llm.shingles import WIDTH, set_key, shingle_sets
from textquarry.llm.text_stats import chunks
from textquarry.session import estimated_bytes

SIMILARITY = 75  # percent
# Input bytes a fragment is made for, fragments at least; parts in which the overlap of a pair is counted.
FRAGMENT_BYTES = 8 << 20
FRAGMENTS = 64
PAIR_PARTS = 4
HUB_ROUNDS = 3
# Words of 64 bits in a document's bitmap.
BITMAP = 8

_SEGMENTS = "frag int, key long, doc_id long, n long, toks array<bigint>, freqs array<int>"
_BLOBS = "frag int, doc_ids array<bigint>, keys binary, sizes binary, toks binary"
_BLOB_NAMES = ["frag", "doc_ids", "keys", "sizes", "toks"]


def fragments_for(docs: DataFrame) -> int:
    """Number of fragments; grows with a large input so that one fragment does not."""
    return int(min(1 << 20, max(FRAGMENTS, estimated_bytes(docs) // FRAGMENT_BYTES)))


def _cut(docs: DataFrame, width: int, n_fragments: int) -> DataFrame:
    """Segments of all documents, packed per fragment; the documents themselves travel with some fragment."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for part, texts in chunks(batch):
                sets = shingle_sets(texts, width)
                sizes = np.array([len(s) for s in sets], np.int64)
                keys = np.array([set_key(s) if len(s) else 0 for s in sets], np.int64)
                tokens = np.concatenate(sets)
                frag = ((tokens >> np.uint64(32)) * np.uint64(n_fragments) >> np.uint64(32)).astype(np.int32)
                owner = np.repeat(np.arange(len(sets)), sizes)
                order = np.argsort(frag, kind="stable")
                frag, owner, tokens = frag[order], owner[order], tokens[order]
                new = np.flatnonzero(np.concatenate([[True], (frag[1:] != frag[:-1]) | (owner[1:] != owner[:-1])])[:len(frag)])
                counts = np.diff(np.append(new, len(frag))).astype(np.uint32)
                seg_frag, seg_key = frag[new], keys[owner[new]]
                starts = np.flatnonzero(np.concatenate([[True], seg_frag[1:] != seg_frag[:-1]])[:len(seg_frag)])
                ends = np.append(starts[1:], len(seg_frag))
                first = np.append(new, len(frag))
                turn = (turn + 7919) % n_fragments
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(seg_frag[s]) for s in starts] + [turn], pa.int32()),
                    pa.array([None] * len(starts) + [part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([seg_key[s:e].tobytes() for s, e in zip(starts, ends)] + [keys.tobytes()], pa.binary()),
                    pa.array([counts[s:e].tobytes() for s, e in zip(starts, ends)] + [sizes.tobytes()], pa.binary()),
                    pa.array([tokens[first[s]:first[e]].tobytes() for s, e in zip(starts, ends)] + [None], pa.binary()),
                ], _BLOB_NAMES)

    return rows.mapInArrow(cut, _BLOBS)


def _table(frag: int, keys: np.ndarray, doc_ids: pa.Array | None, n: np.ndarray | None, lists: list | None) -> pa.Table:
    rows = len(keys)
    none = lambda t: pa.nulls(rows, t)
    toks, freqs = lists if lists else (none(pa.list_(pa.int64())), none(pa.list_(pa.int32())))
    return pa.Table.from_arrays([
        pa.array(np.full(rows, frag), pa.int32()), pa.array(keys, pa.int64()),
        none(pa.int64()) if doc_ids is None else doc_ids, none(pa.int64()) if n is None else pa.array(n, pa.int64()),
        toks, freqs], ["frag", "key", "doc_id", "n", "toks", "freqs"])


def _shared(frag: int, keys: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> pa.Table:
    """The tokens of a fragment that two documents or more hold, by document, with the number of documents."""
    _, first = np.unique(keys, return_index=True)
    if len(first) < len(keys):  # equal sets: once
        keep = np.zeros(len(keys), bool)
        keep[first] = True
        tokens = tokens[np.repeat(keep, counts)]
        keys, counts = keys[keep], counts[keep]
    segment = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
    order = np.argsort(tokens)
    tokens = tokens[order]
    new = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])[:len(tokens)])
    freq = np.repeat(f := np.diff(np.append(new, len(tokens))), f).astype(np.int32)
    held = freq > 1
    segment, tokens, freq = segment[order[held]], tokens[held], freq[held]
    order = np.argsort(segment, kind="stable")
    segment, tokens, freq = segment[order], tokens[order], freq[order]
    at = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])[:len(segment)])
    offsets = pa.array(np.append(at, len(segment)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(tokens.view(np.int64))),
             pa.ListArray.from_arrays(offsets, pa.array(freq))]
    return _table(frag, keys[segment[at]], None, None, lists)


def _first_fragments(blobs: DataFrame) -> DataFrame:
    def of(group: pa.Table) -> pa.Table:
        frag = group.column("frag")[0].as_py()
        out, keys, counts, tokens = [], [], [], []
        for ids, k, s, t in zip(*(group.column(c).to_pylist() if c == "doc_ids" else group.column(c)
                                  for c in ("doc_ids", "keys", "sizes", "toks"))):
            if ids is not None:
                out.append(_table(frag, np.frombuffer(k.as_buffer(), np.int64), pa.array(ids, pa.int64()),
                                  np.frombuffer(s.as_buffer(), np.int64), None))
            else:
                keys.append(np.frombuffer(k.as_buffer(), np.int64))
                counts.append(np.frombuffer(s.as_buffer(), np.uint32))
                tokens.append(np.frombuffer(t.as_buffer(), np.uint64))
        if tokens:
            out.append(_shared(frag, np.concatenate(keys), np.concatenate(counts).astype(np.int64), np.concatenate(tokens)))
        return pa.concat_tables(out)

    return blobs.groupBy("frag").applyInArrow(of, _SEGMENTS)


def _again(segments: DataFrame) -> DataFrame:
    """Fragments once more, after documents have gone."""
    def of(group: pa.Table) -> pa.Table:
        lists = group.column("toks").combine_chunks()
        counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        return _shared(group.column("frag")[0].as_py(), group.column("key").to_numpy(), counts,
                       lists.flatten().to_numpy().view(np.uint64))

    return segments.groupBy("frag").applyInArrow(of, _SEGMENTS)


def _able(segments: DataFrame, sizes: DataFrame, similarity: int) -> DataFrame:
    """``key``, ``n``, ``s``: documents of whose set enough is left (s tokens) to link."""
    left = segments.groupBy("key").agg(F.sum(F.size("toks")).alias("s"))
    return left.join(sizes, "key").where(100 * F.col("s") >= similarity * F.col("n")).select("key", "n", "s")


def _bound(similarity: int) -> str:
    """Sizes n, m of which s, t tokens are left can reach the similarity."""
    return f"(100 + {similarity}) * least(s, t) >= {similarity} * (n + m)"


def _bitmap(tokens: str) -> str:
    """A bit for every token's hash; several tokens may share one."""
    zeros = ", ".join(f"'b{k}', 0L" for k in range(BITMAP))
    bit = "shiftleft(1L, cast(shiftrightunsigned(o.t, 8) & 63 as int))"
    put = ", ".join(f"acc.b{k} | if(o.t & {BITMAP - 1} = {k}, {bit}, 0L) as b{k}" for k in range(BITMAP))
    return f"aggregate({tokens}, named_struct({zeros}), (acc, o) -> struct({put}))"


def _bitmap_bound(similarity: int) -> str:
    """As ``_bound``, but a bit that only one bitmap (x or y) has is a token that the other document lacks."""
    only = lambda a, b: " - ".join(f"bit_count({a}.b{k} & ~{b}.b{k})" for k in range(BITMAP))
    return f"(100 + {similarity}) * least(s - {only('x', 'y')}, t - {only('y', 'x')}) >= {similarity} * (n + m)"


def _test(pairs: DataFrame, parts: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b, n, m) that link: overlaps per part of the order, summed per pair.

    One document may be in very many pairs; both joins are on a document and a part, and AQE splits what is too large.
    """
    a = parts.select(F.col("key").alias("a"), "part", F.col("toks").alias("x"))
    b = parts.select(F.col("key").alias("b"), "part", F.col("toks").alias("y"))
    overlap = pairs.join(a, "a").join(b, ["b", "part"]).select("a", "b", "n", "m", F.size(F.array_intersect("x", "y")).alias("o"))
    return (overlap.groupBy("a", "b").agg(F.sum("o").alias("o"), F.first("n").alias("n"), F.first("m").alias("m"))
            .where(f"100 * o >= {similarity} * (n + m - o)").select("a", "b"))


def _relabelled(keys: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).select(F.col("node").alias("key"), "label")
    return stored(keys.join(found, "key", "left").select("key", F.coalesce("label", "key").alias("label")), "labels")


def _links(prefixes: DataFrame, bitmaps: DataFrame, parts: DataFrame, keys: DataFrame, similarity: int) -> DataFrame:
    """Links enough to connect what all links connect. ``prefixes``: tok, key, n, s; ``bitmaps``: key, x."""
    links, labels = None, keys.select("key", F.col("key").alias("label"))
    for turn in range(HUB_ROUNDS + 1):
        members = stored(prefixes.join(labels, "key"), "members")
        rank = F.struct((F.col("s") / F.col("n")).alias("r"), F.xxhash64("key", F.lit(turn)).alias("h")) if turn == 0 else \
            F.struct(F.xxhash64("key", F.lit(turn)).alias("h"))
        hub = F.struct("key", "label", "n", "s")
        if turn < HUB_ROUNDS:
            hubs = members.groupBy("tok").agg(F.max_by(hub, rank).alias("hub"), F.min("label").alias("l0"), F.max("label").alias("l1"))
            hubs = hubs.where("l0 <> l1").select("tok", *[F.col(f"hub.{c}").alias(o) for c, o in
                                                        (("key", "key2"), ("label", "label2"), ("n", "m"), ("s", "t"))])
            found = members.join(hubs, "tok").where("label <> label2")
        else:
            # The label most members of a token carry; only the others are paired, with whoever differs.
            each = members.groupBy("tok", "label").agg(F.count("*").alias("c"))
            most = (each.groupBy("tok").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count("*").alias("k"))
                    .where("k > 1").select("tok", "most"))
            members = stored(members.join(most, "tok").join(bitmaps, "key"), "members")
            other = members.where("label <> most").select("tok", F.col("key").alias("key2"), F.col("label").alias("label2"),
                                                          F.col("n").alias("m"), F.col("s").alias("t"), F.col("x").alias("y"))
            found = members.join(other, "tok").where("label <> label2 and (label = most or key < key2)").where(
                _bitmap_bound(similarity))
        pairs = found.where(_bound(similarity)).select(
            F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b"),
            F.expr("if(key < key2, n, m)").alias("n"), F.expr("if(key < key2, m, n)").alias("m")).distinct()
        new = stored(_test(pairs, parts, similarity), "links")
        if new.isEmpty() and turn < HUB_ROUNDS:
            continue
        links = new if links is None else links.unionByName(new)
        if turn < HUB_ROUNDS:
            labels = _relabelled(keys, links)
    return links


def join(docs: DataFrame, similarity: int = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    Input: doc_id (whole number) and text; more columns are left aside. Words are runs of other than ASCII white space,
    A-Z lower-cased. Null and wordless texts have no shingles and link with nothing; fewer words than ``width`` are one
    shingle; rows with an equal doc_id are rows of their own. component_id is the smallest non-null doc_id among the
    texts reached by links of at least ``similarity`` percent, the row's own included.
    """
    n_fragments = fragments_for(docs)
    cut = stored(_first_fragments(_cut(docs, width, n_fragments)), "segments")
    rows = cut.where("n is not null").select("doc_id", "n", "key")
    sizes = stored(rows.where("n > 0").groupBy("key").agg(F.first("n").alias("n")), "sizes")
    segments = cut.where("toks is not null").select("frag", "key", "toks")
    able = stored(_able(segments, sizes, similarity), "able")
    segments = stored(_again(segments.join(able.select("key"), "key", "left_semi")).select("frag", "key", "toks", "freqs"), "segments")
    able = stored(_able(segments, sizes, similarity), "able")
    segments = segments.join(able, "key")
    # The rarest tokens left: any partner within reach shares one of them.
    prefix = F.expr(f"cast(s - ceil({similarity} * n / 100.0) + 1 as int)")
    order = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("freqs").alias("f"), F.col("toks").alias("t")))))
    sets = stored(segments.groupBy("key", "n", "s").agg(order.alias("o")).select(
        "key", "n", "s", F.slice("o", F.lit(1), prefix).alias("p"), F.expr(_bitmap("o")).alias("x")), "sets")
    prefixes = sets.select(F.explode("p").alias("o"), "key", "n", "s").select(F.col("o.t").alias("tok"), "key", "n", "s")
    part = F.expr(f"cast(frag * {PAIR_PARTS}L div {n_fragments} as int)")
    parts = stored(segments.groupBy("key", part.alias("part")).agg(F.flatten(F.collect_list("toks")).alias("toks")), "parts")
    labels = components(_links(prefixes, sets.select("key", "x"), parts, able, similarity)).select(F.col("node").alias("key"), "label")
    labelled = stored(rows.join(labels, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("label", "key")).alias("label")), "labelled")
    smallest = labelled.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(smallest, "label", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One row of each component, that of the smallest doc_id; rows with null doc_id stay, of repeated rows one.

    A doc_id is expected to name one text. All columns stay, whatever their names. Only ids travel: those that go are broadcast if they are few by count.
    """
    go, two = unused(docs, "gone"), unused(docs, "twice")
    found = stored(join(docs, similarity).where("doc_id is not null"), "groups")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(go)).distinct()
    left = docs.join(small_side(stored(gone, "gone")), F.col("doc_id") == F.col(go), "left_anti")
    twice = stored(found.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias(two)), "twice")
    if twice.isEmpty():
        return left
    twice = small_side(twice)
    same = F.col("doc_id") == F.col(two)
    return left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
