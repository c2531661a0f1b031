"""Repair of the structure of conversations: the cheapest edits that leave an optional system turn and pairs of user and assistant.

A conversation is a row of symbols (role initial and fault). Equal symbols in a row are one run, advanced by the binary powers
of the symbol's min-plus transition between the four states of the target pattern. Rows lie sorted over the tasks, a
conversation is cut into segments, and only the segments' transitions meet: costs run back over them, states forward,
and every segment unrolls its own choices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textquarry.llm.common import stored

# Costs of the edits, and of a cut-off text that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Faults of a row; blank and duplicate rows must go.
CLEAN, CUT, BLANK, DUPLICATE = 0, 1, 2, 3
ROLES = ("s", "u", "a")
# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
# The state that an inserted or renamed turn leads to: the user's, or the assistant's after the user's.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
# Rows of a segment at most.
SEGMENT = 65_536
NOTHING = hashlib.sha256(b"").hexdigest()


def after_keep(state: int, role: str) -> int | None:
    """The state after a turn that stays as it is, None if it cannot stand there."""
    if role == "s":
        return SYSTEM if state == START else None
    if role not in ROLES:
        return None
    return NEXT[state] if (NEXT[state] == USER) == (role == "u") else None


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product: the cheapest way through a, then b."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def _unit() -> np.ndarray:
    out = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(out, 0)
    return out


def _inserted() -> np.ndarray:
    """Any number of inserted turns."""
    step = _unit()
    for s in range(4):
        step[s, NEXT[s]] = min(step[s, NEXT[s]], INSERT)
    out = step
    for _ in range(3):
        out = product(out, step)
    return out


INSERTED = _inserted()


@lru_cache(maxsize=None)
def transition(role: str, fault: int, power: int = 0) -> np.ndarray:
    """What 2 ** power rows of a symbol cost from state to state, turns inserted before each included."""
    if power:
        half = transition(role, fault, power - 1)
        return product(half, half)
    step = np.full((4, 4), FAR, np.int64)
    stay = TRUNCATED if fault == CUT else 0
    for s in range(4):
        step[s, s] = DELETE
        if fault in (CLEAN, CUT):
            step[s, NEXT[s]] = min(step[s, NEXT[s]], REROLE + stay)
            kept = after_keep(s, role)
            if kept is not None:
                step[s, kept] = min(step[s, kept], stay)
    return product(INSERTED, step)


def advanced(role: str, fault: int, times: int) -> np.ndarray:
    """The transition of a run, from its binary powers."""
    out, power = None, 0
    while times:
        if times & 1:
            one = transition(role, fault, power)
            out = one if out is None else product(out, one)
        times >>= 1
        power += 1
    return _unit() if out is None else out


def costs_to_end() -> np.ndarray:
    """Per state after the last row: turns to insert until the pattern is whole."""
    return INSERTED[:, list(ENDS)].min(1)


def unrolled(runs: list[tuple[str, int, int]], state: int, to_go: np.ndarray) -> tuple[int, bytes, bytes]:
    """The state after the runs (role, fault, times), the initials of the cheapest edits, the ASCII-least of equal cost,
    and the state that each leads to; ``to_go`` is what every state costs after the runs."""
    after = [to_go]
    for role, fault, times in reversed(runs):
        after.append((advanced(role, fault, times) + after[-1]).min(1))
    after.reverse()
    audit, states = bytearray(), bytearray()
    for (role, fault, times), end in zip(runs, after[1:]):
        one = transition(role, fault)
        inner = [end]
        for _ in range(times):
            inner.append((one + inner[-1]).min(1))
        inner = [x.tolist() for x in reversed(inner)]
        may_stay = fault in (CLEAN, CUT)
        stay = TRUNCATED if fault == CUT else 0
        for here, there in zip(inner, inner[1:]):
            while DELETE + there[state] != here[state] and INSERT + here[NEXT[state]] == here[state]:
                state = NEXT[state]
                audit += b"I"
                states.append(state)
            kept = after_keep(state, role) if may_stay else None
            if DELETE + there[state] == here[state]:
                audit += b"D"
            elif kept is not None and stay + there[kept] == here[state]:
                audit += b"K"
                state = kept
            else:
                audit += b"R"
                state = NEXT[state]
            states.append(state)
    return state, bytes(audit), bytes(states)


def ending(state: int) -> tuple[bytes, bytes]:
    """Inserts after the last row, and the states they lead to."""
    states = bytearray()
    while state not in ENDS:
        state = NEXT[state]
        states.append(state)
    return b"I" * len(states), bytes(states)


def placed(turns: DataFrame) -> DataFrame:
    """Distinct rows of every conversation with ``copies``, in order: ``at`` rises with conv_id, turn (nulls first), role,
    text. Rows lie sorted over the tasks, so a conversation may take many; equal rows are counted before they are sorted."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    distinct = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), CLEAN).otherwise(CUT).cast("tinyint")
    ordered = distinct.orderBy("conv_id", "turn", "role", "text")
    return stored(ordered.select("*", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"),
                                 F.sha2("text", 256).alias("said"), F.monotonically_increasing_id().alias("at")), "turns")


def _faults(rows: DataFrame) -> DataFrame:
    """Rows without their texts, ``fault`` DUPLICATE where role and text stand earlier in the conversation."""
    firsts = rows.where(F.col("fault") != BLANK).groupBy("conv_id", "role", "said").agg(F.min("at").alias("at")).select(
        "at", F.lit(True).alias("is_first"))
    light = rows.select("conv_id", "turn", "copies", "initial", "fault", "at").join(firsts, "at", "left")
    return light.withColumn("fault", F.when((F.col("fault") != BLANK) & F.col("is_first").isNull(), DUPLICATE)
                            .otherwise(F.col("fault")).cast("tinyint")).drop("is_first")


def _runs(initials: list[str], faults: list[int], copies: list[int]) -> list[tuple[str, int, int]]:
    """Symbols of consecutive rows, equal ones collapsed. Copies behind the first of a row must go like blank rows."""
    out: list[list] = []

    def put(role: str, fault: int, times: int) -> None:
        if out and out[-1][0] == role and out[-1][1] == fault:
            out[-1][2] += times
        else:
            out.append([role, fault, times])

    for initial, fault, n in zip(initials, faults, copies):
        gone = fault in (BLANK, DUPLICATE)
        # A row that must go has one transition whatever its role.
        put("" if gone else initial if initial in ROLES else "x", BLANK if gone else fault, n if gone else 1)
        if not gone and n > 1:
            put("", BLANK, n - 1)
    return [tuple(x) for x in out]


def _through(runs: list[tuple[str, int, int]]) -> np.ndarray:
    out = _unit()
    for run in runs:
        out = product(out, advanced(*run))
    return out


def _segmented(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Segments of rows sorted by ``at``: a conversation's rows of consecutive places, ``most`` at most."""
    rows: list[tuple] = []
    done: list[tuple] = []
    kind: pa.DataType | None = None

    def close() -> None:
        conv, at, *_ = rows[0]
        _, _, initials, faults, copies = map(list, zip(*rows))
        runs = _runs(initials, faults, copies)
        illegal = sum(n - 1 for n in copies) + sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        done.append((conv, at, copies, [{"role": r, "fault": f, "times": n} for r, f, n in runs], _through(runs).ravel().tolist(),
                     illegal, initials[0], initials[-1]))
        rows.clear()

    def out() -> pa.RecordBatch:
        names = ["conv_id", "at", "copies", "runs", "through", "illegal", "first", "last"]
        run = pa.struct([("role", pa.string()), ("fault", pa.int32()), ("times", pa.int64())])
        kinds = [kind, pa.int64(), pa.list_(pa.int64()), pa.list_(run), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names)
        done.clear()
        return batch

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "initial", "fault", "copies"))):
            if rows and (row[0] != rows[0][0] or row[1] != rows[-1][1] + 1 or len(rows) >= most):
                close()
            rows.append(row)
        if len(done) >= 1000:
            yield out()
    if rows:
        close()
    if done:
        yield out()


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation, from its segments' transitions: the cost to go after each segment, back from the last."""
    part = pa.struct([("at", pa.int64()), ("to_go", pa.list_(pa.int64()))])
    for batch in batches:
        costs, illegal, parts = [], [], []
        for found in batch.column("parts").to_pylist():
            to_go, out = costs_to_end(), []
            for x in reversed(found):
                out.append({"at": x["at"], "to_go": to_go.tolist()})
                to_go = (np.array(x["through"], np.int64).reshape(4, 4) + to_go).min(1)
            costs.append(int(to_go[START]))
            illegal.append(sum(x["illegal"] for x in found)
                           + sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(found, found[1:])))
            parts.append(out)
        yield pa.RecordBatch.from_arrays([pa.array(costs, pa.int64()), pa.array(illegal, pa.int64()), pa.array(parts, pa.list_(part))],
                                         ["cost", "illegal", "parts"])


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment and state before it: the state after it, the edits and the states they lead to. The first segment of
    a conversation has one state before it."""
    choice = pa.struct([("end", pa.int32()), ("audit", pa.binary()), ("states", pa.binary())])
    for batch in batches:
        out = []
        for runs, to_go, is_first in zip(*(batch.column(c).to_pylist() for c in ("runs", "to_go", "is_first"))):
            symbols = [(r["role"], r["fault"], r["times"]) for r in runs]
            each = [unrolled(symbols, s, np.array(to_go, np.int64)) for s in ([START] if is_first else range(4))]
            out.append([dict(zip(("end", "audit", "states"), x)) for x in each])
        kept = [batch.column(c) for c in ("conv_id", "at", "copies", "cost", "illegal")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.list_(choice))], ["conv_id", "at", "copies", "cost", "illegal", "choices"])


def _decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row that stays or has a turn inserted beside it: roles inserted before, its new role (null: its own), whether
    it stays, and roles inserted behind it."""
    names = pa.list_(pa.string())
    for batch in batches:
        for at, copies, choice, tail in zip(*(batch.column(c).to_pylist() for c in ("at", "copies", "choice", "tail"))):
            edits = iter(zip(choice["audit"], choice["states"]))
            out: list[tuple] = []
            for i, n in enumerate(copies):
                before, role, stays, after = [], None, False, []
                for _ in range(n):
                    for edit, state in edits:
                        if edit != ord("I"):
                            break
                        (after if stays else before).append(NAMES[state])
                    if edit != ord("D"):
                        stays, role = True, NAMES[state] if edit == ord("R") else None
                if i + 1 == len(copies):
                    after += [NAMES[s] for s in tail]
                if stays or before or after:
                    out.append((at + i, before, role, stays, after))
            if out:
                kinds = [pa.int64(), names, pa.string(), pa.bool_(), names]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["at", "before", "new_role", "stays", "behind"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every conversation's turns, fed line by line in their order."""
    digest, conv, kind = None, None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for name, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if digest is not None and name != conv:
                yield out()
                digest = None
            if digest is None:
                digest, conv = hashlib.sha256(), name
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
    if digest is not None:
        yield out()


class Repair:
    """The repair of all conversations.

    Input: conv_id, turn, role, text; other columns are left aside. A null role or text is one space, a null conv_id is a
    conversation of its own, null turns come first, rows of one turn are ordered by role and text, equal rows repeat each
    other. A turn without a role, or with another initial, cannot stay as it is. No row: nothing.

    ``summary()``: per conv_id gaps, blank, duplicate, truncated, illegal, cost, audit. ``turns()``: the repaired rows, ordered by
    at, part within a conversation. ``digests()``: per conv_id with a turn left, repaired_sha256 of its ``role:text`` lines.

    A conversation's rows may lie in many tasks; per segment of up to ``segment`` rows its runs, one 4 x 4 transition and,
    where more than one state may come before it, a choice for each are kept. What meets per conversation is a row per segment, the
    audit itself, and the texts as a stream for the digest, which runs in order by its nature.
    """

    def __init__(self, turns: DataFrame, segment: int = SEGMENT):
        self.rows = placed(turns)
        self.faults = stored(_faults(self.rows), "faults")
        kind = dict(self.rows.dtypes)["conv_id"]
        segments = stored(self.faults.orderBy("at").mapInArrow(
            lambda batches: _segmented(batches, segment), f"conv_id {kind}, at long, copies array<bigint>, runs array<struct<role:string,fault:int,times:bigint>>, "
                        "through array<bigint>, illegal long, first string, last string"), "segments")
        parts = segments.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "through", "illegal", "first", "last"))).alias("parts"))
        costs = parts.select("parts").mapInArrow(_costs, "cost long, illegal long, parts array<struct<at:bigint,to_go:array<bigint>>>")
        part = F.posexplode(F.reverse("parts"))
        costs = costs.select("cost", "illegal", part.alias("place", "part")).select(
            "cost", "illegal", (F.col("place") == 0).alias("is_first"), "part.at", "part.to_go")
        choices = stored(segments.select("conv_id", "at", "copies", "runs").join(costs, "at").mapInArrow(
            _choices, f"conv_id {kind}, at long, copies array<bigint>, cost long, illegal long, "
                      "choices array<struct<end:int,audit:binary,states:binary>>"), "choices")
        # From segment to segment: the state that the choices so far end in.
        ends = choices.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", F.transform(
            "choices", lambda c: c["end"]).alias("ends")))).alias("parts"))
        path = F.aggregate("parts", F.struct(F.lit(START).alias("state"), F.array().cast("array<struct<at:bigint,before:int>>").alias("path")),
                           lambda acc, x: F.struct(F.get(x["ends"], acc["state"]).alias("state"), F.concat(acc["path"], F.array(
                               F.struct(x["at"].alias("at"), acc["state"].alias("before")))).alias("path")))
        ways = ends.select(path.alias("way"), F.size("parts").alias("n")).select("way.state", "n", F.posexplode("way.path").alias("place", "x"))
        tails = F.create_map(*[F.lit(x) for s in range(4) for x in (s, ending(s)[1])])
        ways = ways.select("x.at", "x.before", F.when(F.col("place") == F.col("n") - 1, tails[F.col("state")]).otherwise(
            F.lit(b"")).alias("tail"))
        self.chosen = stored(choices.join(ways, "at").select("conv_id", "at", "copies", "cost", "illegal", "tail",
                                                             F.get("choices", F.col("before")).alias("choice")), "chosen")

    def summary(self) -> DataFrame:
        copies, fault = F.col("copies"), F.col("fault")
        gone = F.when(fault == DUPLICATE, copies).when(fault != BLANK, copies - 1).otherwise(0)
        counts = self.faults.groupBy("conv_id").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
            F.sum(F.when(fault == BLANK, copies).otherwise(0)).alias("blank"), F.sum(gone).alias("duplicate"),
            F.sum((fault == CUT).cast("long")).alias("truncated"))
        edits = F.concat(F.col("choice.audit").cast("string"), F.repeat(F.lit("I"), F.length("tail")))
        audits = self.chosen.groupBy("conv_id").agg(
            F.max("illegal").alias("illegal"), F.max("cost").alias("cost"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("at"), edits.alias("edits")))), lambda x: x["edits"]), "").alias("audit"))
        return same_conversation(counts, audits)

    def turns(self) -> DataFrame:
        decided = self.chosen.mapInArrow(_decisions, "at long, before array<string>, new_role string, stays boolean, behind array<string>")
        made = lambda c: F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
        own = F.when(F.col("stays"), F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text")))).otherwise(
            F.array().cast("array<struct<role:string,text:string>>"))
        lines = F.posexplode(F.concat(made("before"), own, made("behind")))
        return self.rows.select("conv_id", "at", "turn", "role", "text").join(decided, "at").select(
            "conv_id", "at", "turn", lines.alias("part", "line")).select("conv_id", "at", "part", "turn", "line.role", "line.text")

    def digests(self) -> DataFrame:
        kind = dict(self.rows.dtypes)["conv_id"]
        lines = self.turns().repartition("conv_id").sortWithinPartitions("conv_id", "at", "part")
        return lines.select("conv_id", "role", "text").mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string")


def same_conversation(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on conv_id, null being a conversation too."""
    return left.join(right.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")


def damage(turns: DataFrame) -> DataFrame:
    """Rows as a checksum of conversation and turn spoils them: one in 20 dropped, emptied, without its full stops, doubled, or
    given to the user each."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), h.alias("h")).where("h <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "h")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1)))).drop("col")


def report(originals: DataFrame, fixed: Repair) -> DataFrame:
    """Summary and digest for every conv_id of ``originals``; zeros and empty texts where no row is left."""
    every = originals.select("conv_id").distinct()
    out = same_conversation(same_conversation(every, fixed.summary()), fixed.digests())
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))
