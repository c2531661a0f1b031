"""Conversation repair against all edits tried out."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from textquarry.llm import repair
from textquarry.llm.repair import BLANK, CLEAN, CUT, DUPLICATE, Repair, report

LEGAL = re.compile(r"(s?(ua)+)?")


def initials(lines):
    """Role initials; a turn without a role can stand nowhere."""
    return "".join(r[:1] or "?" for r, _ in lines)


def all_ways(rows):
    """(cost, audit, lines) of every way with at most two turns inserted at a place; rows are (role, text, fault)."""
    ways = [(0, "", [])]

    def grown(ways):
        out = list(ways)
        for _ in range(2):
            ways = [(c + 3, a + "I", lines + [(r, "")]) for c, a, lines in ways for r in ("user", "assistant")]
            out += ways
        return [w for w in out if re.fullmatch("s?(ua)*u?", initials(w[2]))]

    for role, text, fault in rows:
        nexts = []
        for c, a, lines in grown(ways):
            nexts.append((c + 4, a + "D", lines))
            if fault in (CLEAN, CUT):
                stay = 3 if fault == CUT else 0
                nexts.append((c + stay, a + "K", lines + [(role, text)]))
                nexts += [(c + 3 + stay, a + "R", lines + [(r, text)]) for r in ("user", "assistant")]
        ways = [w for w in nexts if re.fullmatch("s?(ua)*u?", initials(w[2]))]
    return [w for w in grown(ways) if LEGAL.fullmatch(initials(w[2]))]


def expected(rows):
    """The report of one conversation from rows (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append(BLANK if not last else DUPLICATE if (role, text) in seen else CLEAN if last in ".!?" else CUT)
        seen.add((role, text))
    cost, audit, lines = min(all_ways([(r, x, f) for (_, r, x), f in zip(rows, faults)]), key=lambda w: (w[0], w[1]))
    turns = {t for t, _, _ in rows if t is not None}
    starts = [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest())


def found(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"])
            for r in df.collect()}


SYMBOLS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), st.sampled_from([CLEAN, CUT, BLANK])), max_size=5)


@given(SYMBOLS)
@settings(max_examples=150, deadline=None)
def test_choices_are_the_cheapest_and_least(rows):
    runs = repair._runs([r[0] for r, _ in rows], [f for _, f in rows], [1] * len(rows))
    cost, audit, lines = min(all_ways([(r, "", f) for r, f in rows]), key=lambda w: (w[0], w[1]))
    to_go = repair.costs_to_end()
    assert (repair._through(runs) + to_go).min(1)[0] == cost
    state, edits, _ = repair.unrolled(runs, 0, to_go)
    assert (edits + repair.ending(state)[0]).decode() == audit


@given(SYMBOLS, st.integers(1, 4), st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_powers_equal_single_steps(rows, cut, times):
    runs = repair._runs([r[0] for r, _ in rows], [f for _, f in rows], [times] * len(rows))
    single = repair._unit()
    for role, fault, n in runs:
        for _ in range(n):
            single = repair.product(single, repair.transition(role, fault))
    assert (repair._through(runs) == single).all()
    halves = repair.product(repair._through(runs[:cut]), repair._through(runs[cut:]))
    assert (halves == single).all()


def talks(seed, n, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \n", "Yes.", "Go on!\t", None, "end.\x85"]
    rows = []
    for conv in [*range(n), None]:
        for _ in range(rng.randrange(1, most)):
            rows.append((conv, rng.choice([0, 1, 2, 3, 5, 9, None]), rng.choice(["system", "user", "assistant", "tool", "", None]), rng.choice(texts)))
    return rows


def test_against_all_edits(spark):
    rows = talks(1, 60, 6)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, fault string")
    want = {c: expected([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    for segment in (65_536, 2):
        fixed = Repair(df, segment)
        assert found(report(df, fixed)) == want
    turns = fixed.turns().orderBy("at", "part").collect()
    for conv in want:
        lines = "\n".join(f"{r['role']}:{r['text']}" for r in turns if r["conv_id"] == conv)
        assert hashlib.sha256(lines.encode()).hexdigest() == want[conv][-1]


def test_one_long_conversation_in_many_tasks_and_segments(spark):
    rng = random.Random(3)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"Text {rng.randrange(900)}" + rng.choice(["", ".", "!"])) for i in range(2_000)]
    rows += [(7, 2_100, "user", "Again."), (8, 0, "user", "")] * 700
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = found(report(df, Repair(df)))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = Repair(df, 50)
        assert found(report(df, parts)) == whole
        assert parts.chosen.count() > 40
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    gaps, blank, duplicate, *_, audit, _ = whole[7]
    assert gaps == 100 and audit.endswith("D" * 600) and sum(audit.count(x) for x in "DKR") == 2_700
    assert whole[8] == (0, 700, 0, 0, 699, 2_800, "D" * 700, hashlib.sha256(b"").hexdigest())


def test_long_run_costs(spark):
    runs = repair._runs(["u", "a"] * 3, [CLEAN] * 6, [1] * 6)
    assert repair.unrolled(runs, 0, repair.costs_to_end())[1] == b"KKKKKK"
    assert (repair.advanced("", BLANK, 1 << 40).diagonal() == 4 << 40).all()
    assert np.array_equal(repair.advanced("u", CLEAN, 0), repair._unit())


def test_damage_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert report(empty, Repair(repair.damage(empty))).count() == 0
    rows = [(c, t, "assistant" if i % 2 else "user", f"Hm. {c} and {t}!" if i % 3 else None)
            for c in [*range(40), None] for i, t in enumerate([0, 1, 2, None])]
    after = []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = " " if x is None else x
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        after += [(c, t, "user" if h == 4 else r, x)] * (0 if h == 0 else 2 if h == 3 else 1)
    df = spark.createDataFrame(rows, schema)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, repair.damage(df).collect()), key=key) == sorted(after, key=key)
    one = spark.createDataFrame([(0, 8, "user", "Gone.")], schema)
    gone = found(report(one, Repair(one.where("turn < 0"))))
    assert gone == {0: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
