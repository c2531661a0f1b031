"""Personal data: patterns against plain regular expressions, the field against enumeration and on held-out texts."""

import itertools
import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from textquarry.llm import pii
from textquarry.llm.pii import KINDS, LABELS, O

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def good(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == 1:
        return all(int(x) <= 255 for x in text.split("."))
    if kind == 2:
        doubled = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and doubled % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def plain(text):
    return [(k, *m.span()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if good(k, m[0])]


PIECES = ["a.b@c-d.e", "@", "x@y", ".com", "1.2.3.4", "256.1.1.1", ".9", "4111 1111-1111 1111", "41111111111111111", "4111  1111", "+1 (555) 010-9999",
          "+", "+12", " ", "-", "é", "00000000000000000000255.0.0.1", "(", "\n", "%", "٣", "Mail "]


@given(st.lists(st.sampled_from(PIECES), max_size=9).map("".join) | st.text("ab@.+-1 (9", max_size=40))
@settings(max_examples=500, deadline=None)
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 10 ** 6, "1" * 10 ** 6, "1." * 500_000, "@a.b" * 250_000, "+1 " * 300_000, "a@" * 500_000, "12 " * 100_000, "[" * 10 ** 6):
        base = pii.base_spans(text)
        pii.windows(text, base)


def ways(spans):
    """All sets of candidates side by side."""
    for n in range(len(spans) + 1):
        for some in itertools.combinations(range(len(spans)), n):
            own = sorted(spans[x] for x in some)
            if all(a[1] <= b[0] for a, b in zip(own, own[1:])):
                yield some


def weight(some, spans, scores, steps):
    total, label, place = 0.0, O, 0
    for x in sorted(some, key=lambda x: spans[x]):
        i, j, k = spans[x]
        if i > place:
            total, label = total + steps[label, O], O
        total, label, place = total + steps[label, k] + scores[x], k, j
    return total + steps[label, O]


ISLAND = st.lists(st.tuples(st.integers(0, 4), st.integers(1, 3), st.integers(0, 3)), min_size=1, max_size=6, unique=True)


@given(ISLAND, st.integers(0, 10 ** 6))
@settings(max_examples=150, deadline=None)
def test_best_path_and_expectations_against_enumeration(drawn, seed):
    rng = np.random.default_rng(seed)
    spans = [(i, i + n, k) for i, n, k in drawn]
    scores, steps = rng.normal(size=len(spans)), rng.normal(size=(LABELS, LABELS))
    steps[O, O] = 0
    each = {some: weight(some, spans, scores, steps) for some in ways(spans)}
    best = pii.best_path(spans, scores, steps)
    assert np.isclose(weight(best, spans, scores, steps), max(each.values()))
    total, p, pairs = pii.expected(spans, scores, steps)
    assert np.isclose(total, np.logaddexp.reduce(list(each.values())))
    for x in range(len(spans)):
        assert np.isclose(p[x], sum(np.exp(w - total) for some, w in each.items() if x in some))
    # The expected steps are the gradient of the sum; equal places without a span are O to O and weigh nothing.
    for a, b in itertools.product(range(LABELS), range(LABELS)):
        if (a, b) != (O, O):
            moved = steps.copy()
            moved[a, b] += 1e-5
            assert np.isclose(pairs[a, b], (pii.expected(spans, scores, moved)[0] - total) / 1e-5, atol=1e-3)


NAMES = ["anna", "b.lee", "c_ng", "d.ray", "eva", "finn.o"]


def base_texts(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        digits = "".join(str(x) for x in rng.integers(0, 10, 15))
        card = next(digits + c for c in "0123456789" if pii.luhn(digits + c))
        spans = [f"{rng.choice(NAMES)}{i}@mail{i % 7}.example.{'com' if i % 2 else 'org'}", ".".join(map(str, rng.integers(0, 256, 4))), card,
                 f"+{rng.integers(1, 60)} ({rng.integers(200, 999)}) {rng.integers(200, 999)}-{rng.integers(1000, 9999)}"]
        out += [(k, f"The word of {rng.choice(NAMES)} was ", s, f" and no {rng.choice(['more', 'less'])}.") for k, s in enumerate(spans)]
    return out


def test_field_finds_other_writings_and_leaves_look_alikes():
    model = pii.train(pii.examples(base_texts(80, 1)))
    rng = np.random.default_rng(9)
    found = wrong = 0
    cases = base_texts(50, 2)
    for kind, before, span, behind in cases:
        for make in (pii.rewritten, pii.look_alike):
            middle = make(kind, span, rng)
            spans = pii.decode(before + middle + behind, [(a, b) for _, a, b in pii.base_spans(before + middle + behind)], True, True, *model)
            if make is pii.rewritten:
                found += (kind, len(before), len(before) + len(middle)) in spans
            else:
                wrong += bool(spans)
    assert found >= 0.9 * len(cases) and wrong <= 0.05 * len(cases)


def test_blocks_of_a_long_window_equal_the_whole():
    model = pii.train(pii.examples(base_texts(60, 1)))
    text = " ".join(f"call (555) 201-{i:04d} or x{i} [at] mail.example [dot] com," for i in range(300))
    kept = pii.BLOCK
    try:
        pii.BLOCK = 10 ** 9
        whole = pii.decode(text, [], True, True, *model)
        for pii.BLOCK in (1_000, 37):
            assert pii.decode(text, [], True, True, *model) == whole
    finally:
        pii.BLOCK = kept
    assert len(whole) >= 500


def test_query_shape_on_awkward_rows(spark):
    texts = ["mail a.b@c.de or 10.0.0.1", None, "", "x" * 3_000 + " a@b.cd " + "9" * 2_000, "+1 (555) 010-9999, 4111 1111 1111 1111", "clean text, version 2.0.1 of 2021"]
    texts += [f"{b}{s}{e}" for _, b, s, e in base_texts(60, 3)]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(0, texts[0], "k", 1), (None, "The word of eva was 555-210-9999 and no more.", "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, k0 int")
    got = pii.find(docs, ["doc_id", "k0"]).select("doc_id", "k0", pii.joined(F.col("base")).alias("b"), pii.joined(F.col("spans")).alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else "The word of eva was 555-210-9999 and no more."
        assert r["b"] == ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in plain(text or ""))
        assert set(filter(None, r["b"].split(","))) <= set(r["s"].split(","))
    by = {r["doc_id"]: r["s"] for r in got}
    assert by[5] == "" and by[None] == "phone:20:32" and by[1] == by[2] == ""
    empty = docs.limit(0)
    assert pii.find(empty, ["doc_id"]).count() == 0
    lonely = pii.find(docs.where("doc_id = 5"), ["doc_id"]).collect()
    assert lonely[0]["spans"] == []
