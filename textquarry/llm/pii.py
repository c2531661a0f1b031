"""Personal data: exact patterns, and a semi-Markov conditional random field for what the patterns miss.

A text is read once, into the patterns' spans and the windows around what may be one more (digits in groups, at and dot signs and the words that
stand for them). Inside a window the field weighs whole candidate spans by their shape, digits, check sums and neighbours, and a
dynamic program over spans of bounded length chooses boundaries and kinds together. It learns from the corpus's own
pattern spans, written in other ways.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textquarry.llm.common import stored

# The kinds in their order and the base patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# No address starts inside a run of digits, so runs are tried from their start only.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# What may belong to a span that the patterns miss; a window goes AROUND characters further to both sides.
DIGITS_CUE = re.compile(r"[0-9](?:[\x20().\-/_\[\]:+]{0,3}[0-9]){6,}+|[0-9]\x20?[\[({<]?\x20?\.\x20?[\])}>]?\x20?[0-9]{1,3}\x20?[\[({<]?\x20?\.")
SIGN_CUE = re.compile(r"@|[\[({<]\x20?(?:[aA][tT]|[dD][oO][tT])\x20?[\])}>]")
WORD_CUE = re.compile(r"(?<=\x20)[dD][oO][tT](?=\x20)")
AROUND = 64
ATOM = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
# A candidate has so many atoms and characters at most.
ATOMS, CHARS = 39, 80
_OPEN, _CLOSE = r"\x20?[\[({<]\x20?", r"\x20?[\])}>]\x20?"
_AT = rf"(?:\x20?@\x20?|{_OPEN}at{_CLOSE}|\x20at\x20)"
_DOT = rf"(?:\x20?\.\x20?|{_OPEN}(?:dot|\.){_CLOSE}|\x20dot\x20)"
LOOSE = {
    "email": re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I),
    "ip": re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}", re.I),
    "number": re.compile(r"[+(]{0,2}[0-9](?:[\x20().\-/_]{0,3}[0-9])+"),
}
O, LABELS = len(KINDS), len(KINDS) + 1
BUCKETS = 1 << 15
# The training sample, per kind: spans of the lowest hashes, and as many windows without one. Then passes and steps.
SAMPLE, EPOCHS, RATE = 250, 4, 0.3
TEXT_BYTES = 4_000_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: an at sign with a domain behind it and what the characters before it leave of a local part."""
    free = 0
    for m in DOMAIN.finditer(text):
        floor = max(free, text.rfind("@", free, m.start()) + 1)
        before = text[floor:m.start()]
        start = floor + len(before.rstrip(LOCAL))
        if start < m.start():
            yield start, m.end()
            free = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the patterns, by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        # Ten characters hold no 13 digits, 37 hold over 19.
        if 13 <= m.end() - m.start() <= 37:
            digits = digits_of(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def windows(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches around cues outside the base spans; overlapping ones are one."""
    cues = [m.span() for m in DIGITS_CUE.finditer(text)] + [m.span() for m in SIGN_CUE.finditer(text)]
    cues += [m.span() for m in WORD_CUE.finditer(text)]
    if not cues:
        return []
    taken = sorted((a, b) for _, a, b in base)
    out: list[tuple[int, int]] = []
    at = 0
    for a, b in sorted(cues):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at < len(taken) and taken[at][0] <= a and b <= taken[at][1]:
            continue
        a, b = max(0, a - AROUND), min(len(text), b + AROUND)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shape(text: str) -> str:
    short = re.sub(r"[0-9]+", lambda m: str(len(m[0])) + "d", text)
    return re.sub(r"[^\W\d_]{4,}", "a", re.sub(r"(?i)(?<![^\W_])(at|dot)(?![^\W_])", lambda m: m[0].lower(), short))


def features(kind: int, text: str, before: str, behind: str) -> list[int]:
    """Hashed features of a whole span: its shape, digits, check sums, separators and neighbours."""
    digits = digits_of(text)
    groups = re.findall("[0-9]+", text)
    marks = "".join(sorted(set(re.findall(r"[^\w]", text))))
    found = ["bias", f"n{len(digits)}", f"g{len(groups)}", f"m{marks}"]
    if kind != 0:
        found += [f"s{_shape(text)}", f"l{','.join(str(len(g)) for g in groups)}", f"f{text[0] if not text[0].isdigit() else '0'}"]
        found.append(f"luhn{luhn(digits) if 13 <= len(digits) <= 19 else ''}")
        found.append(f"byte{len(groups) == 4 and all(int(g) <= 255 for g in groups)}")
        found.append(f"sep{len(set(re.findall('[^0-9+()]+', text.lower())))}")
    else:
        name, domain = re.split(_AT, text.lower(), maxsplit=1)
        parts = re.split(_DOT, domain)
        found += [f"p{min(len(parts), 5)}", f"t{parts[-1].isalpha()}{min(len(parts[-1]), 8)}", f"x{parts[-1]}", f"v{bool(digits)}",
                  f"at{re.search(_AT, text.lower())[0].strip()}", f"dot{''.join(sorted(set(x.strip() for x in re.findall(_DOT, domain))))}",
                  f"o{'.' in name}{min(len(name), 3)}"]
    found += [f"b{before[-1:] if not before[-1:].isalnum() else 'w'}", f"e{behind[:1] if not behind[:1].isalnum() else 'w'}",
              f"e2{behind[:2] if not behind[:2].isalnum() else 'w'}"]
    word = re.search(r"([^\W\d_]{2,12})\W{0,3}$", before[-16:])
    found.append(f"w{word[1].lower() if word else ''}")
    crc = zlib.crc32
    return [crc(f"{KINDS[kind]}:{x}".encode()) % BUCKETS for x in found]


def _kinds(text: str) -> list[int]:
    """Kinds that a span of this form may have."""
    out = []
    if ("@" in text or "at" in text.lower()) and LOOSE["email"].fullmatch(text):
        out.append(0)
    if text[0].isdigit() and LOOSE["ip"].fullmatch(text):
        out.append(1)
    if LOOSE["number"].fullmatch(text):
        n = len(digits_of(text))
        out += [2] * (13 <= n <= 19 and text[0].isdigit()) + [3] * (7 <= n <= 15)
    return out


def candidates(text: str, taken: list[tuple[int, int]], whole_left: bool = True, whole_right: bool = True) -> list[tuple[int, int, int]]:
    """(start, end, kind) of a window's candidates. They begin and end where words do, hold no line end and no character of a base
    span (``taken``). At a side that is not the text's own end nothing is known of what follows, so none touches it."""
    atoms = [m.span() for m in ATOM.finditer(text)]
    blocked = np.zeros(len(text) + 1, np.int32)
    for a, b in taken:
        blocked[max(0, a):max(0, b)] = 1
    blocked = np.concatenate([[0], np.cumsum(blocked)])
    out = []
    for i, (start, _) in enumerate(atoms):
        c = text[start]
        if not (c.isalnum() or c in "+(") or (start == 0 and not whole_left):
            continue
        if start and (text[start - 1].isalnum() or c in "+(" and text[start - 1] in "+("):
            continue
        for a, end in atoms[i:i + ATOMS]:
            if end - start > CHARS or "\n" in text[a:end] or blocked[end] != blocked[start]:
                break
            if a == start or not text[a].isalnum() or (end == len(text) and not whole_right) or end < len(text) and text[end].isalnum():
                continue
            out += [(start, end, kind) for kind in _kinds(text[start:end])]
    return out


def span_features(text: str, span: tuple[int, int, int]) -> list[int]:
    a, b, kind = span
    return features(kind, text[a:b], text[max(0, a - 20):a], text[b:b + 4])


# A text outside its candidates is one label O after the other, for free; so every stretch that no candidate crosses stands
# for itself, and only the places where candidates begin or end count as steps.
def islands(spans: list[tuple[int, int, int]]) -> Iterator[tuple[list[int], list[int], list[tuple[int, int, int]]]]:
    """Groups of overlapping or adjoining candidates: their numbers, the places, and (first place, last place, kind)."""
    group: list[int] = []
    end = -1

    def out() -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
        places = sorted({p for x in group for p in spans[x][:2]})
        at = {p: i for i, p in enumerate(places)}
        return group, places, [(at[spans[x][0]], at[spans[x][1]], spans[x][2]) for x in group]

    for x in sorted(range(len(spans)), key=lambda x: spans[x]):
        if group and spans[x][0] > end:
            yield out()
            group = []
        group.append(x)
        end = max(end, spans[x][1]) if len(group) > 1 else spans[x][1]
    if group:
        yield out()


def _by(spans: list[tuple[int, int, int]], side: int) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for x, span in enumerate(spans):
        out.setdefault(span[side], []).append(x)
    return out


def best_path(spans: list[tuple[int, int, int]], scores: np.ndarray, steps: np.ndarray) -> list[int]:
    """The likeliest candidates of an island, side by side: scores of spans and of steps between labels add up. Ties go to O."""
    n = max(j for _, j, _ in spans)
    best = np.full((n + 1, LABELS), -np.inf)
    best[0, O] = 0
    back = np.full((n + 1, LABELS, 2), O, np.int64)
    by_end = _by(spans, 1)

    def top(x: np.ndarray) -> int:
        return O if x[O] >= x.max() else int(x.argmax())

    for j in range(1, n + 1):
        into = best[j - 1] + steps[:, O]
        best[j, O], back[j, O] = into.max(), (-1, top(into))
        for x in by_end.get(j, ()):
            i, _, k = spans[x]
            into = best[i] + steps[:, k]
            if into.max() + scores[x] > best[j, k]:
                best[j, k], back[j, k] = into.max() + scores[x], (x, top(into))
    j, label, out = n, top(best[n] + steps[:, O]), []
    while j:
        x, before = back[j, label]
        if x >= 0:
            out.append(int(x))
        j, label = (j - 1 if x < 0 else spans[x][0]), before
    return out[::-1]


def expected(spans: list[tuple[int, int, int]], scores: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Forward-backward over all segmentations of an island: the logarithm of their sum, the probability of every candidate,
    and how often each step is expected."""
    n = max(j for _, j, _ in spans)
    add = np.logaddexp.reduce
    alpha = np.full((n + 1, LABELS), -np.inf)
    alpha[0, O] = 0
    by_end, by_start = _by(spans, 1), _by(spans, 0)
    for j in range(1, n + 1):
        alpha[j, O] = add(alpha[j - 1] + steps[:, O])
        for x in by_end.get(j, ()):
            i, _, k = spans[x]
            alpha[j, k] = np.logaddexp(alpha[j, k], add(alpha[i] + steps[:, k]) + scores[x])
    total = add(alpha[n] + steps[:, O])
    beta = np.full((n + 1, LABELS), -np.inf)
    beta[n] = steps[:, O]
    p, pairs = np.zeros(len(spans)), np.zeros((LABELS, LABELS))
    pairs[:, O] += np.exp(alpha[n] + beta[n] - total)
    for i in range(n - 1, -1, -1):
        onward = steps[:, O] + beta[i + 1, O]
        beta[i] = onward
        pairs[:, O] += np.exp(alpha[i] + onward - total)
        for x in by_start.get(i, ()):
            _, j, k = spans[x]
            onward = steps[:, k] + scores[x] + beta[j, k]
            beta[i] = np.logaddexp(beta[i], onward)
            each = np.exp(alpha[i] + onward - total)
            p[x] = each.sum()
            pairs[:, k] += each
    return float(total), p, pairs


def train(examples: list[tuple[str, list[tuple[int, int, int]], list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and steps from (window, its spans (start, end, kind), base spans to leave aside): gradient ascent
    (Adagrad) on the log-likelihood of the segmentations."""
    weights, steps = np.zeros(BUCKETS), np.zeros((LABELS, LABELS))
    squares, step_squares = np.full(BUCKETS, 1e-2), np.full((LABELS, LABELS), 1e-2)
    ready = []
    for text, gold, taken in examples:
        spans = candidates(text, taken)
        for group, _, inside in islands(spans):
            found = [np.array(span_features(text, spans[x])) for x in group]
            is_gold = np.array([spans[x] in gold for x in group])
            ready.append((inside, found, is_gold))
    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for at in order.permutation(len(ready)):
            spans, found, is_gold = ready[at]
            scores = np.array([weights[f].sum() for f in found])
            _, p, pairs = expected(spans, scores, steps)
            error = is_gold - p
            ids = np.concatenate(found)
            rows, where = np.unique(ids, return_inverse=True)
            g = np.bincount(where, np.repeat(error, [len(f) for f in found]))
            squares[rows] += g * g
            weights[rows] += RATE * g / np.sqrt(squares[rows])
            seen, label, place = np.zeros((LABELS, LABELS)), O, 0
            for i, j, k in sorted(s for s, y in zip(spans, is_gold) if y):
                if i > place:
                    seen[label, O] += 1
                    label = O
                seen[label, k] += 1
                label, place = k, j
            seen[label, O] += 1
            g = seen - pairs
            g[O, O] = 0
            step_squares += g * g
            steps += RATE * g / np.sqrt(step_squares)
    return weights, steps


# Ways to write a span so that the patterns do not see it, and look-alikes that are none.
def rewritten(kind: int, span: str, rng: np.random.Generator) -> str:
    """The span in another form, with the same content."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    if kind == 0:
        name, domain = span.split("@")
        return name + pick(" at ", " [at] ", "[at]", "(at)", " (at) ", " @ ", "{at}", " AT ") + domain.replace(
            ".", pick(" dot ", "[dot]", " [dot] ", "(dot)", " . ", " DOT ", "[.]"))
    if kind == 1:
        return span.replace(".", pick("[.]", " . ", "(.)", " dot ", "[dot]", " [.] ", "(dot)"))
    digits = digits_of(span)
    if kind == 2:
        mark = pick(".", "/", "  ", "_", " - ", ". ")
        return mark.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    area, one, two = digits[-10:-7], digits[-7:-4], digits[-4:]
    country = digits[:-10]
    return pick(f"({area}) {one}-{two}", f"{area}-{one}-{two}", f"{area}.{one}.{two}", f"00{country} {area} {one} {two}", f"{country}-{area}-{one}-{two}",
                f"{area}/{one}-{two}", f"{area} {one} {two}", f"{country} ({area}) {one}-{two}", f"+{country}/{area}/{one}/{two}", f"{area}-{one}{two}")


def look_alike(kind: int, span: str, rng: np.random.Generator) -> str:
    """A text of much the same characters that is no personal data."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    digits = digits_of(span) or "20210304"
    if kind == 0:
        name, domain = span.split("@")
        return pick(f"{name} at {domain.replace('.', ' ')}", f"@{name}", f"{name} dot {domain.split('.')[-1]}", f"{name} @ {domain.replace('.', ' ')}")
    if kind == 1:
        parts = span.split(".")
        parts[int(rng.integers(4))] = str(int(rng.integers(256, 1000)))
        return pick("[.]", " . ", "(.)", " dot ").join(parts)
    if kind == 2:
        digits = digits[:-1] + str((int(digits[-1]) + int(rng.integers(1, 10))) % 10)
        return pick(".", "/", "  ", "_", " - ", "").join(digits[i:i + 4] for i in range(0, len(digits), 4))
    d = digits * 2
    return pick(f"20{d[0]}{d[1]}-0{d[2]}-1{d[3]} 1{d[4]}:2{d[5]}", f"{d[:3]},{d[3:6]},{d[6:9]}", f"{d[:6]}.{d[6:10]}", d[:8], d[:12], f"{d[:2]}/{d[2:4]}/20{d[4:6]}",
                f"{d[:4]}-{d[4:8]}", f"{d[:3]} {d[3:6]}", f"20{d[:2]} 20{d[2:4]} 20{d[4:6]}", f"{d[:2]} {d[2:4]} {d[4:6]} {d[6:8]} {d[8:10]}", f"{d[:1]}.{d[1:9]}")


def examples(found: list[tuple[int, str, str, str]]) -> list[tuple[str, list[tuple[int, int, int]], list[tuple[int, int]]]]:
    """Training windows from sampled (kind, text before, span, text behind); kind -1 is a window without a span."""
    out = []
    for kind, before, span, behind in found:
        rng = np.random.default_rng(zlib.crc32(f"{kind}:{before}:{span}:{behind}".encode()))
        for make, is_span in ((rewritten, True), (look_alike, False)) if kind >= 0 else ((None, False),):
            middle = make(kind, span, rng) if make else span
            text, at = before + middle + behind, (len(before), len(before) + len(middle))
            taken = [(a, b) for _, a, b in base_spans(text) if b <= at[0] or a >= at[1]]
            out.append((text, [(*at, kind)] if is_span else [], taken))
    return out


def _span_type() -> pa.DataType:
    return pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
# Characters of a long window that are weighed at once.
BLOCK = 50_000


def decode(text: str, taken: list[tuple[int, int]], whole_left: bool, whole_right: bool, weights: np.ndarray, steps: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) that the field finds in a window. Candidates that could not gain by any neighbours are left out."""
    gain = (steps - steps[:, [O]]).max(0) + (steps - steps[O]).max(1)
    spans, scores = [], []
    for at in range(0, len(text), BLOCK):
        left, right = max(0, at - 24), min(len(text), at + BLOCK + CHARS + 24)
        part = text[left:right]
        own = [(a - left, b - left) for a, b in taken if a < right and b > left]
        for a, b, k in candidates(part, own, left > 0 or whole_left, right < len(text) or whole_right):
            if at <= a + left < at + BLOCK:
                score = float(weights[span_features(part, (a, b, k))].sum())
                if score + gain[k] > 0:
                    spans.append((a + left, b + left, k))
                    scores.append(score)
    out = []
    for group, _, inside in islands(spans):
        for x in best_path(inside, np.array([scores[x] for x in group]), steps):
            a, b, k = spans[group[x]]
            out.append((k, a, b))
    return out


def _read(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Base spans, their surroundings and the windows of whole texts."""
    window = pa.list_(pa.struct([("start", pa.int64()), ("text", pa.string()), ("ends", pa.bool_())]))
    case = pa.list_(pa.struct([("kind", pa.int32()), ("before", pa.string()), ("span", pa.string()), ("behind", pa.string())]))
    for batch in batches:
        held = start = 0
        base, cases, found = [], [], []
        for i, x in enumerate(batch.column("text")):
            text = x.as_py() or ""
            spans = base_spans(text)
            base.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans])
            cases.append([{"kind": k, "before": text[max(0, a - 40):a], "span": text[a:b], "behind": text[b:b + 40]}
                          for k, a, b in spans if b - a <= CHARS])
            found.append([{"start": a, "text": text[a:b], "ends": b == len(text)} for a, b in windows(text, spans)])
            held += len(text)
            if held >= TEXT_BYTES or i + 1 == batch.num_rows:
                part = batch.slice(start, i + 1 - start)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + [pa.array(base, _span_type()), pa.array(cases, case), pa.array(found, window)],
                                                 [*kept, "base", "cases", "windows"])
                held, start, base, cases, found = 0, i + 1, [], [], []


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns as k0, k1, ..., the ``base`` spans of every text, those as ``cases`` to learn from, and the ``windows`` that may hold
    more; a null text has none. Stored: every text is read once."""
    kept = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col("text").alias("text"))
    schema = ", ".join([f"{k} {t}" for k, t in rows.dtypes if k != "text"]
                       + [f"base {SPANS}", "cases array<struct<kind:int,before:string,span:string,behind:string>>",
                          "windows array<struct<start:bigint,text:string,ends:boolean>>"])
    return stored(rows.mapInArrow(lambda batches: _read(batches, kept), schema), "scanned")


def sample(read: DataFrame, per_kind: int = SAMPLE) -> list[tuple[int, str, str, str]]:
    """(kind, 40 characters before, span, 40 behind) of up to ``per_kind`` distinct base spans per kind, and as many windows without
    one (kind -1), those of the lowest hashes."""
    cases = read.select(F.explode("cases").alias("x")).select("x.*")
    others = read.select(F.explode("windows").alias("x")).where(F.char_length("x.text") <= 4 * AROUND).select(
        F.lit(-1).alias("kind"), F.lit("").alias("before"), F.col("x.text").alias("span"), F.lit("").alias("behind"))
    one = cases.unionByName(others).groupBy("kind", F.xxhash64("span").alias("h")).agg(F.min(F.struct("span", "before", "behind")).alias("x"))
    # The rank filter is applied before the shuffle too.
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("h"))).where(F.col("rank") <= per_kind)
    rows = ranked.select("kind", "h", "x.before", "x.span", "x.behind").collect()
    return [(r["kind"], r["before"], r["span"], r["behind"]) for r in sorted(rows, key=lambda r: (r["kind"], r["h"]))]


def fit(read: DataFrame, per_kind: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Learn the field from a bounded sample of the base spans that ``scan`` found. Without one, it finds nothing."""
    return train(examples(sample(read, per_kind)))


def label(read: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """``keep`` columns, ``base`` and ``spans`` (base spans and those that the field adds, by kind, then start) of texts read by ``scan``."""
    kept = [f"k{i}" for i in range(len(keep))]
    shared = read.sparkSession.sparkContext.broadcast(model)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, steps = shared.value
        for batch in batches:
            out = []
            for base, found in zip(batch.column("base"), batch.column("windows")):
                base = [(KINDS.index(x["kind"]), x["start"], x["end"]) for x in base.as_py()]
                spans = list(base)
                for w in found.as_py():
                    at = w["start"]
                    taken = [(a - at, b - at) for _, a, b in base if b > at and a < at + len(w["text"])]
                    spans += [(k, a + at, b + at) for k, a, b in decode(w["text"], taken, at == 0, w["ends"], weights, steps)]
                out.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + [batch.column("base"), pa.array(out, _span_type())],
                                             [*kept, "base", "spans"])

    schema = ", ".join([f"{k} {t}" for k, t in read.dtypes if k in kept] + [f"base {SPANS}", f"spans {SPANS}"])
    return read.mapInArrow(labelled, schema).toDF(*keep, "base", "spans")


def find(docs: DataFrame, keep: list[str], per_kind: int = SAMPLE) -> DataFrame:
    """Personal data in every whole ``text``: one row per row with the ``keep`` columns, ``base`` and ``spans`` (kind, start, end; code
    points, end exclusive).

    A null or empty text has none, equal rows are told alike, a very long text is read whole: its windows are weighed in blocks that
    no candidate is cut by. An empty table gives no rows. Base spans may overlap each other; added ones touch no base span and, of
    equal weight, the fewer are taken. Other columns, whatever their names, stay away from the work.
    """
    read = scan(docs, keep)
    return label(read, fit(read, per_kind), keep)


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
