"""Operators on small and awkward inputs, against brute force where there is one."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from textquarry.llm import (chat_format, decontamination, html_text, language_id, mixing, ngram_join, quality_classifier,
                            quality_rules, recurrent_lm, text_stats, token_counts)
from textquarry.llm.components import components

WORDS = {"en": "the of and house tree water with this that from light paper stone river".split(),
         "de": "der die und haus baum wasser mit dieser licht papier stein fluss über schön".split()}
LONG = " ".join(random.Random(1).choices(WORDS["en"], k=30_000))


def prose(lang, n, seed):
    return " ".join(random.Random(seed).choices(WORDS[lang], k=n))


@pytest.fixture(scope="module")
def docs(spark):
    """Two languages, junk, null and empty values, a long text, repeated rows, near copies and clashing column names."""
    rows = [(i, prose("en" if i % 2 else "de", 40 + i, i), "en" if i % 2 else "de", f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, "### $$$ %%% | " + prose("en", 30, 200 + i).upper() + " !!", "en", "s1") for i in range(20)]
    rows += [(200, None, "en", "s0"), (201, "", None, None), (202, " \t\n", "de", "s1"), (203, "12 ++ 77", None, "s2"),
             (204, LONG, "en", None), (None, prose("de", 50, 7), None, None), (1, rows[1][1], "en", "s1"),
             (206, rows[3][1] + " end", "en", "s0"), (207, "word", None, "s0"), (208, "word", None, "s1")]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = {c: F.lit(9) for c in ("n_chars", "key", "label", "size", "h", "path", "start", "n_words", "k0", "kept", "score")}
    return out.withColumns(extra).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1, 0) for i in range(0, 40)] + [(100 + i, 0, 0) for i in range(18)] + [(5, 1, 0), (7, None, None), (None, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_counts_against_plain_python(docs):
    got = {(r["doc_id"], r["n_words"]): r for r in text_stats.with_counts(docs, ["doc_id"]).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        words = text.encode().split()
        seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        inside = {j for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
        row = got[r["doc_id"], len(words)]
        assert row["n_repeat_words"] == len(inside)
        assert row["word_chars"] == sum(len(w.decode()) for w in words)
        assert row["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        lines = [x for x in text.split("\n") if x.split()]
        assert row["n_dup_lines"] == len(lines) - len(set(lines))


def test_repeated_windows_and_lines():
    line = b"a b c d e f g h"
    c = text_stats.counts([line + b"\n" + line + b"\nx", b"a a a a a a a a a a", b"", b"q\n\nq\n \n"])
    assert c["n_repeat_words"].tolist() == [16, 10, 0, 0]
    assert c["n_dup_lines"].tolist() == [1, 0, 0, 1]


def test_decision_list(docs, labels):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    assert all(got[i]["kept"] for i in range(40) if i not in (1,)) and not any(got[100 + i]["kept"] for i in range(20))
    assert got[200]["base_failed"] and got[201]["base_failed"] and not got[202]["kept"]


def test_decision_list_learns_thresholds():
    rng = np.random.default_rng(0)
    x = rng.random((600, 2))
    bad = ((x[:, 0] > 0.7) & (x[:, 1] > 0.5)).astype(int)
    rules = quality_rules.learn(x, bad, ["a", "b"])
    hit = np.zeros(len(x), bool)
    for rule in rules:
        hit |= quality_rules._mask(rule, x, ["a", "b"])
    assert (hit == bad).mean() > 0.97
    assert quality_rules.learn(x[:0], bad[:0], ["a", "b"]) == []


def test_without_labels(spark, docs, labels):
    none = labels.where("false")
    assert quality_rules.judge(docs, none).where("not kept and not base_failed").isEmpty()
    assert quality_classifier.classify(docs, none, F.col("source"), F.col("lang")).where("not kept").isEmpty()
    assert quality_rules.judge(docs.where("false"), labels).isEmpty()
    assert quality_classifier.classify(docs.where("false"), labels, F.col("source"), F.col("lang")).isEmpty()


def test_quality_classifier(docs, labels):
    got = quality_classifier.classify(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(20))
    stay = quality_classifier.keep_good(docs, labels, F.col("source"), F.col("lang"))
    assert stay.columns == docs.columns and stay.count() == sum(r["kept"] for r in got)


def test_sites_shrink_to_their_parent(spark):
    rows = [("a", 1.0, 1.0), ("b", 900.0, 1000.0), ("c", 100.0, 1000.0)]
    groups = spark.createDataFrame([(h, g / n, n, 0.5) for h, g, n in rows], "host string, rate double, n double, parent double")
    got = {r["host"]: r["posterior"] for r in quality_classifier._shrunk(groups, "parent").collect()}
    assert abs(got["a"] - 0.5) < 0.35 and abs(got["b"] - 0.9) < 0.01 and abs(got["c"] - 0.1) < 0.01


def test_language(docs):
    data = docs.withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.fit(data.where("not held_out"))
    got = language_id.predict(data, model, ["doc_id", "held_out", "lang"], spans=True).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] in (200, 201, 202, 203):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None and r["doc_id"] < 40:
            assert r["lang_pred"] == r["lang"] and r["score"] > 0.9
    assert {r["lang_pred"] for r in language_id.predict(data, None, ["doc_id"]).collect()} == {"und"}
    assert language_id.fit(data.where("false")) is None


def test_language_sample_counts_copies_once(spark):
    """The bound holds with copies, and a language of copies has rows."""
    rows = [("en", prose("en", 30, i)) for i in range(900)] + [("en", prose("en", 200, 5000))] * 500
    rows += [("de", prose("de", 200, i % 3)) for i in range(3000)] + [("fr", " ")] * 5
    found = language_id.training_windows(spark.createDataFrame(rows, "lang string, text string"), docs_per_label=100)
    assert found.groupby("label").size()["de"] == 3 * language_id.WINDOWS and set(found["label"]) == {"de", "en"}
    assert 100 <= found.groupby("label").size()["en"] <= 99 + language_id.WINDOWS


def test_language_of_words_in_mixed_text(spark, docs):
    model = language_id.fit(docs)
    text = prose("en", 12, 900) + " " + prose("de", 12, 901)
    row = language_id.predict(spark.createDataFrame([(text,)], "text string"), model, [], spans=True).first()
    assert [(s["lang"], s["words"]) for s in row["runs"]] == [("en", 12), ("de", 12)] or len(row["runs"]) <= 4


def test_language_of_text_without_spaces(spark):
    """The whole run counts, not its first characters; it stays one word in the runs."""
    script = {"zh": "的一是不了人我在有他这中大来上", "ja": "のにはをたがでてとしれさいある"}
    run = lambda lang, n, seed: "".join(random.Random(seed).choices(script[lang], k=n))
    rows = [(run(lang, 400, i), lang) for i in range(60) for lang in script]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    asked = [(i, run("zh", 40, 900 + i) + run("ja", 400, 950 + i)) for i in range(5)]
    asked += [(9, "https://example.org/" + "x" * 30 + run("zh", 400, 990) + " " + run("zh", 10, 991))]
    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(asked, "doc_id long, text string"), model, ["doc_id"], spans=True).collect()}
    assert all(got[i]["lang_pred"] == "ja" and [s["words"] for s in got[i]["runs"]] == [1] for i in range(5))
    assert got[9]["lang_pred"] == "zh" and sum(s["words"] for s in got[9]["runs"]) == 2


def test_posteriors_against_enumeration():
    rng = np.random.default_rng(3)
    model = language_id.Model(["a", "b"], np.zeros((4, 2), np.float32), rng.standard_normal((2, 2)).astype(np.float32),
                              rng.standard_normal(2).astype(np.float32))
    scores = rng.standard_normal((5, 2)).astype(np.float32)
    ids, lengths = np.array([0, 1, 2, 3, 4, 1]), np.array([2, 0, 4])
    got = language_id.Labeller(model).posteriors(ids, lengths, scores)
    at = 0
    for n in lengths:
        total, mass = 0.0, np.zeros((n, 2))
        for path in np.ndindex(*[2] * int(n)):
            s = sum(scores[ids[at + i], y] for i, y in enumerate(path)) + sum(model.transition[a, b] for a, b in zip(path, path[1:]))
            p = math.exp(s + (model.start[path[0]] if n else 0))
            total += p
            for i, y in enumerate(path):
                mass[i, y] += p
        if n:
            assert np.allclose(got[at:at + n], mass / total, atol=1e-4)
        at += n


def test_mix(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    total = sum(r["size"] for r in got)
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(docs.where("false")).isEmpty()


def test_targets_by_repeated_resharing(spark):
    sizes = {"a": 1000, "b": 10, "c": 300, "d": 0, None: 77, "e": 500}
    got = {r["source"]: r["target"] for r in mixing.source_targets(
        spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, open_ = dict.fromkeys(names, 0.0), set(names)
    rest = 1.5 * sum(sizes.values())
    while rest > 1e-9 and open_:
        w = sum(weight[s] for s in open_)
        for s in list(open_):
            want[s] += rest * weight[s] / w
        rest = 0.0
        for s in list(open_):
            if want[s] >= 2 * sizes[s]:
                rest += want[s] - 2 * sizes[s]
                want[s] = 2.0 * sizes[s]
                open_.discard(s)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in names)


def test_chat_round_trip(spark):
    part = "struct<kind string, text string, ref string, width int, height int, seconds double, pages int>"
    nasty = r"<|turn|> </s>[INST] \ <\| [\INST] <<|end|>"
    rows = [(1, 0, "user", [("text", nasty, None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None),
                            ("audio", None, "b.wav", None, None, 1.5, None)]),
            (1, 1, "assistant", [("text", "one " + nasty, None, None, None, None, None), ("document", None, "c.pdf", None, None, None, 2),
                                 ("text", " two", None, None, None, None, None)]),
            (2, None, None, None), (2, 5, "assistant", [("text", None, None, None, None, None, None)]), (None, 0, "us\ner", [])]
    chats = chat_format.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
                                     .withColumn("segment", F.lit(0)))
    got = {r["conv_id"]: r for r in chats.select("*", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(
        F.col("formatted"), F.col("turn_starts"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", nasty), ("assistant", "one " + nasty + " two")]
    assert got[1]["loss"] == ["one " + nasty, " two"]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 512)]
    assert [tuple(t) for t in got[2]["turns"]] == [("", ""), ("assistant", "")] and got[2]["loss"] == [""]
    assert [tuple(t) for t in got[None]["turns"]] == [("us\ner", "")]


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                up[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None and (least[root(i)] is None or d < least[root(i)]):
            least[root(i)] = d
    return sorted(((d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def test_ngram_join_against_all_pairs(spark, docs):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for i in range(60):  # a chain of near copies and copies with few or many edits
        text = list(base)
        for _ in range(rng.randrange(0, 7)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(text)))
        if i % 3 == 0:
            base = text
    passage = " ".join(rng.choice(vocabulary) for _ in range(55))
    rows += [(2000 + i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(5 + i))) for i in range(25)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(frame).collect()), key=str)
    assert got == brute_components(rows)
    assert ngram_join.join(frame.where("false")).isEmpty()
    left = [r["doc_id"] for r in ngram_join.one_of_each(frame).collect()]
    assert sorted(map(str, set(left))) == sorted({str(c) for _, _, c in got}) and left.count(1) == 1


def test_components_of_a_star_and_a_path(spark):
    edges = [(500, i) for i in range(1, 40)] + [(1000 + i, 1001 + i) for i in range(30)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in [500, *range(1, 40)]) and all(got[1000 + i] == 1000 for i in range(31))


def test_decontamination_against_all_windows(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(500)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate([12, 25, 25, 40, 3, 1, 60, 300])] + [(50, ["x", "y"] * 10), (51, [])]
    rows = []
    for i in range(40):
        words = text(80)
        k, item = items[i % len(items)]
        item = list(item)
        if i % 4 == 1 and len(item) > 30:
            item[2] = "changed"
        if i % 4 == 2 and len(item) > 10:
            item[len(item) // 2] = "changed"
        rows.append((i, " ".join(words[:30] + item + words[30:])))
    rows += [(90, None), (91, ""), (92, "x y x y x y x y x y x y x y x y x y x y x"), (0, rows[0][1]), (None, rows[1][1])]
    grams = lambda w: Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    want = {}
    for d, t in rows:
        w = (t or "").lower().split()
        for k, item in items:
            a = grams(item)
            for s in range(len(w) - len(item) + 1 if item else 0):
                b = grams(w[s:s + len(item)])
                both = sum((a & b).values())
                sim = both / (2 * sum(a.values()) - both)
                if sim >= 0.75 and sim > want.get((d, k), (0, 0))[0]:
                    want[d, k] = sim, s
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(99, None)], "item_id long, text string")
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(0), "pos": F.lit(0), "item_id": F.lit(0)})
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in decontamination.matches(frame, bench).collect()}
    assert got == want
    clean = decontamination.decontaminate(frame, bench)
    assert clean.columns == frame.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontamination.matches(frame.where("false"), bench).isEmpty() and decontamination.matches(frame, bench.where("false")).isEmpty()


def test_decontamination_of_documents_shorter_than_the_item(spark):
    words = [f"u{i}" for i in range(59)]
    rows = [(1, words[1:]), (2, words[:30] + words[31:]), (3, words[:46]), (4, words[:45]), (5, words[:6] + ["no"] * 50), (6, words[20:24])]
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"]: (r["start"], r["n_words"], r["similarity"]) for r in decontamination.matches(frame, bench).collect()}
    assert got == {1: (0, 58, 54 / 55), 2: (0, 58, 50 / 59), 3: (0, 46, 42 / 55)}
    assert {r["doc_id"] for r in decontamination.decontaminate(frame, bench).collect()} == {4, 5, 6}


def page_text(html):
    blocks = [b for b in html_text.read_page(html) if not b[2]]
    part = next((p for p in ("article", "main") if any(b[3] == p for b in blocks)), "")
    return "\n".join(b[0] for b in blocks if b[3] == part)


@pytest.mark.parametrize("html, text", [
    ("<p>a &amp; b&nbsp; c&#33;<p>d<br>e", "a & b c!\nd e"),
    ("<body><nav>n</nav><article><header><h1>T</h1></header><p>x <b>y</b></p><form>f</form><div class='comments'>c</div>"
     "<footer>f</footer></article><aside>s</aside><footer>g</footer></body>", "T\nx y"),
    ("<main><p>m</p><div class=share>s</div></main><div>other</div>", "m"),
    ("<script>if (a < b) '</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes", "yes"),
    ("<div class='page has-sidebar'><article class=comment>bad</article><article><p>good</article></div>", "good"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"), ("a <3 b < c", "a <3 b < c"), ("", ""),
    ("<p>one<span class=ad>buy</span> two</p><div hidden>h</div>", "one two"), ("<div>" * 3000 + "deep", "deep")])
def test_page(html, text):
    assert page_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("<article class='post category-social'><section id=related-work><h2 id=social-policy>S</h2><p id=notice-period>n</p>"
     "</section><div class=share-buttons>b</div><div class=social-history>h</div></article>", "S\nn\nh"),
    ("<main class=widget-page><p>m <span class=ad-hoc>x</span></p></main>", "m x"), ("<p id=notice>n</p>", "n"),
    ("<article><p>a</p><div class=comments><article class=post>c</article></div></article>", "a"),
    ("<article><p>a</p></article><div id=comments><article>c</article></div>", "a")])
def test_words_in_names_that_are_content(html, text):
    assert page_text(html) == text


def test_style_tree_cuts_what_repeats(spark):
    """Boilerplate without any mark: the same lines on all pages of a host, in a branch of their own."""
    def page(i):
        return (f"<body><div class=a><p>Same line for all</p><p>And another</p></div><div class=b><p>{prose('en', 30, i)}</p>"
                f"<p>{prose('de', 20, i)}</p></div></body>")

    rows = [(i, f"http://Site.example/{i}", page(i)) for i in range(12)]
    rows += [(20, "http://other.example/", page(1)), (21, None, None), (22, "no url", ""), (0, "http://site.example/0", page(0))]
    got = defaultdict(list)
    for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect():
        got[r["page_id"]].append(r)
    assert all(r["text"] == f"{prose('en', 30, i)}\n{prose('de', 20, i)}" for i in range(12) for r in got[i])
    assert got[20][0]["text"].startswith("Same line") and got[21][0]["text"] == "" == got[22][0]["text"] and len(got[0]) == 2
    assert all(r["n_chars"] == len(r["text"]) for rs in got.values() for r in rs)


def test_style_tree_cuts_inside_articles(spark):
    """Boilerplate in the article, on pages whose body and article have classes of their own; copies of a page stay whole."""
    def page(i):
        return (f"<body class='p-{'abcdefghijkl'[i]} tpl'><article class='x{i}'><div class='w-1/2'><p>Read on with a pass</p></div>"
                f"<section><p>{prose('en', 30, i)}</p></section></article></body>")

    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(12)] + [(50 + i, "http://b.example/", page(3)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == prose("en", 30, i) for i in range(12))
    assert all(got[50 + i] == "Read on with a pass\n" + prose("en", 30, 3) for i in range(12))


def test_style_tree_keeps_what_holds_something_important():
    """A node with many children is not cut while one of them differs between pages."""
    paths = [f"/body/article/c{k}" for k in range(15)] + ["/body/article/p"]
    tree = html_text.pd.DataFrame({"path": paths, "m": 20, "evenness": [1.0] * 15 + [0.0], "layouts": 0.0})
    assert sorted(html_text._branches(tree)) == sorted(paths[:-1])


def test_token_counts(spark, docs):
    vocabulary = token_counts.Vocabulary(spark)
    lengths = token_counts.encoded_lengths(docs, "text", vocabulary)
    plain = sorted(r["length"] for r in lengths.collect())
    table = token_counts.histogram(lengths).cache()
    assert table.count() == len(set(plain))
    for r in table.collect():
        n = r["length"]
        assert r["n_docs"] == plain.count(n) and r["docs_from"] == sum(x >= n for x in plain)
        assert r["tokens_from"] == sum(x for x in plain if x >= n) and r["tokens_upto"] == sum(x for x in plain if x <= n)
        assert r["truncated_tokens"] == sum(min(x, n) for x in plain)
        assert r["quantile"] == pytest.approx(sum(x <= n for x in plain) / len(plain))
    cut = {r["context_limit"]: (r["tokens"], r["cut_docs"]) for r in token_counts.truncated_total(table, [10, 64, 10**6]).collect()}
    assert cut == {k: (sum(min(x, k) for x in plain), sum(x > k for x in plain)) for k in (10, 64, 10**6)}
    assert token_counts.quantiles(table, [0.5]).first()[0] == plain[(len(plain) + 1) // 2 - 1]
    assert token_counts.histogram(lengths.where("false")).isEmpty()


def test_language_model(docs):
    data = docs.withColumn("held_out", F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False)))
    got = recurrent_lm.score(data).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    rows = data.select("doc_id", "text", "held_out").collect()
    c = Counter(w for r in rows if not r["held_out"] for w in tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r["doc_id"]), len(w := tokens(r["text"])), sum(c[x] > 0 for x in w),
                   round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 3)) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 3)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert recurrent_lm.score(data.where("false")).isEmpty()
    assert all(r["n_known"] == 0 for r in recurrent_lm.score(data.where("doc_id < 4").withColumn("held_out", F.lit(True))).collect())


def test_language_model_adds_up_to_one():
    rng = np.random.default_rng(2)
    v = recurrent_lm.make_vocabulary(np.sort(rng.integers(0, 1 << 62, 40).astype(np.uint64)), rng.integers(1, 50, 40), 900, 60)
    w = recurrent_lm.initial(v)
    h = rng.standard_normal((1, recurrent_lm.HIDDEN)).astype(np.float32)
    n = len(v.number_mass)
    logs, _ = recurrent_lm.output(w, v, np.repeat(h, n, 0), np.arange(n))
    assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_language_model_gradients():
    rng = np.random.default_rng(4)
    v = recurrent_lm.make_vocabulary(np.sort(rng.integers(0, 1 << 62, 9).astype(np.uint64)), rng.integers(1, 9, 9), 99, 9)
    w = recurrent_lm.initial(v)
    ids = rng.integers(0, len(v.number_mass), (3, 5))
    loss = lambda w: float(sum(recurrent_lm.score_ids(w, v, row[1:].astype(np.int32), np.array([4])).sum()
                               for row in ids))
    ids[:, 0] = recurrent_lm.STOP
    grad = w.like(np.zeros(w.flat().size))
    recurrent_lm._window(w, v, ids, np.zeros((3, recurrent_lm.HIDDEN), np.float32), grad)
    for name in ("inputs", "recurrent", "bias", "class_bias", "word_bias", "embed"):
        a, g = getattr(w, name), getattr(grad, name)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = a[at], 1e-2
        a[at] = old + step
        up = loss(w)
        a[at] = old - step
        down = loss(w)
        a[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.05, abs=0.02)


def test_language_model_learns_from_every_token(spark, docs):
    """All tokens of every training document are learned once; a long text is several blocks in several rounds."""
    line = np.arange(2 * recurrent_lm.BLOCK + 8)
    blocks = recurrent_lm.blocks_of(line)
    assert np.concatenate([b[1:] for b in blocks]).tolist() == line[1:].tolist() and len(blocks) == 3
    rows = recurrent_lm._gathered(docs.select("doc_id", "text")).collect()
    learned = sum(len(r["span"]) // 8 - 1 for r in rows if r["span"] is not None)
    assert learned == sum(r["n"] for r in rows if r["n"] is not None) > 30_000
    long_text = recurrent_lm._gathered(docs.where("doc_id = 204").select("doc_id", "text")).where("span is not null")
    assert long_text.select(F.col("shard") % recurrent_lm.ROUNDS).distinct().count() == recurrent_lm.ROUNDS


def test_language_model_spreads_copies(spark):
    """Copies of a text, also null ones and whole equal rows, meet different trainers in every round."""
    rows = [(i, "the same text") for i in range(200)] + [(7, "an equal row")] * 200 + [(None, None)] * 200
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = recurrent_lm._gathered(frame).where("span is not null").groupBy("span").agg(
        F.count("*").alias("n"), F.countDistinct("shard").alias("shards"),
        F.countDistinct(F.col("shard") % recurrent_lm.ROUNDS).alias("rounds")).collect()
    assert [(r["n"], r["rounds"]) for r in found] == [(200, recurrent_lm.ROUNDS)] * 3 and all(r["shards"] > 190 for r in found)


def test_language_model_passes_do_not_depend_on_size(spark, monkeypatch):
    """Every block is trained on once, with few tokens and with many."""
    v = recurrent_lm.make_vocabulary(np.arange(1, 9, dtype=np.uint64), np.full(8, 5), 99, 9)
    blocks = [(np.arange(1, 9, dtype=np.uint64).tobytes(), i) for i in range(40)]
    spans = spark.createDataFrame([(bytearray(b), i) for b, i in blocks], "span binary, shard long")
    asked = []
    real = type(spans).where
    monkeypatch.setattr(type(spans), "where", lambda self, c: asked.append(str(c)) or real(self, c))
    for tokens in (280, 10 * recurrent_lm.TRAINER_TOKENS):
        asked.clear()
        recurrent_lm.fit(spans, v, tokens)
        assert len([a for a in asked if "shard" in a]) == recurrent_lm.ROUNDS


def test_pipeline_stages(spark, docs, labels, tmp_path):
    folder = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    bench = docs.where("doc_id = 9").select(F.lit(1).alias("item_id"), F.col("text"))
    bench.write.parquet(f"{folder}/benchmark.parquet")
    left = spark.read.parquet(f"{folder}/documents.parquet")
    columns = left.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, folder).collect(), left.schema)
        assert left.columns == columns, name
    ids = [r["doc_id"] for r in left.collect()]
    assert not {*range(100, 120), 200, 201, 202, 203, 206, 9, 208} & set(ids) and {0, 2, 3, 4} <= set(ids) and ids.count(1) == 1
    got = corpus_pipeline.run(spark, folder)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(map(str, ids))


def test_crc_is_that_of_the_id_as_text(spark):
    frame = spark.createDataFrame([(12,), (None,)], "doc_id long")
    from textquarry.llm.common import document_hash
    assert [r[0] for r in frame.select(document_hash(F.col("doc_id"))).collect()] == [zlib.crc32(b"12"), zlib.crc32(b"")]


def test_page_texts_are_stored_once(spark, monkeypatch):
    kept, stored = {}, html_text.stored
    monkeypatch.setattr(html_text, "stored", lambda df, name, *more: kept.setdefault(name, stored(df, name, *more)))
    rows = [(i, f"https://a.b/{i}", f"<body><nav>menu</nav><article><p>text {i}</p><div class='x{i}'>more {i}</div></article></body>") for i in range(8)] + [(8, None, None)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"text {i}\nmore {i}" for i in range(8)}, 8: ""}
    # Texts outside the main part, and all texts for the style tree, are hashes.
    assert all(dict(kept[name].dtypes)["blocks"].startswith("array<struct<text:bigint,") for name in ("blocks", "labels"))
    assert "texts" not in kept["labels"].columns and sum(r["texts"] == [] for r in kept["blocks"].collect()) == 1
    assert not any("menu" in t for r in kept["blocks"].collect() for t in r["texts"])


def test_word_features_are_made_for_all_words_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(33, 127, rng.integers(1, 41)).astype(np.uint8)) for _ in range(300)] + [b"a", b"AB", b"abc", b"x" * 40]
    odd = [b"12", b"_", "é".encode(), "Über".encode(), b"\xff", b"\xffa"]
    assert language_id.have_letter(words + odd).tolist() == [bool(language_id.LETTER.search(w.decode("utf-8", "replace"))) for w in words + odd]
    assert language_id.have_letter([]).tolist() == []
    plain = [w for w in words if language_id.LETTER.search(w.decode())]
    ids, sizes = language_id.ascii_features(plain)
    assert ids.tolist() == [x for w in plain for x in language_id.word_features(w)]
    assert sizes.tolist() == [len(language_id.word_features(w)) for w in plain]
    model = language_id.Model(["a", "b"], rng.standard_normal((language_id.BUCKETS, 2)).astype(np.float32), np.zeros((2, 2), np.float32), np.zeros(2, np.float32))
    want = [model.emission[language_id.word_features(w)].sum(0) for w in words + odd]
    assert language_id.Labeller(model).emissions(words + odd) == pytest.approx(np.array(want), abs=1e-4)
    want = language_id.Labeller(model).emissions(plain)
    monkeypatch.setattr(language_id, "word_features", None)
    assert (language_id.Labeller(model).emissions(plain) == want).all()


def test_language_model_holds_the_words_of_few_texts(monkeypatch):
    texts = [prose("en", 20 + i, i).encode() for i in range(60)] + [b"", b"rare odd", b" "]
    ids, table, lengths = recurrent_lm.hashed_words(texts)
    words = np.sort(np.append(table[:12], np.uint64(recurrent_lm.END)))
    v = recurrent_lm.make_vocabulary(words, np.arange(5, 5 + len(words)), 999, 40)
    w = recurrent_lm.initial(v)
    whole = recurrent_lm.score_texts(texts, w, v)
    held, real = [], recurrent_lm.hashed_words
    monkeypatch.setattr(recurrent_lm, "hashed_words", lambda some: held.append(sum(map(len, some))) or real(some))
    monkeypatch.setattr(recurrent_lm, "COUNTED_BYTES", 500)
    parts = recurrent_lm.score_texts(texts, w, v)
    assert len(held) > 5 and max(held) < 500 + max(map(len, texts))
    assert whole.keys() == parts.keys()
    for name in whole:
        a, b = whole[name].to_pylist(), parts[name].to_pylist()
        assert [sorted(x) for x in a] == [sorted(x) for x in b] if name in ("rare", "times") else a == pytest.approx(b)


def test_language_model_shuffles_numbers(spark, docs, monkeypatch):
    kept, stored = {}, recurrent_lm.stored
    monkeypatch.setattr(recurrent_lm, "stored", lambda df, name, *more: kept.setdefault(name, stored(df, name, *more)))
    recurrent_lm.score(docs.select("doc_id", "text").where("doc_id < 20").withColumn("held_out", F.lit(False)))
    spans = kept["gathered"].where("span is not null")
    assert kept["numbered"].columns == ["numbers", "shard"]
    assert kept["numbered"].agg(F.sum(F.length("numbers"))).first()[0] * 4 == spans.agg(F.sum(F.length("span"))).first()[0] > 0


def test_language_model_gradients_of_ended_documents():
    """Documents that end within a window give what they give alone, the last word of the network too."""
    rng = np.random.default_rng(8)
    v = recurrent_lm.make_vocabulary(np.sort(rng.integers(0, 1 << 62, 200).astype(np.uint64)), rng.integers(1, 50, 200), 999, 300)
    w = recurrent_lm.initial(v)
    n = len(v.number_mass)
    ids = rng.integers(0, n, (4, 7))
    ids[0] = [1, n - 1, 5, 9, n - 1, 3, 4]
    ids[1, 3:], ids[2, 5:] = -1, -1

    def grads(rows):
        grad = w.like(np.zeros(w.flat().size))
        _, tokens = recurrent_lm._window(w, v, rows, np.zeros((len(rows), recurrent_lm.HIDDEN), np.float32), grad)
        return grad.flat(), tokens

    alone = [grads(ids[i:i + 1, :(k := int((ids[i] >= 0).sum()))]) for i in range(4)]
    together, tokens = grads(ids)
    assert tokens == sum(t for _, t in alone) == 6 + 2 + 4 + 6
    assert together == pytest.approx(sum(g for g, _ in alone), abs=1e-5)


def test_language_model_window_takes_no_new_memory():
    """A window works in the arrays of the one before; before, it took 6 MB anew."""
    import tracemalloc

    rng = np.random.default_rng(9)
    v = recurrent_lm.make_vocabulary(np.sort(rng.integers(0, 1 << 62, 200).astype(np.uint64)), rng.integers(1, 50, 200), 999, 300)
    blocks = [rng.integers(0, len(v.number_mass), 513) for _ in range(recurrent_lm.BATCH)]
    peaks, real = [], recurrent_lm._window

    def window(*args):
        tracemalloc.reset_peak()
        held = tracemalloc.get_traced_memory()[0]
        found = real(*args)
        peaks.append(tracemalloc.get_traced_memory()[1] - held)
        return found

    recurrent_lm._window = window
    tracemalloc.start()
    try:
        recurrent_lm.train(recurrent_lm.initial(v), v, blocks, 1)
    finally:
        tracemalloc.stop()
        recurrent_lm._window = real
    assert len(peaks) == 32 and max(peaks[1:]) < 1_500_000


def test_language_model_large_logits():
    """Outputs far beyond what float32 holds as exponentials."""
    rng = np.random.default_rng(6)
    v = recurrent_lm.make_vocabulary(np.sort(rng.integers(0, 1 << 62, 200).astype(np.uint64)), rng.integers(1, 50, 200), 999, 300)
    w, h, n = recurrent_lm.initial(v), rng.standard_normal((1, recurrent_lm.HIDDEN)).astype(np.float32), len(v.number_mass)
    for shift in (1000, -1000):
        w.class_bias[:] += shift
        w.word_bias[:] += shift
        logs, _ = recurrent_lm.output(w, v, np.repeat(h, n, 0), np.arange(n))
        assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-2)
        grad = w.like(np.zeros(w.flat().size))
        recurrent_lm._window(w, v, rng.integers(0, n, (4, 9)), np.zeros((4, recurrent_lm.HIDDEN), np.float32), grad)
        assert np.isfinite(grad.flat()).all() and np.abs(grad.flat()).max() > 0


def test_words_are_hashed_without_a_value_per_word():
    """Texts go to Arrow as they are; words are what Python splits and lower-cases."""
    class Text(bytes):
        def lower(self):
            raise AssertionError("a value per word")

    rng = np.random.default_rng(7)
    signs = np.frombuffer(b" \t\n\x0b\x0c\rabAB\x00\x1c\x1f\x85\xa0\xc2\xff", np.uint8)
    texts = [bytes(rng.choice(signs, rng.integers(0, 30))) for _ in range(500)] + [b"", b" ", " É x\u2003y ".encode()]
    for some in (texts, [b"", b" \n"], []):
        ids, table, lengths = recurrent_lm.hashed_words([Text(t) for t in some])
        words = [w for t in some for w in t.lower().split()]
        assert table[ids].tolist() == [xxhash.xxh3_64_intdigest(w) for w in words] and len(table) == len(set(words))
        assert lengths.tolist() == [len(t.split()) for t in some]
