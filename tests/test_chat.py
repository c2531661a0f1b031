"""Context, conversations, tools, web and streams."""

import json

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from textquarry.functions.toolinput import decode_inputs
from textquarry.operators import conversations
from textquarry.operators.context import CONTEXT_CUT, CONTEXT_INTRO, context_of, enrich
from textquarry.operators.tools import ToolBox, execute
from textquarry.plans.chat import prompts
from textquarry.schemas import FILE, SNIPPET, TOOL_CALL
from textquarry.sources.vector_table import VectorTable
from textquarry.sources.web import web_results
from textquarry.streaming.jobs import enrich_stream, index_stream

FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def block(path, content):
    return f"--- File: {path} (Lines: 1-2) ---\n```go\n{content}\n```\n\n"


def model_context(contents, budget=1000):
    out, used = CONTEXT_INTRO, 0
    for c in contents:
        b = block("p", c)
        if used + len(b.encode()) > budget:
            return out + CONTEXT_CUT
        out, used = out + b, used + len(b.encode())
    return out


def spark_contexts(spark, queries):
    rows = [(q, r, "p", 1, 2, c) for q, contents in enumerate(queries) for r, c in enumerate(contents)]
    hits = spark.createDataFrame(rows, "query_id long, rank int, file_path string, start_line long, end_line long, content string")
    return {r.query_id: r.context for r in context_of(hits).collect()}


def test_budget(spark):
    room = 1000 - len(block("p", ""))
    cases = [["a" * room], ["a" * (room + 1)], ["é" * (room // 2)], ["é" * (room // 2 + 1)], ["a", "b" * 2000, "c"],
             ["a" * (room - len(block("p", "b"))), "b"], ["a" * (room - len(block("p", "b")) + 1), "b"]]
    got = spark_contexts(spark, cases)
    assert [got[i] for i in range(len(cases))] == [model_context(c) for c in cases]
    assert got[1] == CONTEXT_INTRO + CONTEXT_CUT


@FEW
@given(st.lists(st.lists(st.text("aé\n", max_size=400), min_size=1, max_size=5), min_size=1, max_size=10))
def test_budget_model(spark, queries):
    got = spark_contexts(spark, queries)
    assert [got[i] for i in range(len(queries))] == [model_context(c) for c in queries]


def test_enrich_without_context(spark):
    turns = spark.createDataFrame([("1", "hi"), ("2", "ho")], "query_id string, text string")
    contexts = spark.createDataFrame([("1", "C")], "query_id string, context string")
    got = {r.query_id: r.prompt for r in enrich(turns, contexts).collect()}
    assert got == {"1": "C\n\nUser Query:\nhi", "2": "ho"}


TURNS = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 4, "user", "d"),
         (1, 900, "assistant", "e"), (1, 901, "assistant", "f"), (2, 5, "user", "x"), (3, 7, "assistant", "y")]


def model_history(rows, n):
    out = {}
    for conv, turn, _, _ in rows:
        before = sorted(r for r in rows if r[0] == conv and r[1] < turn)
        out[conv, turn] = [r[3] for r in before[-n:]]
    return out


def turn_frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_history(spark):
    for chunk in (1, 2, 3, 1024):
        for n in (1, 3):
            got = conversations.history_before_turn(turn_frame(spark, TURNS), n, chunk).collect()
            assert {(r.conv_id, r.turn): [m.text for m in r.history] for r in got} == model_history(TURNS, n)


@FEW
@given(st.sets(st.tuples(st.integers(0, 2), st.integers(0, 40)), min_size=1, max_size=60), st.integers(1, 4), st.integers(1, 9))
def test_history_model(spark, keys, n, chunk):
    rows = [(c, t, "user" if t % 3 else "assistant", f"{c}.{t}") for c, t in keys]
    got = conversations.history_before_turn(turn_frame(spark, rows), n, chunk).collect()
    assert {(r.conv_id, r.turn): [m.text for m in r.history] for r in got} == model_history(rows, n)
    groups = conversations.with_turn_group(turn_frame(spark, rows), chunk).collect()
    users = lambda c, t: sum(1 for r in rows if r[0] == c and r[1] <= t and r[2] == "user")
    assert all(g.turn_group == users(g.conv_id, g.turn) for g in groups) and len(groups) == len(rows)


def test_ranked(spark):
    from textquarry.operators.ranks import ranked
    rows = [(k, i * 10**9, "x") for k, n in ((1, 500), (2, 1), (None, 7)) for i in range(n)]
    frame = spark.createDataFrame(rows, "k int, at long, v string").repartition(5)
    got = {(r.k, r["at"]): r.place for r in ranked(frame, ["k"], ["at"]).collect()}
    assert got == {(k, at): at // 10**9 for k, at, _ in rows}
    assert ranked(frame.limit(0), ["k"], ["at"]).count() == 0


def test_sparse_turn_numbers(spark):
    rows = [(1, t * 86_400_000, "user" if t % 3 else "assistant", f"m{t}") for t in range(30)]
    for n, chunk in ((3, 4), (40, 8)):
        got = conversations.history_before_turn(turn_frame(spark, rows), n, chunk).collect()
        assert {(r.conv_id, r.turn): [m.text for m in r.history] for r in got} == model_history(rows, n)
    groups = conversations.with_turn_group(turn_frame(spark, rows), 4).collect()
    assert all(g.turn_group == sum(r[2] == "user" for r in rows if r[1] <= g.turn) for g in groups) and len(groups) == 30


def test_turn_groups(spark):
    for chunk in (2, 1024):
        got = sorted(conversations.turn_groups(turn_frame(spark, TURNS), chunk).collect())
        assert [(r.conv_id, r.turn_group, r.first_turn, r.last_turn, r.n_messages, r.n_replies, r.user_text) for r in got] == [
            (1, 0, 0, 0, 1, 0, None), (1, 1, 1, 2, 2, 1, "a"), (1, 2, 3, 3, 1, 0, "c"), (1, 3, 4, 901, 3, 2, "d"),
            (2, 1, 5, 5, 1, 0, "x"), (3, 0, 7, 7, 1, 1, None)]


def test_decode(spark):
    inputs = ['{"query": "q", "k": 2}', '{"query": "q"}', '{"k": "2", "query": "q"}', '{"query": 5}', "nonsense", "null", "{}",
              "[1]", '{"query": null, "extra": {}}', '{"k": 1.5}', "", '{"Query": "Q", "K": 3}']
    calls = spark.createDataFrame(list(enumerate(inputs)), "i long, input string")
    got = sorted(decode_inputs(calls, "t", {"query": "string", "k": "int"}).select("i", "query", "k", "format_error").collect())
    bad = "invalid input format for t"
    assert [r.format_error for r in got] == [None, None, bad, bad, bad, None, None, bad, None, bad, bad, None]
    assert (got[0].query, got[0].k, got[1].k, got[5].query, got[8].query) == ("q", 2, 0, "", "")
    assert (got[11].query, got[11].k) == ("Q", 3)
    blank = decode_inputs(calls.filter("i = 10"), "t", {"query": "string"}, blank_ok=True).first()
    assert blank.format_error is None
    maps = spark.createDataFrame([(0, '{"m": {"a": "b", "c": null}}'), (1, '{"m": {"a": 1}}'), (2, '{"m": "x"}'), (3, "{}")],
                                 "i long, input string")
    got = sorted(decode_inputs(maps, "t", {"m": "text_map"}).collect())
    assert [r.format_error for r in got] == [None, bad, bad, None] and got[0].m == {"a": "b", "c": ""} and got[3].m == {}


def test_tools(spark):
    files = spark.createDataFrame([("a.txt", 3, bytearray(b"one")), ("d/b.txt", 1, bytearray(b"b")),
                                   ("vector_store_fallback_1.txt", 5, bytearray(b"gamma"))], FILE)
    snips = spark.createDataFrame([("s1", "alpha beta", "p", 1, 2, ["f"], None, {"m": "v"}), ("s2", "beta", "p", 3, 4, [], None, {})], SNIPPET)
    web = spark.createDataFrame([("w", '{"web": {"results": [{"title": "t", "url": "u", "age": 1}]}, "x": 1}')], "query string, body string")
    box = ToolBox(files, snips, web=web)
    calls = [
        ("r", "read_file", {"path": "a.txt"}), ("r2", "read_file", {"path": "zz"}), ("l", "list_files", {}), ("l2", "list_files", {"path": "d"}),
        ("e1", "edit_file", {"path": "a.txt", "old_str": "one", "new_str": "two"}),
        ("e2", "edit_file", {"path": "a.txt", "old_str": "two", "new_str": ""}), ("e3", "edit_file", {"path": "a.txt", "old_str": "one"}),
        ("c", "create_file", {"path": "n", "content": "x"}), ("s", "vector_search", {"query": "alpha", "k": 1}),
        ("s2", "vector_search", {"query": "amm"}), ("s3", "vector_search", {"query": "zzz"}), ("s4", "vector_search", {"k": 3}),
        ("u", "vector_upsert", {"text_content": "hello", "metadata": {"a": "b"}}), ("u2", "vector_upsert", {"text_content": "..."}),
        ("w", "search_web", {"query": "w"}), ("x", "nope", {}), ("y", "read_file", 5)]
    frame = spark.createDataFrame([(c, i, n, json.dumps(a)) for i, (c, n, a) in enumerate(calls)], TOOL_CALL)
    got = {r.call_id: (r.content, r.is_error) for r in box.execute(frame).collect()}
    assert got["r"] == ("one", False)
    assert got["r2"] == ("Error executing tool 'read_file': file not found at path 'zz' within workspace", True)
    assert json.loads(got["l"][0]) == ["a.txt", "d", "vector_store_fallback_1.txt"] and json.loads(got["l2"][0]) == ["d/b.txt"]
    assert got["e1"] == got["e2"] == ("Successfully edited file 'a.txt'", False)
    assert got["e3"] == ("Error executing tool 'edit_file': string 'one' not found in file 'a.txt'", True)
    assert got["c"] == ("Successfully created file 'n'", False)
    assert json.loads(got["s"][0]) == [{"id": "s1", "content": "alpha beta", "file_path": "p", "start_line": 1, "end_line": 2,
                                        "symbols": ["f"], "metadata": {"m": "v"}}]
    assert json.loads(got["s2"][0]) == [{"filename": "vector_store_fallback_1.txt", "content": "gamma", "relevance": 1.0,
                                         "matched_line": "gamma"}]
    assert got["s3"] == ("No relevant information found in fallback files.", False)
    assert got["s4"] == ("Error executing tool 'vector_search': query is required for vector_search", True)
    assert got["u"][0].startswith("Successfully upserted content with ID: ")
    assert got["u2"][0].startswith("Successfully created file 'vector_store_fallback_")
    assert json.loads(got["w"][0]) == {"web": {"results": [{"title": "t", "url": "u"}]}}
    assert got["x"] == ("tool not found", True)
    assert got["y"] == ("Error executing tool 'read_file': invalid input format for read_file", True)
    snips_out, fallback = box.upserts(frame.filter("name = 'vector_upsert'"))
    assert [(r.content, r.metadata) for r in snips_out.collect()] == [("hello", {"a": "b"})]
    assert [r.content for r in fallback.collect()] == ["..."]

    off = spark.createDataFrame([("read_file", False)], "name string, enabled boolean")
    assert execute(frame.filter("call_id = 'r'"), box.handlers(), off).first().content == "tool not found"
    bare = ToolBox(files, names={"read_file": "cat"})
    assert set(bare.handlers()) == {"cat", "list_files", "edit_file", "create_file"}
    shown = {r.name: json.loads(r.input_schema) for r in bare.definitions().collect()}
    assert set(shown) == set(bare.handlers()) and shown["cat"]["properties"] == {"path": {"type": "string"}}
    assert box.definitions().count() == 7


def test_long_listing_comes_in_pages(spark, monkeypatch):
    from textquarry.operators import tools
    monkeypatch.setattr(tools, "LISTING_PAGE", 10)
    files = spark.range(95).select(F.format_string("d/%03d", "id").alias("path"), F.lit(0).cast("long").alias("length"),
                                   F.lit(b"").alias("content"))
    call = spark.createDataFrame([("l", 0, "list_files", '{"path": "d"}')], TOOL_CALL)
    rows = ToolBox(files).execute(call).collect()
    assert [(r.page, r.pages) for r in sorted(rows, key=lambda r: r.page)] == [(i, 10) for i in range(1, 11)]
    assert [p for r in sorted(rows, key=lambda r: r.page) for p in json.loads(r.content)] == [f"d/{i:03d}" for i in range(95)]


def test_web(spark):
    bodies = spark.createDataFrame([(1, '{"web":{"results":[{"title":"a","url":"u","description":"d","z":1},{"title":"b"}]}}'),
                                    (2, '{"web":{}}'), (3, "broken")], "i long, body string")
    got = sorted((r.i, r.title, r.url, r.description) for r in web_results(bodies).collect())
    assert got == [(1, "a", "u", "d"), (1, "b", None, None)]


def test_streams(spark, tmp_path):
    snips = spark.createDataFrame([("s1", "alpha beta", "p", 1, 2, [], None, None)], SNIPPET)
    rows = [(1, 1, "user", "alpha"), (1, 2, "assistant", "b"), (1, 3, "user", "zzz")]
    source = str(tmp_path / "turns")
    turn_frame(spark, rows[:2]).write.parquet(source)
    stream = lambda: spark.readStream.schema(turn_frame(spark, rows).schema).parquet(source)
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    enrich_stream(stream(), snips, out, offsets).awaitTermination()
    turn_frame(spark, rows[2:]).write.mode("append").parquet(source)
    enrich_stream(stream(), snips, out, offsets).awaitTermination()
    columns = ["conv_id", "turn", "prompt"]
    got = sorted(spark.read.parquet(out).select(*columns).collect())
    assert got == sorted(prompts(turn_frame(spark, rows), snips).select(*columns).collect()) and len(got) == 2

    files = spark.createDataFrame([("a.txt", 3, bytearray(b"one")), ("b.go", 22, bytearray(b"package b\nfunc A() {\n}"))], FILE)
    source = str(tmp_path / "files")
    files.write.parquet(source)
    table = VectorTable.ensure(spark, str(tmp_path / "table"))
    for checkpoint in ("one", "two"):  # the second stream replays everything
        index_stream(spark.readStream.schema(FILE).parquet(source), table, str(tmp_path / checkpoint)).awaitTermination()
    assert sorted((r.file_path, tuple(r.symbols), len(r.embedding)) for r in table.read().collect()) == [
        ("a.txt", (), 1536), ("b.go", ("A",), 1536)]
