"""File requests, edits, upserts, the stored table and the workspace."""

import os

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F
import pytest

from textquarry.operators import mutations, upsert
from textquarry.schemas import FILE, SNIPPET
from textquarry.sources.vector_table import VectorTable
from textquarry.sources.workspace import list_workspace, read_workspace, write_workspace

FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def file_rows(spark, rows):
    return spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in rows], FILE)


@pytest.fixture(scope="module")
def files(spark):
    return file_rows(spark, [("a.txt", b"one two two"), ("d/b.txt", b"\xff x"), ("d/e/c.txt", b""), (".hid", b"h")])


def test_read(spark, files):
    asked = spark.createDataFrame(list(enumerate(["a.txt", "./d/../d//b.txt", "/d/e/c.txt", "", "../x", "..foo", "nope", "d", "."])),
                                  "seq long, path string")
    got = {r.seq: (r.content and bytes(r.content), r.error) for r in mutations.read_files(asked, files).collect()}
    assert got[0] == (b"one two two", None) and got[1] == (b"\xff x", None) and got[2][1] is None
    assert got[3][1] == "path is required for read_file"
    assert got[4][1] == "invalid path: '../x' attempts to traverse outside the workspace"
    assert got[5][1] == "invalid path: '..foo' attempts to traverse outside the workspace"
    assert got[6][1] == "file not found at path 'nope' within workspace"
    assert got[7][1] == "path 'd' is a directory, not a file" and got[8][1] == "path '.' is a directory, not a file"


def test_list(spark, files):
    asked = spark.createDataFrame(list(enumerate(["", "d", "d/", "a.txt", "nope", "..", "/d"])), "seq long, path string")
    got = {}
    for r in mutations.list_dir(asked, files).collect():
        got.setdefault(r.seq, set()).add((r.entry, r.is_dir) if r.error is None else r.error)
    assert got[0] == {(".hid", False), ("a.txt", False), ("d", True)}
    assert got[1] == got[2] == {("d/b.txt", False), ("d/e", True)}
    assert got[3] == {"path 'a.txt' is not a directory"}
    assert got[4] == {"directory not found at path 'nope' within workspace"}
    assert got[5] == {"invalid path: '..' attempts to traverse outside the workspace"}
    assert got[6] == {("/d/b.txt", False), ("/d/e", True)}


def test_create(spark, files):
    asked = spark.createDataFrame([(1, "n/x", "first"), (2, "n/./x", "second"), (3, "a.txt", "z"), (4, "d", "z"), (5, "", "z"),
                                   (6, "../q", "z"), (7, "empty", "")], "seq long, path string, content string")
    done = mutations.create_files(asked, files)
    got = {r.seq: r.error for r in done.collect()}
    assert got[1] is None and got[7] is None
    assert got[2] == "file already exists at path 'n/./x'" and got[3] == "file already exists at path 'a.txt'"
    assert got[4] == "file already exists at path 'd'" and got[5] == "path is required for create_file"
    assert got[6].startswith("invalid path")
    after = {r.path: bytes(r.content) for r in mutations.apply_creates(files, done).collect()}
    assert after["n/x"] == b"first" and after["empty"] == b"" and after["a.txt"] == b"one two two" and len(after) == 6


def test_edit_once(spark, files):
    extra = files.unionByName(file_rows(spark, [("r.txt", b"a.b axb"), ("o.txt", b"aaaa"), ("u.txt", b"\xc3\xa9\xff-x")]))
    asked = spark.createDataFrame([
        (1, "a.txt", "one", "1"), (2, "d/b.txt", "zz", ""), (3, "r.txt", "a.b", "\\1$"), (4, "o.txt", "aa", "b"),
        (5, "u.txt", "x", ""), (6, "nope", "x", "y"), (7, "d", "x", "y"), (8, ".hid", "", "y"), (9, "../a", "x", "y")],
        "seq long, path string, old_str string, new_str string")
    got = {r.seq: (r.content and bytes(r.content), r.error) for r in mutations.edit_once(asked, extra).collect()}
    assert got[1] == (b"1 two two", None) and got[3] == (b"\\1$ axb", None) and got[5] == (b"\xc3\xa9\xff-", None)
    assert got[2][1] == "string 'zz' not found in file 'd/b.txt'"
    assert got[4][1] == "string 'aa' found multiple times (2) in file 'o.txt', expected exactly one"
    assert got[6][1] == "file not found at path 'nope' within workspace"
    assert got[7][1] == "path 'd' is a directory, cannot edit"
    assert got[8][1] == "path and old_str are required for edit_file" and got[9][1].startswith("invalid path")


def model_edits(content: bytes, edits):
    errors = []
    for old, new in edits:
        n = content.count(old.encode())
        if n == 1:
            content = content.replace(old.encode(), new.encode(), 1)
        errors.append(n)
    return content, errors


@FEW
@given(st.lists(st.tuples(st.sampled_from("abc"), st.text("xyz", min_size=1, max_size=2), st.text("xyz", max_size=2)), max_size=25))
def test_edit_sequence_model(spark, edits):
    start = {"a": b"xyz", "b": b"zzz yx", "c": b""}
    table = file_rows(spark, list(start.items()))
    asked = spark.createDataFrame([(i, *e) for i, e in enumerate(edits)], "seq long, path string, old_str string, new_str string")
    rows = mutations.edit_sequence(asked, table).collect()
    after = {r.path: bytes(r.content) for r in mutations.apply_edits(table, mutations.edit_sequence(asked, table)).collect()}
    for name, content in start.items():
        mine = [(i, e) for i, e in enumerate(edits) if e[0] == name]
        want, counts = model_edits(content, [(old, new) for _, (_, old, new) in mine])
        assert after[name] == want
        failed = {i for (i, _), n in zip(mine, counts) if n != 1}
        assert failed == {r.seq for r in rows if r.key == name and r.error}
    assert sorted(r.seq for r in rows if r.seq is not None) == list(range(len(edits)))


def test_edit_sequence_without_broadcast(spark):
    # Both sides then arrive partitioned by key already.
    table = file_rows(spark, [(f"f{i}", b"a") for i in range(500)])
    asked = spark.range(500).select(F.col("id").alias("seq"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"),
                                    F.lit("a").alias("old_str"), F.lit("b").alias("new_str"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = mutations.edit_sequence(asked, table).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 1000 and not [r for r in rows if r.error]


def snippet_rows(spark, rows):
    return spark.createDataFrame([(i, c, "p", 1, 1, ["s", ""], v, {"content": "m", "e": ""}) for i, c, v in rows], SNIPPET)


def test_table(spark, tmp_path):
    table = VectorTable.ensure(spark, str(tmp_path / "t"), dim=2)
    assert table.read().count() == 0
    table.upsert(snippet_rows(spark, [("a", "1", [1.0, 0.0]), ("b", "1", [0.0, 1.0]), ("n", "1", None), ("", "1", [1.0, 1.0])]))
    with pytest.raises(ValueError):
        VectorTable.ensure(spark, str(tmp_path / "t"), dim=7)
    again = VectorTable.ensure(spark, str(tmp_path / "t"))
    assert again.dim == 2
    again.upsert(snippet_rows(spark, [("b", "2", [0.0, 2.0]), ("c", "2", [1.0, 0.1])]))
    contents = lambda: sorted((len(r.id), r.id[:1] if len(r.id) == 1 else "", r.content) for r in again.read().collect())
    want = [(1, "a", "1"), (1, "b", "2"), (1, "c", "2"), (64, "", "1")]
    assert contents() == want
    again.compact()
    assert contents() == want
    again.upsert(snippet_rows(spark, [("a", "3", [1.0, 0.0])]))
    assert contents() == [(1, "a", "3")] + want[1:]
    row = again.read().first()
    assert row.symbols == ["s"] and row.metadata == {"content": "m"}
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    hits = sorted(again.search(queries, 2).collect(), key=lambda r: r["rank"])
    assert [(r.id, r.content, r.metadata) for r in hits] == [("a", "3", {"content": "m"}), ("c", "2", {"content": "m"})]
    with pytest.raises(Exception, match="dimensions"):
        again.upsert(snippet_rows(spark, [("z", "1", [1.0])]))
    assert again.read().count() == 4


def test_upsert_latest(spark):
    rows = lambda data: spark.createDataFrame(data, "id long, embedding array<float>, version int")
    old = rows([(1, [1.0], 1), (2, [1.0], 1)])
    new = rows([(2, [2.0], 2), (2, [3.0], 3), (1, None, 9), (3, [1.0], 2)])
    got = sorted((r.id, r.embedding[0], r.version) for r in upsert.upsert_latest(old, new).collect())
    assert got == [(1, 1.0, 1), (2, 3.0, 3), (3, 1.0, 2)]


def test_fallback(spark):
    texts = spark.createDataFrame([("a", {"k": "v", "b": "c"}, []), ("b", {}, None), ("c", None, None), ("d", {}, [1.0])],
                                  "text_content string, metadata map<string,string>, embedding array<float>")
    got = sorted(r.content for r in upsert.fallback_files(texts).collect())
    assert got == ["a\n\n--- Metadata ---\nb: c\nk: v\n", "b", "c"]
    table = file_rows(spark, [("vector_store_fallback_1.txt", b"x"), ("d/vector_store_fallback_2.txt", b"y"), ("z.txt", b"")])
    assert [r.filename for r in upsert.fallback_docs(table).collect()] == ["vector_store_fallback_1.txt"]


def test_workspace(spark, tmp_path):
    root = tmp_path / "w"
    (root / "d" / ".e" / "_f").mkdir(parents=True)
    (root / "empty").mkdir()
    (root / ".env").write_bytes(b"A=1")
    (root / "d" / ".e" / "_f" / "x.GO").write_bytes(b"g")
    (root / "d" / "big.bin").write_bytes(b"a" * (10 * 1024 * 1024 + 1))
    (root / "d" / "big.go").write_bytes(b"a" * (10 * 1024 * 1024 + 1))
    listed = {r.path: r.length for r in list_workspace(spark, str(root)).collect()}
    assert listed == {".env": 3, "d/.e/_f/x.GO": 1, "d/big.bin": 10485761, "d/big.go": 10485761}
    got = {r.path: (r.content and len(r.content), r.error) for r in read_workspace(spark, str(root)).collect()}
    assert got[".env"] == (3, None) and got["d/big.go"] == (10485761, None)
    assert got["d/big.bin"] == (None, "file too large (>10MB): d/big.bin")
    out = tmp_path / "out"
    write_workspace(file_rows(spark, [("a/.b/c", b"1"), ("d", b"")]), str(out)).collect()
    assert (out / "a/.b/c").read_bytes() == b"1" and (out / "d").read_bytes() == b""
    with pytest.raises(Exception):
        read_workspace(spark, str(tmp_path / "gone")).collect()
    assert os.path.isdir(out)


def test_jobs(spark, tmp_path):
    from textquarry.__main__ import main
    root = tmp_path / "w"
    root.mkdir()
    (root / "a.go").write_bytes(b"package a\n\nfunc Alpha() {\n}\n")
    table, turns, calls = (str(tmp_path / n) for n in ("table", "turns", "calls"))
    main(["index", str(root), table])
    spark.createDataFrame([(1, 1, "user", "alpha")], "conv_id long, turn long, role string, text string").write.parquet(turns)
    made = [("r", 1, "read_file", '{"path": "a.go"}'), ("c", 2, "create_file", '{"path": "d/new", "content": "x"}'),
            ("e", 3, "edit_file", '{"path": "a.go", "old_str": "Alpha", "new_str": "Beta"}'),
            ("u", 4, "vector_upsert", '{"text_content": "kept text"}')]
    spark.createDataFrame(made, "call_id string, seq long, name string, input string").write.parquet(calls)
    main(["prompts", turns, table, str(tmp_path / "p")])
    main(["tools", calls, str(root), table, str(tmp_path / "t")])
    assert "func Alpha() {\n}\n```" in spark.read.parquet(str(tmp_path / "p")).first().prompt
    answers = {r.call_id: r.content for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert answers["r"].startswith("package a")
    after = {r.path: bytes(r.content) for r in spark.read.parquet(str(tmp_path / "t_files")).collect()}
    assert after == {"a.go": b"package a\n\nfunc Beta() {\n}\n", "d/new": b"x"}
    assert VectorTable.ensure(spark, table).read().filter("content = 'kept text'").count() == 1


def test_texts_with_other_metadata_are_other_texts(spark):
    rows = [("hello", {"a": "1"}), ("hello", {"a": "2"}), ("hello", None)]
    texts = spark.createDataFrame([(t, m, [1.0]) for t, m in rows], "text_content string, metadata map<string,string>, embedding array<float>")
    assert texts.count() == upsert.text_snippets(texts).select("id").distinct().count() == 3
    lost = texts.withColumn("embedding", F.lit(None).cast("array<float>"))
    assert upsert.fallback_files(lost).select("filename").distinct().count() == 3


def test_creates_with_equal_seq(spark):
    files = spark.createDataFrame([("old", 1, bytearray(b"x"))], "path string, length long, content binary")
    calls = spark.createDataFrame([("b", 1, "new", "2"), ("a", 1, "new", "1"), ("c", 1, "../x", "3"), ("d", 1, "", "4"), ("e", 2, "old", "5")],
                                  "call_id string, seq long, path string, content string")
    created = mutations.create_files(calls, files)
    assert sorted(r.call_id for r in created.filter("error is null").collect()) == ["a"]
    assert created.count() == 5
    assert sorted((r.path, bytes(r.content)) for r in mutations.apply_creates(files, created).collect()) == [("new", b"1"), ("old", b"x")]


def test_dangling_link_does_not_stop_the_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    got = {r.path: r.error for r in read_workspace(spark, str(tmp_path)).collect()}
    assert got["a.txt"] is None and "failed to read" in got["gone"]


def test_equal_ids_have_a_stated_winner(spark, tmp_path):
    batch = [("a", f"c{i}", [1.0, float(i)]) for i in range(8)]
    left = []
    for run in range(3):
        rows = snippet_rows(spark, batch[run:] + batch[:run]).repartition(3 + run)
        table = VectorTable.ensure(spark, str(tmp_path / f"t{run}"), dim=2)
        table.upsert(rows)
        left.append([r.content for r in table.read().collect()])
        table.upsert(rows.withColumn("seq", -F.substring("content", 2, 1).cast("int")))
        left.append([r.content for r in table.read().collect()])
    assert left == [["c7"], ["c0"]] * 3


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    table = VectorTable.ensure(spark, str(tmp_path / "t"), dim=2, buckets=8)
    table.upsert(snippet_rows(spark, [(f"id{i}", "old", [1.0, 0.0]) for i in range(60)]))
    files = lambda: {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "t" / "rows") for f in names if f.startswith("part")}
    before = files()
    assert table.upsert(snippet_rows(spark, [("id7", "new", [0.0, 1.0])])) == 2
    after = files()
    assert len(set(before) - set(after)) == 1 and all(after[f] == before[f] for f in set(before) & set(after)) and len(before) == 8
    assert sorted(r.content for r in table.read().collect()) == ["new"] + ["old"] * 59
    assert table.upsert(snippet_rows(spark, [("n", "x", None)])) == 3 and files() == after
    table.register("snippets_of_a_test")
    try:
        assert spark.table("snippets_of_a_test").filter("content = 'new'").count() == 1
        shown = {r["key"]: r["value"] for r in spark.sql("SHOW TBLPROPERTIES snippets_of_a_test").collect()}
        assert (shown["dim"], shown["metric"], shown["buckets"]) == ("2", "cosine", "8")
    finally:
        spark.sql("DROP TABLE snippets_of_a_test")


def test_search_under_a_condition(spark, tmp_path):
    table = VectorTable.ensure(spark, str(tmp_path / "t"), dim=2)
    rows = snippet_rows(spark, [(f"{i}", f"{i}", [1.0, i / 10]) for i in range(10)])
    table.upsert(rows.withColumn("metadata", F.create_map(F.lit("even"), (F.col("id").cast("int") % 2 == 0).cast("string"))))
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    hits = table.search(queries, 3, where=F.element_at("metadata", "even") == "false")
    assert [r.id for r in sorted(hits.collect(), key=lambda r: r["rank"])] == ["1", "3", "5"]


def test_files_that_cannot_be_read_are_named(spark, tmp_path):
    from textquarry.operators.snippets import file_errors, index_summary, snippets
    from textquarry.plans.index import index_directory
    root = tmp_path / "w"
    root.mkdir()
    (root / "a.txt").write_text("hello")
    (root / "big.txt").write_text("x" * 50)
    (root / "gone.txt").symlink_to(root / "nowhere")
    (root / "gone.go").symlink_to(root / "nowhere")
    (root / "n.bin").write_bytes(b"\x00" * 40)
    files = read_workspace(spark, str(root), max_file_bytes=49)
    summary = {(r.kind, r.name): r.n for r in index_summary(files, max_file_bytes=49).collect()}
    assert summary[("files", "(all)")] == 5 and summary[("snippets", "(all)")] == 1
    left_out = {name for kind, name in summary if kind == "left out"}
    assert len(left_out) == 4 and "file too large (>49 bytes): big.txt" in left_out
    assert {r.path: r.error.split(":")[0] for r in file_errors(files).collect() if "gone" in r.path} == {
        "gone.txt": "failed to read file gone.txt", "gone.go": "failed to read file gone.go"}
    assert [r.file_path for r in snippets(files).collect()] == ["a.txt"]
    table = VectorTable.ensure(spark, str(tmp_path / "t"))
    index_directory(spark, str(root), table, max_file_bytes=49)
    assert [r.file_path for r in table.read().collect()] == ["a.txt"]


def test_rows_that_are_there_are_not_written_again(spark, tmp_path):
    table = VectorTable.ensure(spark, str(tmp_path / "t"), dim=2, buckets=4)
    schema = "id string, content string, file_path string, start_line long, end_line long, symbols array<string>, embedding array<float>, metadata map<string,string>"
    rows = [(f"i{i}", f"text {i}", "p", i, i, ["s"], [float(i), 1.0], {"b": "1", "a": str(i)}) for i in range(20)]
    rows += [("none", None, "", None, 1, [], [0.0, 1.0], None), ("twice", "a", "p", 1, 1, [], [0.0, 1.0], {}), ("twice", "b", "p", 1, 1, [], [0.0, 1.0], {})]
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t" / "rows").rglob("*.parquet")}
    contents = lambda: sorted((r["id"], str(r.asDict(True))) for r in table.read().collect())
    assert table.upsert(spark.createDataFrame(rows, schema)) == 1
    first, kept = files(), contents()
    assert len(kept) == 22 and dict(kept)["twice"].count("'b'")
    assert table.upsert(spark.createDataFrame(rows[::-1], schema)) == 2
    assert files() == first and contents() == kept
    # A null instead of an empty value, another order of symbols or one other number is a change; only its bucket is rewritten.
    for i, row in enumerate([("none", "", "", None, 1, [], [0.0, 1.0], None), ("i3", "text 3", "p", 3, 3, ["s", None], [3.0, 1.0], {"a": "3", "b": "1"}),
                             ("i3", "text 3", "p", 3, 3, [None, "s"], [3.0, 1.0], {"a": "3", "b": "1"}), ("new", "x", "", 1, 1, [], [0.5, 1.0], {})]):
        before = files()
        assert table.upsert(spark.createDataFrame([row], schema)) == 3 + i
        gone = {f.rsplit("/", 2)[1] for f in before if f not in files()}
        assert len(gone) <= 1 and files() != before
        assert [r["content"] for r in table.read().filter(F.col("id") == row[0]).collect()] == [row[1]]
    assert len(contents()) == 23
