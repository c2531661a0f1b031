"""The workspace format: batch, conditions, streams."""

import os
import time

import pytest
from pyspark.sql import functions as F

from textquarry.operators.snippets import index_summary
from textquarry.sources import workspace_source
from textquarry.sources.workspace import read_workspace


@pytest.fixture
def root(spark, tmp_path):
    workspace_source.register(spark)
    (tmp_path / "d" / ".e" / "_f").mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    (tmp_path / ".env").write_bytes(b"A=1")
    (tmp_path / "d" / ".e" / "_f" / "x.GO").write_bytes(b"g")
    (tmp_path / "d" / "b.txt").write_bytes(b"bee")
    (tmp_path / "da").write_bytes(b"12345")
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    return tmp_path


def rows(df):
    return {r["path"]: (r["length"], r["content"] and bytes(r["content"]), r["error"]) for r in df.collect()}


def load(spark, root, **options):
    return spark.read.format("workspace").options(**options).load(str(root))


def test_equals_the_scan(spark, root):
    assert rows(load(spark, root)) == rows(read_workspace(spark, str(root))) and len(rows(load(spark, root))) == 5
    listing = rows(load(spark, root, contents="false"))
    assert listing["da"] == (5, None, None) and listing["gone"][2] is None
    assert rows(load(spark, root, maxFileBytes=4))["da"] == (5, None, "file too large (>4 bytes): da")
    found = {r["kind"] for r in index_summary(load(spark, root)).collect()}
    assert found == {"files", "snippets", "left out"}


def test_conditions_come_before_contents(spark, root):
    with open(root / "huge", "wb") as f:
        f.truncate(40 << 30)  # sparse: opening it would end the task
    files = load(spark, root, maxFileBytes=1 << 50)
    assert set(rows(files.filter("length < 100"))) == {".env", "d/.e/_f/x.GO", "d/b.txt", "da", "gone"}
    assert set(rows(files.filter("path like 'd%' and length between 2 and 4"))) == {"d/b.txt"}
    assert set(rows(files.filter(F.col("path").startswith("d/.e")))) == {"d/.e/_f/x.GO"}
    assert set(rows(files.filter("path = 'd/b.txt' or path = 'da'").filter("length < 9"))) == {"d/b.txt", "da"}
    assert set(rows(files.filter("path in ('da', 'none') and upper(path) = 'DA'"))) == {"da"}


def test_large_directories_are_shared_out(spark, tmp_path, monkeypatch):
    workspace_source.register(spark)
    for i in range(50):
        (tmp_path / f"{i}.txt").write_text(str(i))
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one").write_text("1")
    monkeypatch.setattr(workspace_source, "FILES", 8)
    tree = workspace_source._Tree({"path": str(tmp_path)})
    shares = tree.shares(tree.folders())
    assert len(shares) == 8
    read = [path for share in shares for batch in tree.read(share) for path in batch.column("path").to_pylist()]
    assert sorted(read) == sorted([f"{i}.txt" for i in range(50)] + ["s/one"])


def test_stream(spark, root, tmp_path_factory):
    out, offsets = (str(tmp_path_factory.mktemp("s") / x) for x in ("out", "offsets"))

    def run():
        stream = spark.readStream.format("workspace").load(str(root))
        query = stream.select("path", "content").writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r["path"] for r in spark.read.parquet(out).collect())

    first = run()
    assert first == [".env", "d/.e/_f/x.GO", "d/b.txt", "da", "gone"]
    time.sleep(0.02)
    (root / "new").write_text("n")
    os.utime(root / "da")
    assert run() == sorted([*first, "new", "da"])


def test_no_path_and_no_folder(spark, tmp_path):
    workspace_source.register(spark)
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("workspace").load().collect()
    with pytest.raises(Exception):
        load(spark, tmp_path / "none").collect()
    assert load(spark, tmp_path).count() == 0
