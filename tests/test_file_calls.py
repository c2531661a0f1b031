"""File calls in order against a model of a file system."""

import posixpath
import random

from textquarry.operators import file_calls
from textquarry.operators.tools import ToolBox
from textquarry.schemas import FILE, TOOL_CALL

CALLS = "call_id string, seq long, tool string, path string, content string, old_str string, new_str string"
PLACE = {"read_file": 0, "create_file": 1, "edit_file": 2}


def model(files, calls):
    """Answers and files after the calls, one by one."""
    files = dict(files)
    answers = {}

    def parents(key):
        while "/" in key:
            key = key.rsplit("/", 1)[0]
            yield key

    def is_dir(key):
        return key == "." or any(key in parents(f) for f in files)

    for call_id, _, tool, path, content, old, new in sorted(calls, key=lambda c: (c[1], PLACE[c[2]], c[0])):
        key = posixpath.normpath(path).lstrip("/") or "."
        error = message = None
        if path == "" or tool == "edit_file" and old == "":
            error = "path and old_str are required for edit_file" if tool == "edit_file" else f"path is required for {tool}"
        elif posixpath.normpath(path).startswith(".."):
            error = f"invalid path: '{path}' attempts to traverse outside the workspace"
        elif tool == "create_file":
            if key in files or is_dir(key):
                error = f"file already exists at path '{path}'"
            elif any(p in files for p in parents(key)):
                error = f"failed to create parent directory for '{path}'"
            else:
                files[key] = (content or "").encode()
                message = f"Successfully created file '{path}'"
        elif key not in files:
            kind = "a directory, not a file" if tool == "read_file" else "a directory, cannot edit"
            error = f"path '{path}' is {kind}" if is_dir(key) else f"file not found at path '{path}' within workspace"
        elif tool == "read_file":
            message = files[key].decode("utf-8", "replace")
        else:
            n = files[key].count(old.encode())
            if n == 1:
                files[key] = files[key].replace(old.encode(), new.encode(), 1)
                message = f"Successfully edited file '{path}'"
            else:
                error = (f"string '{old}' not found in file '{path}'" if n == 0
                         else f"string '{old}' found multiple times ({n}) in file '{path}', expected exactly one")
        answers[call_id] = (tool, message, error)
    return answers, files


def random_calls(seed, groups, each):
    rng = random.Random(seed)
    files, calls = {}, []
    for g in range(groups):
        names = [f"g{g}/{x}" for x in ("a", "a/b", "a/b/c", "d", "a/e", "a.b")]
        for x in rng.sample(names[3:], rng.randrange(3)):
            if not any(f.startswith(x + "/") or x.startswith(f + "/") for f in files):
                files[x] = "".join(rng.choice("xyzé") for _ in range(rng.randrange(6))).encode()
        for i in range(each):
            tool = rng.choice(["read_file", "create_file", "edit_file", "edit_file"])
            path = rng.choice([*names, *names, "", f"g{g}", f"./g{g}//d", f"/g{g}/a/../a/b", "../x", "."])
            text = lambda n: "".join(rng.choice("xyzé") for _ in range(rng.randrange(n)))
            calls.append((f"{rng.randrange(10 ** 9)}:{g}:{i}", rng.randrange(each), tool, path,
                          rng.choice([text(6), None]) if tool == "create_file" else None,
                          text(3) if tool == "edit_file" else None, text(3) if tool == "edit_file" else None))
    return files, calls


def run(spark, files, calls, **limits):
    table = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in files.items()], FILE)
    done = file_calls.run(spark.createDataFrame(calls, CALLS), table, **limits)
    answers = {r["call_id"]: (r["tool"], r["content"], r["error"]) for r in done.answers.collect()}
    after = {r["path"]: bytes(r["content"]) for r in file_calls.apply(table, done.contents).collect()}
    assert done.answers.count() == len(calls)
    return answers, after


def test_against_a_file_system(spark):
    files, calls = random_calls(4, 120, 14)
    want = model(files, calls)
    assert run(spark, files, calls) == want
    assert run(spark, files, calls, fold_calls=0) == want
    assert run(spark, files, calls, fold_calls=5, fold_bytes=20) == want


def test_bytes_and_no_calls(spark):
    files = {"r.txt": b"a.b axb", "u.txt": b"\xc3\xa9\xff-x", "e": b""}
    edits = [("1", 0, "edit_file", "r.txt", None, "a.b", "\\1$"), ("2", 1, "edit_file", "u.txt", None, "x", ""), ("3", 2, "read_file", "u.txt", None, None, None),
             ("4", 3, "edit_file", "e", None, "x", "y")]
    for calls in (0, 100):
        answers, after = run(spark, files, edits, fold_calls=calls)
        assert after == {"r.txt": b"\\1$ axb", "u.txt": b"\xc3\xa9\xff-", "e": b""}
        assert answers["3"] == ("read_file", "é�-", None) and answers["4"][2] == "string 'x' not found in file 'e'"
    assert run(spark, files, edits[:0]) == ({}, files)


def test_tool_calls_see_each_other(spark):
    box = ToolBox(spark.createDataFrame([("old", 3, bytearray(b"old"))], FILE), names={"read_file": "cat"})
    rows = [("c", 0, "create_file", '{"path": "n", "content": "one"}'), ("e", 1, "edit_file", '{"path": "n", "old_str": "one", "new_str": "two"}'),
            ("r", 2, "cat", '{"path": "n"}'), ("s", 1, "cat", '{"path": "n"}'), ("o", 0, "cat", '{"path": "old"}'), ("b", 3, "cat", "5")]
    calls = spark.createDataFrame(rows, TOOL_CALL)
    got = {r.call_id: (r.content, r.is_error) for r in box.execute(calls).collect()}
    assert got == {"c": ("Successfully created file 'n'", False), "e": ("Successfully edited file 'n'", False), "r": ("two", False), "s": ("one", False),
                   "o": ("old", False), "b": ("Error executing tool 'cat': invalid input format for cat", True)}
    files, stored = box.effects(calls)
    assert stored is None and {r.path: bytes(r.content) for r in files.collect()} == {"old": b"old", "n": b"two"}
