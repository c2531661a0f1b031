"""The entry points without the training-data part."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("blocked", ["xxhash", "tiktoken_none", "textquarry.llm", "corpus_pipeline"])
def test_a_missing_package_leaves_the_other_queries(blocked, tmp_path):
    code = (f"import sys; sys.modules[{blocked!r}] = None; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; "
            "print(len(e.queries()), 'rag_prompt' in e.queries(), any(q.startswith('op') for q in e.queries()), set(e.oracle_sql()) <= set(e.queries()))")
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-500:]
    n, has_others, has_ops, fits = said.stdout.split()
    whole = os.path.isdir(os.path.join(ROOT, "textquarry", "llm"))
    assert int(n) > 40 and has_others == "True" and fits == "True" and has_ops == str(whole and blocked == "tiktoken_none")
