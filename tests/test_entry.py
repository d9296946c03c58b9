"""The driver's contract, and the engine without the corpus operators."""

import os
import re
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("quillstack.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
names = set(e.queries())
assert "type_stats" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert set(e.oracle_sql()) <= names
print(len(names))
"""


def test_queries_and_sql_have_the_same_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark, data):
    assert entry.entry(spark).count() > 0


def test_engine_works_without_the_corpus_operators():
    out = subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]


def test_no_module_imports_the_corpus_operators():
    for top, _, files in os.walk(os.path.join(ROOT, "quillstack")):
        for name in files:
            if name.endswith(".py") and "llm" not in top.split(os.sep):
                with open(os.path.join(top, name)) as f:
                    assert not re.search(r"^\s*(from|import)\s[^\n]*\bllm\b", f.read(), re.M), name
