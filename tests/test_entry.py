"""The driver contract, with and without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as driver

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_oracles(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_without_llm():
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("codestrata.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert e.queries() and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
assert set(e.oracle_sql()) == set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_llm():
    for path in (ROOT / "codestrata").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
