"""The entry module works with the training-data package and without it."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
BLOCK = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("lexmill.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
"""


def names(before: str) -> set[str]:
    code = before + "\nimport __spark_entry__ as e\nq, o = e.queries(), e.oracle_sql()\nassert set(o) <= set(q)\nprint(*q)"
    return set(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split())


def test_without_the_training_data_package():
    without = names(BLOCK)
    assert "hybrid_search" in without and not any(n.startswith("op") and n[2].isdigit() for n in without)
    assert without <= names("")


def test_nothing_else_imports_it():
    for p in (ROOT / "lexmill").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "lexmill.llm" not in p.read_text()
