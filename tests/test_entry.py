"""The entry module works with and without the folder of training-data operators."""

import subprocess
import sys

from conftest import ROOT

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("drillsight.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
names = entry.queries()
assert "department_risk" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
assert set(entry.oracle_sql()) == set(names)
"""


def test_without_the_folder():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True)


def test_nothing_else_imports_the_folder():
    for path in (ROOT / "drillsight").rglob("*.py"):
        if "llm" not in path.parts:
            assert "drillsight.llm" not in path.read_text(), path
