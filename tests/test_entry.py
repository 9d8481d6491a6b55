"""The entry module works without the optional training-data subpackage."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

BLOCK = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("ledgerlens.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from ledgerlens.plans.catalog import REGISTRY
assert set(e.queries()) == set(REGISTRY), set(e.queries()) ^ set(REGISTRY)
assert set(e.oracle_sql()) == {n for n, q in REGISTRY.items() if q.sql}
"""


@pytest.mark.parametrize("block", [BLOCK, BLOCK.replace('name == "corpus_pipeline" or name.startswith("ledgerlens.llm")', 'name == "ahocorasick"')])
def test_entry_without_the_subpackage(block):
    done = subprocess.run([sys.executable, "-c", block], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_no_other_module_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "ledgerlens")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "llm" not in f.read(), name
