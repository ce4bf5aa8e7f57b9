import importlib
import subprocess
import sys
from pathlib import Path

import pytest


@pytest.fixture
def without_llm(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("veridelta.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "veridelta.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    yield importlib.import_module("__spark_entry__")
    sys.modules.pop("__spark_entry__", None)


def test_imports_without_llm(without_llm):
    names = without_llm.queries()
    assert "did_hc1" in names and not [n for n in names if n.startswith("op") or n == "pipeline"]
    assert set(without_llm.oracle_sql()) <= set(names)


def test_queries_can_be_listed_without_a_session():
    root = Path(__file__).resolve().parents[1]
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, sql = map(int, said.stdout.split())
    assert n >= sql > 50
