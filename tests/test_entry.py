"""The registry: every SQL has its query, and the flagship runs."""

import importlib
import sys


def test_names_match():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()


def test_core_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tarnstone.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tarnstone.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "bm25_topk" in entry.queries() and "p1_found" not in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")
