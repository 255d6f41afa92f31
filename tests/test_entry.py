import importlib
import sys

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "p5_found" in entry.queries() and "rt_bm25_eval" in entry.queries()


def test_core_stands_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "leafmill.llm", None)
    for name in [m for m in sys.modules if m.startswith("leafmill.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    fresh = importlib.import_module("__spark_entry__")
    assert "rt_bm25" in fresh.queries() and "p2_found" not in fresh.queries()
    monkeypatch.undo()
    sys.modules["__spark_entry__"] = entry
