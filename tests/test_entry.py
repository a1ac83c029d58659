import importlib
import sys

import __spark_entry__


def test_queries_and_oracles_agree():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert __spark_entry__.FLAGSHIP in queries


def test_entry_imports_without_the_training_data_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "leafmill.llm", None)
    alone = importlib.reload(__spark_entry__)
    try:
        assert alone.queries() and not any(n.startswith("op") and n[2].isdigit() for n in alone.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
