"""The entry module works with and without the optional subpackage."""

import importlib
import sys


def test_queries_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("tidemark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tidemark.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(entry)
    assert "crps_price_vs_baseline" in bare.queries() and not any(n.startswith("op") for n in bare.queries())
    assert set(bare.oracle_sql()) <= set(bare.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
