import importlib
import sys

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_training_data_operators(monkeypatch):
    """The module must import and list the other queries when the subpackage is gone."""
    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("orrery.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "orrery.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(entry)
    assert "ob3_three_axis_search" in bare.queries()
    assert not any(q.startswith("op") for q in bare.queries() if q[2:3].isdigit())
    monkeypatch.undo()
    importlib.reload(entry)
