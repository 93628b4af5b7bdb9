import importlib
import sys

import __spark_entry__ as entry_point
import pytest
from docloom.plans import queries
from oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, queries.QUERIES[name], queries.ORACLE[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry_without_optional_part(monkeypatch):
    """Without the optional subpackage the other queries are there."""

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name in ("docloom.llm", "corpus_pipeline"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [m for m in sys.modules if m.startswith("docloom.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    alone = importlib.import_module("__spark_entry__")
    assert set(alone.queries()) == set(queries.QUERIES)
