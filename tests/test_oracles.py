"""Every registered query on the smallest driver tables: against its oracle, and without pairing joins or row UDFs."""

import pytest

from conftest import SF_DIR
from ledgerlark.plans import load
from ledgerlark.sources.adapters import BASE_TABLES
from tools.compare import oracle_connection, sorted_rows

REGISTRY = load()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR, BASE_TABLES)


@pytest.mark.parametrize("name", list(REGISTRY.QUERIES))
def test_query(spark, con, name):
    df = REGISTRY.QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan
    assert "ArrowEvalPython" not in plan or name.startswith("search_")
    if name not in REGISTRY.ORACLES:
        assert rows
        return
    want = con.sql(REGISTRY.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted_rows(df.columns, rows) == sorted_rows(want.columns, want.fetchall())


def test_names_are_plain():
    assert not [n for n in REGISTRY.QUERIES if n.startswith("op") or "pipeline" in n]
