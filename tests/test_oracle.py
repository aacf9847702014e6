"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from conftest import SF, TABLES
from quirelens.queries import ORACLES, QUERIES


# No pairing of all rows with all rows, and no Python in any plan.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "MapInArrow")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(table):
    names = sorted(table.column_names)

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    cols = [[value(v) for v in table.column(n).to_pylist()] for n in names]
    return names, sorted(zip(*cols), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.toArrow()
    assert name in ORACLES
    want = con.sql(ORACLES[name]).to_arrow_table()
    assert plain(got) == plain(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in UNWANTED if w in plan]
    types = {f.name: str(f.type) for f in got.schema}
    assert types == {f.name: str(f.type) for f in want.schema}


def test_entry_runs(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
