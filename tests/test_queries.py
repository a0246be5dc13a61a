"""Every registered engine query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from wavemill.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in [*TABLES, "labels"]:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    one = lambda v: "\0" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(one(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    found = QUERIES[name](spark, SF)
    rows = found.collect()
    if name not in ORACLES:
        assert rows and found.columns
        return
    result = sql.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert plain(rows, found.columns) == plain(result.fetchall(), columns)


def test_resampling_agrees_in_both_forms(spark):
    a = {(r.vec_id, r.channel, r.sample): r.value for r in QUERIES["resample_relational"](spark, SF).collect()}
    b = {(r.vec_id, r.channel, r.sample): r.value for r in QUERIES["resample_udf"](spark, SF).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-3


def test_scans_are_pruned_and_pushed_down(spark):
    plan = QUERIES["manifest_view_filtered"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "l_returnflag" in plan and "l_shipdate" not in plan.split("ReadSchema")[1]


def test_no_query_plans_a_cross_product(spark):
    for name in ("event_windows", "sliding_windows_overlap", "backend_parity", "channel_correlation", "resample_relational"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
