"""Every registered query of this library against its SQL, on the smallest of the given tables."""

import math
import os

import duckdb
import pytest

from arborist.plans import registry
from arborist.plans.testgraph import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    rows = [[r[c] for c in sorted(found.columns)] for r in found.collect()]
    if name in registry.oracle_sql():
        want = duck.execute(registry.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(found.columns)
        order = sorted(range(len(names)), key=names.__getitem__)
        assert sorted([plain(x) for x in r] for r in rows) == sorted([plain(r[i]) for i in order] for r in want.fetchall())


def test_request_rules_count_whole_seconds(spark, tmp_path):
    """A window of 180 s that ends between two seconds: 0.6 s and 180.4 s are whole seconds 0 and 180, so the second request is in a new window."""
    name = "k1_request_rules"
    duckdb.sql(
        f"""COPY (SELECT CAST(i AS BIGINT) AS event_id, TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(ms) AS ts, CAST(1 AS BIGINT) AS user_id, 'click' AS event_type, 1.0 AS value, '' AS props
        FROM (VALUES (1, 600), (2, 180400), (3, 180700), (4, 359900), (5, 360100)) t(i, ms)) TO '{tmp_path}/events.parquet' (FORMAT parquet)"""
    )
    want = [(1, True), (2, True), (3, False), (4, False), (5, True)]
    assert sorted((r.event_id, r.allowed) for r in registry.queries()[name](spark, str(tmp_path)).collect()) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    found = con.execute(registry.oracle_sql()[name])
    at = [d[0] for d in found.description]
    assert sorted((r[at.index("event_id")], r[at.index("allowed")]) for r in found.fetchall()) == want


def test_an_order_that_calls_two_services_from_one_file(spark, tmp_path):
    """Both calls are found where one order gives two calls of a Kotlin file: their fields have names of their own."""
    for t in TABLES:
        duckdb.sql(f"COPY (SELECT * FROM '{SF}/{t}.parquet' LIMIT {0 if t == 'lineitem' else 1000000}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    # file 104 is Kotlin, in a graph of services; lines 1 of order 104 with a quantity of 25 call the files of their parts
    duckdb.sql(
        f"""COPY (SELECT CAST(104 AS BIGINT) AS l_orderkey, CAST(p AS BIGINT) AS l_partkey, CAST(0 AS BIGINT) AS l_suppkey, CAST(1 AS INT) AS l_linenumber, CAST(25 AS DOUBLE) AS l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
        FROM (SELECT * FROM '{SF}/lineitem.parquet' LIMIT 1), (VALUES (101), (102)) v(p)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)"""
    )
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    for name in ("x17_service_calls", "e18_service_call_edges"):
        found = registry.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        assert len(want) == 2 and sorted(tuple(r) for r in found.collect()) == sorted(want)
