"""Registered queries against their DuckDB twins, invariants of the analyses, and the SQL guard."""

import math
import os

import duckdb
import pytest

from ledgerline.operators import analytics, kpi, periods, stats, verbs
from ledgerline.plans import registry, sqlbox

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{SF}/{t}')")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return round(float(x), 3)
    return str(x).replace(" 00:00:00", "")


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_twin(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracles()[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(([plain(v) for v in r] for r in got.select(*columns).collect()), key=str)
    b = sorted(([plain(v) for v in r] for r in want[columns].astype(object).itertuples(index=False)), key=str)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-6)) for p, q in zip(x, y)), (x, y)


def test_bridge_and_effects_add_up(spark):
    o = registry.read(spark, SF, "orders")
    w = periods.bounds(o, "o_orderdate")
    rows = analytics.bridge(o, "o_orderdate", "o_totalprice", "o_orderpriority", w, 2).collect()
    v = analytics.volume_rate(o, "o_orderdate", "o_totalprice", None, w).first()
    assert sum(r.delta for r in rows) == pytest.approx(v.m1 - v.m0, abs=0.05)
    assert v.volume_effect + v.rate_effect == pytest.approx(v.m1 - v.m0)
    assert all(r.retention_pct == 100 for r in analytics.cohorts(o, "o_orderdate", "o_custkey").collect() if r.offset == 0)


def test_empty_table_gives_no_kpi(spark):
    o = registry.read(spark, SF, "orders").limit(0)
    assert kpi.pack(o, [kpi.KPI("total", "sum", params={"field": "x"})], {"x": "o_totalprice"}, "o_orderdate").count() == 0
    assert verbs.histogram(o, "o_totalprice").count() == 0


def test_resample_takes_all_orders(spark, duck):
    got = registry.queries()["resample_orders"](spark, SF).agg({"count": "sum", "sum": "sum"}).first()
    n, total = duck.execute("SELECT count(o_totalprice), sum(o_totalprice) FROM orders WHERE o_orderdate IS NOT NULL").fetchone()
    assert n > 1000 and got["sum(count)"] == n and got["sum(sum)"] == pytest.approx(total)


def test_profile_has_every_column(spark):
    rows = registry.queries()["profile_table"](spark, SF).collect()
    assert sorted(r.col for r in rows) == sorted(registry.read(spark, SF, "orders").columns)


def test_resample_fills_gaps(spark):
    df = spark.createDataFrame([("2024-01-05", 2.0), ("2024-01-31", 4.0), ("2024-02-01", None), ("2024-05-09", 7.0), (None, 9.0)], "d string, x double")
    got = [(str(r.bucket), r["sum"], r["count"], r["mean"], r["max"], r["min"]) for r in verbs.resample(df.withColumn("d", df.d.cast("timestamp")), "d", "x").orderBy("bucket").collect()]
    empty = (0.0, 0, None, None, None)
    assert got == [("2024-01-01", 6.0, 2, 3.0, 4.0, 2.0), ("2024-02-01", *empty), ("2024-03-01", *empty), ("2024-04-01", *empty), ("2024-05-01", 7.0, 1, 7.0, 7.0, 7.0)]


def test_filters_keep_null_policy(spark):
    df = spark.createDataFrame([("Abc",), (None,), ("x",)], "s string")
    assert verbs.where(df, "s", "contains", "B").count() == 1 and verbs.where(df, "s", "not contains", "B").count() == 2


def test_tails():
    assert stats.t_p_value(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert stats.f_p_value(4.0, 2, 20) == pytest.approx(0.0345721, abs=1e-5)


@pytest.mark.parametrize("text", ["DROP TABLE data", "SELECT 1; SELECT 2", "INSERT INTO data SELECT * FROM data", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM parquet.`/etc`", "SET a=b", ""])
def test_guard_refuses(spark, text):
    with pytest.raises(sqlbox.Refused):
        sqlbox.check(spark, text)


def test_guard_accepts(spark):
    df = spark.createDataFrame([(1, 2.0)], "load int, v double")
    assert sqlbox.ask(df, "WITH a AS (SELECT load, v FROM data) SELECT load, sum(v) AS s FROM a GROUP BY load;").first().s == 2.0
