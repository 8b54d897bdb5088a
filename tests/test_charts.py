"""Chart marks, the chart recommender, Kendall's tau against every pair, the outlook and odd delimited files."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import charts, forecast, kpi, periods, semantics, stats
from ledgerline.plans import registry
from ledgerline.sources import delimited

SF = "/root/testdata/sf0.001"


def by_pairs(rows):
    rows = [r for r in rows if None not in r]
    s = tx = ty = n = 0
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        s += ((a > c) - (a < c)) * ((b > d) - (b < d))
        tx, ty, n = tx + (a == c), ty + (b == d), n + 1
    return s / math.sqrt((n - tx) * (n - ty))


@pytest.mark.parametrize("block", [1, 5, 40, 1_000_000])
def test_kendall_against_all_pairs(spark, block):
    at = random.Random(7)
    rows = [(at.choice([1.0, 1.0, 1.0, *map(float, range(30))]), float(at.randrange(25))) for _ in range(180)] + [(None, 1.0), (2.0, None)]
    rows += rows[:20] + [(float(i), -float(i)) for i in range(20)]
    got = stats.kendall(spark.createDataFrame(rows, "a double, b double"), "a", "b", block=block).first()
    assert got.n == sum(None not in r for r in rows) and got.tau == pytest.approx(by_pairs(rows), abs=1e-6)


def test_kendall_of_little(spark):
    none = spark.createDataFrame([], "a double, b double")
    assert stats.kendall(none, "a", "b").collect() == [(0, None)]
    assert stats.kendall(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").collect() == [(2, None)]


def test_recommended(spark):
    df = registry.read(spark, SF, "orders").select("o_orderdate", "o_totalprice", "o_custkey", "o_orderpriority")
    got = charts.recommend(semantics.profile(df))
    assert [c.kind for c in got] == ["line", "scatter", "box", "histogram", "pie"] and got[0].x == "o_orderdate"
    assert all(charts.marks(df, c).count() > 0 for c in got)
    assert charts.recommend([]) == [] and len(charts.recommend(semantics.profile(df), 2)) == 2


def test_marks_of_other_kinds(spark):
    df = registry.read(spark, SF, "orders")
    assert charts.marks(df, charts.Chart("funnel", "", "o_orderstatus")).agg(F.sum("total")).first()[0] == df.count()
    assert charts.marks(df, charts.Chart("treemap", "", "o_orderstatus", "o_totalprice", "o_orderpriority")).where("depth = 0").count() == 1
    events = registry.read(spark, SF, "events")
    assert charts.heat(events, "ts").agg(F.sum("n")).first()[0] == events.where("ts is not null").count()
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-08",), (None,)], "d string").select(F.col("d").cast("timestamp").alias("d"))
    assert charts.heat(days, "d").collect() == [(0, None, 2)]
    with pytest.raises(ValueError):
        charts.marks(df, charts.Chart("rose", "", "o_orderstatus"))


def test_charts_of_empty_tables(spark):
    o = registry.read(spark, SF, "orders").limit(0)
    assert charts.box(o, "o_orderpriority", "o_totalprice").count() == 0
    assert charts.line(o, "o_orderdate", "o_totalprice").count() == 0
    assert charts.stacked(o, "o_orderdate", "o_totalprice", "o_orderpriority").count() == 0


def test_waterfall_meets_the_total(spark):
    o = registry.read(spark, SF, "orders")
    w = periods.bounds(o, "o_orderdate")
    bars = {r.step: r for r in charts.waterfall(o, "o_orderdate", "o_totalprice", "o_orderpriority", w, 2).collect()}
    assert bars[3].label == "Others" and bars[3].stop == pytest.approx(bars[4].stop, abs=0.05) and bars[0].start == 0


def test_outlook(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-06-30', interval 1 day)) as d").select(F.col("d").cast("timestamp").alias("d"), F.lit(2.0).alias("x"))
    got, grain = forecast.outlook(days, "d", "x")
    assert grain == "W" and got.count() == 8 and {round(r.mean) for r in got.collect()} == {14}
    months = days.unionByName(days.withColumn("d", F.col("d") + F.expr("interval 80 days")))
    assert forecast.outlook(months, "d", "x")[1] == "W"
    got, why = forecast.outlook(days.limit(6), "d", "x")
    assert got is None and "6 full periods" in why


def test_selection(spark):
    assert kpi.target(["qty", "net_price", "revenue"], "sales") == "revenue" and kpi.target(["a"], "hr") == "a" and kpi.target([], "hr") is None
    df = spark.createDataFrame([(1.0,), (3.0,), (3.0,), (-2.0,), (None,)], "x double")
    got = {r.key: r.value for r in kpi.selection(df, "x", "hr").where("domain = 'hr'").collect()}
    assert got["headcount"] == 3 and got["avg_salary"] == 1.25 and "gini" in got
    got = {r.key: r.value for r in kpi.selection(df, "x", "finance").where("domain = 'finance'").collect()}
    assert got == {"net_total": 5, "inflows": 7, "outflows": -2, "in_out_ratio": 3.5}


def test_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('item,note,price\ntea,"two\nlines, and ""more""",5\noil,plain,6\nsalt,"x\ny",7\n')
    rows = {r.item: r for r in delimited.load(spark, str(path)).df.collect()}
    assert rows["tea"].note == 'two\nlines, and "more"' and rows["salt"].price == 7 and len(rows) == 3


def test_months_as_columns(spark, tmp_path):
    path = tmp_path / "in.csv"
    months = [f"2024-{m:02}" for m in range(1, 7)]
    path.write_text("shop," + ",".join(months) + "\n" + "".join(f"s{i}," + ",".join(str(i * 10 + k) for k in range(6)) + "\n" for i in range(4)))
    got = delimited.load(spark, str(path))
    assert got.df.columns == ["shop", "period", "value"] and got.df.count() == 24 and "months as columns" in got.receipt[-1]


def test_saved_text_is_read_again(spark, tmp_path):
    rows = [("tea, green", 'say "hi"', 1.5, [1, 2]), ("oil\nraw", None, 2.5, None), (" salt ", "x", 3.5, []), ("rice", "y", None, [3])]
    path = str(tmp_path / "out")
    delimited.save(spark.createDataFrame(rows, "item string, note string, price double, tags array<int>").repartition(2), path)
    got = {r.item: r for r in delimited.load(spark, path).df.collect()}
    assert set(got) == {"tea, green", "oil\nraw", "salt", "rice"} and got["tea, green"].note == 'say "hi"' and got["oil\nraw"].price == 2.5
    assert got["tea, green"].tags == "[1,2]" and got["rice"].price is None
