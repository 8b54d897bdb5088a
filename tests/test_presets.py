"""Roles, field mapping, preset ranking, cards and forecasts on frames made for them."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import analytics, forecast, insights, kpi, periods, semantics, stats, verbs
from ledgerline.plans import catalog, packs, registry

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2024, 1, 1)


def retail(spark, n=400, days=180, seed=1):
    rng = random.Random(seed)
    rows = [(f"O{i}", DAY + datetime.timedelta(days=rng.randrange(days)), rng.choice(["tea", "rice", "oil", "salt", "milk", "soap"]), rng.choice(["food", "home", "care"]), rng.choice(["North", "South", "East"]), rng.randrange(1, 9), round(rng.lognormvariate(6, 0.5), 2), float(rng.choice([0, 5, 10]))) for i in range(n)]
    return spark.createDataFrame(rows, "`Order ID` string, `Order Date` date, `Product Name` string, Category string, Store string, Qty long, `Net Amount` double, Discount double")


def hr(spark):
    rng = random.Random(2)
    rows = [(f"E{i}", rng.choice(["Ops", "HR", "IT", "Legal", "Sales"]), rng.choice(["Clerk", "Lead", "Head"]), rng.choice(["Male", "Female"]), float(rng.randrange(300, 2000) * 1000), DAY, DAY if i % 5 == 0 else None) for i in range(200)]
    return spark.createDataFrame(rows, "`Employee Code` string, Department string, Designation string, Gender string, CTC double, `Date of Joining` date, `Exit Date` date")


def crm(spark):
    rng = random.Random(3)
    stages = ["Won", "Lost", "Proposal", "Negotiation", "Qualified", "Open"]
    rows = [(float(rng.randrange(1000, 90000)), rng.choice(stages), DAY + datetime.timedelta(days=i), DAY + datetime.timedelta(days=i + rng.randrange(10, 120)), rng.choice("ABCD"), f"C{rng.randrange(30)}", rng.choice(["web", "event"])) for i in range(150)]
    return spark.createDataFrame(rows, "`Deal Value` double, `Deal Stage` string, `Created Date` date, `Close Date` date, Owner string, Company string, `Lead Source` string")


def logistics(spark):
    rng = random.Random(4)
    rows = [(f"AWB{i}", DAY + datetime.timedelta(days=i % 90), DAY + datetime.timedelta(days=i % 90 + rng.randrange(1, 9)), rng.choice(["Delivered", "RTO", "In Transit"]), rng.choice(["X", "Y"]), float(rng.randrange(40, 400)), rng.choice(["Pune", "Delhi", "Agra"])) for i in range(300)]
    return spark.createDataFrame(rows, "`AWB Number` string, `Dispatch Date` date, `Delivery Date` date, `Delivery Status` string, `Courier Partner` string, `Freight Amount` double, Destination string")


def test_catalogue_holds_together():
    assert len(catalog.PRESETS) == 15 and set(packs.BINDINGS) == set(catalog.PRESETS)
    for p in catalog.PRESETS.values():
        fields, keys = {f.name for f in p.fields}, {k.key for k in p.kpis}
        assert p.metric in fields and set(p.slicers) <= fields and set(p.tiles) <= keys and len(p.tiles) in (3, 4)
        for k in p.kpis:
            named = {v for n, v in k.params.items() if n in ("field", "by", "start", "end", "num_field", "den_field", "value_field", "cond_field", "where_field")}
            assert named <= fields and {k.params[n] for n in ("num", "den", "kpi") if n in k.params} <= keys
        assert all({c.x, c.y or c.x, c.color or c.x} <= fields for c in p.charts)
        assert set(packs.mapping(p)) <= fields


@pytest.mark.parametrize(("make", "key", "bound"), [(retail, "retail", {"revenue": "Net Amount", "quantity": "Qty", "product": "Product Name"}), (hr, "hr", {"salary": "CTC", "exit_date": "Exit Date"}), (crm, "sales_crm", {"stage": "Deal Stage", "account": "Company"}), (logistics, "logistics", {"shipment_id": "AWB Number", "cost": "Freight Amount"})])
def test_detection(spark, make, key, bound):
    columns = semantics.profile(make(spark))
    best = semantics.detect(columns)
    assert best.preset.key == key and bound.items() <= best.mapping.items() and best.confidence >= 60
    assert len(set(best.mapping.values())) == len(best.mapping)


def test_roles(spark):
    rows = [(i, f"u{i}", i % 2 == 0, i % 3, i * 1.5, "x" * 70 + str(i % 9), f"2024-01-{i % 28 + 1:02d}", 2000 + i % 30, "ab"[i % 2], None) for i in range(100)]
    df = spark.createDataFrame(rows, "row_key long, user string, flag boolean, kind long, amount double, body string, `when day` string, year long, side string, none string")
    roles = {c.name: c.role for c in semantics.profile(df)}
    assert roles == {"row_key": "identifier", "user": "identifier", "flag": "binary", "kind": "categorical", "amount": "continuous", "body": "text", "when day": "temporal", "year": "temporal", "side": "binary", "none": "categorical"}
    assert semantics.profile(df.limit(0))[0].rows == 0 and semantics.profile(df.select()) == []
    assert semantics.domain(semantics.profile(retail(spark))) == "sales" and semantics.domain([]) == "general"


def test_override_takes_a_column_away(spark):
    df = retail(spark)
    bound = semantics.bind(df, override={"cost": "Net Amount", "store": ""})
    assert bound.mapping["cost"] == "Net Amount" and "revenue" not in bound.mapping and "store" not in bound.mapping
    assert semantics.bind(spark.createDataFrame([(1.0,)] * 9, "zz double")) is None


def test_kpis_of_a_detected_preset(spark):
    df = hr(spark)
    bound = semantics.bind(df)
    got = {r.key: r.value for r in kpi.pack(df, bound.preset.kpis, bound.mapping, semantics.when(bound.preset, bound.mapping), F.lit("2025-01-01").cast("timestamp")).collect()}
    assert got["headcount"] == 200 and got["exit_share"] == 20 and got["avg_tenure"] == pytest.approx((0.8 * 366) / 365.25)


def test_cards(spark):
    df = retail(spark, 640)
    spikes = [(f"S{i}", DAY + datetime.timedelta(days=60 + 70 * (i % 2)), "tea", "food", "North", 1, 60_000.0, 0.0) for i in range(40)]
    df = df.unionByName(spark.createDataFrame(spikes, df.schema))
    bound = semantics.bind(df)
    kpis = kpi.pack(df, bound.preset.kpis, bound.mapping, "Order Date").collect()
    issue = type("I", (), {"check": "missing", "column": "Qty", "affected": 9, "severity": "high"})
    cards = insights.cards(df, bound.preset, bound.mapping, kpis, [issue], most=99)
    kinds = [c.kind for c in cards]
    assert kinds.count("anomaly") >= 2 and "dq_warning" in kinds and "leader" in kinds
    assert insights.cards(df, bound.preset, bound.mapping, kpis, [issue]) == cards[:7]
    assert [c.materiality for c in cards] == sorted((c.materiality for c in cards), reverse=True)
    assert any("'tea' (Product Name)" in c.headline or "North" in c.headline or "food" in c.headline for c in cards if c.kind == "anomaly")
    assert insights.cards(df.limit(0), bound.preset, bound.mapping, []) == []


def test_trend_card_needs_a_trend():
    assert insights.trend_card(np.array([1.0, 2, 3, 4]), "M", "x") is None
    assert insights.trend_card(np.arange(10, 30.0), "M", "x").severity == "good"
    weekly = 100 + 40 * np.sin(np.arange(40) * 2 * np.pi / 7)
    assert insights.trend_card(weekly, "D", "x") is None and np.abs(forecast.deseasonalised(weekly, "D") - 100).max() < 1


def test_forecast_choice(spark):
    rng = np.random.default_rng(5)
    daily = 50 + 20 * np.sin(np.arange(120) * 2 * np.pi / 7) + rng.normal(0, 1, 120)
    days = [DAY + datetime.timedelta(days=i) for i in range(140)]
    made = forecast.choose(daily, days[:120], 14)
    truth = 50 + 20 * np.sin(np.arange(120, 134) * 2 * np.pi / 7)
    assert made.model == "holt-winters(7)" and np.abs(made.mean - truth).mean() < 3
    weeks = [DAY + datetime.timedelta(days=7 * i) for i in range(60)]
    line = np.linspace(100, 200, 25)
    assert forecast.choose(line, weeks[:25], 3).model == "linear" and forecast.choose(line, weeks[:25], 3).mean == pytest.approx(200 + np.arange(1, 4) * 100 / 24)
    walk = np.cumsum(rng.normal(0.5, 1, 60)) + 100
    assert forecast.choose(walk, weeks, 5).model == "arima(1,1,1)" and np.all(np.diff(forecast.choose(walk, weeks, 5).width) > 0)
    assert forecast.choose(line[:9], weeks[:9], 3) is None and forecast.backtest(line, weeks[:25]) == pytest.approx(0, abs=1e-6)
    rows = [("a", d, float(v)) for d, v in zip(days, daily)] + [("b", d, 1.0) for d in days[:4]] + [(None, d, float(v)) for d, v in zip(weeks, line)] + [("a", None, 1.0)]
    got = forecast.forecasts(spark.createDataFrame(rows, "k string, period date, value double"), 5, ["k"]).collect()
    assert {(r.k, r.model) for r in got} == {("a", "holt-winters(7)"), ("b", None), (None, "linear")} and len(got) == 11
    assert forecast.forecasts(spark.createDataFrame([], "period date, value double"), 5).count() == 0


def test_tests_with_p_values(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(x), "ab"[i % 2], "xyz"[i % 3], float(i)) for i, x in enumerate(rng.normal(0.2, 1, 120))], "x double, g string, h string, i double")
    assert stats.chi2_p_value(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9) and stats.chi2_p_value(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    for test, how in (("t1", {"x": "x", "mu": 0.0}), ("t2", {"x": "x", "group": "g", "a": "a", "b": "b"}), ("chi2", {"x": "g", "y": "h"}), ("anova", {"x": "x", "group": "h"}), ("slope", {"y": "x", "x": "i"}), ("corr", {"a": "x", "b": "i"})):
        assert 0 < stats.tested(df, test, **how).first().p <= 1, test
    table = spark.createDataFrame([("a", "x")] * 12 + [("a", "y")] * 5 + [("b", "x")] * 7 + [("b", "y")] * 9, "p string, q string")
    assert stats.chi_square(table, "p", "q").first().chi2 == pytest.approx(33 * (abs(12 * 9 - 5 * 7) - 16.5) ** 2 / (17 * 16 * 19 * 14), abs=1e-5)


def test_small_amounts_are_summed(spark):
    df = spark.createDataFrame([(0.004, "a")] * 1000 + [(None, "a")], "x double, k string")
    r = verbs.group(df, ["k"], "x", ["sum", "mean", "std", "var", "median", "nunique"]).first()
    assert (r["sum"], r["mean"], r["median"], r["nunique"]) == (4.0, 0.004, 0.004, 1)
    small = verbs.group(df.withColumn("x", F.col("x") * (1 + F.monotonically_increasing_id() % 2)), ["k"], "x", ["var"]).first()
    assert small["var"] == pytest.approx(4e-6, rel=0.01)


def test_not_equal_keeps_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert [r.v for r in verbs.where(df, "v", "!=", "1").collect()] == [2, None]


@pytest.mark.parametrize("column", ["o_totalprice", "same", "none"])
def test_quantiles_and_ranks(spark, column):
    o = registry.read(spark, SF, "orders").withColumns({"same": F.lit(5.0), "none": F.lit(None).cast("double")})
    want = o.agg(*(F.percentile(column, F.lit(q)).alias(n) for n, q in (("a", 0.0), ("b", 0.37), ("c", 0.5), ("d", 1.0)))).first()
    assert tuple(kpi.quantiles(o, column, {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}).first()) == pytest.approx(tuple(want), nan_ok=True) if want.a is not None else kpi.quantiles(o, column, {"a": 0.0}).first().a is None


def test_months_become_rows(spark):
    wide = spark.createDataFrame([("a", "1", "2", "3", "4", "x", None), ("b", "1,000", "2", "3", "4", "5", "6")], "shop string, Jan string, Feb string, Mar string, Apr string, May string, Jun string")
    got = verbs.unpivot_wide(wide)
    assert got.columns == ["shop", "period", "value"] and got.count() == 12 and got.where("shop = 'b' and month(period) = 1").first().value == 1000
    assert verbs.unpivot_wide(wide.drop("May", "Jun")).columns == ["shop", "Jan", "Feb", "Mar", "Apr"]


def test_top_and_others_add_up(spark):
    df = spark.createDataFrame([(k, float(v)) for k, v in (("a", 5), ("b", 4), ("c", 3), (None, 2))], "k string, v double")
    assert {(r.segment, r.total) for r in verbs.others(df, "k", "v", 2).collect()} == {("a", 5.0), ("b", 4.0), ("Others", 5.0)}
    assert verbs.others(df, "k", "v", 9).count() == 4
    assert verbs.summary_diff(df, df.dropna()).where("item = 'missing'").first().removed == 1
    assert verbs.seeded_sample(df, 2).collect() == verbs.seeded_sample(df.repartition(3), 2).collect()
    assert analytics.trend_bands(spark.createDataFrame([(DAY, 1.0)], "period date, value double")).count() == 0


def test_period_arithmetic():
    for g in "DWMQ":
        for d in (datetime.date(2024, 12, 31), datetime.date(2024, 2, 29), datetime.date(2023, 1, 1)):
            first = periods.start(d, g)
            assert first <= d < periods.after(first, g) and periods.start(periods.after(first, g), g) == periods.after(first, g)
