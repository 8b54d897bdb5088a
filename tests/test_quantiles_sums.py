"""Exact quantiles by groups, sums of odd values, NaN as missing, and tables that are empty, constant or of one row."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import analytics, charts, kpi, periods, quantiles, stats, verbs

NAN, INF = float("nan"), float("inf")


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(x,) for x in values], f"x {kind}")


@pytest.mark.parametrize("accuracy", [quantiles.ACCURACY, 60])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "SLACKS", [3.0 / accuracy * 8**i for i in range(1, 3)] + [1.0])
    rng = random.Random(4)
    groups = {"hot": [rng.gauss(0, 1) for _ in range(9000)], "ties": [rng.choice([1.0, 2.0, 2.5]) for _ in range(700)], "one": [5.0], "two": [1.0, 4.0], "few": [3.0, -1.0, 8.0, 8.0], "none": [None, NAN]}
    rows = [(g, x, None if x is None or x != x else -2 * x) for g, v in groups.items() for x in v] + [(None, 1.0, 1.0)]
    rng.shuffle(rows)
    wanted = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "median": 0.5, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    got = {(r.g, r.name): r for r in quantiles.exact(df, ["g"], {"x": F.col("x"), "y": F.col("y")}, wanted).collect()}
    assert set(got) == {(g, n) for g in groups if g != "none" for n in "xy"}
    for g, v in groups.items():
        for name, sign in (("x", 1), ("y", -2)):
            if g != "none":
                assert got[g, name].n == len(v)
                for c, q in wanted.items():
                    assert got[g, name][c] == pytest.approx(np.quantile(np.array(v) * sign, q), rel=1e-12, abs=1e-12)
    alone = {r.name: r for r in quantiles.exact(df, [], {"x": F.col("x")}, wanted).collect()}
    every = [x for _, x, _ in rows if x is not None and x == x]
    assert alone["x"].median == pytest.approx(np.median(every)) and alone["x"].n == len(every)
    assert quantiles.exact(df.limit(0), [], {"x": F.col("x")}, wanted).count() == 0


def test_sums_keep_small_large_and_missing_values(spark):
    total = lambda values: frame(spark, values).repartition(4).agg(periods.money("x").alias("s"), periods.mean("x").alias("m")).first()
    for values in ([1e-7] * 1000, [1e25, 2e25, -1e25], [1e-300, 3e-300], [0.1] * 10, [1e15, 0.25, -1e15], [123456.78] * 999, [-1e-13, 1e-20]):
        assert total(values).s == pytest.approx(math.fsum(values), rel=1e-13)
        assert total(values).m == pytest.approx(math.fsum(values) / len(values), rel=1e-13)
    assert total([NAN, 2.0]).m == 2.0 and total([None, 4.0]).m == 4.0
    assert total([INF, 2.0]).s == INF and total([INF, 2.0]).m == INF and total([-INF, 1.0]).s == -INF
    assert total([None, NAN]).s is None and total([]).m is None


def test_order_of_rows_does_not_show(spark):
    rng = random.Random(9)
    values = [rng.choice([1, -1]) * rng.random() * 10 ** rng.randint(-9, 9) for _ in range(5000)]
    seen = set()
    for n in range(4):
        rng.shuffle(values)
        seen.add(frame(spark, values).repartition(n + 1).agg(periods.money("x")).first()[0])
    assert len(seen) == 1


def test_nan_is_missing(spark):
    u = kpi.universal(frame(spark, [NAN, 2.0, 4.0, None]), "x").first()
    assert (u.total, u.mean, u.median, u.p75, u["count"], u.null_rate, u.outliers, u.max) == (6.0, 3.0, 3.0, 3.5, 2, 50.0, 0, 4.0)
    odd = frame(spark, [float(i) for i in range(30)] + [NAN, INF, -INF])
    bins = {r.bin: r.n for r in verbs.histogram(odd, "x").collect()}
    assert sum(bins.values()) == 30 and set(bins) == set(range(10))
    assert kpi.pareto(odd.where("abs(x) < 1e9"), "x", 0.1).first()[0] == round(100 * (29 + 28 + 27) / 435, 1)
    df = spark.createDataFrame([("a", NAN), ("a", 1.0), ("a", 3.0), ("b", NAN)], "g string, x double")
    got = {r.g: tuple(r)[1:] for r in verbs.group(df, ["g"], "x", ["sum", "mean", "count", "max", "median", "nunique"]).collect()}
    assert got == {"a": (4.0, 2.0, 2, 3.0, 2.0, 2), "b": (None, None, 0, None, None, 0)}
    assert sorted(r.x for r in verbs.fill_missing(df, "x", "median").collect()) == [1.0, 2.0, 2.0, 3.0]
    assert sorted(r.x for r in verbs.fill_missing(df, "x", "mean").collect()) == [1.0, 2.0, 2.0, 3.0]
    assert verbs.without_outliers(frame(spark, [1.0] * 20 + [NAN, 900.0]), "x").count() == 21
    d = {r.col: r for r in verbs.describe(df).collect()}
    assert (d["x"]["count"], d["x"].n_unique, d["x"].p50, d["g"].top) == (2, 2, 2.0, "a")


def test_pack_counts_values_once(spark):
    rows = [(f"o{i % 7}" if i % 5 else None, f"c{i % 3}", float(i), f"2024-0{1 + i % 4}-0{1 + i % 9}") for i in range(200)]
    df = spark.createDataFrame(rows, "o string, c string, x double, d string").withColumn("d", F.col("d").cast("date"))
    K = kpi.KPI
    specs = [K("orders", "distinct", params={"field": "o"}), K("people", "distinct", params={"field": "c"}), K("top", "top_share", params={"by": "o", "field": "x", "n": 2}), K("top1", "top_share", params={"by": "c", "field": "x", "n": 1}), K("mid", "median", params={"field": "x"}), K("sum", "sum", params={"field": "x"})]
    got = {r.key: r for r in kpi.pack(df, specs, {c: c for c in "ocx"}, "d").collect()}
    by = lambda j, keep: sorted((sum(r[2] for r in rows if r[j] == v) for v in {r[j] for r in rows} - {None}), reverse=True)
    assert got["orders"].value == 7 and got["people"].value == 3
    assert got["top"].value == pytest.approx(100 * sum(by(0, 2)[:2]) / sum(by(0, 2))) and got["top1"].value == pytest.approx(100 * by(1, 1)[0] / sum(by(1, 1)))
    assert got["mid"].value == np.median([r[2] for r in rows]) and got["sum"].value == sum(r[2] for r in rows)
    assert got["top"].previous is None and got["orders"].previous == 7 and got["mid"].previous is not None


def test_tables_without_rows_or_spread(spark):
    empty, one, same = frame(spark, []), frame(spark, [3.0]), frame(spark, [2.0] * 40)
    for df in (empty, one, same):
        assert kpi.universal(df, "x").count() == 1 and kpi.gini(df, "x").count() == 1 and kpi.pareto(df, "x").count() == 1
        assert verbs.histogram(df, "x").count() == 0 and verbs.without_outliers(df, "x").count() == df.count()
        assert verbs.describe(df).count() == 1 and analytics.distribution(df, "x").count() == 1 and kpi.flows(df, "x").count() == 1
        two = df.withColumn("y", F.col("x")).withColumn("g", F.lit("g"))
        assert verbs.density(two, "x", "y").count() == (0 if df is empty else 1)
        assert charts.box(two, "g", "x").count() == (0 if df is empty else 1)
        for test, how in (("t1", {"x": "x", "mu": 2.0}), ("anova", {"x": "x", "group": "g"}), ("t2", {"x": "x", "group": "g", "a": "g", "b": "h"}), ("chi2", {"x": "x", "y": "g"}), ("corr", {"a": "x", "b": "y"}), ("slope", {"y": "y", "x": "x"})):
            assert stats.tested(two, test, **how).first().p in (None, 1.0), test
    assert stats.tested(same, "t1", x="x", mu=1.0).first().p == 0.0
    line = spark.createDataFrame([(float(i), -2.0 * i) for i in range(5)], "x double, y double")
    assert stats.tested(line, "corr", a="x", b="y").first().p == 0.0
    apart = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    assert stats.tested(apart, "anova", x="x", group="g").first().p == 0.0 and stats.tested(apart, "t2", x="x", group="g", a="a", b="b").first().p == 0.0


def test_periods_without_rows(spark):
    schema = "d date, x double, g string"
    for rows in ([], [("2024-01-05", 1.0, "a")] * 6):
        df = spark.createDataFrame([(r[0], *r[1:]) for r in rows], schema.replace("date", "string")).withColumn("d", F.col("d").cast("date"))
        w = periods.bounds(df, "d")
        analytics.bridge(df, "d", "x", "g", w).collect()
        assert analytics.volume_rate(df, "d", "x", None, w).first().r0 is None
        assert analytics.volume_rate(df, "d", "x", "g", w).count() == 1
        assert analytics.mix_shift(df, "d", "x", "g", w).first().blended_pct is None
        assert analytics.segments(df, "d", "x", ["g"], w).count() == (1 if rows else 0)
        assert verbs.resample(df, "d", "x").count() == (1 if rows else 0)
        assert analytics.cohorts(df, "d", "g").count() == (1 if rows else 0) and analytics.pace(df, "d", "x").count() == (1 if rows else 0)


@pytest.mark.parametrize("rows", [kpi.RANGE_ROWS, 1])
def test_ranks_over_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(kpi, "RANGE_ROWS", rows)
    rng = random.Random(6)
    values = [rng.choice([rng.gauss(0, 1), float(round(rng.gauss(5, 3))), 7.0]) for _ in range(900)] + [None, NAN]
    clean = sorted(v for v in values if v is not None and v == v)
    for down in (False, True):
        got = {r.value: (r.copies, r.before) for r in kpi.positions(frame(spark, values).repartition(3), "x", down).collect()}
        ranked = clean[::-1] if down else clean
        assert got == {v: (clean.count(v), ranked.index(v)) for v in set(clean)}
    pairs = [(v, rng.choice([v, rng.random()])) for v in clean]
    df = spark.createDataFrame(pairs + [(1.0, None), (NAN, 2.0)], "a double, b double").repartition(3)
    p = pd.DataFrame(pairs, columns=["a", "b"])
    assert stats.spearman(df, "a", "b").first().rho == pytest.approx(p.a.rank().corr(p.b.rank()), abs=1e-6)
    tau = stats.kendall(df, "a", "b", block=50).first()
    x, y = p.a.to_numpy(), p.b.to_numpy()
    s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    want = s.sum() / np.sqrt((np.sign(x[:, None] - x) ** 2).sum() * (np.sign(y[:, None] - y) ** 2).sum())
    assert (tau.n, tau.tau) == (len(pairs), pytest.approx(want, abs=1e-6))
    assert stats.spearman(df.limit(0), "a", "b").first().rho is None and stats.kendall(df.limit(0), "a", "b").first().tau is None


@pytest.mark.parametrize("few", [quantiles.FEW, 0])
def test_a_large_group_is_not_brought_together(spark, monkeypatch, few):
    """Few groups: their sketches go to the rows, whatever Spark would choose. Many: each group's rows are dealt out."""
    monkeypatch.setattr(quantiles, "FEW", few)
    df = spark.range(0, 60_000, 1, 6).select(F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("g"), (F.col("id") * 7919 % 60_013).cast("double").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = quantiles.exact(df, ["g"], {"v": F.col("v")}, {"m": 0.5, "p": 0.9})
        got = {r.g: (r.n, r.m, r.p) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    v = np.arange(60_000) * 7919 % 60_013
    for g, own in (("a", v[np.arange(60_000) % 50 != 0]), ("b", v[::50])):
        assert got[g] == (len(own), pytest.approx(np.quantile(own, 0.5)), pytest.approx(np.quantile(own, 0.9)))
    assert ("BroadcastHashJoin" in plan and "SortMergeJoin" not in plan) if few else "_part" in plan
