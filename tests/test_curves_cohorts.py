"""LOWESS, violins, bounded hierarchies, cohort grids, pace, sessions, memory and headers that look like months."""

import random
import threading
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerline.operators import analytics, charts, curves, insights, memory, semantics, series, stats, verbs
from ledgerline.plans import catalog
from ledgerline.streaming import sessions


def plain_lowess(x, y, places, share, rounds):
    n, k = len(x), max(1, int(share * len(x) + 1e-10))

    def fit(robust):
        out = []
        for p in places:
            h = np.sort(np.abs(x - p))[k - 1]
            w = robust * (np.clip(1 - (np.abs(x - p) / h) ** 3, 0, None) ** 3 if h > 0 else x == p)
            mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
            v = (w * (x - mx) ** 2).sum()
            out.append(my + (w * (x - mx) * (y - my)).sum() / v * (p - mx) if v > 1e-12 * w.sum() * h * h else my)
        return np.array(out)

    fitted = fit(np.ones(n))
    for _ in range(rounds):
        r = np.abs(y - np.interp(x, places, fitted))
        m = np.median(r)
        if m == 0:
            break
        fitted = fit(np.clip(1 - (r / (6 * m)) ** 2, 0, None) ** 2)
    return fitted


@pytest.mark.parametrize("points, share, rounds", [(400, 2 / 3, 3), (12, 0.5, 2), (25, 0.2, 0)])
def test_lowess_equals_numpy(spark, points, share, rounds):
    rng = np.random.default_rng(points)
    x = np.round(rng.uniform(0, 10, 150), 1)
    y = np.sin(x) * 3 + rng.normal(size=150)
    y[:6] += 40  # outliers, whose weights go
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2.0, float("nan")), (float("inf"), 1.0)], "x double, y double").repartition(3)
    got = curves.lowess(df, "x", "y", share, rounds, points).orderBy("x").collect()
    distinct = np.unique(x)
    places = distinct if len(distinct) <= points else np.unique(np.quantile(x, np.linspace(0, 1, points)))
    assert np.allclose([r.x for r in got], places)
    assert np.allclose([r.fitted for r in got], plain_lowess(x, y, places, share, rounds), rtol=1e-8, atol=1e-8)


def test_lowess_of_little(spark):
    df = lambda rows: spark.createDataFrame(rows, "x double, y double")
    assert curves.lowess(df([]), "x", "y").count() == 0
    assert [tuple(r) for r in curves.lowess(df([(1.0, 5.0)]), "x", "y").collect()] == [(1.0, 5.0)]
    assert [tuple(r) for r in curves.lowess(df([(1.0, 5.0), (1.0, 7.0)]), "x", "y").collect()] == [(1.0, 6.0)]
    line = curves.lowess(df([(float(i), 2.0 * i) for i in range(30)]), "x", "y").collect()
    assert all(r.fitted == pytest.approx(2 * r.x) for r in line) and len(line) == 30


def test_violin_equals_the_direct_density(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=500), "b": rng.exponential(size=300), "same": np.ones(40), "one": np.ones(1)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", float("nan")), ("b", float("inf")), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = charts.marks(df, charts.Chart("violin", "", "g", "v")).collect()
    assert {r.segment for r in got} == {"a", "b"}
    for g in "ab":
        v, own = groups[g], sorted((r["at"], r.density) for r in got if r.segment == g)
        h = 1.059 * min(v.std(ddof=1), (np.quantile(v, 0.75) - np.quantile(v, 0.25)) / 1.349) * len(v) ** -0.2
        at = np.array([a for a, _ in own])
        direct = np.exp(-0.5 * ((at[:, None] - v[None]) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert len(own) == curves.GRID and np.allclose(at, np.linspace(v.min() - 2 * h, v.max() + 2 * h, curves.GRID))
        assert np.abs(direct - [y for _, y in own]).max() < 0.01 * direct.max()  # what sharing units between places changes


def test_hierarchy_is_bounded_and_sums_up(spark):
    rng = random.Random(3)
    rows = [(f"a{min(rng.randrange(40), rng.randrange(40))}", rng.choice([f"b{i}" for i in range(30)] + [None]), f"c{rng.randrange(9)}", rng.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "x string, y string, z string, v double")
    got = verbs.hierarchy_top(df, ["x", "y", "z"], "v", 3).collect()
    whole = sum(r[3] for r in rows)
    for depth in range(4):
        own = [r for r in got if r.depth == depth]
        assert len(own) <= 4**depth and len({(r.x, r.y, r.z) for r in own}) == len(own)
        leaves = [r for r in got if r.depth < depth and r.depth > 0 and (r.x, r.y, r.z)[r.depth - 1] == "Others"]
        assert sum(r.total for r in own) + sum(r.total for r in leaves) == pytest.approx(whole)
    tops = sorted({r[0] for r in rows}, key=lambda x: -sum(r[3] for r in rows if r[0] == x))[:3]
    assert {r.x for r in got if r.depth == 1} == {*tops, "Others"}
    assert verbs.hierarchy_top(df.limit(0), ["x", "y"], "v", 3).where("depth > 0").count() == 0


def test_cohort_grid_tells_zero_from_unseen(spark):
    rows = []
    for i in range(40):
        first = date(2024, 1, 10) if i < 25 else date(2024, 3, 5)
        rows += [(f"e{i}", first), (f"e{i}", first + timedelta(days=1))] + ([(f"e{i}", date(2024, 4, 8))] if i % 5 == 0 else [])
    df = spark.createDataFrame(rows, "e string, d date")
    got = {(str(r.cohort), r.offset): (r.entities, r.retention_pct) for r in analytics.cohort_grid(df, "d", "e").collect()}
    assert got == {("2024-01-01", 0): (25, 100.0), ("2024-01-01", 1): (0, 0.0), ("2024-01-01", 2): (0, 0.0), ("2024-01-01", 3): (5, 20.0), ("2024-03-01", 0): (15, 100.0), ("2024-03-01", 1): (3, 20.0), ("2024-03-01", 2): (None, None), ("2024-03-01", 3): (None, None)}
    few = df.where("e < 'e3'")
    assert analytics.cohort_grid(few, "d", "e").count() == 0  # too few entities
    weekly = spark.createDataFrame([(f"e{i}", date(2024, 1, 1) + timedelta(days=d)) for i in range(40) for d in (0, 8, 30)], "e string, d date")
    assert sorted((r.offset, r.entities) for r in analytics.cohort_grid(weekly, "d", "e").collect()) == [(0, 40), (1, 40), (2, 0), (3, 0), (4, 40)]


def test_pace_gates_and_run_rate(spark):
    rows = [(date(2024, 2, 1) + timedelta(days=i), 2.0) for i in range(29)] + [(date(2024, 3, 1) + timedelta(days=i), 3.0) for i in range(10)]
    df = spark.createDataFrame(rows, "d date, v double")
    r = analytics.pace_summary(df, "d", "v", "M").first()
    assert (str(r.period), r.day, r.days, r.so_far, r.previous_same_day, r.previous_total, r.pace_pct, r.run_rate) == ("2024-03-01", 10, 31, 30.0, 20.0, 58.0, 50.0, 93.0)
    assert r.projected_pct == pytest.approx(100 * (93 - 58) / 58, abs=1e-6)
    assert analytics.pace_summary(df.limit(19), "d", "v", "M").count() == 0 and analytics.pace_summary(df, "d", "v", "Q").count() == 0
    assert analytics.pace_summary(df.where("d < '2024-02-25'"), "d", "v", "M").count() == 0


def test_year_and_end_labels(spark):
    df = spark.createDataFrame([(date(2022, 5, 1), 1.0), (date(2024, 2, 29), 4.0)], "d date, v double")
    ends = lambda g: [str(r.bucket) for r in verbs.resample(df, "d", "v", g, "end").orderBy("bucket").collect()]
    assert ends("Y") == ["2022-12-31", "2023-12-31", "2024-12-31"] and ends("M")[-1] == "2024-02-29" and ends("Q")[0] == "2022-06-30" and ends("W")[-1] == "2024-03-03" and ends("D")[-1] == "2024-02-29"


def test_sessions_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    rows = [(f"u{rng.randrange(5)}", start + timedelta(minutes=rng.randrange(6000)), 1.5) for _ in range(400)] + [(None, start, 1.0), ("u1", None, 1.0)]
    schema = "u string, t timestamp, v double"
    table = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, sessions.sessions(table, "t", "u", "v").collect()))
    plain = []
    for u in {r[0] for r in rows} - {None}:
        own = sorted(r[1] for r in rows if r[0] == u and r[1])
        cuts = [0] + [i for i in range(1, len(own)) if own[i] - own[i - 1] > timedelta(minutes=30)] + [len(own)]
        plain += [(u, own[a], own[b - 1], b - a, 1.5 * (b - a)) for a, b in zip(cuts, cuts[1:])]
    assert want == sorted(plain)
    for i, part in enumerate((rows[:200], rows[200:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    read = lambda d: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{d}")
    q = sessions.sessions(read("in"), "t", "u", "v", late="10 days").writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    spark.createDataFrame([("zz", start + timedelta(days=30), 0.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/p2")
    q.processAllAvailable()
    got = [r for r in map(tuple, spark.table("sess").collect()) if r[0] != "zz"]
    late = spark.createDataFrame([("u0", start, 9.0)], schema).coalesce(1)
    late.write.parquet(f"{tmp_path}/in/late")
    q.processAllAvailable()
    count = sessions.dropped(q)
    q.stop()
    assert sorted(got) == want and count == 1


def test_memory_hit_then_forced_then_rank(spark, tmp_path):
    folder = f"file://{tmp_path}/memory"
    df = spark.createDataFrame([(date(2024, 1, 1), 2.0, "p", 3)] * 3, "order_date date, revenue double, product string, quantity int")
    plain = semantics.bind(df, remembered=folder)
    memory.remember(spark, folder, [" Revenue", "PRODUCT", "order_date", "quantity"], "finance", {"amount": "revenue", "account": "product", "gone": "no_such"})
    hit = semantics.bind(df, remembered=folder)
    assert (hit.preset.key, hit.confidence, hit.mapping) == ("finance", 100, {"amount": "revenue", "account": "product"})
    forced = semantics.bind(df, preset="retail", remembered=folder)
    assert forced.preset.key == "retail" and forced.confidence < 100
    assert semantics.bind(df, override={"revenue": "revenue"}, remembered=folder).confidence == semantics.bind(df).confidence
    memory.forget(spark, folder, df.columns)
    assert memory.recall(spark, folder, df.columns) is None and semantics.bind(df, remembered=folder) == plain
    (tmp_path / "memory").mkdir(exist_ok=True)
    memory.remember(spark, folder, df.columns, "retail", {"x": "nowhere"})
    assert memory.recall(spark, folder, df.columns) is None  # none of its columns is there
    for text in ("{", "[]", '{"version": 0, "preset": "retail", "mapping": {"a": "revenue"}}'):
        memory._add(memory.Files(spark, folder), memory._place(folder, df.columns), text)
        assert memory.recall(spark, folder, df.columns) is None


def test_memory_written_by_many(spark, tmp_path):
    folder, columns = f"file://{tmp_path}", ["a", "b"]
    run = lambda i: [memory.remember(spark, folder, columns, f"p{i}", {"f": "a"}) for _ in range(5)]
    threads = [threading.Thread(target=run, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert memory.recall(spark, folder, columns).preset in {f"p{i}" for i in range(4)}
    assert 1 <= len([p for p in next(tmp_path.iterdir()).iterdir() if p.name.endswith(".json")]) <= 4


def test_headers_that_only_look_like_months(spark):
    words = spark.createDataFrame([("x", 1, 2, 3, 4, 5)], "shop string, market int, margin int, decline int, separate int, mayor int")
    years = spark.createDataFrame([("x", 1, 2, 3, 4, 5)], "shop string, `2019` int, `2020` int, `2021` int, `2022` int, `2023` int")
    assert verbs.unpivot_wide(words).columns == words.columns and verbs.unpivot_wide(years).columns == years.columns
    wide = spark.createDataFrame([("x", "1,000", None, "3", "4", "n/a", "9")], "shop string, Jan string, `feb 2023` string, `Mar-24` string, `2024-04` string, May string, margin string")
    got = sorted((str(r.period), r.value) for r in verbs.unpivot_wide(wide, year=2022).collect())
    assert got == sorted([("2022-01-01", 1000.0), ("2023-02-01", None), ("2024-03-01", 3.0), ("2024-04-01", 4.0), ("2022-05-01", None)])
    assert verbs.unpivot_wide(wide.drop("Jan", "May")).columns == wide.drop("Jan", "May").columns


def test_domains_and_templates(spark):
    column = lambda name, kind="double": semantics.profile(spark.createDataFrame([(float(i),) for i in range(30)], f"`{name}` {kind}"))[0]
    assert semantics.domain([column("Ledger Balance"), column("Units")]) == "finance" and semantics.domain([column("zzz")]) == "general"
    assert semantics.domain([column("qty")]) == "sales" and semantics.domain([column("cpc"), column("roas")]) == "marketing"
    assert semantics.template(["order_date", "customer_name", "revenue"]) == "sales" and semantics.template(["staff id", "wage"]) == "hr" and semantics.template(["x"]) is None


def test_shares_near_a_threshold_are_counted(spark):
    df = spark.range(20_000).select(F.concat(F.lit("v"), F.least(F.col("id"), F.lit(10_010))).alias("user_id"), F.concat(F.lit("w"), F.least(F.col("id"), F.lit(18_001))).alias("label"))
    a, b = semantics.profile(df)
    assert (a.distinct, b.distinct) == (10_011, 18_002) and b.role == "identifier"


def test_words_of_retail_and_of_a_house(spark):
    rows = [(datetime(2024, 1, 1 + i), 10.5 + i, f"thing {i % 7}", i % 4) for i in range(28)]
    df = spark.createDataFrame(rows, "`Created At` timestamp, Amt double, `Product Title` string, pcs int")
    found = semantics.detect(semantics.profile(df))
    assert found.preset.key == "retail" and found.mapping == {"order_date": "Created At", "revenue": "Amt", "product": "Product Title", "quantity": "pcs"}
    odd = spark.createDataFrame(rows, "`When Sold` timestamp, Taken double, Ware string, Heads int")
    assert semantics.detect(semantics.profile(odd)) is None
    ours = catalog.with_words({"retail": {"order_date": ["when sold"], "revenue": ["taken"], "product": ["ware"], "quantity": ["heads"]}})
    bound = semantics.bind(odd, presets=ours)
    assert bound.preset.key == "retail" and bound.mapping == {"order_date": "When Sold", "revenue": "Taken", "product": "Ware", "quantity": "Heads"}
    assert "date" in ours["retail"].fields[0].words and catalog.PRESETS["retail"].fields[0].words == catalog.RETAIL.fields[0].words
    for wrong in ({"nope": {}}, {"retail": {"nope": ["x"]}}):
        with pytest.raises(KeyError):
            catalog.with_words(wrong)


def test_context_and_concentration():
    rows = [Row(key="total", value=99.0), Row(key="exit_share", value=70.0), Row(key="top_share", value=80.0)]
    card = insights.concentration_card(rows)
    assert card.evidence == {"kpi": "exit_share", "share": 70.0} and insights.concentration_card(rows[:1]) is None
    text = insights.context([card])
    assert text.splitlines()[0].startswith("Findings") and "exit_share is 70 %" in text and "concentration (warn, weight 4.0)" in text


def test_decomposition_needs_points(spark):
    made = lambda n: spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i), float(i % 3)) for i in range(n)], "period date, value double")
    assert series.decompose(made(13), 3).count() == 0 and series.decompose(made(14), 3).count() == 14


def test_grid_charts(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 2.0), ("b", 3.0, 2.0), ("c", float("nan"), 2.0), ("b", 3.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    cells = {(r.ba, r.bb): r.n for r in charts.scatter_matrix(df, ["x", "y"], 2).collect()}
    assert cells == {(0, 0): 1, (1, 0): 2}
    assert {(r.facet, r.bx, r.by): r.n for r in charts.facets(df, "x", "y", "g", 2, 2).collect()} == {("a", 0, 0): 1, ("a", 1, 0): 1, ("b", 1, 0): 1}
    assert charts.scatter_matrix(df.limit(0), ["x", "y"]).count() == 0 and charts.facets(df.limit(0), "x", "y", "g").count() == 0


def test_gates_of_years_and_weekdays(spark):
    daily = lambda first, n, step=1: spark.createDataFrame([(first + timedelta(days=i * step), 1.0) for i in range(n)], "d date, v double")
    years = lambda df: analytics.year_over_year(df, "d", "v").count()
    assert years(daily(date(2022, 3, 1), 401)) > 0 and years(daily(date(2022, 3, 1), 400)) == 0
    assert years(daily(date(2022, 3, 1), 29, 20)) == 0 and years(daily(date(2022, 3, 1), 30, 20)) > 0 and years(daily(date(2022, 3, 1), 0)) == 0
    week = lambda df: analytics.seasonality(df, "d", "v").count()
    assert week(daily(date(2024, 1, 1), 5)) == 5 and week(daily(date(2024, 1, 1), 4)) == 0
    assert week(daily(date(2024, 1, 1), 7).withColumn("v", F.lit(0.0))) == 0


def test_gates_of_drivers(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=60)
    rows = [(float(a), float(2 * a + rng.normal()), float(0.45 * a + rng.normal()), float(rng.normal()), float(a) if i < 29 else None) for i, a in enumerate(m)]
    df = spark.createDataFrame(rows, "m double, near double, some double, none double, few double")
    got = {r.column: r for r in analytics.drivers(df, "m", ["near", "some", "none", "few"]).collect()}
    x = np.array([r[:4] for r in rows])
    for i, c in enumerate(("near", "some", "none"), 1):
        r = np.corrcoef(x[:, 0], x[:, i])[0, 1]
        p = stats.t_p_value(r * np.sqrt(58 / (1 - r * r)), 58)
        assert (c in got) == (abs(r) >= 0.3 and p < 0.01)
        if c in got:
            assert got[c].n == 60 and got[c].r == pytest.approx(r) and got[c].p == pytest.approx(p) and got[c].strength == ("strong" if abs(r) >= 0.6 else "moderate")
    assert "near" in got and "few" not in got and analytics.drivers(df, "m", []).count() == 0 and analytics.drivers(df.limit(0), "m", ["near"]).count() == 0
    y = rng.normal(size=14)
    lead = lambda n: spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i), float(y[i]), float(y[i - 2]) if i > 1 else 0.0) for i in range(n)], "period date, driver double, target double")
    best = analytics.leading(lead(14)).collect()
    assert [(b["lag"], b.n) for b in best] == [(2, 12)] and best[0].r == pytest.approx(1.0) and best[0].p < 1e-6
    assert analytics.leading(lead(9)).where("lag = 2").count() == 0  # seven pairs


@pytest.mark.parametrize("cuts", [3, 60])
def test_cells_give_exact_order_statistics(spark, monkeypatch, cuts):
    monkeypatch.setattr(curves, "CELLS", cuts)
    rng = np.random.default_rng(cuts)
    x = np.concatenate([rng.normal(size=900), np.round(rng.normal(size=900), 1), np.full(500, 0.3), [-1e9, 1e9]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3)
    cells = curves.Cells(df, "x")
    assert cells.n == len(x)
    asks = [(p, k) for p in (None, -5.0, 0.3, 0.31, 1e9) for k in (1, 2, 700, 1500, len(x))]
    assert cells.kth(asks) == [np.sort(x if p is None else np.abs(x - p))[k - 1] for p, k in asks]


def test_lowess_makes_no_row_for_each_place(spark, monkeypatch):
    """Quantiles of forty distances took a row for each row and place."""
    seen = []
    plain = curves.quantiles.exact
    monkeypatch.setattr(curves.quantiles, "exact", lambda df, keys, values, wanted: seen.append(len(values) * len(wanted)) or plain(df, keys, values, wanted))
    df = spark.range(300).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    assert curves.lowess(df, "x", "y").count() == curves.POINTS and set(seen) == {1}
