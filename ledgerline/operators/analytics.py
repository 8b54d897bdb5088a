"""Analyses over periods and segments: trend, anomalies, bridge, volume and rate, pace, years, cohorts, drivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kpi, periods, stats, verbs


def by_period():
    """Over period rows only: at most a few thousand, never raw rows."""
    return W.orderBy("period")


def rolling_anomalies(series: DataFrame, limit: float = 2.5) -> DataFrame:
    """period, value, z of the residual from a centred median of five periods (three at least)."""
    five = by_period().rowsBetween(-2, 2)
    out = series.withColumn("_m", F.when(F.count("value").over(five) >= 3, F.percentile("value", F.lit(0.5)).over(five))).withColumn("_r", F.col("value") - F.col("_m"))
    z = F.col("_r") / F.nullif(F.stddev_samp("_r").over(W.partitionBy()), F.lit(0.0))
    return out.select("period", "value", z.alias("z")).withColumn("anomaly", F.coalesce(F.abs("z") >= limit, F.lit(False)))


def changes(series: DataFrame) -> DataFrame:
    """Period over period, momentum against the four before, and the trailing mean of four (two at least)."""
    v, last = F.col("value"), F.lag("value").over(by_period())
    four, trail = by_period().rowsBetween(-4, -1), by_period().rowsBetween(-3, 0)
    return series.select(
        "period",
        "value",
        (100.0 * F.try_divide(v - last, F.abs(last))).alias("change_pct"),
        (100.0 * F.try_divide(v - F.avg("value").over(four), F.abs(F.avg("value").over(four)))).alias("momentum_pct"),
        F.when(F.count("value").over(trail) >= 2, F.avg("value").over(trail)).alias("trailing_mean"),
    )


def trend(series: DataFrame) -> DataFrame:
    """n, slope, intercept, r2 and t of value on the period's ordinal."""
    i = series.withColumn("i", (F.row_number().over(by_period()) - 1).cast("double"))
    s = i.agg(F.count("value").alias("n"), F.regr_slope("value", "i").alias("slope"), F.regr_intercept("value", "i").alias("intercept"), F.regr_r2("value", "i").alias("r2"))
    return s.withColumn("t", F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / F.nullif(1 - F.col("r2"), F.lit(0.0))))


def two_periods(df: DataFrame, when: str, w: periods.Window) -> tuple[DataFrame, Column, Column]:
    """The rows of the current and previous period, and a predicate for each. Ranges of the column itself go to the scan.
    A period that there is not (an empty table, or one period only) has no rows."""
    cur, prev = (periods.within(df, when, first, w.grain) if first else F.lit(False) for first in (w.current, w.previous))
    return df.where(cur | prev), cur, prev


def bridge(df: DataFrame, when: str, value: str, segment: str, w: periods.Window, top: int = 5) -> DataFrame:
    """segment, current, previous, delta: the largest moves and the rest as Others; the deltas sum to the whole move."""
    rows, cur, prev = two_periods(df, when, w)
    v, zero = F.col(value), F.lit(0.0)
    sums = rows.groupBy(F.coalesce(F.col(segment).cast("string"), F.lit("(null)")).alias("segment")).agg(F.coalesce(periods.money(F.when(cur, v)), zero).alias("current"), F.coalesce(periods.money(F.when(prev, v)), zero).alias("previous"))
    move = F.abs(F.col("current") - F.col("previous"))
    out = verbs.top_and_others(sums, "segment", ["current", "previous"], [F.desc(move), F.col("segment")], top)
    out = out.select("segment", F.round("current", 2).alias("current"), F.round("previous", 2).alias("previous"))
    return out.withColumn("delta", F.round(F.col("current") - F.col("previous"), 2))


def volume_rate(df: DataFrame, when: str, value: str, unit: str | None, w: periods.Window) -> DataFrame:
    """The move as volume effect (v1 - v0) r0 and rate effect (r1 - r0) v1."""
    rows, cur, prev = two_periods(df, when, w)
    sums = [periods.money(F.when(cur, F.col(value))).alias("m1"), periods.money(F.when(prev, F.col(value))).alias("m0")]
    if unit:
        units = kpi.distinct_counts(rows, unit, {"cur": cur, "prev": prev}, "n").select(F.col("n__cur").alias("v1"), F.col("n__prev").alias("v0"))
        s = rows.agg(*sums).crossJoin(F.broadcast(units))  # one row each
    else:
        s = rows.agg(*sums, F.count_if(cur).cast("double").alias("v1"), F.count_if(prev).cast("double").alias("v0"))
    s = s.withColumn("r1", F.try_divide("m1", "v1")).withColumn("r0", F.try_divide("m0", "v0"))
    return s.select("m1", "m0", "v1", "v0", "r1", "r0", ((F.col("v1") - F.col("v0")) * F.col("r0")).alias("volume_effect"), ((F.col("r1") - F.col("r0")) * F.col("v1")).alias("rate_effect"))


def mix_shift(df: DataFrame, when: str, value: str, segment: str, w: periods.Window) -> DataFrame:
    """Blended rate and the rate at the previous mix, over segments seen in both periods."""
    rows, cur, prev = two_periods(df, when, w)
    v = F.col(value)
    s = rows.groupBy(segment).agg(periods.money(F.when(cur, v)).alias("m1"), periods.money(F.when(prev, v)).alias("m0"), F.count(F.when(cur, 1)).cast("double").alias("n1"), F.count(F.when(prev, 1)).cast("double").alias("n0")).where("n1 > 0 and n0 > 0")
    t = s.agg(F.sum("m1").alias("m1"), F.sum("m0").alias("m0"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum(F.col("m1") / F.col("n1") * F.col("n0")).alias("f"))
    blended = F.try_divide(F.try_divide("m1", "n1"), F.try_divide("m0", "n0"))
    return t.select(F.round(100 * (blended - 1), 6).alias("blended_pct"), F.round(100 * (F.try_divide("f", "m0") - 1), 6).alias("fixed_mix_pct"))


def segments(df: DataFrame, when: str, value: str, dims: list[str], w: periods.Window) -> DataFrame:
    """dim, segment, total, share and move of every dimension from one scan, by unpivoting the dimensions first."""
    p, v = periods.period_of(when, w.grain), F.col("v")
    pairs = F.array(*(F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("(null)")).alias("segment")) for d in dims))
    rows = df.select(p.alias("p"), F.col(value).alias("v"), F.explode(pairs).alias("s")).select("p", "v", "s.*")
    cur, prev = (F.col("p") == F.lit(first) if first else F.lit(False) for first in (w.current, w.previous))
    s = rows.groupBy("dim", "segment").agg(periods.money("v").alias("total"), periods.money(F.when(cur, v)).alias("m1"), periods.money(F.when(prev, v)).alias("m0"), F.count_if(cur).alias("n1"), F.count_if(prev).alias("n0"))
    all_ = rows.groupBy("dim").agg(periods.money("v").alias("_all"))  # a row for each dimension
    s, share = s.join(F.broadcast(all_), "dim"), 100.0 * F.try_divide("total", "_all")
    move = F.when((F.col("n1") >= 8) & (F.col("n0") >= 8), 100.0 * F.try_divide(F.col("m1") - F.col("m0"), F.abs("m0")))
    return s.select("dim", "segment", "total", F.round(share, 6).alias("share_pct"), F.round(move, 6).alias("move_pct"))


def pareto_curve(df: DataFrame, key: str, value: str) -> DataFrame:
    """Groups by value and their cumulative share; one row for each group, ties by key.

    Totals are dealt to ranges cut at approximate quantiles; a group's running total is that of its range up to it and
    the sum of the ranges before, a row for each range.
    """
    s = df.groupBy(key).agg(periods.money(value).alias("total")).where("total is not null")
    s = s.withColumn("_bin", kpi.range_of(F.col("total"), s, F.col("total")))
    sums = s.groupBy("_bin").agg(F.sum("total").alias("_t"))
    before = sums.select("_bin", F.coalesce(F.sum("_t").over(W.orderBy(F.desc("_bin")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"), F.sum("_t").over(W.partitionBy()).alias("_all"))
    down = W.partitionBy("_bin").orderBy(F.desc("total"), key).rowsBetween(W.unboundedPreceding, 0)
    share = 100.0 * (F.col("_before") + F.sum("total").over(down)) / F.col("_all")
    return s.join(F.broadcast(before), "_bin").select(F.col(key).cast("string").alias("segment"), "total", F.round(share, 6).alias("cum_share_pct"))


def pace(df: DataFrame, when: str, value: str, g: str = "M") -> DataFrame:
    """Running totals by day of the latest two periods, the unfinished one included."""
    p = periods.period_of(when, g)
    last = [r.p for r in df.select(p.alias("p")).where("p is not null").distinct().orderBy(F.desc("p")).limit(2).collect()]
    days = df.where(p.isin(last) if last else F.lit(False)).groupBy(p.alias("period"), (F.datediff(F.to_date(when), p) + 1).cast("long").alias("day")).agg(periods.money(value).alias("v"))
    return days.select("period", "day", F.round(F.sum("v").over(W.partitionBy("period").orderBy("day").rowsBetween(W.unboundedPreceding, 0)), 2).alias("running"))


#: Dated rows, and days that they span, below which years are not compared.
YEAR_ROWS, YEAR_DAYS = 30, 400


def year_over_year(df: DataFrame, when: str, value: str, first_month: int = 1) -> DataFrame:
    """year (fiscal where first_month > 1), month, total, and the change on the same month a year before. No rows below
    YEAR_ROWS dated rows, or where they span less than YEAR_DAYS or lie in one year."""
    y = F.year(when) + F.when(F.month(when) >= first_month, 1).otherwise(0) if first_month > 1 else F.year(when)
    s = df.where(F.col(when).isNotNull()).groupBy(y.cast("long").alias("year"), F.month(when).cast("long").alias("month")).agg(periods.money(value).alias("total"))
    span = df.agg(F.count(when).alias("n"), F.min(when).alias("lo"), F.max(when).alias("hi")).where((F.col("n") >= YEAR_ROWS) & (F.datediff("hi", "lo") >= YEAR_DAYS))  # one row or none
    every = W.partitionBy()  # months by years only
    s = s.crossJoin(F.broadcast(span.select("n"))).drop("n").withColumn("_years", F.max("year").over(every) - F.min("year").over(every)).where("_years > 0").drop("_years")
    before = F.lag("total").over(W.partitionBy("month").orderBy("year"))
    gap = F.col("year") - F.lag("year").over(W.partitionBy("month").orderBy("year"))
    return s.withColumn("change_pct", F.when(gap == 1, F.round(100.0 * F.try_divide(F.col("total") - before, F.abs(before)), 6)))


#: Weekdays that a week's shape needs.
WEEKDAYS = 5


def seasonality(df: DataFrame, when: str, value: str) -> DataFrame:
    """weekday (Monday 0), total, n, share. No rows below WEEKDAYS different days, or where they total 0."""
    s = df.where(F.col(when).isNotNull()).groupBy(F.weekday(when).cast("long").alias("weekday")).agg(periods.money(value).alias("total"), F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy()  # seven rows at most
    shaped = s.withColumn("_all", F.sum("total").over(whole)).withColumn("_days", F.count(F.lit(1)).over(whole)).where((F.col("_days") >= WEEKDAYS) & (F.col("_all") != 0))
    return shaped.withColumn("share_pct", F.round(100.0 * F.col("total") / F.col("_all"), 6)).drop("_all", "_days")


def cohorts(df: DataFrame, when: str, entity: str, most: int = 6) -> DataFrame:
    """cohort (first month), offset in months, entities and retention, by one window minimum and no join."""
    m = periods.period_of(when, "M")
    seen = df.where(F.col(entity).isNotNull() & F.col(when).isNotNull()).select(F.col(entity).alias("e"), m.alias("m")).distinct()
    rows = seen.withColumn("cohort", F.min("m").over(W.partitionBy("e"))).withColumn("offset", F.months_between("m", "cohort").cast("long"))
    s = rows.where(F.col("offset") <= most).groupBy("cohort", "offset").agg(F.count(F.lit(1)).alias("entities"))
    size = F.max(F.when(F.col("offset") == 0, F.col("entities"))).over(W.partitionBy("cohort"))
    return s.withColumn("retention_pct", F.round(100.0 * F.col("entities") / size, 6))


#: A cohort grid needs so many dated rows and entities; shorter spans are seen by weeks.
GRID_ROWS, GRID_ENTITIES, GRID_DAYS = 60, 30, 85


def cohort_grid(df: DataFrame, when: str, entity: str, cohorts: int = 8, most: int = 6) -> DataFrame:
    """cohort, offset, entities, retention_pct of the latest cohorts: every offset up to `most`, 0 where a cohort was not
    seen, null where its period begins after the last date and nothing can have been seen yet.

    By months, or by weeks where the dates span less than GRID_DAYS. No rows below GRID_ROWS dated rows or GRID_ENTITIES
    entities, or where every entity is seen in one period only.
    """
    rows = df.where(F.col(entity).isNotNull() & F.col(when).isNotNull())
    span = rows.agg(F.min(when).alias("lo"), F.max(when).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    empty = df.sparkSession.createDataFrame([], "cohort date, offset long, entities long, retention_pct double")
    if span.n < GRID_ROWS:
        return empty
    g = "M" if (span.hi - span.lo).days >= GRID_DAYS else "W"
    seen = rows.select(F.col(entity).alias("e"), periods.period_of(when, g).alias("p")).distinct().withColumn("cohort", F.min("p").over(W.partitionBy("e")))
    step = F.months_between("p", "cohort") if g == "M" else F.datediff("p", "cohort") / 7
    s = seen.groupBy("cohort", step.cast("long").alias("offset")).agg(F.count(F.lit(1)).alias("entities"))  # a row for each pair of periods
    sizes = s.where(F.col("offset") == 0).select("cohort", F.col("entities").alias("size"))
    total = sizes.agg(F.sum("size").alias("n")).crossJoin(F.broadcast(s.agg(F.max("offset").alias("most")))).first()
    if (total.n or 0) < GRID_ENTITIES or (total.most or 0) < 1:
        return empty
    latest = sizes.orderBy(F.desc("cohort")).limit(cohorts)
    spine = latest.withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(most, total.most)).cast("long"))))
    begins = F.add_months("cohort", F.col("offset").cast("int")) if g == "M" else F.date_add("cohort", (F.col("offset") * 7).cast("int"))
    found = F.coalesce("entities", F.lit(0))
    seen_by_now = begins.cast("timestamp") <= F.lit(span.hi).cast("timestamp")
    out = spine.join(s, ["cohort", "offset"], "left").withColumn("entities", F.when(seen_by_now, found))
    return out.select("cohort", "offset", "entities", F.round(100.0 * F.col("entities") / F.col("size"), 6).alias("retention_pct"))


#: Dated rows that a pace needs.
PACE_ROWS = 20


def pace_summary(df: DataFrame, when: str, value: str, g: str | None = None) -> DataFrame:
    """One row: the latest period, the day it is at and its days, its total so far, the previous period's at the same day
    and whole, the pace (percent) and what the period comes to at this rate, with its change on the previous (percent).

    For periods of weeks or months, by the dates' span unless given. No row below PACE_ROWS dated rows, for other periods,
    or for one period only.
    """
    from datetime import timedelta

    w = periods.bounds(df, when, g)
    rows = df.where(F.col(when).isNotNull())
    empty = df.sparkSession.createDataFrame([], "period date, day long, days long, so_far double, previous_same_day double, previous_total double, pace_pct double, run_rate double, projected_pct double")
    if w.grain not in ("W", "M") or w.current is None or rows.count() < PACE_ROWS:
        return empty
    last = rows.agg(F.max(when).alias("hi")).first().hi
    period = periods.start(last.date() if hasattr(last, "date") else last, w.grain)
    earlier = rows.where(F.col(when) < F.lit(period.isoformat()).cast(df.schema[when].dataType)).agg(F.max(when).alias("hi")).first().hi
    if earlier is None:
        return empty
    previous = periods.start(earlier.date() if hasattr(earlier, "date") else earlier, w.grain)
    day = ((last.date() if hasattr(last, "date") else last) - period).days + 1
    days = periods.length(period, w.grain)
    cur, prev = periods.within(rows, when, period, w.grain), periods.within(rows, when, previous, w.grain)
    same = prev & (F.to_date(when) < F.lit(previous + timedelta(days=day)))
    v = F.col(value)
    s = rows.where(cur | prev).agg(periods.money(F.when(cur, v)).alias("so_far"), periods.money(F.when(same, v)).alias("previous_same_day"), periods.money(F.when(prev, v)).alias("previous_total"))
    rate = F.col("so_far") / day * days
    change = lambda a, b: F.round(100.0 * F.try_divide(a - F.col(b), F.nullif(b, F.lit(0.0))), 6)
    return s.select(F.lit(period).alias("period"), F.lit(day).cast("long").alias("day"), F.lit(days).cast("long").alias("days"), F.round("so_far", 4).alias("so_far"), F.round("previous_same_day", 4).alias("previous_same_day"), F.round("previous_total", 4).alias("previous_total"), change(F.col("so_far"), "previous_same_day").alias("pace_pct"), F.round(rate, 4).alias("run_rate"), change(rate, "previous_total").alias("projected_pct"))


def repeat_gap(df: DataFrame, when: str, entity: str) -> DataFrame:
    """Entities, those that came back, their rate, and the median days between visits."""
    days = df.where(F.col(entity).isNotNull() & F.col(when).isNotNull()).select(F.col(entity).alias("e"), F.to_date(when).alias("d")).distinct()
    gap = days.withColumn("gap", F.datediff("d", F.lag("d").over(W.partitionBy("e").orderBy("d"))))
    one = gap.groupBy("e").agg(F.count("gap").alias("again"))
    return one.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("again") > 0).alias("repeaters")).withColumn("repeat_pct", F.round(100.0 * F.col("repeaters") / F.col("entities"), 6)).crossJoin(F.broadcast(kpi.quantiles(gap, "gap", {"median_gap": 0.5})))


#: What an association of rows needs: pairs, r and p; and one of a driver some periods before: pairs, r and p.
DRIVER, LEADING = (30, 0.3, 0.01), (8, 0.5, 0.05)
STRONG = 0.6


def drivers(df: DataFrame, metric: str, others: list[str]) -> DataFrame:
    """column, n, r, p, strength (strong from STRONG, else moderate) of the columns that move with the metric: DRIVER pairs
    or more, and r and p past its bounds. One aggregate for all columns; their p are tails worked out on the driver."""
    m = periods.number(metric)
    parts = [F.struct(F.count(F.when(m.isNotNull(), periods.number(c))).alias("n"), periods.corr(m, periods.number(c)).alias("r")).alias(str(i)) for i, c in enumerate(others)]
    row = df.agg(*parts).first() if parts else []
    found = [(c, s.n, s.r, stats.r_p_value(s.r, s.n)) for c, s in zip(others, row) if s.r is not None and s.n >= DRIVER[0]]
    kept = [(c, n, r, p, "strong" if abs(r) >= STRONG else "moderate") for c, n, r, p in found if abs(r) >= DRIVER[1] and p < DRIVER[2]]
    return df.sparkSession.createDataFrame(kept, "column string, n long, r double, p double, strength string")


def leading(series: DataFrame, most: int = 4) -> DataFrame:
    """lag, n, r, p of the lag at which a driver leads its target best, if any passes LEADING; no row else. series: period,
    driver, target."""
    found = [(x["lag"], x.n, x.r, stats.r_p_value(x.r, x.n)) for x in driver_lags(series, most).collect() if x.r is not None and x.n >= LEADING[0]]
    kept = sorted((f for f in found if abs(f[2]) >= LEADING[1] and f[3] < LEADING[2]), key=lambda f: (-abs(f[2]), f[0]))[:1]
    return series.sparkSession.createDataFrame(kept, "lag long, n long, r double, p double")


def driver_lags(series: DataFrame, most: int = 4) -> DataFrame:
    """lag, n, r of driver k periods before against target. series: period, driver, target."""
    lagged = series.select("target", *(F.lag("driver", k).over(by_period()).alias(f"d{k}") for k in range(1, most + 1)))
    parts = [F.struct(F.lit(k).cast("long").alias("lag"), F.count(F.when(F.col(f"d{k}").isNotNull() & F.col("target").isNotNull(), 1)).alias("n"), F.round(periods.corr(F.col(f"d{k}"), F.col("target")), 6).alias("r")) for k in range(1, most + 1)]
    return lagged.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, median, p90, least and largest value, bias-corrected skewness with its band, and values more than three
    deviations (ddof 1) from the mean. Null statistics below 30 values."""
    x = periods.number(column)
    n = F.count(x)
    s = df.agg(n.alias("n"), periods.mean(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"), (F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))).alias("skew"))
    far = df.crossJoin(F.broadcast(s.select("_m", "_s"))).agg(F.count_if(F.abs((x - F.col("_m")) / F.nullif("_s", F.lit(0.0))) > 3).alias("outliers"))
    out = s.drop("_m", "_s").crossJoin(F.broadcast(kpi.quantiles(df, column, {"median": 0.5, "p90": 0.9}))).crossJoin(F.broadcast(far))
    shape = F.when(F.col("skew") > 1, "right-skewed").when(F.col("skew") < -1, "left-skewed").otherwise("balanced")
    return out.select("n", *(F.when(F.col("n") >= 30, F.col(c)).alias(c) for c in ("median", "mean", "p90", "min", "max", "skew", "outliers")), F.when(F.col("n") >= 30, shape).alias("shape"))


def scorecard(kpis: DataFrame) -> DataFrame:
    """key, value, delta_pct, direction (flat within 0.05 %) and verdict by polarity, of the rows of a KPI pack."""
    d = F.col("delta_pct")
    direction = F.when(F.abs(d) < kpi.FLAT, "flat").when(d > 0, "up").when(d < 0, "down")
    good = (d > 0) == (F.col("polarity") == "up_good")
    verdict = F.when(d.isNull(), "no comparison").when(F.abs(d) < kpi.FLAT, "stable").when(F.col("polarity") == "neutral", "neutral").when(good, "favourable").otherwise("adverse")
    return kpis.select("key", "value", "delta_pct", direction.alias("direction"), verdict.alias("verdict"))


def trend_bands(series: DataFrame) -> DataFrame:
    """n, mean, best and worst period, and how steady the series is: CV up to 15 % stable, up to 40 % moderate, else
    volatile. No row below four periods."""
    s = series.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.max_by("period", F.struct("value", "period")).alias("best"), F.min_by("period", F.struct("value", "period")).alias("worst"), (100 * F.try_divide(F.stddev_samp("value"), F.abs(F.nullif(F.avg("value"), F.lit(0.0))))).alias("cv"))
    return s.where("n >= 4").withColumn("steadiness", F.when(F.col("cv") <= 15, "stable").when(F.col("cv") <= 40, "moderate").when(F.col("cv").isNotNull(), "volatile"))


def linear_forecast(series: DataFrame, horizon: int, step_days: int) -> DataFrame:
    """step, period, mean, lower, upper: a line on the ordinal, with a band of 1.96 residual deviations (ddof 0)."""
    i = series.withColumn("i", (F.row_number().over(by_period()) - 1).cast("double"))
    s = i.agg(F.max("period").alias("last"), F.count("value").alias("n"), F.regr_slope("value", "i").alias("b"), F.regr_intercept("value", "i").alias("a"), F.sqrt(F.var_pop("value") * (1 - F.regr_r2("value", "i"))).alias("sd"))
    out = s.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).withColumn("mean", F.col("a") + F.col("b") * (F.col("n") - 1 + F.col("step")))
    return out.select(F.col("step").cast("long").alias("step"), F.date_add("last", F.col("step") * step_days).alias("period"), *(F.round(F.col("mean") + k * F.col("sd"), 2).alias(x) for x, k in (("mean", 0.0), ("lower", -1.96), ("upper", 1.96))))
