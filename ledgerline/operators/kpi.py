"""KPI algebra: a pack of specs becomes one aggregate over the slices all, current and previous.

Every additive KPI is an aggregate with a FILTER for each slice, so they cost one scan (after the bounds) however many
they are; composite KPIs are arithmetic over the aggregated row. Distinct counts and shares of the top groups, again
however many, take one more scan: each row gives a tagged value for each of them, which map tasks group before the one
shuffle. Medians of all KPIs and slices come from exact quantiles together. NaN counts as missing everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import periods, quantiles as exact_quantiles

FLAT, SLICES = 0.05, ("all", "cur", "prev")
#: Ranges that distinct values are dealt to, and rows of a range beyond which it is cut again.
RANGES, RANGE_ROWS = 64, 500_000
UNIT_DAYS = {"days": 1.0, "months": 30.44, "years": 365.25}


@dataclass(frozen=True)
class KPI:
    key: str
    kind: str
    fmt: str = "number"
    polarity: str = "neutral"
    params: dict[str, Any] = field(default_factory=dict)


def matches(c: Column | str, values: Sequence[str]) -> Column:
    """Equal to one of the values or holding one as a whole word, on trimmed lower case; null counts as no."""
    import re

    text = F.lower(F.trim(F.col(c) if isinstance(c, str) else c).cast("string"))
    low = [v.lower() for v in values]
    words = "|".join(re.escape(v) for v in low)
    return F.coalesce(text.isin(low) | text.rlike(rf"\b({words})\b"), F.lit(False))


def aggregate(k: KPI, mapping: dict[str, str], by: Column, as_of: Column) -> dict[str, Column] | None:
    """The aggregates that a KPI of a slice needs, by part; None if a field isn't mapped."""
    p = k.params

    def col(name: str) -> Column | None:
        return F.col(mapping[p[name]]) if p.get(name) in mapping else None

    one = F.when(by, F.lit(1))
    if k.kind in ("sum", "mean", "median", "max"):
        x = col("field")
        if x is None:
            return None
        keep = by
        if p.get("positive_only"):
            keep = keep & (x > 0)
        if p.get("negative_only"):
            keep = keep & (x < 0)
        if "where_field" in p:
            if p["where_field"] in mapping:
                keep = keep & matches(mapping[p["where_field"]], p["where_values"])
            elif not p.get("where_fallback"):
                return None
        x = F.when(keep, x)
        if k.kind == "median":  # of all KPIs and slices together: exact_quantiles
            return {"median": periods.number(x)}
        agg = {"sum": lambda: periods.money(x), "mean": lambda: periods.mean(x), "max": lambda: F.max(periods.number(x))}[k.kind]()
        return {"value": agg * p.get("scale", 1.0)}
    if k.kind == "distinct":  # of a mapped field: by_value
        return {"value": F.count(one).cast("double")} if col("field") is None and p.get("fallback_rows") else None
    if k.kind == "rows":
        return {"value": F.count(one).cast("double")}
    if k.kind == "ratio_fields":
        a, b = col("num_field"), col("den_field")
        if a is None or b is None:
            return None
        return {"value": F.try_divide(periods.money(F.when(by, a)), periods.money(F.when(by, b))) * (100.0 if p.get("as_percent") else 1.0)}
    if k.kind in ("rate", "rate_notnull"):
        x = col("field")
        if x is None:
            return None
        hit = matches(x, p["values"]) if k.kind == "rate" else x.isNotNull()
        share = F.try_divide(100.0 * F.count(F.when(by & hit, 1)).cast("double"), F.count(one).cast("double"))
        return {"value": F.when(F.count(F.when(by, x)) > 0, share) if k.kind == "rate" else share}
    if k.kind == "date_diff":
        a, b = col("start"), col("end")
        if a is None:
            return None
        b = F.coalesce(b, as_of) if b is not None and p.get("open_end") else as_of if b is None and p.get("open_end") else b
        if b is None:
            return None
        days = F.floor((F.unix_timestamp(b.cast("timestamp")) - F.unix_timestamp(a.cast("timestamp"))) / 86400)
        kept = F.when(by & (days >= 0), days)
        return {"value": F.try_divide(F.sum(kept).cast("double"), F.count(kept).cast("double")) / UNIT_DAYS[p.get("unit", "days")]}
    if k.kind == "share_where_num":
        v, c = col("value_field"), col("cond_field")
        if v is None or c is None:
            return None
        test = {">": c > p["threshold"], ">=": c >= p["threshold"], "<": c < p["threshold"], "<=": c <= p["threshold"]}[p["op"]]
        return {"value": 100.0 * F.try_divide(F.coalesce(periods.money(F.when(by & test, v)), F.lit(0.0)), periods.money(F.when(by, v)))}
    return {}


def distinct_counts(df: DataFrame, column: str, cut: dict[str, Column], name: str) -> DataFrame:
    """One row, <name>__<slice>: distinct values of a column in each slice, from one grouping by value with a flag for each
    slice, so no row is multiplied and no task holds a set of values."""
    flags = [F.max(F.when(by, 1).otherwise(0)).alias(f"_{s}") for s, by in cut.items()]
    once = df.where(F.col(column).isNotNull()).groupBy(F.col(column)).agg(*flags)
    return once.agg(*(F.coalesce(F.sum(f"_{s}"), F.lit(0)).cast("double").alias(f"{name}__{s}") for s in cut))


#: Buckets that a KPI's groups are dealt to before the largest of each are compared.
BUCKETS = 64


def by_value(df: DataFrame, cut: dict[str, Column], distinct: dict[str, str], top: dict[str, tuple[str, Column, int]]) -> DataFrame:
    """One row: <key>__<slice>, the distinct values of each column in distinct, and <key>__all, the share (percent) of the
    n largest groups in all of each (column, amount, n) in top. Null values and groups count as none.

    A row gives one tagged value for each key. Values are grouped once, with a flag for each slice and the sum of the
    amounts; each bucket of groups then hands on its n largest sums at most.
    """
    slices = [s for s in cut if s != "all"]
    tags = [(k, c, F.lit(None).cast("double"), 0) for k, c in distinct.items()] + [(k, c, v, n) for k, (c, v, n) in top.items()]
    cells = F.array(*(F.struct(F.lit(i).alias("tag"), F.col(c).cast("string").alias("v"), v.cast("double").alias("m")) for i, (_, c, v, _) in enumerate(tags)))
    rows = df.select(*(cut[s].alias(f"_{s}") for s in slices), F.explode(cells).alias("_c")).select(*(f"_{s}" for s in slices), "_c.*").where("v is not null")
    once = rows.groupBy("tag", "v").agg(*(F.max(f"_{s}").alias(f"_{s}") for s in slices), periods.money("m").alias("m"))
    most = max([n for *_, n in tags])
    bucket = W.partitionBy("tag", "_b").orderBy(F.desc_nulls_last("m"))
    ranked = once.withColumn("_b", F.pmod(F.xxhash64("v"), F.lit(BUCKETS))).withColumn("_r", F.row_number().over(bucket)) if most else once.withColumn("_r", F.lit(1))
    sums = ranked.groupBy("tag").agg(
        F.count(F.lit(1)).alias("all"),
        *(F.count_if(F.col(f"_{s}")).alias(s) for s in slices),
        periods.money("m").alias("total"),
        F.slice(F.sort_array(F.collect_list(F.when(F.col("_r") <= most, F.col("m"))), asc=False), 1, max(1, most)).alias("largest"),
    )
    out = []
    for i, (key, _, _, n) in enumerate(tags):
        of = lambda c, i=i: F.max(F.when(F.col("tag") == i, F.col(c)))
        if n:
            head = F.aggregate(F.slice(of("largest"), 1, n), F.lit(0.0), lambda a, x: a + x)
            out.append((100.0 * F.try_divide(head, of("total"))).alias(f"{key}__all"))
        else:
            out += [F.coalesce(of(s), F.lit(0)).cast("double").alias(f"{key}__{s}") for s in cut]
    return sums.agg(*out)


def top_share(df: DataFrame, by: str, value: str, n: int = 10, absolute: bool = False) -> DataFrame:
    """One row: the share (percent) of the n largest groups in all groups; null keys are left out."""
    v = F.abs(F.col(value)) if absolute else F.col(value)
    return by_value(df, {"all": F.lit(True)}, {}, {"value": (by, v, n)}).withColumnRenamed("value__all", "value")


def pack(df: DataFrame, kpis: Sequence[KPI], mapping: dict[str, str], when: str | None, as_of: Column | None = None) -> DataFrame:
    """key, value, previous, delta_pct, fmt, polarity of the KPIs that have a value."""
    as_of = F.current_timestamp() if as_of is None else as_of
    w = periods.bounds(df, when) if when else periods.Window("D", None, None, None)
    cut = {"all": F.lit(True)}
    if w.previous:
        cut |= {s: F.coalesce(periods.within(df, when, first, w.grain), F.lit(False)) for s, first in (("cur", w.current), ("prev", w.previous))}
    aggs, known, distinct, top, medians = [], {}, {}, {}, {}
    for k in kpis:
        p = k.params
        if k.kind == "distinct" and p["field"] in mapping:
            distinct[k.key] = mapping[p["field"]]
            known |= {(k.key, s): F.col(f"{k.key}__{s}") for s in cut}
            continue
        if k.kind == "top_share":
            if p["by"] in mapping and p["field"] in mapping:
                amount = F.col(mapping[p["field"]])
                top[k.key] = mapping[p["by"]], F.abs(amount) if p.get("absolute") else amount, p.get("n", 10)
            continue
        for s, by in cut.items():
            parts = aggregate(k, mapping, by, as_of)
            if parts and "median" in parts:
                medians[f"{k.key}__{s}"] = parts["median"]
                known[k.key, s] = F.col(f"{k.key}__{s}") * p.get("scale", 1.0)
            elif parts:
                aggs.append(parts["value"].alias(f"{k.key}__{s}"))
                known[k.key, s] = F.col(f"{k.key}__{s}")
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    if distinct or top:
        row = row.crossJoin(F.broadcast(by_value(df, cut, distinct, top)))  # one row each
    if medians:
        long = exact_quantiles.exact(df, [], medians, {"median": 0.5})
        row = row.crossJoin(F.broadcast(long.agg(*(F.max(F.when(F.col("name") == n, F.col("median"))).alias(n) for n in medians))))
    by_key = {k.key: k for k in kpis}

    def value(key: str, s: str, depth: int = 0) -> Column | None:
        k = by_key.get(key)
        if k is None or depth > 4:
            return None
        if (key, s) in known:
            return known[key, s]
        if k.kind == "ratio":
            a = value(k.params["num"], s, depth + 1)
            parts = [value(x, s, depth + 1) for x in k.params.get("den_sum", [k.params.get("den")])]
            b = [F.coalesce(x, F.lit(0.0)) for x in parts if x is not None]
            if a is None or not b:
                return None
            return F.try_divide(a, F.nullif(sum(b[1:], b[0]), F.lit(0.0))) * (100.0 if k.params.get("as_percent") else 1.0)
        if k.kind == "growth" and w.previous and s == "all":
            a, b = value(k.params["kpi"], "cur", depth + 1), value(k.params["kpi"], "prev", depth + 1)
            return None if a is None or b is None else 100.0 * F.try_divide(a - b, F.abs(b))
        return None

    rows = []
    for k in kpis:
        v = F.col(f"{k.key}__all") if k.key in top else value(k.key, "all") if k.kind != "top_share" else None
        if v is None:
            continue
        cur, prev = (value(k.key, s) if w.previous and k.kind not in ("growth", "top_share") else None for s in ("cur", "prev"))
        delta = 100.0 * F.try_divide(cur - prev, F.abs(prev)) if cur is not None and prev is not None else F.lit(None)
        rows.append(F.struct(F.lit(k.key).alias("key"), v.cast("double").alias("value"), (prev if prev is not None else F.lit(None)).cast("double").alias("previous"), delta.cast("double").alias("delta_pct"), F.lit(k.fmt).alias("fmt"), F.lit(k.polarity).alias("polarity")))
    empty = "key string, value double, previous double, delta_pct double, fmt string, polarity string"
    out = row.select(F.explode(F.array(*rows)).alias("k")).select("k.*") if rows else df.sparkSession.createDataFrame([], empty)
    return out.where("value is not null and not isnan(value)")


# --- formulas on a single column


def universal(df: DataFrame, column: str) -> DataFrame:
    """Total, mean, median, spread, null rate, quartiles, bias-corrected skewness and |z| > 3 outliers of a column.

    NaN counts as missing. Statistics of no values are null, as are those of a spread that a single value has not.
    """
    x = periods.number(column)
    n, sd = F.count(x), F.stddev_samp(x)
    stats = df.agg(
        periods.money(x).alias("total"),
        periods.mean(x).alias("mean"),
        sd.alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        n.alias("count"),
        F.round(100.0 * F.count_if(x.isNull()) / F.nullif(F.count(F.lit(1)), F.lit(0)), 2).alias("null_rate"),
        F.round(F.try_divide(sd, F.nullif(F.avg(x), F.lit(0.0))) * 100, 2).alias("cv"),
        F.round(F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)), 4).alias("skew"),
        F.avg(x).alias("_m"),
    )
    row = F.broadcast(stats.select(F.col("_m"), F.nullif("std", F.lit(0.0)).alias("_s")))  # one row
    outliers = df.crossJoin(row).agg(F.count_if(F.abs((x - F.col("_m")) / F.col("_s")) > 3).alias("outliers"))
    parts = quantiles(df, column, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return stats.drop("_m").crossJoin(F.broadcast(parts)).withColumn("iqr", F.col("p75") - F.col("p25")).crossJoin(F.broadcast(outliers))


def positions(df: DataFrame, column: str, descending: bool, weight: str | None = None) -> DataFrame:
    """value, copies and rank before it of each distinct value: ranks without a row-level sort in one task.

    Distinct values are dealt to ranges cut at approximate quantiles, so ranges are alike however the values lie; exact
    ranks come from a window inside each range and the counts of the ranges before it, a row for each range.
    """
    x = periods.number(column)
    counts = df.where(x.isNotNull()).groupBy(x.alias("value")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("copies"))
    counts = counts.withColumn("_bin", range_of(F.col("value"), df, x))
    order = F.desc if descending else F.asc
    sums = counts.groupBy("_bin").agg(F.sum("copies").alias("_n"))
    before = sums.select("_bin", F.coalesce(F.sum("_n").over(W.orderBy(order("_bin")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_bin").orderBy(order("value")).rowsBetween(W.unboundedPreceding, -1)
    return counts.join(F.broadcast(before), "_bin").select("value", "copies", (F.col("_before") + F.coalesce(F.sum("copies").over(inside), F.lit(0))).alias("before"))


def range_of(value: Column, df: DataFrame, x: Column) -> Column:
    """The number of the range that a value is in, ascending with it: of RANGES cut at approximate quantiles of x in df (one
    aggregate), each cut evenly again where it would have more than about RANGE_ROWS rows."""
    parts = F.percentile_approx(x, F.lit([i / RANGES for i in range(1, RANGES)]), F.lit(20 * RANGES))
    r = df.agg(parts.alias("cuts"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()
    cuts, finer = sorted(set(r.cuts or [])), -(-r.n // (RANGES * RANGE_ROWS))

    def halve(low: int, high: int) -> Column:
        """How many of cuts[low:high] lie below the value, and low more; a few comparisons, all in generated code."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > cuts[middle], halve(middle + 1, high)).otherwise(halve(low, middle))

    if finer <= 1:
        return halve(0, len(cuts))
    ends = [float(e) for e in (r.lo, *cuts, r.hi)]
    at = lambda some: F.get(F.array(*(F.lit(e) for e in some)), halve(0, len(cuts)))
    inside = F.floor(F.try_divide(value - at(ends[:-1]), at(ends[1:]) - at(ends[:-1])) * finer)
    return halve(0, len(cuts)) * finer + F.greatest(F.lit(0), F.least(F.coalesce(inside, F.lit(0)), F.lit(finer - 1)))


def quantiles(df: DataFrame, column: str, wanted: dict[str, float]) -> DataFrame:
    """One row, a column for each wanted quantile, exact with linear interpolation; null for a column without values."""
    found = exact_quantiles.exact(df, [], {"x": F.col(column)}, wanted)
    return found.agg(*(F.max(c).alias(c) for c in wanted))


def pareto(df: DataFrame, column: str, share: float = 0.2) -> DataFrame:
    """Percent of the total held by the top share of rows (at least one)."""
    n = df.where(periods.number(column).isNotNull()).count()
    top = max(1, int(n * share))
    p = positions(df, column, True)
    taken = F.greatest(F.lit(0), F.least(F.col("copies"), F.lit(top) - F.col("before")))
    return p.agg(F.round(100.0 * F.try_divide(periods.money(F.col("value") * taken), periods.money(F.col("value") * F.col("copies"))), 1).alias("pareto"))


def gini(df: DataFrame, column: str) -> DataFrame:
    """Gini coefficient over rows in ascending order, four decimals."""
    p = positions(df, column, False)
    n, b = F.col("copies"), F.col("before")
    ranks = (n * b + n * (n + 1) / 2).cast("decimal(20,0)")  # sum of the ranks of the copies
    s = p.agg(F.sum(ranks.cast("double") * F.col("value")).alias("w"), periods.money(F.col("value") * n).alias("t"), F.sum(n).alias("n"))
    return s.select(F.round(2 * F.try_divide(F.col("w"), F.col("n") * F.col("t")) - F.try_divide(F.col("n") + 1, F.col("n")), 4).alias("gini"))


def flows(df: DataFrame, column: str) -> DataFrame:
    """Net, inflow and outflow totals, and their ratio."""
    x = F.col(column)
    s = df.agg(periods.money(x).alias("net_total"), periods.money(F.when(x > 0, x)).alias("inflows"), periods.money(F.when(x < 0, x)).alias("outflows"))
    return s.withColumn("in_out_ratio", F.round(F.try_divide("inflows", F.abs("outflows")), 4))


# Words that mark the column a domain's KPIs are of, in order of preference.
TARGETS = {
    "sales": ["revenue", "sales", "amount", "price", "total"],
    "hr": ["salary", "wage", "compensation", "pay"],
    "finance": ["amount", "balance", "value", "cost", "expense"],
    "marketing": ["spend", "cost", "revenue", "value"],
}


def target(numbers: Sequence[str], domain: str) -> str | None:
    """The numeric column that a domain's KPIs are of: the first that holds the domain's best word, else the first."""
    named = (n for word in TARGETS.get(domain, []) for n in numbers if word in n.lower())
    return next(named, numbers[0] if numbers else None)


def selection(df: DataFrame, column: str, domain: str) -> DataFrame:
    """domain, key, value: the universal KPIs of a column, and those of sales, hr or finance. KPIs without a value, as of an
    empty column, have no row."""
    base = universal(df, column)
    rows = _long(base.withColumnRenamed("skew", "skewness"), "universal")
    own = None
    if domain == "sales":
        own = base.select(F.col("total").alias("total_revenue"), F.col("mean").alias("aov"), F.col("std").alias("rev_std")).crossJoin(F.broadcast(pareto(df, column)))
    elif domain == "hr":
        heads = df.where(F.col(column).isNotNull()).select(column).distinct().agg(F.count(F.lit(1)).alias("headcount"))
        own = base.select(F.col("mean").alias("avg_salary")).crossJoin(F.broadcast(heads)).crossJoin(F.broadcast(gini(df, column)))
    elif domain == "finance":
        own = flows(df, column)
    return (rows.unionByName(_long(own, domain)) if own is not None else rows).where("value is not null")


def _long(row: DataFrame, domain: str) -> DataFrame:
    """A row for each column of a frame of one row."""
    doubles = row.select(*(F.col(c).cast("double").alias(c) for c in row.columns))
    return doubles.unpivot([], row.columns, "key", "value").select(F.lit(domain).alias("domain"), "key", "value")
