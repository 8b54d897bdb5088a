"""Charts: which ones suit a table, and the rows that each kind draws. Drawing is left to the caller.

Marks are small: every kind groups, bins or takes a top-k in Spark. Kinds with a mark for each group take the largest ones
and show the rest as Others, so marks don't grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import analytics, curves, kpi, periods, quantiles, semantics, verbs

#: Groups that a box plot or a pie can show, groups of a bar chart, colours, and bars of a tornado.
FEW, BARS, COLOURS, MOVES = 8, 12, 8, 12


@dataclass(frozen=True)
class Chart:
    kind: str
    title: str
    x: str
    y: str | None = None
    color: str | None = None


def recommend(columns: Sequence[semantics.Column], most: int = 5) -> list[Chart]:
    """Charts for a profiled table, the most telling first; none for a table without numbers, dates or groups."""
    when, group = (next((c for c in columns if c.role == role), None) for role in ("temporal", "categorical"))
    numbers = [c.name for c in columns if c.role in ("continuous", "discrete")]
    small = group is not None and group.distinct <= FEW

    def offers() -> Iterator[Chart]:
        if when and numbers:
            yield Chart("line", f"{numbers[0]} as {when.name} goes on", when.name, numbers[0])
        if len(numbers) > 1:
            yield Chart("scatter", f"{numbers[0]} beside {numbers[1]}, point by point", numbers[0], numbers[1], group.name if group else None)
        if group and numbers:
            title = f"Spread of {numbers[0]} in each {group.name}" if small else f"{numbers[0]} of the largest {group.name}"
            yield Chart("box" if small else "bar", title, group.name, numbers[0])
        if numbers:
            yield Chart("histogram", f"How often {numbers[0]} takes which values", numbers[0])
        if group:
            yield Chart("pie" if small else "bar", f"Rows of each {group.name}" if small else f"Rows of the largest {group.name}", group.name)

    return list(offers())[:most]


def marks(df: DataFrame, chart: Chart) -> DataFrame:
    """The rows that a chart draws. A chart without y counts rows."""
    x, y, color = chart.x, chart.y, chart.color
    if chart.kind in ("line", "area"):
        return line(df, x, y)
    if chart.kind in ("bar", "pie", "donut", "funnel"):
        return verbs.others(df, x, y, {"bar": BARS, "funnel": BARS}.get(chart.kind, FEW))
    if chart.kind == "stacked_bar":
        return stacked(df, x, y, color)
    if chart.kind == "box":
        return box(df, x, y)
    if chart.kind == "violin":
        return curves.violin(df, x, y, _largest(df.where(periods.number(y).isNotNull()), x, None, FEW))
    if chart.kind == "trendline":
        return curves.lowess(df, x, y)
    if chart.kind == "scatter_matrix":
        return scatter_matrix(df, [x, y, *([color] if color else [])])
    if chart.kind == "scatter":
        return verbs.seeded_sample(df.select(x, y, *([color] if color else [])).where(F.col(x).isNotNull() & F.col(y).isNotNull()))
    if chart.kind == "histogram":
        return verbs.histogram(df, x)
    if chart.kind == "density":
        return verbs.density(df, x, y)
    if chart.kind == "heat":
        return heat(df, x)
    if chart.kind in ("sunburst", "treemap"):
        return verbs.hierarchy_top(df, [x, color] if color else [x], y, FEW)
    raise ValueError(f"no chart of kind {chart.kind!r}")


def _total(value: str | None) -> Column:
    return F.coalesce(periods.money(value), F.lit(0.0)) if value else F.count(F.lit(1)).cast("double")


def line(df: DataFrame, when: str, value: str | None) -> DataFrame:
    """period, value over periods of the grain that the span asks for, the trailing partial one left out."""
    w = periods.bounds(df, when)
    return periods.series(df, when, _total(value), w.grain, w).select("period", "value")


def _largest(df: DataFrame, group: str, value: str | None, most: int) -> list[str]:
    """Names of the groups with the largest totals, ties by name; at most `most` of them reach the driver."""
    sums = df.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("g")).agg(_total(value).alias("t"))
    return [r.g for r in sums.orderBy(F.desc("t"), "g").limit(most).collect()]


def stacked(df: DataFrame, when: str, value: str | None, color: str) -> DataFrame:
    """period, color, value: the COLOURS largest groups, all others (nulls too) as Others."""
    w = periods.bounds(df, when)
    group = F.col(color).cast("string")
    name = F.when(group.isin(_largest(df, color, value, COLOURS)), group).otherwise("Others")
    dated = df.where(F.col(when).isNotNull()).groupBy(periods.period_of(when, w.grain).alias("period"), name.alias("color")).agg(_total(value).alias("value"))
    return dated.where(F.col("period") != F.lit(w.dropped)) if w.dropped else dated


def scatter_matrix(df: DataFrame, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """a, b, ba, bb, n: the counts of each pair of columns on a grid of bins x bins, all pairs in two scans. Values that are
    not finite have no place; a column without spread is one bin, 0."""
    xs = {c: verbs.finite(c) for c in columns}
    r = df.agg(*(f(x).alias(f"{n}{i}") for i, x in enumerate(xs.values()) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    at = {}
    for i, (c, x) in enumerate(xs.items()):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        place = F.least(F.floor((x - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)) if lo is not None and hi > lo else F.lit(0)
        at[c] = F.when(x.isNotNull(), place.cast("long"))
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), at[a].alias("ba"), at[b].alias("bb")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("ba is not null and bb is not null")
    return cells.groupBy("a", "b", "ba", "bb").agg(F.count(F.lit(1)).alias("n"))


def facets(df: DataFrame, x: str, y: str, facet: str, most: int = 4, bins: int = 20) -> DataFrame:
    """facet, bx, by, n: a density grid for each of the largest groups, on axes that all share."""
    rows = df.where(F.col(facet).cast("string").isin(_largest(df, facet, None, most)))
    cx, cy = verbs.finite(x), verbs.finite(y)
    rows = rows.select(F.col(facet).cast("string").alias("facet"), cx.alias("x"), cy.alias("y")).where("x is not null and y is not null")
    r = rows.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    at = lambda c, lo, hi: F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("long") if lo is not None and hi > lo else F.lit(0).cast("long")
    return rows.groupBy("facet", at("x", r.x0, r.x1).alias("bx"), at("y", r.y0, r.y1).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def small_multiples(df: DataFrame, when: str, value: str, segment: str, most: int = 4) -> DataFrame:
    """segment, period, value: a series for each of the largest segments; periods without rows are absent."""
    w = periods.bounds(df, when)
    group = F.col(segment).cast("string")
    rows = df.where(F.col(when).isNotNull() & group.isin(_largest(df, segment, value, most)))
    out = rows.groupBy(group.alias("segment"), periods.period_of(when, w.grain).alias("period")).agg(_total(value).alias("value"))
    return out.where(F.col("period") != F.lit(w.dropped)) if w.dropped else out


def box(df: DataFrame, group: str, value: str) -> DataFrame:
    """segment, n, min, p25, median, p75, max of the FEW largest groups by rows, exact.

    All groups' quantiles are found in two passes, without a group in one task."""
    rows = df.where(F.col(group).cast("string").isin(_largest(df.where(periods.number(value).isNotNull()), group, None, FEW)))
    rows = rows.select(F.col(group).cast("string").alias("segment"), periods.number(value).alias("v")).where("v is not null")
    ends = rows.groupBy("segment").agg(F.min("v").alias("min"), F.max("v").alias("max"))  # FEW rows
    parts = quantiles.exact(rows, ["segment"], {"v": F.col("v")}, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return parts.join(F.broadcast(ends), "segment").select("segment", "n", "min", "p25", "median", "p75", "max")


def heat(df: DataFrame, when: str, hours: int = 3) -> DataFrame:
    """weekday (Monday 0), hour, n where the times show more than `hours` different hours; else hour is null throughout."""
    s = df.where(F.col(when).isNotNull()).groupBy(F.weekday(when).cast("long").alias("weekday"), F.hour(F.col(when).cast("timestamp")).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    timed = s.agg(F.count_distinct("hour").alias("_h"))
    hour = F.when(F.col("_h") > hours, F.col("hour"))
    return s.crossJoin(F.broadcast(timed)).groupBy("weekday", hour.alias("hour")).agg(F.sum("n").alias("n"))


def tornado(kpis: DataFrame) -> DataFrame:
    """key, delta_pct, favourable of the MOVES first KPIs by key that have a comparison; no row for fewer than two."""
    moved = analytics.scorecard(kpis).where("delta_pct is not null").orderBy("key").limit(MOVES)
    enough = moved.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy())).where("_n > 1")
    return enough.select("key", "delta_pct", (F.col("verdict") == "favourable").alias("favourable"))


def _floating(steps: DataFrame) -> DataFrame:
    """label, start, stop of bars that stand on the sum of those before, from rows of step, label, delta."""
    end = F.sum("delta").over(W.orderBy("step"))
    return steps.select("step", "label", F.round(end - F.col("delta"), 2).alias("start"), F.round(end, 2).alias("stop"))


def waterfall(df: DataFrame, when: str, value: str, segment: str, w: periods.Window, top: int = 5) -> DataFrame:
    """step, label, start, stop: from the previous period's total through the largest moves and Others to the current one."""
    moves = analytics.bridge(df, when, value, segment, w, top)
    last = F.col("segment") == "Others"
    order = W.orderBy(last, F.desc(F.abs("delta")), "segment")
    before = moves.agg(F.lit(0).alias("step"), F.lit("previous").alias("label"), F.sum("previous").alias("delta"))
    steps = moves.select(F.row_number().over(order).alias("step"), F.col("segment").alias("label"), "delta")
    bars = _floating(before.unionByName(steps))
    total = moves.agg(F.lit(top + 2).alias("step"), F.lit("current").alias("label"), F.lit(0.0).alias("start"), F.round(F.sum("current"), 2).alias("stop"))
    return bars.unionByName(total)


def effects(df: DataFrame, when: str, value: str, unit: str | None, w: periods.Window) -> DataFrame:
    """step, label, start, stop: the move as its volume and its rate effect."""
    v = analytics.volume_rate(df, when, value, unit, w)
    bars = [("previous", F.lit(0.0), F.col("m0")), ("volume", F.col("m0"), F.col("m0") + F.col("volume_effect")), ("rate", F.col("m0") + F.col("volume_effect"), F.col("m1")), ("current", F.lit(0.0), F.col("m1"))]
    rows = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"), F.round(a, 2).alias("start"), F.round(b, 2).alias("stop")) for i, (label, a, b) in enumerate(bars)))
    return v.select(F.explode(rows).alias("r")).select("r.*")
