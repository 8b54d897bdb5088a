"""Exact quantiles of many columns and groups at once, in two passes, without a group's values in one task.

The first pass keeps a quantile sketch of each group and column (of bounded size, merged from map tasks), which brackets
each wanted quantile between two values. The second counts what lies below the bracket and, for the values inside it,
the copies of each; the exact order statistics are found among those. A bracket holds about 48 / ACCURACY of a large
group's rows, so a group of 10 ** 9 rows leaves some 10 ** 6 values to be put in order. That a bracket holds the wanted places is
checked in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import staging
from . import periods

#: A sketch is off by one rank in so many at most; brackets reach at least three times as far on both sides, and by two
#: ranks more: small groups take the wider ones of these.
ACCURACY = 50_000
SLACKS = [3.0 / ACCURACY * 8**i for i in range(1, 6)] + [1.0]

#: So many groups are few: their sketches go to all tasks, some 200 bytes each. The rows of more groups meet theirs in so
#: many tasks a group.
FEW, DEALT = 20_000, 16


def _dealt(long: DataFrame, sketch: DataFrame, by: list[str]) -> DataFrame:
    """long with the columns of sketch, of which there are many; the rows of one group are dealt to DEALT tasks."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("_part")
    dealt = long.withColumn("_part", (F.monotonically_increasing_id() % DEALT).cast("int"))
    return dealt.join(sketch.select("*", parts), [*by, "_part"]).drop("_part")


def exact(df: DataFrame, keys: list[str], values: dict[str, Column], wanted: dict[str, float]) -> DataFrame:
    """keys, name (of values), n and a column for each wanted quantile, with linear interpolation as pandas has it.

    Null and NaN count as missing. With keys the sketch runs at once. Groups with a null key are left out, and so is a name without values in a group.
    """
    named = F.array(*(F.struct(F.lit(n).alias("name"), periods.number(c).alias("x")) for n, c in values.items()))
    long = df.dropna(subset=keys) if keys else df
    long = long.select(*keys, F.explode(named).alias("_c")).select(*keys, "_c.*").where("x is not null")
    by, qs = [*keys, "name"], list(wanted.values())
    probabilities = [min(1.0, max(0.0, q + s)) for q in qs for slack in SLACKS for s in (-slack, slack)]
    sketch = long.groupBy(by).agg(F.percentile_approx("x", F.lit(probabilities), F.lit(ACCURACY)).alias("_cuts"), F.count(F.lit(1)).alias("n"))
    level = F.lit(len(SLACKS) - 1)
    for i, slack in reversed(list(enumerate(SLACKS[:-1]))):
        level = F.when(F.col("n") * (slack - 3.0 / ACCURACY) >= 2, i).otherwise(level)
    picked = F.transform(F.sequence(F.lit(0), F.lit(2 * len(qs) - 1)), lambda j: F.get("_cuts", (j / 2).cast("int") * 2 * len(SLACKS) + 2 * level + j % 2))
    sketch = sketch.select(*by, "n", picked.alias("_cuts"))
    if keys:  # its size tells how it is joined; few groups don't bring the table together by group
        sketch = staging.settle(sketch)
    few = not keys or sketch.limit(FEW + 1).count() <= FEW
    rows = long.join(F.broadcast(sketch), by) if few else _dealt(long, sketch, by)

    def cell(i: int) -> Column:
        low, high = F.get("_cuts", F.lit(2 * i)), F.get("_cuts", F.lit(2 * i + 1))
        below, inside = F.col("x") < low, (F.col("x") >= low) & (F.col("x") <= high)
        return F.when(below | inside, F.struct(F.lit(i).alias("q"), F.when(inside, F.col("x")).alias("v")))

    cells = rows.select(*by, "n", F.explode(F.array(*(cell(i) for i in range(len(qs))))).alias("_c")).where("_c is not null").select(*by, "n", "_c.*")
    counts = cells.groupBy(*by, "q", "v").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    up = W.partitionBy(*by, "q").orderBy(F.asc_nulls_first("v")).rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("b", F.coalesce(F.sum("c").over(up), F.lit(0)))
    place = F.element_at(F.array(*(F.lit(float(q)) for q in qs)), F.col("q") + 1) * (F.col("n") - 1)
    at = lambda p: F.max(F.when(F.col("v").isNotNull() & (F.col("b") <= p) & (p < F.col("b") + F.col("c")), F.col("v")))
    found = placed.groupBy(*by, "q").agg(F.max("n").alias("n"), at(F.floor(place)).alias("lo"), at(F.ceil(place)).alias("hi"), F.max(place - F.floor(place)).alias("part"))
    held = F.assert_true(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.lit("a quantile lies outside its bracket"))
    between = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part"))
    checked = found.select(*by, "n", "q", F.when(held.isNull(), between).alias("v"))
    return checked.groupBy(by).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("q") == i, F.col("v"))).alias(name) for i, name in enumerate(wanted)))
