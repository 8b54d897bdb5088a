"""Data audit: issues of a table and the score they leave of 100.

One aggregate serves row count, gaps in required fields and negatives; one unpivot, grouped by cell value, serves
constant and inconsistently spelled columns, so no distinct count multiplies the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COST = {"high": 18, "medium": 8, "low": 3}
SCHEMA = "check string, column string, severity string, affected long"


def _issues(df: DataFrame, check: str, column: Column | str, severity: Column | str, affected: Column) -> DataFrame:
    plain = lambda c: F.lit(c) if isinstance(c, str) else c
    return df.select(F.lit(check).alias("check"), plain(column).cast("string").alias("column"), plain(severity).alias("severity"), affected.cast("long").alias("affected")).where("severity is not null")


def totals(df: DataFrame, required: Sequence[str], quantities: Sequence[str]) -> DataFrame:
    """Empty table, missing required values (over 2 %: medium, over 20 %: high), negative quantities."""
    n = F.count(F.lit(1))
    cells = [
        *(F.struct(F.lit("missing").alias("check"), F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("affected")) for c in required),
        *(F.struct(F.lit("negative").alias("check"), F.lit(c).alias("column"), F.count_if(F.col(c) < 0).alias("affected")) for c in quantities),
        F.struct(F.lit("empty").alias("check"), F.lit(None).cast("string").alias("column"), F.when(n == 0, 1).otherwise(0).cast("long").alias("affected")),
    ]
    x = df.agg(n.alias("n"), F.array(*cells).alias("cells")).select("n", F.explode("cells").alias("x")).select("n", "x.*")
    share = F.col("affected") / F.nullif("n", F.lit(0))
    severity = (
        F.when((F.col("check") == "missing") & (share > 0.2), "high")
        .when((F.col("check") == "missing") & (share > 0.02), "medium")
        .when((F.col("check") == "negative") & (F.col("affected") > 0), "medium")
        .when((F.col("check") == "empty") & (F.col("affected") > 0), "high")
    )
    return x.select("check", "column", severity.alias("severity"), "affected").where("severity is not null")


def duplicates(df: DataFrame) -> DataFrame:
    """Rows equal to another in every column, the first of each not counted; the share sets the severity."""
    once = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    t = once.agg(F.sum("_n").alias("n"), F.sum(F.col("_n") - 1).alias("d"))
    share = F.col("d") / F.col("n")
    return _issues(t, "duplicates", F.lit(None), F.when(share > 0.05, "high").when(share > 0.01, "medium").when(share > 0, "low"), F.col("d"))


def day_gaps(df: DataFrame, when: str) -> DataFrame:
    """One row: days with rows, the median and the longest distance between them."""
    days = df.where(F.col(when).isNotNull()).select(F.to_date(when).alias("d")).distinct()
    gap = days.withColumn("gap", F.datediff("d", F.lag("d").over(W.orderBy("d"))))
    return gap.agg(F.count(F.lit(1)).alias("days"), F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.max("gap").cast("long").alias("longest"))


def folding(df: DataFrame, column: str) -> DataFrame:
    """One row: distinct values, and distinct values without case and outer blanks, from one grouping by value."""
    once = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    folded = once.groupBy(F.lower(F.trim("v"))).agg(F.count(F.lit(1)).alias("raw"))
    return folded.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.count(F.lit(1)).alias("folded"))


def cell_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """col, n_rows, nulls, n_unique, ratio of the columns (all by default), exactly: a pair for each cell, summed in map
    tasks by value, so no distinct count multiplies the rows."""
    names = list(df.columns if columns is None else columns)
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("v")) for c in names))).alias("x")).select("x.*")
    once = cells.groupBy("col", "v").agg(F.count(F.lit(1)).alias("n"))
    out = once.groupBy("col").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("n_unique"))
    return out.withColumn("ratio", F.round(F.col("n_unique") / F.col("n_rows"), 4))


def gaps(df: DataFrame, when: str) -> DataFrame:
    """Gaps in the days of `when` beyond the larger of 7 days and 6 typical gaps; needs 10 days. Affected: such gaps.

    The window is over distinct days, a few thousand for each decade, whatever the table holds.
    """
    days = df.where(F.col(when).isNotNull()).select(F.to_date(when).alias("d")).distinct()
    gap = days.withColumn("gap", F.datediff("d", F.lag("d").over(W.orderBy("d"))))
    t = gap.agg(F.count(F.lit(1)).alias("n"), F.percentile("gap", F.lit(0.5)).alias("typical"), F.collect_list("gap").alias("all"))
    big = F.size(F.filter("all", lambda g: g > F.greatest(F.lit(7.0), F.col("typical") * 6)))
    return _issues(t, "gap", when, F.when((F.col("n") >= 10) & (big > 0), "medium"), big)


def partial_month(df: DataFrame, when: str, as_of: Column) -> DataFrame:
    """The latest month is that of as_of, and as_of is before its 25th."""
    t = df.agg(F.max(when).alias("last"))
    now = (F.trunc("last", "month") == F.trunc(as_of, "month")) & (F.dayofmonth(as_of) < 25)
    return _issues(t, "partial", when, F.when(now, "low"), F.lit(1))


def spellings(df: DataFrame) -> DataFrame:
    """Text columns of 2 to 200 values of which some differ by case or outer blanks alone; and columns of one value.

    A sketch of each column rules out those of far more values, so their cells are never shuffled.
    """
    if not df.columns:
        return df.sparkSession.createDataFrame([], SCHEMA)
    sketch = df.agg(*(F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(df.columns))).first()
    few = [f for i, f in enumerate(df.schema) if sketch[f"d{i}"] <= 400]
    if not few:
        return df.sparkSession.createDataFrame([], SCHEMA)
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.typeName() == "string").alias("text"), F.col(f"`{f.name}`").cast("string").alias("v")) for f in few))).alias("x")).select("x.*")
    once = cells.groupBy("column", "text", "v").agg(F.count(F.lit(1)).alias("n"))
    folded = once.groupBy("column", "text", F.lower(F.trim("v")).alias("f")).agg(F.count("v").alias("raw"))
    t = folded.groupBy("column", "text").agg(F.sum("raw").alias("raw"), F.count("f").alias("folded"))
    odd = _issues(t.where("text and raw between 2 and 200"), "inconsistent", F.col("column"), F.when(F.col("raw") > F.col("folded"), "medium"), F.col("raw") - F.col("folded"))
    flat = t.agg(F.count_if(F.col("raw") <= 1).alias("n"))
    return odd.unionByName(_issues(flat, "constant", F.lit(None), F.when(F.col("n") > 0, "low"), F.col("n")))


def audit(df: DataFrame, required: Sequence[str] = (), quantities: Sequence[str] = (), when: str | None = None, as_of: Column | None = None) -> DataFrame:
    """check, column, severity, affected, score of every issue; the score repeats. No issue: one row with nulls and 100."""
    found = totals(df, required, quantities).unionByName(duplicates(df)).unionByName(spellings(df))
    if when:
        found = found.unionByName(gaps(df, when))
        if as_of is not None:
            found = found.unionByName(partial_month(df, when, as_of))
    blank = found.agg(F.max(F.col("check") == "empty").alias("empty"), F.sum(F.element_at(F.create_map(*(F.lit(x) for kv in COST.items() for x in kv)), F.col("severity"))).alias("cost"))
    score = blank.select(F.when(F.col("empty"), 0).otherwise(F.greatest(F.lit(0), 100 - F.coalesce("cost", F.lit(0)))).cast("long").alias("score"))
    return score.join(found, F.lit(True), "left").select("check", "column", "severity", "affected", "score")
