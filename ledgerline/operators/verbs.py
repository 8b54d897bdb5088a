"""Ad-hoc verbs: filters, cleaning, grouping, resampling, rolling means, tables and tests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import periods, quantiles


def where(df: DataFrame, column: str, op: str, literal: str) -> DataFrame:
    """== != > >= < <= with the literal in the column's type; contains and not contains ignore case. Null equals, contains
    and exceeds nothing, so != and not contains keep it."""
    c = F.col(column)
    if op in ("contains", "not contains"):
        hit = F.coalesce(F.contains(F.lower(c.cast("string")), F.lower(F.lit(literal))), F.lit(False))
        return df.where(hit if op == "contains" else ~hit)
    v = F.lit(literal).cast(df.schema[column].dataType)
    return df.where({"==": c == v, "!=": ~c.eqNullSafe(v), ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op])


def between_dates(df: DataFrame, column: str, first, last) -> DataFrame:
    return df.where(F.to_date(column).between(F.lit(first), F.lit(last)))


def mode(df: DataFrame, column: str):
    """The most frequent value, the smallest of several."""
    r = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).first()
    return r[0] if r else None


def fill_missing(df: DataFrame, column: str, how: str, constant=None) -> DataFrame:
    """Rows without a value dropped, or given the mode, mean, median or a constant. NaN of a numeric column counts as no
    value. A column without values stays as it is."""
    if df.schema[column].dataType.typeName() in ("float", "double"):
        df = df.withColumn(column, F.when(~F.isnan(column), F.col(column)))
    if how == "drop":
        return df.dropna(subset=[column])
    if how == "mode":
        value = mode(df, column)
    elif how == "constant":
        value = constant
    elif how == "mean":
        value = df.agg(F.avg(periods.number(column))).first()[0]
    else:
        found = quantiles.exact(df, [], {"x": F.col(column)}, {"median": 0.5}).first()
        value = found.median if found else None
    return df.withColumn(column, F.coalesce(column, F.lit(value))) if value is not None else df


def without_outliers(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """Rows within limit population deviations; rows of null or NaN stay, and so does every row where no spread is known
    (no values, one value, or an infinite one)."""
    x = periods.number(column)
    m, s = df.agg(F.avg(x), F.stddev_pop(x)).first()
    return df.where(x.isNull() | (F.abs((x - F.lit(m)) / F.lit(s)) <= limit)) if s and s == s else df


def duplicates(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows, duplicate rows."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


AGGREGATES = {
    "sum": periods.money,
    "mean": periods.mean,
    "max": F.max,
    "min": F.min,
    "count": F.count,
    "std": F.stddev_samp,
    "var": F.var_samp,
}


def group(df: DataFrame, keys: list[str], column: str, functions: list[str], order: Column | None = None) -> DataFrame:
    """Grouped aggregates; rows with a null key are left out. first and last need an order and skip nulls. NaN of a numeric
    column counts as missing.

    nunique groups by value first; medians come from exact quantiles, which split a group of any size; the other
    functions are one aggregate over the rows.
    """
    rows = df.dropna(subset=keys)
    if df.schema[column].dataType.typeName() in ("float", "double"):
        rows = rows.withColumn(column, F.when(~F.isnan(column), F.col(column)))
    x = F.col(column)
    ordered = {"first": lambda c: F.min_by(c, F.when(x.isNotNull(), order)), "last": lambda c: F.max_by(c, F.when(x.isNotNull(), order))}
    plain = [f for f in functions if f not in ("median", "nunique")]
    out = rows.groupBy(*keys).agg(*((AGGREGATES | ordered)[f](column).alias(f) for f in plain)) if plain else rows.select(*keys).distinct()
    if "nunique" in functions:
        values = rows.select(*keys, column).distinct()
        out = out.join(values.groupBy(*keys).agg(F.count(column).alias("nunique")), keys)
    if "median" in functions:  # groups without values have none
        out = out.join(quantiles.exact(rows, keys, {"x": x}, {"median": 0.5}).select(*keys, "median"), keys, "left")
    return out.select(*keys, *functions)


def value_counts(df: DataFrame, column: str, top: int) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(top)


def crosstab(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))


def resample(df: DataFrame, when: str, value: str, g: str = "M", label: str = "start") -> DataFrame:
    """Dense buckets of days, weeks (from Monday), months, quarters or years (D W M Q Y), labelled by their first or, with
    label "end", last day: an empty one has sum 0, count 0 and null otherwise."""
    s = df.where(F.col(when).isNotNull()).groupBy(periods.period_of(when, g).alias("bucket")).agg(periods.money(value).alias("s"), F.count(value).alias("c"), F.max(value).alias("max"), F.min(value).alias("min"))
    step = {"D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month", "Q": "interval 3 months", "Y": "interval 1 year"}[g]
    spine = s.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr(step))).alias("bucket"))
    named = F.date_sub((F.col("bucket") + F.expr(step)).cast("date"), 1).alias("bucket") if label == "end" else F.col("bucket")
    return spine.join(s, "bucket", "left").select(named, F.coalesce("s", F.lit(0.0)).alias("sum"), F.coalesce("c", F.lit(0)).alias("count"), F.try_divide("s", "c").alias("mean"), "max", "min")


def rolling_mean(series: DataFrame, k: int) -> DataFrame:
    return series.select("period", "value", F.round(F.avg("value").over(W.orderBy("period").rowsBetween(1 - k, 0)), 4).alias("rolling"))


def forward_fill(df: DataFrame, column: str, keys: list[str], order: str) -> DataFrame:
    return df.withColumn(column, F.last(column, ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def finite(column: str) -> Column:
    """A column as doubles, null where it is NaN or infinite: what has a place on an axis."""
    x = periods.number(column)
    return F.when(F.abs(x) < float("inf"), x)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """bin, n over clamp(rows // 15, 10, 40) bins of equal width; the largest value falls in the last bin. Values that are
    not finite have no bin; fewer than 20 values, or equal ones, have no histogram."""
    x = finite(column)
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()
    if r.n < 20 or r.lo == r.hi:
        return df.sparkSession.createDataFrame([], "bin long, n long")
    bins = min(40, max(10, r.n // 15))
    at = F.least(F.floor((x - F.lit(r.lo)) / F.lit((r.hi - r.lo) / bins)), F.lit(bins - 1))
    return df.where(x.isNotNull()).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Counts in a grid of bins x bins. Pairs that are not finite have no cell; a side of equal values is one bin, 0; an
    empty table has no cells."""
    cx, cy = finite(x), finite(y)
    rows = df.where(cx.isNotNull() & cy.isNotNull()).select(cx.alias("_x"), cy.alias("_y"))
    r = rows.agg(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1")).first()
    if r.x0 is None:
        return df.sparkSession.createDataFrame([], "bx long, by long, n long")

    def at(c: str, lo: float, hi: float) -> Column:
        return F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("long") if hi > lo else F.lit(0).cast("long")

    return rows.groupBy(at("_x", r.x0, r.x1).alias("bx"), at("_y", r.y0, r.y1).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def top_and_others(sums: DataFrame, key: str, values: list[str], order: list[Column], top: int) -> DataFrame:
    """The first `top` groups, and one row Others of what is left in all the others; no row if none are left. The groups
    are never sorted in one task: a top-k and a total are enough."""
    head = sums.orderBy(*order).limit(top)
    count = F.count(F.lit(1)).alias("_n")
    all_ = sums.agg(count, *(F.sum(v).alias(v) for v in values))
    some = head.agg(F.count(F.lit(1)).alias("_m"), *(F.sum(v).alias(f"_{v}") for v in values))
    rest = all_.crossJoin(F.broadcast(some)).where("_n > _m").select(F.lit("Others").alias(key), *((F.col(v) - F.col(f"_{v}")).alias(v) for v in values))
    return head.select(key, *values).unionByName(rest)


def others(df: DataFrame, key: str, value: str | None, top: int) -> DataFrame:
    """The top groups and the rest as Others; a null key is a group of its own."""
    total = periods.money(value) if value else F.count(F.lit(1)).cast("double")
    s = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("(null)")).alias("segment")).agg(total.alias("total"))
    return top_and_others(s, "segment", ["total"], [F.desc("total"), F.col("segment")], top).withColumn("total", F.round("total", 2))


def choices(df: DataFrame, column: str, most: int = 30) -> DataFrame:
    """value, n of the most frequent values as text, for a slicer; ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most)


def among(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose value, as text, is one of the chosen; no choice keeps every row."""
    return df.where(F.col(column).cast("string").isin(values)) if values else df


def keep_groups(df: DataFrame, key: str, least: int = 8, most: int = 12) -> DataFrame:
    """Rows of the `most` largest groups with `least` rows or more."""
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).orderBy(F.desc("_n"), key).limit(most)
    return df.join(F.broadcast(kept.select(key)), key, "left_semi")


def describe(df: DataFrame) -> DataFrame:
    """A row for each column: count, n_unique, top, freq (the most frequent value, ties by text), and for numbers mean,
    std, min, p25, p50, p75, max. NaN counts as missing. All columns are described in four scans, however many they are."""
    c = lambda n: F.col(f"`{n}`")
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("float", "double")}
    text = lambda n: F.when(~F.isnan(c(n)), c(n).cast("string")) if n in floats else c(n).cast("string")
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("col"), text(n).alias("v")) for n in df.columns))).alias("x")).select("x.*")
    once = cells.groupBy("col", "v").agg(F.count(F.lit(1)).alias("n"))
    most = once.groupBy("col").agg(F.max(F.when(F.col("v").isNotNull(), F.col("n"))).alias("freq"))
    base = once.groupBy("col").agg(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("count"), F.count("v").alias("n_unique"))
    top = once.join(most, "col").where(F.col("v").isNotNull() & (F.col("n") == F.col("freq"))).groupBy("col", "freq").agg(F.min("v").alias("top"))
    numbers = [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    every = df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(n) for n in df.columns))).alias("col"))  # columns of an empty table too
    out = every.join(base, "col", "left").join(top, "col", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("count", "n_unique")})
    if not numbers:
        return out.select("col", "count", "n_unique", "top", "freq", *(F.lit(None).cast("double").alias(n) for n in ("mean", "std", "min", "p25", "p50", "p75", "max")))
    xs = {n: periods.number(c(n)) for n in numbers}
    one = lambda n, x: F.struct(F.lit(n).alias("col"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    moments = df.agg(F.array(*(one(n, x) for n, x in xs.items())).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    parts = quantiles.exact(df, [], xs, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("n").withColumnRenamed("name", "col")
    return out.join(moments, "col", "left").join(parts, "col", "left").select("col", "count", "n_unique", "top", "freq", "mean", "std", "min", "p25", "p50", "p75", "max")


def summary_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What cleaning did: a row for each of rows, columns, missing, duplicates, with before, after and removed."""

    def one(df: DataFrame) -> DataFrame:
        missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
        counts = df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), missing.cast("long").alias("missing"))
        twice = df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))
        wide = counts.crossJoin(F.broadcast(twice))
        return wide.unpivot([], ["rows", "columns", "missing", "duplicates"], "item", "n")

    return one(before).withColumnRenamed("n", "before").join(one(after).withColumnRenamed("n", "after"), "item").withColumn("removed", F.col("before") - F.col("after"))


def smoothed(series: DataFrame, points: int = 10, noise: float = 0.4) -> DataFrame:
    """period, value, smooth: a trailing mean of seven (three at least) where the series has `points` periods or more and
    its relative changes spread by more than `noise`, else null. A series is one row for each period."""
    line, every = W.orderBy("period"), W.partitionBy()
    change = F.try_divide(F.col("value"), F.lag("value").over(line)) - 1
    s = series.withColumn("_c", change)
    noisy = (F.count("value").over(every) >= points) & (F.stddev_samp("_c").over(every) > noise)
    seven = line.rowsBetween(-6, 0)
    return s.select("period", "value", F.when(noisy & (F.count("value").over(seven) >= 3), F.avg("value").over(seven)).alias("smooth"))


def hierarchy(df: DataFrame, path: list[str], value: str) -> DataFrame:
    """Sums along a path of columns: a row for each prefix of the path, its columns beyond null, with its depth."""
    return df.rollup(*path).agg(F.grouping_id().alias("_g"), periods.money(value).alias("total")).select(*path, (F.lit(len(path)) - F.bit_count("_g")).cast("int").alias("depth"), "total")


def hierarchy_top(df: DataFrame, path: list[str], value: str, most: int = 8) -> DataFrame:
    """hierarchy() of the `most` largest children of each parent, the rest of them as one leaf Others.

    At most (most + 1) ^ depth marks, whose sums at every level are those of the whole. Null labels are '(null)', and an
    own label Others joins the rest. Children are ranked inside their parent, of which each task hands on its `most` largest.
    """
    label = [F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in path]
    now = df.select(*label, periods.number(value).alias("_v")).groupBy(*path).agg(periods.money("_v").alias("_v"))
    for i, c in enumerate(path):
        up, own = path[:i], path[: i + 1]
        order = W.partitionBy(*up).orderBy(F.desc_nulls_last("_t"), c)
        sums = now.where(F.col(c).isNotNull()).groupBy(*own).agg(periods.money("_v").alias("_t"))
        kept = sums.withColumn("_r", F.row_number().over(order)).where((F.col("_r") <= most) & (F.col(c) != "Others"))
        marked = now.join(F.broadcast(kept.select(*own, F.lit(True).alias("_k"))), own, "left")  # most ^ depth rows
        now = marked.select(*up, F.when(F.col("_k"), F.col(c)).when(F.col(c).isNotNull(), F.lit("Others")).alias(c), *(F.when(F.col("_k"), F.col(d)).alias(d) for d in path[i + 1 :]), "_v")
        now = now.groupBy(*path).agg(periods.money("_v").alias("_v"))
    out = hierarchy(now, path, "_v")
    real = [F.col("depth") <= F.lit(i) for i in range(len(path))]
    return out.where(F.forall(F.array(*(r | F.col(c).isNotNull() for r, c in zip(real, path))), lambda b: b))


def pivot_years(df: DataFrame, when: str, value: str, years: list[int] | None = None) -> DataFrame:
    """month and a column for each year with the month's sum, null where there is none."""
    rows = df.where(F.col(when).isNotNull()).select(F.month(when).cast("long").alias("month"), F.year(when).alias("_y"), F.col(value).alias("_v"))
    return rows.groupBy("month").pivot("_y", years).agg(periods.money("_v"))


def largest(df: DataFrame, column: str, context: list[str], most: int = 3) -> DataFrame:
    """The rows with the largest values, with their context; ties by the context."""
    return df.where(F.col(column).isNotNull()).orderBy(F.desc(column), *context).select(column, *context).limit(most)


def seeded_sample(df: DataFrame, most: int = 3_000, seed: int = 42) -> DataFrame:
    """At most `most` rows for a scatter plot, the same ones in every run."""
    return df.orderBy(F.xxhash64(*df.columns, F.lit(seed)), *df.columns).limit(most)


MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
NAMED_MONTH = r"(?i)^(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?:[-/ '.]*(\d{2}|\d{4}))?$"
# Fixed value: headers that may be months.
MONTH_HEADER = r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*([\s\-'/]*\d{2,4})?$|^\d{4}[-/]\d{1,2}$"


def period_of_header(header: str, year: int):
    """The first day of the month that a header names; the given year where it names none, years of two digits in this
    century; None for a word that only begins like a month, and for a month 13."""
    from datetime import date

    text = header.strip()
    if m := re.match(NAMED_MONTH, text):
        y = int(m[2]) if m[2] else year
        return date(y + 2000 if m[2] and len(m[2]) == 2 else y, MONTHS.index(m[1][:3].lower()) + 1, 1)
    if (m := re.match(r"^(\d{4})[-/](\d{1,2})$", text)) and 1 <= int(m[2]) <= 12:
        return date(int(m[1]), int(m[2]), 1)
    return None


def unpivot_wide(df: DataFrame, year: int | None = None) -> DataFrame:
    """Tables with five month-like headers or more beside one to four other columns become rows of period (a date) and
    value, if over 70 % of those headers are months and over half of their cells numbers; any other table stays as it is.

    Headers that only look like months have no period, and their cells no row. Cells that are no number stay as null.
    year is that of months without one: this year, if it isn't given.
    """
    from datetime import date

    wide = [c for c in df.columns if re.match(MONTH_HEADER, c.strip())]
    ids = [c for c in df.columns if c not in wide]
    dated = {c: d for c in wide if (d := period_of_header(c, year or date.today().year))}
    if len(wide) < 5 or not 1 <= len(ids) <= 4 or len(dated) <= 0.7 * len(wide):
        return df
    number = lambda c: F.regexp_replace(F.col(f"`{c}`").cast("string"), r"[,\s%₹$€£]", "").try_cast("double")
    s = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(number(c)).alias(f"c{i}") for i, c in enumerate(wide))).first()
    if not s.n or sum(s[f"c{i}"] for i in range(len(wide))) <= 0.5 * s.n * len(wide):
        return df
    cells = F.array(*(F.struct(F.lit(d).alias("period"), number(c).alias("value")) for c, d in dated.items()))
    return df.select(*(F.col(f"`{c}`") for c in ids), F.explode(cells).alias("_c")).select(*(F.col(f"`{c}`") for c in ids), "_c.period", "_c.value")


def unpivot_months(df: DataFrame, ids: list[str], months: list[str]) -> DataFrame:
    return df.unpivot(ids, months, "period", "value").where("value is not null")
