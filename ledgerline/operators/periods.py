"""Calendar periods: grain by span, trailing partial periods, current and previous period, period series."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
#: A trailing period is partial below this share of its length.
FULL_SHARE = 0.8
LEAST_DATED = 4


def grain(days: int) -> str:
    """Grain for a span in whole days."""
    return "D" if days <= 31 else "W" if days <= 183 else "M" if days <= 1100 else "Q"


def period_of(c: Column | str, g: str) -> Column:
    """First day of the period, as a date."""
    return F.to_date(F.date_trunc(UNITS[g], c))


def length(start: date, g: str) -> int:
    return {"D": 1, "W": 7, "Q": 91}.get(g) or calendar.monthrange(start.year, start.month)[1]


@dataclass(frozen=True)
class Window:
    """Grain, and the last two full observed periods; None where there are too few."""

    grain: str
    current: date | None
    previous: date | None
    dropped: date | None


def start(d: date, g: str) -> date:
    """First day of the period that a day is in."""
    if g == "W":
        return d - timedelta(days=d.weekday())
    month = (d.month - 1) // 3 * 3 + 1 if g == "Q" else d.month
    return d if g == "D" else date(d.year, month, 1)


def after(first: date, g: str) -> date:
    """First day of the next period."""
    if g in ("D", "W"):
        return first + timedelta(days=7 if g == "W" else 1)
    month = first.month + (3 if g == "Q" else 1)
    return date(first.year + (month > 12), (month - 1) % 12 + 1, 1)


def within(df: DataFrame, when: str, first: date, g: str) -> Column:
    """A half-open range of the column itself, which a Parquet scan can prune by."""
    kind = df.schema[when].dataType
    edge = lambda d: F.lit(d.isoformat()).cast(kind)
    return (F.col(when) >= edge(first)) & (F.col(when) < edge(after(first, g)))


def bounds(df: DataFrame, when: str, g: str | None = None) -> Window:
    """One scan: span and periods come from a row for each day, which the calendar bounds."""
    days = df.where(F.col(when).isNotNull()).groupBy(F.to_date(when).alias("d")).agg(F.min(when).alias("lo"), F.max(when).alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    if sum(r.n for r in days) < LEAST_DATED:
        return Window(g or "D", None, None, None)
    lo, hi = min(r.lo for r in days), max(r.hi for r in days)
    g = g or grain((hi - lo).days)
    last = sorted({start(r.d, g) for r in days}, reverse=True)[:3]
    partial = ((max(r.d for r in days) - last[0]).days + 1) / length(last[0], g) < FULL_SHARE
    dropped = last[0] if partial and len(last) > 1 else None
    last = last[1:] if dropped else last
    return Window(g, last[0], last[1] if len(last) > 1 else None, dropped)


def series(df: DataFrame, when: str, value: Column, g: str, w: Window | None = None) -> DataFrame:
    """period, value, n: sparse (periods without rows are absent), without a trailing partial period."""
    out = df.where(F.col(when).isNotNull()).groupBy(period_of(when, g).alias("period")).agg(value.alias("value"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("period") != F.lit(w.dropped)) if w and w.dropped else out


def number(c: Column | str) -> Column:
    """A column as doubles, in which NaN is null: it counts as missing everywhere, while infinities are values."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)


#: money() counts amounts below NEAR in units of 2 ** -UNIT; LOW bits of the units are summed apart from the others.
NEAR, UNIT, LOW = 2.0**40, 20, 22


def money(c: Column | str) -> Column:
    """Sum of amounts as a double, null without amounts; NaN counts as missing, and infinities make it infinite.

    An amount below NEAR is a whole number of units and a rest below one. The units' high bits are summed as doubles
    (exact up to totals of 3e16), the low bits as integers (up to 2 ** 41 rows), so their sums are the same in any order;
    the rests, far below what such a sum shows, and amounts of NEAR or more are summed as doubles. So the order of rows
    does not show in a sum of money, and neither small nor large values are lost. All of it is plain arithmetic.
    """
    x = number(c)
    units = F.when(F.abs(x) < NEAR, F.floor(x * float(1 << UNIT)))
    high, low = F.shiftright(units, LOW).cast("double"), units.bitwiseAND(F.lit((1 << LOW) - 1).cast("long"))
    rest = F.coalesce(x - units.cast("double") / float(1 << UNIT), x)
    whole = F.sum(high) * float(1 << LOW - UNIT) + F.sum(low).cast("double") / float(1 << UNIT)
    return F.coalesce(whole, F.lit(0.0)) + F.sum(rest)


def mean(c: Column | str) -> Column:
    """money() over the number of amounts."""
    return F.try_divide(money(c), F.count(number(c)))


def corr(a: Column, b: Column) -> Column:
    """Pearson's r of the rows that have both, null where either side has no spread; NaN counts as missing."""
    a, b = number(a), number(b)
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))  # corr itself would divide by zero
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
