"""Tests and fits: Spark aggregates the sufficient statistics, the driver evaluates scalar tails."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import staging
from . import periods


def _over(top: Column, bottom: Column) -> Column:
    """A statistic over its spread: infinite where there is a difference and no spread, null where there is neither."""
    infinite = F.when(top > 0, F.lit(float("inf"))).when(top < 0, F.lit(float("-inf")))
    return F.when(bottom == 0, infinite).otherwise(F.try_divide(top, bottom))


def t_one_sample(df: DataFrame, x: str, mu: float) -> DataFrame:
    """n and t. A constant column differs infinitely from any other mean (p 0); from its own it has no t. Below two values
    there is none."""
    s = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"))
    return s.select("n", F.round(_over(F.col("m") - mu, F.try_divide(F.col("sd"), F.sqrt("n"))), 6).alias("t"))


def t_two_sample(df: DataFrame, x: str, group: str, a: str, b: str) -> DataFrame:
    """Pooled variance. Groups without spread differ infinitely, or have no t where they are equal; so has a group of none."""
    v = lambda g: F.when(F.col(group) == g, F.col(x))
    s = df.agg(*(f(v(g)).alias(f"{n}{i}") for i, g in enumerate((a, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    part = lambda i: (F.col(f"n{i}") - 1) * F.when(F.col(f"n{i}") == 1, 0.0).otherwise(F.col(f"v{i}"))
    pooled = F.try_divide(part(0) + part(1), F.col("n0") + F.col("n1") - 2)
    spread = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("n0")) + F.try_divide(F.lit(1.0), F.col("n1"))))
    return s.select("n0", "n1", F.round(_over(F.col("m0") - F.col("m1"), spread), 6).alias("t"))


def chi_square(df: DataFrame, x: str, y: str) -> DataFrame:
    """Statistic and degrees of freedom of a cross-tab; Yates' correction where there is one degree.

    Cells without a row need no row: chi-square is N * sum of o^2 / (r * k) - N over the observed ones.
    """
    c = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).cast("double").alias("o"))
    row, col = c.groupBy(x).agg(F.sum("o").alias("r")), c.groupBy(y).agg(F.sum("o").alias("k"))
    each = c.join(row, x).join(col, y)
    sums = each.agg(F.sum("o").alias("n"), F.sum(F.col("o") ** 2 / (F.col("r") * F.col("k"))).alias("q"))
    one = sums.crossJoin(row.agg(F.count(F.lit(1)).alias("nr"), F.min("r").alias("ra"), F.max("r").alias("rb"))).crossJoin(col.agg(F.count(F.lit(1)).alias("nk"), F.min("k").alias("ka"), F.max("k").alias("kb")))
    plain = F.col("n") * F.col("q") - F.col("n")
    # Of a 2 x 2 table every cell is as far from what is expected; the correction takes up to 0.5 off that distance.
    spread = F.col("n") ** 3 / (F.col("ra") * F.col("rb") * F.col("ka") * F.col("kb"))
    away = F.sqrt(F.greatest(plain, F.lit(0.0)) / spread)
    dof = (F.col("nr") - 1) * (F.col("nk") - 1)
    yates = F.pow(away - F.least(F.lit(0.5), away), F.lit(2)) * spread
    return one.select(dof.alias("dof"), F.round(F.when(dof == 1, yates).otherwise(plain), 6).alias("chi2"))


def anova(df: DataFrame, x: str, group: str) -> DataFrame:
    """k groups, n rows and F. One group, or a row a group, has no F; groups without spread that differ have an infinite one."""
    g = df.where(F.col(x).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") ** 2).alias("q"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("q") - F.try_divide(F.col("s") ** 2, F.col("n"))
    apart = F.try_divide(F.when(between > 1e-12 * F.col("q"), between).otherwise(F.lit(0.0)), F.col("k") - 1)
    return t.select("k", "n", F.round(_over(apart, F.try_divide("within", F.col("n") - F.col("k"))), 4).alias("f"))


def ols(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of every pair, from one aggregate; each pair over rows where both are present."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    s = df.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(periods.corr(F.col(a), F.col(b)), 6).alias("r")) for a, b in pairs)).alias("p"))
    return s.select(F.explode("p").alias("p")).select("p.*")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks; ranks come from counts of distinct values. Null where a column has one value only."""
    from .kpi import positions

    both = df.select(periods.number(a).alias("x"), periods.number(b).alias("y")).where("x is not null and y is not null")
    # One scan of the rows: ranks and their moments are of the distinct pairs and their numbers.
    each = staging.settle(both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    rank = lambda c, name: positions(each, c, False, "n").select(F.col("value").alias(c), (F.col("before") + (F.col("copies") + 1) / 2).alias(name))
    s = each.agg(F.sum("n").alias("_all"))  # one row; ranks are taken from their mean, (all + 1) / 2, so that large ones lose nothing
    out = each.join(rank("x", "ra"), "x").join(rank("y", "rb"), "y").crossJoin(F.broadcast(s))
    from_mean = lambda c: F.col(c) - (F.col("_all") + 1) / 2
    sums = out.agg(*(F.sum(F.col("n") * v).alias(k) for k, v in (("ab", from_mean("ra") * from_mean("rb")), ("aa", from_mean("ra") ** 2), ("bb", from_mean("rb") ** 2))))
    return sums.select(F.round(F.try_divide("ab", F.nullif(F.sqrt("aa") * F.sqrt("bb"), F.lit(0.0))), 6).alias("rho"))


def _inversions(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Pairs with a smaller x and a larger y, each as often as the product of its two counts n; one pass a bit of y."""
    order = np.lexsort((y, x))
    y, n = np.unique(y, return_inverse=True)[1][order], n[order].astype(float)
    total = 0.0
    for bit in range(int(y.max(initial=0)).bit_length()):
        upper = (y >> bit) & 1
        by = np.argsort(y >> (bit + 1), kind="stable")
        group, upper, m = (y >> (bit + 1))[by], upper[by], n[by]
        before = np.cumsum(m * upper)
        start = np.concatenate([[True], group[1:] != group[:-1]])
        base = (before - m * upper)[start][np.cumsum(start) - 1]
        total += float(((before - base) * m * (1 - upper)).sum())
    return total


def kendall(df: DataFrame, a: str, b: str, block: int = 1_000_000, most: int = 1_000) -> DataFrame:
    """n and tau-b of the rows that have both, exactly: no row is compared with every other.

    Equal rows count once, with their number. Both columns are cut at values into blocks of about `block` rows (more where
    that would give over `most` blocks); a value with so many rows has a block of its own. Pairs in different blocks of
    both columns come from the counts of a grid of at most (2 * most)^2 cells, pairs in one block from that block alone,
    and a block of one value holds none. Fewer than two different values of a column give a null tau.
    """
    from .kpi import positions

    both = df.select(periods.number(a).alias("x"), periods.number(b).alias("y")).where("x is not null and y is not null")
    # One scan of the rows: all that follows is of the distinct pairs and their numbers.
    each = staging.settle(both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    n = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    block = max(block, -(-n // most))

    def cut(c: str) -> DataFrame:
        ranked = staging.settle(positions(each, c, False, "n"))
        at = 2 * F.floor(F.col("before") / block) + (F.col("copies") >= block).cast("int")
        return ranked.select(F.col("value").alias(c), at.cast("long").alias(f"{c}b"), F.col("copies").alias(f"{c}n"))

    xs, ys = cut("x"), cut("y")
    cells = staging.settle(each.join(xs, "x").join(ys, "y"))

    def within(by: str, x: str, y: str):
        def count(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"d": [_inversions(part[x].to_numpy(), part[y].to_numpy(), part["n"].to_numpy())]})

        return cells.where(f"{by} % 2 = 0").select(by, x, y, "n").groupBy(by).applyInPandas(count, "d double")

    grid = cells.groupBy("xb", "yb").agg(F.sum("n").alias("n"))
    across = grid.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(lambda part: pd.DataFrame({"d": [_inversions(part["xb"].to_numpy(), part["yb"].to_numpy(), part["n"].to_numpy())]}), "d double")
    # A block of y holds the pairs of different blocks of x only: those of one block of x are counted there.
    found = across.unionByName(within("xb", "x", "y")).unionByName(within("yb", "xb", "y")).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("d"))
    pairs = lambda c: F.coalesce(F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2), F.lit(0.0))
    one = found.crossJoin(xs.agg(pairs("xn").alias("tx"))).crossJoin(ys.agg(pairs("yn").alias("ty"))).crossJoin(cells.agg(pairs("n").alias("txy")))
    all_ = F.lit(n * (n - 1) / 2)
    tau = F.try_divide(all_ - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("d"), F.sqrt((all_ - F.col("tx")) * (all_ - F.col("ty"))))
    return one.select(F.lit(n).cast("long").alias("n"), F.round(tau, 6).alias("tau"))



def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1)) if 1 != (a + b) * x / (a + 1) else 1e300
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_p_value(t: float, dof: float) -> float:
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def f_p_value(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_p_value(x: float, dof: float) -> float:
    """Upper tail: the regularised incomplete gamma function, by its series or its continued fraction."""
    a, x = dof / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for i in range(1, 1000):
        b += 2
        step = -i * (i - a)
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out * scale


def tested(df: DataFrame, test: str, **how) -> DataFrame:
    """The one row of a test with its two-sided or upper p-value: t1 (x, mu), t2 (x, group, a, b), chi2 (x, y), anova (x,
    group), slope (y, x) or corr (a, b). Spark sums what the statistic needs; its tail is one number on the driver."""
    run = {"t1": t_one_sample, "t2": t_two_sample, "chi2": chi_square, "anova": anova, "slope": slope_test, "corr": corr_test}[test]
    row = run(df, **how)
    r = row.first()
    statistic = {"chi2": "chi2", "anova": "f"}.get(test, "t")
    value = r[statistic]
    if value is None or value != value:
        p = None
    elif math.isinf(value):
        p = 0.0
    elif test == "chi2":
        p = chi2_p_value(value, r.dof) if r.dof else None
    elif test == "anova":
        p = f_p_value(value, r.k - 1, r.n - r.k)
    else:
        dof = r.n - 1 if test == "t1" else r.n0 + r.n1 - 2 if test == "t2" else r.n - 2
        p = t_p_value(value, dof) if dof > 0 else None
    return row.withColumn("p", F.lit(p).cast("double"))


def slope_test(df: DataFrame, y: str, x: str) -> DataFrame:
    """n, slope, r2 and t of a line; t is infinite (p 0) where three values or more lie on it."""
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))
    far = F.when((F.col("r2") > 1 - 1e-14) & (F.col("n") > 2), F.signum("slope") * float("inf"))
    return s.withColumn("t", F.coalesce(far, F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / F.nullif(1 - F.col("r2"), F.lit(0.0)))))


def corr_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, r and t of a correlation; t is infinite (p 0) where r is 1 or -1 of three values or more, null below three."""
    s = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count(F.lit(1)).alias("n"), periods.corr(F.col(a), F.col(b)).alias("r"))
    far = F.when(F.abs("r") > 1 - 1e-14, F.signum("r") * float("inf"))  # 1 but for rounding
    return s.withColumn("t", F.when(F.col("n") > 2, F.coalesce(far, F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") ** 2, F.lit(0.0))))))


def r_p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs."""
    if n < 3 or abs(r) > 1 - 1e-14:
        return 1.0 if n < 3 else 0.0
    return t_p_value(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def residuals(df: DataFrame, y: str, x: str) -> DataFrame:
    """df with fitted and resid of a line, of rows that have both."""
    s = df.agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    fit = F.col("_a") + F.col("_b") * F.col(x)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(F.broadcast(s)).withColumn("fitted", fit).withColumn("resid", F.col(y) - F.col("fitted")).drop("_a", "_b")
