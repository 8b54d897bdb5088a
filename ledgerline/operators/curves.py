"""Curves over points and groups: LOWESS trend lines and the densities that violins draw.

Both are sums over rows for a bounded number of places: map tasks add up what their rows give to each place, and the
places alone are brought together. Marks don't grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import periods, quantiles

#: Places of a trend line. Where x has no more distinct values, each is a place, and the line is LOWESS at every point.
POINTS = 40
#: Cells that the values of x are counted in: an order statistic puts a few of so many parts of the rows in order.
CELLS = 2048


class Cells:
    """Exact counts of a column's values at cuts (odd cells) and between them (even ones), and order statistics from those.

    A statistic of all rows lies in a few cells; only the rows of these are put in order.
    """

    def __init__(self, rows: DataFrame, x: str) -> None:
        self.rows = rows.select(F.col(x).alias("x"))
        wanted = F.lit([i / (CELLS - 1) for i in range(CELLS)])
        self.cuts = np.unique(self.rows.agg(F.percentile_approx("x", wanted, F.lit(10 * CELLS))).first()[0] or [])
        cuts, cell = self.cuts, self._cell

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = sum((np.bincount(cell(cuts, f["x"].to_numpy()), minlength=2 * len(cuts) + 1) for f in frames), np.zeros(2 * len(cuts) + 1, int))
            yield pd.DataFrame({"cell": np.flatnonzero(own), "c": own[own > 0]})

        self.counts = np.zeros(2 * len(cuts) + 1, int)
        for r in self.rows.mapInPandas(count, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).collect():
            self.counts[r.cell] = r.c
        self.n = int(self.counts.sum())

    @staticmethod
    def _cell(cuts: np.ndarray, xs: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts, xs, "left") + np.searchsorted(cuts, xs, "right")

    def kth(self, asks: list[tuple[float | None, int]]) -> list[float]:
        """For each (p, k) the k-th least distance from p, or the k-th least value where p is None; k from 1 to n."""
        cuts, cell = self.cuts, self._cell
        ends = np.concatenate([[-np.inf], cuts, [np.inf]])
        low, high = np.empty(len(self.counts)), np.empty(len(self.counts))
        low[1::2] = high[1::2] = cuts
        low[0::2], high[0::2] = ends[:-1], ends[1:]
        held, low, high = np.flatnonzero(self.counts), low[self.counts > 0], high[self.counts > 0]
        counts, open_, left = self.counts[held], np.zeros((len(asks), len(self.counts)), bool), []
        for i, (p, k) in enumerate(asks):
            least, most = (low, high) if p is None else (np.maximum(0.0, np.maximum(low - p, p - high)), np.maximum(np.abs(low - p), np.abs(high - p)))
            bounds = []
            for side in (least, most):
                order = np.argsort(side, kind="stable")
                bounds.append(side[order][np.searchsorted(np.cumsum(counts[order]), k)])
            below = most < bounds[0]
            open_[i, held] = ~below & (least <= bounds[1])
            left.append(k - int(counts[below].sum()))
        places = [p for p, _ in asks]

        def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                xs = frame["x"].to_numpy()
                at, out = cell(cuts, xs), []
                for i, p in enumerate(places):
                    own = xs[open_[i, at]]
                    v, c = np.unique(own if p is None else np.abs(own - p), return_counts=True)
                    out.append(pd.DataFrame({"i": i, "v": v, "c": c}))
                yield pd.concat(out)

        found = self.rows.mapInPandas(pick, "i int, v double, c long").groupBy("i", "v").agg(F.sum("c").alias("c"))
        reach = F.sum("c").over(W.partitionBy("i").orderBy("v"))
        need = F.element_at(F.lit(left), F.col("i") + 1)
        first = found.withColumn("reach", reach).where(F.col("reach") >= need).groupBy("i").agg(F.min("v").alias("v"))
        got = {r.i: r.v for r in first.collect()}
        return [got[i] for i in range(len(asks))]


def lowess(df: DataFrame, x: str, y: str, share: float = 2 / 3, rounds: int = 3, points: int = POINTS) -> DataFrame:
    """x, fitted: locally weighted lines with tricube weights over the nearest `share` of the rows, refitted `rounds` times
    with bisquare weights of the residuals.

    Places are the distinct x, or `points` of their quantiles where there are more; a row's residual is taken from the
    broken line through the places. The width at a place is the exact distance of its k-th nearest row. Rows without a
    finite x and y are left out; where all rows near a place have one x, the line there is their mean. A round whose
    median residual is 0 ends the fit. No rows, no line.
    """
    a, b = periods.number(x), periods.number(y)
    rows = df.select(a.alias("x"), b.alias("y")).where("x is not null and y is not null and abs(x) < double('infinity') and abs(y) < double('infinity')")
    cells = Cells(rows, "x")
    if not (n := cells.n):
        return df.sparkSession.createDataFrame([], "x double, fitted double")
    distinct = cells.cuts if len(cells.cuts) > points else [r.x for r in rows.select("x").distinct().limit(points + 1).collect()]
    if len(distinct) > points:
        ranks = [i / (points - 1) * (n - 1) for i in range(points)]
        found = cells.kth([(None, 1 + min(n - 1, int(f(r)))) for r in ranks for f in (np.floor, np.ceil)])
        distinct = [lo + (hi - lo) * (r - np.floor(r)) for r, lo, hi in zip(ranks, found[::2], found[1::2])]
    places = np.array(sorted(set(distinct)))
    k = max(1, min(n, int(share * n + 1e-10)))
    widths = np.array(cells.kth([(float(p), k) for p in places]))

    def away_from(line: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        return np.abs(ys - np.interp(xs, places, line))

    def fit(line: np.ndarray | None = None, reach: float = 1.0) -> np.ndarray:
        """Bisquare weights of the residuals from a line, which vanish at `reach`; without a line all weigh 1."""

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(places), 5))
            for frame in frames:
                whole = [frame[c].to_numpy(float) for c in ("x", "y")]
                part = np.zeros(len(frame)) if line is None else away_from(line, *whole) / reach
                whole.append(np.where(part < 1, (1 - part * part) ** 2, 0.0))
                for start in range(0, len(frame), 2_000):  # arrays that stay in the processor's cache
                    xs, ys, own = (c[start : start + 2_000] for c in whole)
                    away = xs[None] - places[:, None]
                    part = np.abs(away) / np.where(widths > 0, widths, 1.0)[:, None]
                    w = np.maximum(1 - part * part * part, 0)  # products: powers take most of the time otherwise
                    w = w * w * w * own
                    w[widths <= 0] = (away[widths <= 0] == 0) * own
                    first = w * away
                    total += np.stack([w.sum(1), first.sum(1), (first * away).sum(1), w @ ys, first @ ys], 1)
            yield pd.DataFrame({"place": range(len(places)), **{f"s{i}": total[:, i] for i in range(5)}})

        each = rows.mapInPandas(sums, "place int, s0 double, s1 double, s2 double, s3 double, s4 double")
        s = np.array([r[1:] for r in each.groupBy("place").agg(*(F.sum(f"s{i}") for i in range(5))).orderBy("place").collect()])
        with np.errstate(invalid="ignore", divide="ignore"):
            mean, centre = s[:, 3] / s[:, 0], s[:, 1] / s[:, 0]
            spread = s[:, 2] / s[:, 0] - centre**2
            slope = (s[:, 4] / s[:, 0] - centre * mean) / spread
        return np.where(spread > 1e-12 * np.maximum(widths, 1e-300) ** 2, mean - slope * centre, mean)

    def residuals(frames: Iterator[pd.DataFrame], line: np.ndarray) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"r": away_from(line, frame["x"].to_numpy(float), frame["y"].to_numpy(float))})

    fitted = fit()
    for _ in range(rounds):
        held = np.where(np.isnan(fitted), 0.0, fitted)  # a place that robust weights left without rows
        away = rows.mapInPandas(lambda frames, line=held: residuals(frames, line), "r double")
        middle = quantiles.exact(away, [], {"r": F.col("r")}, {"m": 0.5}).first().m
        if not middle > 0:
            break
        fitted = fit(held, 6.0 * middle)
    return df.sparkSession.createDataFrame([(float(p), None if np.isnan(f) else float(f)) for p, f in zip(places, fitted)], "x double, fitted double")


#: Places on a violin's axis.
GRID = 128


def violin(df: DataFrame, group: str, value: str, names: list[str], grid: int = GRID) -> DataFrame:
    """segment, n, at, density: a Gaussian kernel density of each named group's finite values at `grid` places.

    The bandwidth is 1.059 min(deviation, interquartile range / 1.349) n ^ -0.2, of the deviation alone where that range
    is 0. Places go from two bandwidths below the least value to two above the largest. A row's unit is shared between
    the two places beside it, and the kernel goes over the places' sums. Groups without spread have no violin.
    """
    x = F.when(F.abs(periods.number(value)) < float("inf"), periods.number(value))
    rows = df.select(F.col(group).cast("string").alias("segment"), x.alias("v")).where(F.col("v").isNotNull() & F.col("segment").isin(names))
    shape = rows.groupBy("segment").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd"))
    parts = quantiles.exact(rows, ["segment"], {"v": F.col("v")}, {"p25": 0.25, "p75": 0.75})
    range_ = F.nullif((F.col("p75") - F.col("p25")) / 1.349, F.lit(0.0))
    width = 1.059 * F.least("sd", range_) * F.pow("n", F.lit(-0.2))
    axes = shape.join(F.broadcast(parts), "segment").where("sd > 0").withColumn("h", width)  # a row for each name
    axes = axes.select("segment", "n", "h", (F.col("lo") - 2 * F.col("h")).alias("a"), ((F.col("hi") - F.col("lo") + 4 * F.col("h")) / (grid - 1)).alias("step"))
    place = (F.col("v") - F.col("a")) / F.col("step")
    low = F.least(F.floor(place), F.lit(grid - 2)).cast("int")
    pair = F.array(F.struct(low.alias("i"), (1 - (place - low)).alias("u")), F.struct((low + 1).alias("i"), (place - low).alias("u")))
    units = rows.join(F.broadcast(axes), "segment").select("segment", F.explode(pair).alias("p")).groupBy("segment", "p.i").agg(F.sum("p.u").alias("u"))
    lists = units.groupBy("segment").agg(F.collect_list(F.struct("i", "u")).alias("units"))  # grid places at most
    kernel = lambda g: F.aggregate("units", F.lit(0.0), lambda s, c: s + c["u"] * F.exp(-0.5 * F.pow((g - c["i"]) * F.col("step") / F.col("h"), F.lit(2))))
    dense = lists.join(F.broadcast(axes), "segment").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    density = kernel(F.col("g")) / (F.col("n") * F.col("h") * float(np.sqrt(2 * np.pi)))
    return dense.select("segment", "n", (F.col("a") + F.col("g") * F.col("step")).alias("at"), density.alias("density"))
