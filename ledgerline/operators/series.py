"""Seasonal decomposition of a period series, z-score outliers and K-means parts."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import AbstractContextManager

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import staging

#: Points that a decomposition needs.
LEAST = 14
#: Bytes that a task of a fit may read at once. It keeps a row as objects of 68 bytes and 8 for each column, and reads a part twice over.
HELD = 120_000_000


def decompose(series: DataFrame, season: int) -> DataFrame:
    """period, value, trend, seasonal, resid of series (period, value): additive, by a centred moving average.

    An even season takes half of the two outer points. Points without a full window have no trend and no rest. Phases
    average to zero. Below LEAST points nothing is told apart, and there is no row. The windows run over periods, a few thousand rows at most, after rows were summed by period.
    """
    half, line = season // 2, W.orderBy("period")
    around = line.rowsBetween(-half, half)
    inner = F.sum("value").over(around)
    if season % 2 == 0:
        inner = inner - 0.5 * (F.lag("value", half).over(line) + F.lead("value", half).over(line))
    trend = F.when(F.count("value").over(around) == 2 * half + 1, inner / season)
    enough = series.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= LEAST)  # one row or none
    t = series.crossJoin(F.broadcast(enough)).withColumn("_phase", (F.row_number().over(line) - 1) % season).withColumn("trend", trend)
    t = t.withColumn("_mean", F.avg(F.col("value") - F.col("trend")).over(W.partitionBy("_phase")))
    level = t.groupBy("_phase").agg(F.first("_mean").alias("_m")).agg(F.avg("_m").alias("_level"))  # one row
    s = t.crossJoin(F.broadcast(level)).withColumn("seasonal", F.col("_mean") - F.col("_level"))
    return s.select("period", "value", "trend", "seasonal", (F.col("value") - F.col("trend") - F.col("seasonal")).alias("resid"))


def outliers(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """Rows whose population z-score is beyond the limit on either side, with z. A column of one value has none."""
    one = df.agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_sd"))
    z = (F.col(column) - F.col("_mean")) / F.nullif("_sd", F.lit(0.0))
    return df.crossJoin(F.broadcast(one)).withColumn("z", z).where(F.abs("z") > limit).drop("_mean", "_sd")


def _standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with all columns, and their standardised vector; a column of one value counts as 0."""
    full = df.dropna(subset=list(columns))
    one = full.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    scaled = full.crossJoin(F.broadcast(one)).withColumns({f"_z_{c}": F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=[f"_z_{c}" for c in columns], outputCol="_v").transform(scaled).select(*full.columns, "_v")


def _parted(df: DataFrame, columns: Sequence[str]) -> AbstractContextManager[DataFrame]:
    """The columns of rows with all of them, in parts that a task of a fit can hold. They are as read, not standardised: so
    their files are the same in every run, and with them the order of parts, by which the fit seeds its first centres."""
    return staging.parted(df.dropna(subset=list(columns)).select(*columns), max(1, HELD // (2 * (68 + 8 * len(columns)))))


def _means(k: int, seed: int) -> KMeans:
    """By rows: left to choose, the estimator reads all vectors once more, and takes rows for few dense columns too."""
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_part", solver="row")


def kmeans(df: DataFrame, columns: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """cluster, n and the mean of each column; clusters are numbered by size, then by the first mean."""
    points = _standard(df, columns)
    with _parted(df, columns) as even:
        model = _means(k, seed).fit(_standard(even, columns))
    parts = model.transform(points).groupBy("_part").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in columns))
    rank = F.row_number().over(W.orderBy(F.desc("n"), f"mean_{columns[0]}"))  # k rows
    return parts.select(rank.alias("cluster"), "n", *(f"mean_{c}" for c in columns))


def elbow(df: DataFrame, columns: Sequence[str], most: int = 10, seed: int = 42) -> list[tuple[int, float]]:
    """(k, within-cluster sum of squares) for k from 2 to `most`."""
    with _parted(df, columns) as even:
        points = _standard(even, columns).select("_v").persist()
        try:
            return [(k, _means(k, seed).fit(points).summary.trainingCost) for k in range(2, most + 1)]
        finally:
            points.unpersist()
