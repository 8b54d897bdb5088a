"""Helpers that the operators share: lineage cuts, measured broadcasts, ordinals, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; one of our own only where all is one machine."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 16 << 20) -> None:
    """Hand whole texts to Python workers in batches of few rows and bytes, so that long ones fit a worker's memory.

    Spark has these limits for a session only, not for a plan; they are lowered, never raised.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key))
        if not now.lstrip("-").isdigit() or int(now) > most or int(now) <= 0:
            spark.conf.set(key, str(most))


#: Where settled frames are that nothing has deleted.
_kept: list[str] = []


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared checkpoint folder and go on from there; lost executors lose nothing of it."""
    path = staging_path(df.sparkSession, "settled")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    _kept.append(path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a settled frame that nothing will read again."""
    remove(df.sparkSession, df._settled_at)
    _kept.remove(df._settled_at)


def mark() -> int:
    return len(_kept)


def sweep(spark: SparkSession, since: int) -> None:
    """Delete the settled frames since a mark, once what reads them is written."""
    for path in _kept[since:]:
        remove(spark, path)
    del _kept[since:]


def join_measured(big: DataFrame, small: DataFrame, on: Sequence[str], how: str, most_rows: int = 200_000) -> DataFrame:
    """Join; small is settled and counted, and broadcast only up to most_rows, else both sides are shuffled."""
    small = settle(small)
    return big.join(F.broadcast(small) if small.count() <= most_rows else small, list(on), how)


def parts(df: DataFrame, size: int) -> int:
    """Partitions of about `size` bytes by Spark's own estimate of df, and no fewer than a shuffle has."""
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = estimate < 1 << 56  # a frame of unknown size counts as larger than anything
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), estimate // size if known else 0)


def buckets(rows: int) -> int:
    """How many buckets ordinals needs so that none of the largest key's has much more than 100000 rows."""
    return max(64, rows // 100_000)


def ordinals(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, seed: int = 0, buckets: int = 64, ties: Sequence[str] = ()) -> DataFrame:
    """Number the rows of each key from 0 in a seeded order, without putting a key's rows in one task.

    Rows of a key are dealt to hashed buckets; a row's number is its rank in its bucket plus the rows of the
    buckets before it. keys must not be null. Rows alike in every order column are interchangeable, or in the order of ties.
    """
    bucketed = df.withColumn("_h", F.xxhash64(*order, F.lit(seed))).withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_b").orderBy("_h", *order, *ties)
    return (
        bucketed.withColumn("_r", F.row_number().over(within))
        .join(offsets, [*keys, "_b"])
        .withColumn(name, F.col("_before") + F.col("_r") - 1)
        .drop("_h", "_b", "_r", "_before")
    )


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a, b: long) -> one row (node, component) per linked node; component is its smallest reachable node.

    Alternates large-star and small-star steps until the edges are stars around the smallest nodes. Minima are summed in
    map tasks before their exchange. They are settled and counted before they are joined back: up to a limit they are
    broadcast, so a hub's edges stay where they are; beyond it both sides of the join are plain exchanges, which
    adaptive execution splits where a hub makes one large.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    digest = None
    for _ in range(rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == digest or now[0] == 0:
            break
        digest = now
        # Large star: each edge (u, v) is v's to give, and v gives u its own smallest neighbour, or itself.
        down = settle(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v"))
        large = settle(_joined(edges, down, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        small = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        before, edges = edges, settle(
            _joined(large, small, "u", "inner")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        for spent in (before, down, large, small):
            discard(spent)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _joined(big: DataFrame, small: DataFrame, on: str, how: str, most_rows: int = 200_000) -> DataFrame:
    """join_measured for a frame that is settled already."""
    return big.join(F.broadcast(small) if small.count() <= most_rows else small, on, how)


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- arrays in a row, in time that grows hardly faster than they do


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """The array of what combine (associative, neutral at zero) makes of values[0 .. i].

    Appending to an array copies it, so one fold over n values would take n * n steps; folds over stretches of about
    the root of n, and one over the stretches, take n * sqrt(n) plain copies of small numbers.
    """

    def within(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        stretches = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / size).cast("int")), lambda k: F.slice(v, k * size + 1, size))
        step = lambda acc, x: F.array_append(acc, combine(F.coalesce(F.element_at(acc, -1), zero), x))
        folded = F.transform(stretches, lambda s: F.aggregate(F.slice(s, 2, F.size(s)), F.slice(s, 1, 1), step))
        before = lambda f: F.aggregate(f, F.array(zero), lambda acc, s: F.array_append(acc, combine(F.element_at(acc, -1), F.element_at(s, -1))))
        return bind(folded, lambda f: bind(before(f), lambda b: F.flatten(F.transform(f, lambda s, k: F.transform(s, lambda x: combine(F.get(b, k), x))))))

    return bind(values, lambda v: F.when(F.size(v) > 0, within(v)).otherwise(v))


#: Code points in a block.
BLOCK = 4_096


def blocks(text: Column) -> Column:
    """A text as an array of blocks, so that cutting far inside it needs no walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(of: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a text in blocks."""
    some = F.sequence((start / BLOCK).cast("int"), ((end - 1) / BLOCK).cast("int"))
    piece = lambda k: F.substring(F.get(of, k), F.greatest(start - k * BLOCK, F.lit(0)) + 1, F.least(end - k * BLOCK, F.lit(BLOCK)) - F.greatest(start - k * BLOCK, F.lit(0)))
    return F.when(end > start, F.array_join(F.transform(some, piece), "")).otherwise("")
