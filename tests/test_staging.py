"""The result cache: hits, misses after a change, what it leaves alone, and its bound."""

import os
import time

from pyspark.sql import functions as F

from ledgerline.sources import staging


def test_second_call_reads_no_source(spark, tmp_path):
    source, folder = f"file://{tmp_path}/t.parquet", f"file://{tmp_path}/results"
    spark.range(100).withColumn("g", F.col("id") % 3).write.parquet(source)
    ask = lambda: spark.read.parquet(source).groupBy("g").agg(F.sum("id").alias("s"))
    first = staging.cached(ask(), folder)
    want = {tuple(r) for r in first.collect()}
    assert len(os.listdir(tmp_path / "results")) == 1
    written = os.stat(next((tmp_path / "results").glob("*/_SUCCESS"))).st_mtime_ns
    again = staging.cached(ask(), folder)
    assert not any("t.parquet" in f for f in again.inputFiles()) and {tuple(r) for r in again.collect()} == want
    assert os.stat(next((tmp_path / "results").glob("*/_SUCCESS"))).st_mtime_ns == written
    assert staging.key_of(ask()) == staging.key_of(ask().select("g", "s")) and staging.key_of(ask()) != staging.key_of(ask().where("g > 0"))


def test_changed_file_misses(spark, tmp_path):
    source, folder = f"file://{tmp_path}/t.parquet", f"file://{tmp_path}/results"
    spark.range(10).write.parquet(source)
    total = lambda: staging.cached(spark.read.parquet(source).agg(F.sum("id").alias("s")), folder).first().s
    assert total() == 45
    time.sleep(0.02)
    spark.range(11).write.mode("overwrite").parquet(source)
    assert total() == 55 and len(os.listdir(tmp_path / "results")) == 2


def test_no_key_for_what_may_change(spark, tmp_path):
    source = f"file://{tmp_path}/t.parquet"
    spark.range(10).write.parquet(source)
    df = spark.read.parquet(source)
    assert staging.key_of(df.withColumn("r", F.rand())) is None and staging.key_of(df.withColumn("t", F.current_timestamp())) is None
    assert staging.key_of(spark.createDataFrame([(1,)], "a int")) is None
    assert staging.cached(spark.range(3), f"file://{tmp_path}/results").count() == 3 and not (tmp_path / "results").exists()


def test_oldest_go(spark, tmp_path):
    source, folder = f"file://{tmp_path}/t.parquet", f"file://{tmp_path}/results"
    spark.range(10).write.parquet(source)
    ask = lambda n: spark.read.parquet(source).where(F.col("id") < n)
    keys = [staging.key_of(ask(n)) for n in (1, 2, 3)]
    for n in (1, 2):
        staging.cached(ask(n), folder, most=2)
        time.sleep(0.02)
    staging.cached(ask(1), folder, most=2)  # used again
    time.sleep(0.02)
    assert staging.cached(ask(3), folder, most=2).count() == 3
    assert sorted(os.listdir(tmp_path / "results")) == sorted([keys[0], keys[2]])


def test_parts_hold_so_many_rows_at_most(spark):
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    df = spark.range(0, 1000, 1, 1).selectExpr("CASE WHEN id % 7 > 0 THEN double(id) END AS x", "string(id) AS s")
    with staging.parted(df, 130) as even:
        counts = [r["count"] for r in even.groupBy(F.spark_partition_id()).count().collect()]
        assert max(counts) <= 130 and sum(counts) == 1000 and not df.exceptAll(even).count() and not even.exceptAll(df).count()
        path = even.inputFiles()[0].rsplit("/", 1)[0]
        assert staging.Files(spark, path).exists(path)
    assert not staging.Files(spark, path).exists(path) and spark.conf.get("spark.sql.files.openCostInBytes") == before
    with staging.parted(df, 1000) as same:
        assert same is df
    with staging.parted(df.limit(0), 10) as none:
        assert none.count() == 0
