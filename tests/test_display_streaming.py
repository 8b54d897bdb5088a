"""Values as text, and the streamed series against the batch one."""

import datetime

from pyspark.sql import functions as F

from ledgerline.functions import display
from ledgerline.streaming import periods


def test_display(spark):
    df = spark.createDataFrame([(1234567.0,), (-950.5,), (12.0,), (2.5e9,), (None,)], "v double")
    assert [r[0] for r in df.select(display.amount(F.col("v"), "$")).collect()] == ["$1.23M", "-$950.50", "$12", "$2.50B", None]
    assert [r[0] for r in df.limit(1).select(display.amount(F.col("v"), "₹")).collect()] == ["₹12.35 L"]
    assert df.limit(1).select(display.shown(F.lit(12.345), "percent"), display.shown(F.lit(1.5), "ratio"), display.shown(F.lit(3), "days")).first()[:] == ("12.3%", "1.50x", "3.0 days")
    assert display.fingerprint(["B ", "a"]) == display.fingerprint(["A", "b"])


def test_stream_equals_batch(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1, 6)
    rows = [(day + datetime.timedelta(hours=7 * i), float(i)) for i in range(60)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "ts timestamp, v double")
    df.write.parquet(str(tmp_path / "in"))
    for g, unit in (("D", "day"), ("W", "week")):
        stream = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "in"))
        q = periods.series(stream, "ts", "v", g).writeStream.format("memory").queryName(f"s{g}").outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
        want = df.where("ts is not null").groupBy(F.to_date(F.date_trunc(unit, "ts")).alias("period")).agg(F.sum("v").alias("value"), F.count(F.lit(1)).alias("n"))
        assert sorted(spark.table(f"s{g}").collect()) == sorted(want.collect())
