"""The period series over a stream: tumbling windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOWS = {"D": "1 day", "W": "1 week"}
#: Weeks begin on a Monday; Spark's windows count from a Thursday.
OFFSETS = {"D": "0 seconds", "W": "4 days"}


def series(stream: DataFrame, when: str, value: str | None, g: str = "D", late: str = "2 days") -> DataFrame:
    """period, value, n by day or week. when must be a timestamp; rows later than `late` behind the newest are dropped once
    their window is closed, rows without a time always. Without a value column, value counts rows."""
    timed = stream.where(F.col(when).isNotNull()).withWatermark(when, late)
    total = F.sum(F.col(value).cast("double")) if value else F.count(F.lit(1)).cast("double")
    window = F.window(when, WINDOWS[g], WINDOWS[g], OFFSETS[g])
    return timed.groupBy(window).agg(total.alias("value"), F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("period"), "value", "n")
