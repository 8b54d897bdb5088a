"""Sessions of events: runs of a key's events with no gap longer than a given one. The same on a stream and on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import periods


def sessions(events: DataFrame, when: str, key: str, value: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """key, start, end (of the last event), n, total. An event the gap or less after the one before belongs to its
    session. Rows without a time or key belong to none.

    On a stream a session is given out once the watermark, `late` behind the latest event, has passed its end by the gap;
    state is kept by key until then. Rows that come later than that are dropped, and counted in the progress of the query
    (dropped).
    """
    rows = events.where(F.col(when).isNotNull() & F.col(key).isNotNull())
    if rows.isStreaming:
        rows = rows.withWatermark(when, late)
    s = rows.groupBy(key, F.session_window(when, gap).alias("_w")).agg(F.max(when).alias("end"), F.count(F.lit(1)).alias("n"), periods.money(value).alias("total"))
    return s.select(key, F.col("_w.start").alias("start"), "end", "n", "total")


def dropped(query) -> int:
    """Rows that a streaming query has dropped since they came too late."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
