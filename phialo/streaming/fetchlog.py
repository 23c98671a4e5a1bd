"""The fetch log as a stream: it is append-only, and its roll-ups add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_windows(log: DataFrame, time: str = "ts", status: str = "status", every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of each status in each window; the same call works on a stored log."""
    # a watermark needs a time with a zone; a stored log may have either kind
    rows = log.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if log.isStreaming else log
    counts = rows.groupBy(F.window(time, every), status).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), status, "n")
