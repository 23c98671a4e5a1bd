"""Fetch outcomes and roll-ups of the fetch log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phialo.functions import text as T

OUTCOMES = ("SUCCESS", "HTTP_404", "HTTP_ERROR", "REQUEST_ERROR", "SKIPPED_EXISTS")


def fetch_status(file_exists: Column, http_status: Column) -> Column:
    """outcome of one id: file there, 200, 404, another code, no answer."""
    return (
        F.when(file_exists, "SKIPPED_EXISTS").when(http_status == 200, "SUCCESS").when(http_status == 404, "HTTP_404").when(http_status.isNotNull(), "HTTP_ERROR").otherwise("REQUEST_ERROR")
    )


def by_day(log: DataFrame) -> DataFrame:
    """``log`` with a typed time and its ``day``, as ``write_log`` stores it; rows without a time have no day."""
    time = F.col("timestamp") if log.schema["timestamp"].dataType.typeName().startswith("timestamp") else F.try_to_timestamp(F.col("timestamp").cast("string"))
    return log.withColumn("timestamp", time).withColumn("day", F.col("timestamp").cast("date"))


def log_since(log: DataFrame, start: str) -> DataFrame:
    """rows of the run that began at ``start``.

    On a log of ``by_day`` the days before are not listed and the time is compared as it is
    stored, so both conditions reach the scan; a time that is text is read row by row.
    """
    kind = log.schema["timestamp"].dataType.simpleString()
    if not kind.startswith("timestamp"):
        return log.where(F.try_to_timestamp(F.col("timestamp").cast("string")) >= F.lit(start).cast("timestamp"))
    rows = log.where(F.col("timestamp") >= F.lit(start).cast(kind))
    return rows.where(F.col("day") >= F.lit(start).cast("date")) if "day" in log.columns else rows


def log_summary(log: DataFrame) -> DataFrame:
    """A1: totals, rates of attempted ids in percent (2 digits, 0 without attempts), durations."""
    s, ms = F.col("status"), T.strip(T.or_empty(F.col("duration_ms").cast("string"))).try_cast("double")
    t = log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s != "SKIPPED_EXISTS").alias("attempted"),
        F.count_if(s == "SUCCESS").alias("success"),
        F.count_if(s.isin("HTTP_ERROR", "REQUEST_ERROR", "HTTP_404")).alias("errors"),
        F.coalesce(F.round(F.avg(ms), 2), F.lit(0.0)).alias("avg_duration_ms"),
        F.coalesce(F.max(ms), F.lit(0.0)).alias("max_duration_ms"),
    )
    rate = lambda c: F.coalesce(F.round(100.0 * F.col(c) / F.nullif(F.col("attempted"), F.lit(0)), 2), F.lit(0.0))
    return t.withColumns({"success_rate": rate("success"), "error_rate": rate("errors")})


def log_distributions(log: DataFrame) -> DataFrame:
    """A2: (kind, value, n) by status, and by http_status, error_type and attempts where given."""
    text = lambda c: T.or_empty(F.col(c).cast("string"))
    pairs = [F.struct(F.lit("status").alias("kind"), text("status").alias("value"))]
    pairs += [F.when(text(c) != "", F.struct(F.lit(c).alias("kind"), text(c).alias("value"))) for c in ("http_status", "error_type")]
    pairs.append(F.struct(F.lit("attempt_count").alias("kind"), T.safe_int(text("attempt_count")).cast("string").alias("value")))
    rows = log.select(F.explode(F.array(*pairs)).alias("z")).where("z IS NOT NULL")
    return rows.groupBy("z.kind", "z.value").agg(F.count(F.lit(1)).alias("n"))


def run_summary(log: DataFrame, ids: DataFrame, manifest: DataFrame) -> DataFrame:
    """A3: one row with a count for each outcome, ids loaded and manifest rows."""
    outcomes = log.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in OUTCOMES])
    loaded = ids.agg(F.count(F.lit(1)).alias("ids_loaded"))
    listed = manifest.agg(F.count(F.lit(1)).alias("manifest_rows"))
    return outcomes.crossJoin(loaded).crossJoin(listed)  # one row each
