"""Results that a job gathers over several runs, some of which may fail.

Rows lie under ``rows/run=R/part=P``; a part counts once its marker lies under ``_commits``,
and the marker is written when the part's rows are all there.  A run that fails leaves its
markers, so the next one carries those rows, ignores the rest and asks only for what has no
good result.  A part that is written again replaces what lay there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phialo.operators.sections import carried, pending


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Parts that count, by run."""
    at, files = _files(spark, f"{path}/_commits")
    found: dict[int, list[int]] = {}
    for mark in files.listStatus(at) if files.exists(at) else []:
        run, part = mark.getPath().getName().split("-")
        found.setdefault(int(run), []).append(int(part))
    return found


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of all parts that count; None before the first one."""
    parts = committed(spark, path)
    if not parts:
        return None
    good = F.lit(False)
    for run, some in parts.items():
        good = good | ((F.col("run") == run) & F.col("part").isin(some))
    return spark.read.parquet(f"{path}/rows").where(good).drop("run", "part")


def resume(
    asked: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], key: str = "product_id", question: str = "brand_name", good: str = "status = 'Success'", parts: int = 8
) -> DataFrame:
    """Results of ``asked``, those of earlier runs with status Skipped.

    ``work`` gets the distinct questions of a part and returns them with its columns, among
    them ``status``.  Equal questions lie in one part, so each is put once a run.  Parts are
    written one after the other; ``parts`` bounds what a failure can cost.
    """
    spark = asked.sparkSession
    before = read_results(spark, path)
    done = None if before is None else before.where(good)
    todo = asked if done is None else pending(asked, done, key)
    todo = todo.withColumn("part", F.pmod(F.xxhash64(question), F.lit(parts)))
    run = max(committed(spark, path), default=0) + 1
    for part in range(parts):
        rows = todo.where(F.col("part") == part).drop("part")
        answers = work(rows.select(question).distinct()).withColumnRenamed(question, "_question")
        out = rows.join(answers, F.col(question).eqNullSafe(F.col("_question"))).drop("_question").withColumns({"run": F.lit(run), "part": F.lit(part)})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "part").parquet(f"{path}/rows")
        at, files = _files(spark, f"{path}/_commits/{run}-{part}")
        files.create(at, True).close()
    # of a key's rows the latest good one counts, or else the latest
    now = spark.read.parquet(f"{path}/rows").where((F.col("run") == run) & F.col("part").isin(committed(spark, path)[run])).drop("run", "part")
    return now if done is None else carried(asked, done, key).unionByName(now)
