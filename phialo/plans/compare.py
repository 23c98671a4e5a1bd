"""Repeated runs against each other; rows carry ``run``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phialo.functions import text as T


def run_keys(rows: DataFrame, full: bool = False) -> DataFrame:
    """Distinct (run, product_id, term[, frequency, soc]) in comparison form."""
    columns = [T.run_term(F.col("adr_term")).alias("term")]
    if full:
        columns += [T.run_term(F.col("frequency")).alias("frequency"), T.run_term(F.col("soc")).alias("soc")]
    return rows.select("run", F.col("product_id").cast("string").alias("product_id"), *columns).distinct()


def run_membership(rows: DataFrame, full: bool = False) -> DataFrame:
    """How many keys are present in how many runs: (runs, keys)."""
    keys = run_keys(rows, full)
    by = [c for c in keys.columns if c != "run"]
    return keys.groupBy(*by).agg(F.count(F.lit(1)).alias("runs")).groupBy("runs").agg(F.count(F.lit(1)).alias("keys"))


def compare_sets(a: DataFrame, b: DataFrame, by: str | None = None) -> DataFrame:
    """Sizes of both sides' distinct keys, of what they share and what only one has."""
    both = a.withColumn("_a", F.lit(True)).unionByName(b.select(a.columns).withColumn("_a", F.lit(False)))
    keys = both.groupBy(*a.columns).agg(F.bool_or("_a").alias("_in_a"), F.bool_or(~F.col("_a")).alias("_in_b"))
    grouped = keys.groupBy(by) if by else keys
    in_a, in_b = F.col("_in_a"), F.col("_in_b")
    return grouped.agg(
        F.count_if(in_a).alias("left"), F.count_if(in_b).alias("right"), F.count_if(in_a & in_b).alias("common"),
        F.count_if(in_a & ~in_b).alias("only_left"), F.count_if(in_b & ~in_a).alias("only_right"),
    )


def run_row_counts(rows: DataFrame) -> DataFrame:
    """U4: (metric, product_id, value) with zeros for products that a run lacks."""
    runs = [r["run"] for r in rows.select("run").distinct().orderBy("run").collect()]  # a comparison has a handful of runs
    counts = rows.groupBy("product_id").agg(*[F.count_if(F.col("run") == r).alias(f"rows_{r}") for r in runs])
    return counts.unpivot("product_id", [f"rows_{r}" for r in runs], "metric", "value")
