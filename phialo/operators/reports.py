"""Coverage, lengths and data quality of entity tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phialo.functions import text as T


def coverage(df: DataFrame, field: str, sentinel: str) -> DataFrame:
    """Filled and total rows of a field, percent rounded down."""
    filled = F.count_if((F.col(field) != sentinel) & (F.col(field) != ""))
    total = F.count(F.lit(1))
    return df.agg(filled.alias("filled"), total.alias("total"), F.floor(100 * filled / F.greatest(total, F.lit(1))).alias("percent"))


def length_table(df: DataFrame, id: str, text: str, cut: int = 8000) -> DataFrame:
    """Characters of each document and whether a cut would shorten it."""
    n = F.length(T.or_empty(F.col(text))).cast("long")
    return df.select(id, n.alias("clean_chars"), (n > cut).alias("truncated"))


def length_stats(df: DataFrame, chars: str = "clean_chars", cut: int = 8000) -> DataFrame:
    """Documents over the cut, median, 90th percentile (exact, interpolated), maximum."""
    n, over = F.count(F.lit(1)), F.count_if(F.col(chars) > cut)
    return df.agg(
        n.alias("n"), over.alias("over"), T.ratio(100 * over, n).alias("over_percent"),
        F.percentile(chars, F.lit(0.5)).alias("median"), F.percentile(chars, F.lit(0.9)).alias("p90"), F.max(chars).alias("longest"),
    )


def adr_counts(rows: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Rows for each product; products without rows have 0 where a list is given."""
    counts = rows.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    return counts if products is None else products.select("product_id").join(counts, "product_id", "left").na.fill({"n": 0})


def _long(row: DataFrame, check: str) -> DataFrame:
    """A one-row table as (check, metric, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in row.columns])
    return row.select(F.lit(check).alias("check"), F.explode(pairs).alias("z")).select("check", "z.*")


def _codes(df: DataFrame, column: str, missing: str, good: Column) -> DataFrame:
    filled = F.col(column) != missing
    row = df.where(F.col(column) != "").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(filled).alias("filled"), F.count_if(~filled).alias("missing"), F.count_if(filled & ~good).alias("bad_shape")
    )
    return _long(row.withColumn("percent", F.floor(100 * F.col("filled") / F.greatest("total", F.lit(1)))), column)


def quality_report(drugs: DataFrame, adrs: DataFrame, smpcs: DataFrame, facts: DataFrame) -> DataFrame:
    """(check, metric, value) for counts, codes, completeness, labels and addresses."""
    there = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c) != ""))
    refs = facts.select("smpc_id").distinct()
    lost = refs.join(smpcs.select(F.col("slug").alias("smpc_id")), "smpc_id", "left_anti").agg(F.count(F.lit(1)).alias("dangling"))
    shared = drugs.select("slug").join(adrs.select("slug"), "slug", "left_semi").agg(F.countDistinct("slug").alias("shared_names"))
    parts = [
        *[_long(df.agg(F.count(F.lit(1)).alias(name)), "individuals") for name, df in (("drugs", drugs), ("adrs", adrs), ("smpcs", smpcs), ("occurrences", facts))],
        _codes(drugs, "atc_code", "UNKNOWN", T.valid_atc(F.col("atc_code"))),
        _codes(adrs, "meddra_code", "0", T.valid_meddra(F.col("meddra_code"))),
        _codes(adrs, "icd_code", "UNKNOWN", T.valid_icd(F.col("icd_code"))),
        _long(facts.agg(F.count(F.lit(1)).alias("references"), F.countDistinct("smpc_id").alias("targets")), "links"),
        _long(lost, "links"),
        _long(shared, "links"),
        _long(
            facts.agg(
                there("frequency").alias("with_frequency"), there("soc").alias("with_soc"), there("adr_id").alias("with_adr"), there("drug_id").alias("with_drug"),
                F.count_if(F.col("frequency") != "not known").alias("frequency_filled"), F.count_if(F.col("frequency") == "not known").alias("frequency_unknown"),
                F.count_if(F.col("soc") != "UNKNOWN").alias("soc_filled"), F.count_if(F.col("soc") == "UNKNOWN").alias("soc_unknown"),
            ),
            "occurrences",
        ),
        _long(drugs.agg(there("label").alias("drug_labels")), "labels"),
        _long(adrs.agg(there("adr_term").alias("adr_labels")), "labels"),
        _long(smpcs.agg(there("source_url").alias("urls"), F.count_if(~T.valid_url(F.col("source_url"))).alias("bad_urls")), "labels"),
    ]
    return reduce(DataFrame.unionByName, parts)


ISSUES = (("atc_code", "missing"), ("meddra_code", "missing"), ("icd_code", "missing"), ("links", "dangling"), ("atc_code", "bad_shape"))


def quality_verdict(report: DataFrame) -> DataFrame:
    """PASS, or the number of issues with their counts."""
    hit = reduce(lambda a, b: a | b, [(F.col("check") == c) & (F.col("metric") == m) for c, m in ISSUES])
    found = report.where(hit & (F.col("value") > 0)).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "value", "check", "metric"))).alias("issues"))
    return found.select(F.when(F.size("issues") == 0, "PASS").otherwise("INFO").alias("verdict"), "issues")
