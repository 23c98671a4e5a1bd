"""Questions to the graph's tables (dimensions ``drugs``, ``adrs``; facts ``facts``).

Facts have one row for each product and reaction, so counting rows counts occurrences, drugs
of a reaction or reactions of a drug.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phialo.functions import text as T


def adr_per_drug(facts: DataFrame, drugs: DataFrame) -> DataFrame:
    """G1: occurrences for each drug label; drugs of one label count together."""
    named = facts.join(drugs.select("product_id", "label"), "product_id")
    counts = named.groupBy(F.col("label").alias("drugLabel")).agg(F.count(F.lit(1)).alias("numADR"))
    return counts.orderBy(F.desc("numADR"), "drugLabel")


def top_adrs(facts: DataFrame, n: int = 20) -> DataFrame:
    """The reactions with the most drugs."""
    counts = facts.groupBy(F.col("adr_term").alias("adrLabel")).agg(F.count(F.lit(1)).alias("numDrugs"))
    return counts.orderBy(F.desc("numDrugs"), "adrLabel").limit(n)


def atc_categories(drugs: DataFrame) -> DataFrame:
    """Drugs for each first letter of the ATC code."""
    return drugs.groupBy(T.atc_level(F.col("atc_code")).alias("atcCategory")).agg(F.count(F.lit(1)).alias("count")).orderBy("atcCategory")


def by_frequency(facts: DataFrame, drugs: DataFrame, freq: str = "common") -> DataFrame:
    """Drug, reaction and class of occurrences with a frequency."""
    some = facts.where(F.lower("frequency") == freq).join(drugs.select("product_id", "label"), "product_id")
    return some.select(F.col("label").alias("drugLabel"), F.col("adr_term").alias("adrLabel"), "soc").orderBy("drugLabel", "adrLabel")


def soc_distribution(facts: DataFrame) -> DataFrame:
    """Occurrences for each known organ class."""
    counts = facts.where("soc <> 'UNKNOWN'").groupBy("soc").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "soc")


def drug_atc_summary(facts: DataFrame, drugs: DataFrame) -> DataFrame:
    """Occurrences for each label and ATC code."""
    named = facts.join(drugs.select("product_id", "label", "atc_code"), "product_id")
    counts = named.groupBy(F.col("label").alias("drugLabel"), F.col("atc_code").alias("atcCode")).agg(F.count(F.lit(1)).alias("adrCount"))
    return counts.orderBy("atcCode", "drugLabel")


def patient_scenario(facts: DataFrame, drugs: DataFrame, adrs: DataFrame, products: list[str], code: str) -> DataFrame:
    """The named products' drugs, each with its occurrences of a coded reaction or nulls."""
    wanted = drugs.where(F.col("product_id").isin([str(p) for p in products]))
    hit = facts.join(adrs.where(F.col("meddra_code") == code).select("adr_term"), "adr_term").select(
        "product_id", F.col("adr_term").alias("adrLabel"), "frequency", "soc"
    )
    rows = wanted.join(hit, "product_id", "left")
    return rows.select(F.col("product_id").alias("pid"), F.col("label").alias("drugLabel"), F.col("atc_code").alias("atcCode"), "adrLabel", "frequency", "soc").orderBy(
        "drugLabel", "adrLabel"
    )
