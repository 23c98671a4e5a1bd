"""A corpus pipeline: quality rules, near-duplicates, personal data, packing.

Every stage takes what the one before kept.  The last returns the packed pieces, the others
the columns of ``documents``.

Defined results: rows that repeat are one document (one of them stays), rows that share an id
but not their text are documents of their own; null texts and texts without words fail the
base rule of the first stage; empty tables give empty tables; further columns stay up to the
last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phialo import scratch
from phialo.llm import near_duplicates, packing, pii, quality
from phialo.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep."""
    return quality.good_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    A row is known by its id and a hash of all its columns, so that ids may repeat; ids that
    are null come last.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*docs.columns).alias("row"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), key.alias("key"), F.col("text"))
    kept = near_duplicates.near_duplicates(rows, id="key").where("kept").select("key").distinct()
    # rows with one key are equal in every column; the join has brought them together already
    return rows.select("key", "doc").join(kept, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    clean = pii.redact_pii(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return packing.pack(packing.pieces(docs.select("doc_id", "text"), vocabulary("word_bpe_49k.json")))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Tokenising is beyond SQL; tests/llm/test_pipeline.py holds run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
