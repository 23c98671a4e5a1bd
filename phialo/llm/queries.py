"""The registered queries of this subpackage: opN_<name> over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phialo.llm import chat, exact_dedup, filter_audit, fingerprints, lm, near_duplicates, packing, pii, quality, secrets, segmentation, token_counts, whitening


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; every machine has it installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(documents(spark, sf_dir).select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
    return packing.pack(pieces)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = segmentation.encode(documents(spark, sf_dir).select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.col("nbest.score").alias("scores"),
        "ids",
        F.col("nbest.edits").alias("edits"),
        "round_trip",
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir).select("doc_id", "text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(documents(spark, sf_dir).select("doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(documents(spark, sf_dir))
    return out.select("doc_id", *quality.BASE, "base_failed", "kept")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(documents(spark, sf_dir))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_minhash_near_dedup,
        op3_best_fit_packing,
        op4_sentencepiece,
        op5_lm_scoring,
        op6_token_counts,
        op7_secret_scans,
        op8_pii,
        op9_quality_rules,
        op10_document_fingerprints,
        op11_embedding_whitening,
        op12_filter_audit,
        op13_exact_dedup,
    )
}
