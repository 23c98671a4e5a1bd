"""Exact duplicates by block names against grouping by text."""

from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from phialo.llm import exact_dedup

SCHEMA = "doc_id long, text string, n long, name string, kept boolean"
LONG = "".join(chr(97 + i % 23) for i in range(5000))
TEXTS = [None, "", " ", "a", "b", "a", "ü" * 40, "ü" * 40 + "u", "x" * 64, "x" * 65, "x" * 128, "x" * 128, LONG, LONG, LONG[:-1] + "!", "!" + LONG[1:], LONG[:2500] + "!" + LONG[2501:], "🙂" * 33]


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        spare = 1
        for i in ids:
            kept = i == keep and spare == 1
            spare -= kept
            out.append((i, keep, len(ids), kept, sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("block_bytes", [64, 1024])
def test_edge_rows(spark, block_bytes):
    data = [(i, t, -1, "clash", None) for i, t in enumerate(TEXTS)] + [(5, "a", 0, "", True), (None, LONG, 0, "", True), (None, "only null ids", 0, "", True)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(data, SCHEMA), block_bytes=block_bytes)
    assert rows_of(got) == plain([(r[0], r[1]) for r in data])


def test_real_rows_and_a_hot_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    hot = spark.range(10_000, 10_300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the same words again "), 300).alias("text"))
    docs = docs.unionAll(hot)
    assert rows_of(exact_dedup.exact_duplicates(docs, block_bytes=128)) == plain([tuple(r) for r in docs.collect()])


def test_normalised_texts_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "ab")], "doc_id long, text string")
    got = exact_dedup.exact_duplicates(docs, normalise=F.lower)
    assert {(r.doc_id, r.keep_id, r.kept) for r in got.collect()} == {(1, 2, False), (2, 2, True), (3, 3, True)}
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_blocks_of_a_long_text_take_time_in_proportion(spark):
    import time

    def seconds(size):
        docs = spark.range(1).select(F.col("id").alias("doc_id"), F.expr(f"repeat('0123456789abcdef', {size // 16})").alias("text"))
        began = time.perf_counter()
        assert docs.select(F.size(exact_dedup.blocks("cast(text AS binary)", 64)).alias("n")).head().n == size // 64
        return time.perf_counter() - began

    seconds(1 << 16)
    assert seconds(1 << 25) < 20  # half a million blocks; copies of the whole at each step would be 8 TB
