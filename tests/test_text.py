"""Scalar functions on edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from phialo.functions import text as T


def values(spark, f, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (T.strip, ["  a b ", "\t\n"], ["a b", ""]),
    (T.tidy, [" a \n  b "], ["a b"]),
    (lambda c: T.safe_int(c), ["7", " 8 ", "x", "", None], [7, 8, 0, 0, 0]),
    (T.product_id_of, ["https://x/emc/product/12/smpc", "/emc/product/34", "/emc/product/5x", None], [12, 34, None, None]),
    (T.is_sitemap, ["http://a/b.XML?x=1", "http://a/b", "::bad"], [True, False, False]),
    (T.slug, ["  Foo, Bar (x) - 5 mg ", "%%%", "É-ß_a", "a" * 90, "__x__"], ["foo_bar_x_5_mg", "unknown", "é_ß_a", "a" * 80, "x"]),
    (T.title_case, ["o'neil's heart-ache 3rd ÉTAT", "nervous system"], ["O'Neil'S Heart-Ache 3Rd État", "Nervous System"]),
    (T.search_terms, ["Rash (Skin) b", "nausea and vomiting", "pain/ache", "fever"], [["rash"], ["nausea and vomiting", "nausea"], ["pain/ache", "pain"], ["fever"]]),
    (T.drug_query, ["Abc  Def 5 mg | x", "Tablets", "Xyz Tablets.", None, "5 mg"], ["Abc Def", "Tablets", "Xyz", "", "5 mg"]),
    (T.eval_term, [" A&B, γ-x (é) ", None], ["a and b γ x", ""]),
    (T.eval_frequency, ["Very-Common ", "very  common"], ["very common", "very common"]),
    (T.escape_literal, ['a"b\\c\nd '], ['a\\"b\\\\c d']),
    (T.atc_level, ["N05", "UNKNOWN"], ["N", "U"]),
    (T.valid_atc, ["A10BA02", "A10BA", "A10B", "A10", "A", "A1", "a10"], [True] * 5 + [False] * 2),
    (T.valid_meddra, ["1234567", "12345678", "123456", "1234567x"], [True, True, False, False]),
    (T.valid_icd, ["K29.7", "T5", "K290", "K29.7A"], [True, True, False, False]),
    (T.valid_url, ["https://a", "http://a"], [True, False]),
    (T.locations, ["<loc> a </loc><s:loc>b</s:loc><loc></loc>"], [["a", "b"]]),
]


@pytest.mark.parametrize("f,given,want", CASES)
def test_scalars(spark, f, given, want):
    assert values(spark, f, *given) == want


def test_occurrence_id(spark):
    import hashlib

    row = spark.range(1).select(T.occurrence_id(F.lit("12"), F.lit("naïve")).alias("x")).first()
    assert row["x"] == "occ_12_" + hashlib.sha1("12|naïve".encode()).hexdigest()[:12]


def test_rates(spark):
    df = spark.createDataFrame([(0, 0), (3, 10), (10, 10)], "k int, n int")
    rows = df.select("n", T.ratio(F.col("k"), F.col("n")).alias("r"), T.wilson(F.col("k"), F.col("n")).alias("w"), T.percent_text(T.ratio(F.col("k"), F.col("n"))).alias("t")).orderBy("k").collect()
    assert math.isnan(rows[0]["r"]) and math.isnan(rows[0]["w"]["low"]) and rows[0]["t"] == "n/a"
    assert rows[1]["t"] == "30.0%" and abs(rows[1]["w"]["low"] - 0.1078) < 1e-3 and abs(rows[1]["w"]["high"] - 0.6032) < 1e-3
    assert rows[2]["w"]["high"] == 1.0
