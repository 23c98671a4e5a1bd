"""Vocabulary lookups and back-fills on a small vocabulary."""

import random
import re

import pytest
from pyspark.sql import functions as F

from phialo.operators import lookup, sampling


def vocab(spark):
    rows = [
        ("MDR", "1", "Rash", "C1"), ("MDR", "2", "Skin rash itchy", "C2"), ("MDR", "NONE", "Fever", "C3"), ("MDR", "4", "Heart failure, acute", "C4"), ("MDR", "5", "Nausea", "C5"),
        ("ICD10CM", "x/L50", "Urticaria", "C1"), ("ICD10", "y/R11", "nausea", "C5"), ("ICD10CM", "NOCODE", "z", "C5"), ("ICD10", "h/I50", "acute heart failure", "C9"),
    ]
    return spark.createDataFrame(rows, "sab string, code string, name string, cui string")


def adrs(spark):
    rows = [(1, "1", " Rash", "0", "UNKNOWN", ""), (2, "1", "rash", "1", "UNKNOWN", "x"), (3, "2", "Nausea (mild) and pain", "0", "UNKNOWN", ""), (4, "2", "acute HEART failure", "0", "UNKNOWN", ""), (5, "3", "nausae", "0", "UNKNOWN", ""), (6, "3", "ab", "0", "X", "")]
    return spark.createDataFrame(rows, "seq long, product_id string, adr_term string, meddra_code string, icd_code string, meddra_preferred_term string")


def terms(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "term string")


def test_cascade(spark):
    got = {r["term"]: (r["code"], r["status"]) for r in lookup.lookup(terms(spark, "RASH", "itchy rash", "fever", "", "none"), vocab(spark), "MDR").collect()}
    assert got == {"RASH": ("1", "matched_exact"), "itchy rash": ("2", "matched_words"), "fever": ("", "not_found"), "": ("", "empty_query"), "none": ("", "not_found")}


def test_second_pass(spark):
    got = {r["original_term"]: (r["cleaned_candidate"], r["meddra_code"]) for r in lookup.meddra_second_pass(adrs(spark), vocab(spark)).collect()}
    assert got == {"nausea (mild) and pain": ("nausea and pain", "5"), "acute heart failure": ("acute heart failure", "4"), "nausae": ("nausae", "0"), "ab": ("ab", "0")}


def test_approximate_finds_the_closest(spark):
    """Misspelt words find their closest names, as comparing all with all does, and all near pairs by pieces."""
    rng = random.Random(3)
    words = ["nausea", "rash", "heart failure", "acute renal failure", "ab", "customer#0001", "hepatitis b", "x", "abdominal pain upper"]

    def typo(w):
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(w))
            w = w[:at] + rng.choice(["", "a", "e", "#"]) + w[at + rng.randint(0, 1) :]
        return w or "z"

    names = sorted({typo(rng.choice(words)).title() for _ in range(150)} | {"Nausea"})
    asked = sorted({typo(rng.choice(words)) for _ in range(150)} | {"nauseaa"})
    book = spark.createDataFrame([("MDR", str(i), n, "C") for i, n in enumerate(names)], "sab string, code string, name string, cui string")
    pairs = terms(spark, *asked).crossJoin(book).withColumn("far", F.levenshtein(F.lower("term"), F.lower("name")) / F.greatest(F.length("term"), F.length("name")))
    for least, block in ((0.8, 2000), (0.6, 7), (0.4, 2000)):
        lookup.BLOCK, before = block, lookup.BLOCK
        got = sorted((r["term"], r["name"]) for r in lookup.hits(terms(spark, *asked), book, ["MDR"], ["approximate"], least).collect())
        every = sorted((r["_t"], r["_n"]) for r in lookup._by_pieces(terms(spark, *asked), book, least).collect())
        lookup.BLOCK = before
        want = pairs.where(1 - F.col("far") >= least).withColumn("edits", F.levenshtein(F.lower("term"), F.lower("name"))).collect()
        assert every == sorted((r["term"], r["name"].lower()) for r in want)
        fewest = {}
        for r in want:
            fewest[r["term"]] = min(r["edits"], fewest.get(r["term"], 99))
        assert got == sorted((r["term"], r["name"]) for r in want if r["edits"] == fewest[r["term"]])
        assert ("nauseaa", "Nausea") in got


def test_crosswalk_and_backfill(spark):
    targets = lookup.icd_targets(lookup.term_index(adrs(spark)))
    got = {r["term"]: (r["icd_code_new"], r["source"]) for r in lookup.icd_crosswalk(targets, vocab(spark)).collect()}
    assert got == {"rash": ("L50", "crosswalk"), "nausea (mild) and pain": ("UNKNOWN", "freetext"), "acute heart failure": ("I50", "freetext"), "nausae": ("UNKNOWN", "freetext")}
    cache = spark.createDataFrame([("rash", "77", "Rash NOS"), ("ab", "", "")], "term string, code string, preferred string")
    out = {r["seq"]: (r["meddra_code"], r["meddra_preferred_term"]) for r in lookup.backfill_codes(adrs(spark), cache, "meddra_code").collect()}
    assert out[1] == ("77", "rash nos") and out[2] == ("1", "x") and out[6] == ("0", "")
    icd = {r["seq"]: r["icd_code"] for r in lookup.backfill_codes(adrs(spark), cache, "icd_code").collect()}
    assert icd[1] == "77" and icd[6] == "X"


def test_first_pass_is_case_sensitive(spark):
    found = spark.createDataFrame([("Rash", "9")], "term string, code string")
    out = {r["seq"]: r["meddra_code"] for r in lookup.apply_matches(adrs(spark), found, found.where("false")).collect()}
    assert out[1] == "9" and out[2] == "0"


def test_atc(spark):
    inn = spark.createDataFrame([("a, b",), ("c",), ("d",)], "inn string")
    names = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("c", "3", 1), ("c", "3", 2)], "term string, rxcui string, rank int")
    props = spark.createDataFrame([("2", "ATC", "A2"), ("9", "ATC", "A9"), ("1", "TTY", "x")], "rxcui string, prop string, value string")
    rels = spark.createDataFrame([("1", "7", 1), ("3", "8", 1), ("3", "9", 2)], "rxcui string, ing_rxcui string, rank int")
    got = {r["inn"]: (r["atc_code"], r["atc_source"]) for r in lookup.atc_lookup(inn, names, props, rels).collect()}
    assert got == {"a, b": ("A2", "rxnorm_direct"), "c": ("A9", "rxnorm_via_ingredient"), "d": ("UNKNOWN", "not found in RxNorm")}
    drugs = spark.createDataFrame([("120",), ("8137",), ("5",)], "product_id string")
    found = spark.createDataFrame([("eplerenone", "C03", "rxnorm_direct"), ("ibuprofen", "C01EB16", "rxnorm_direct")], "inn string, atc_code string, atc_source string")
    out = {r["product_id"]: (r["active_ingredient"], r["atc_code"], r["atc_source"]) for r in lookup.apply_overrides(drugs, found).collect()}
    assert out == {"120": ("eplerenone", "C03", "rxnorm_direct"), "8137": ("ibuprofen", "M01AE01", "manual_who_atc"), "5": ("", "UNKNOWN", "inn not in map")}


def test_samples(spark):
    df = spark.range(1000).selectExpr("cast(id AS string) AS product_id")
    a = [r[0] for r in sampling.sample_n(df, 50).collect()]
    b = [r[0] for r in sampling.sample_n(df.repartition(7), 50).collect()]
    assert a == b and len(set(a)) == 50 and a == sorted(a, key=int)
    picks = sampling.pick_candidates(spark.range(5).selectExpr("id AS product_id", "5 - id AS n"), [("big", F.col("n") > 3), ("any", F.lit(True)), ("none", F.lit(False))], ["n"])
    assert [(r["product_id"], r["reason"]) for r in picks.orderBy("pick").collect()] == [(1, "big"), (4, "any")]


def held_by(term, names):
    """The best name that holds all words of a term, by comparing it with all."""
    words = set(re.findall(r"\w+", term.lower()))
    fits = [(len(n), c, n) for c, n in names if words and words <= set(re.findall(r"\w+", n.lower()))]
    return min(fits, default=None)


@pytest.mark.parametrize("block", [2, 2000])
def test_words_like_all_pairs(spark, block):
    pick = random.Random(block)
    words = ["pain", "acute", "of", "back", "severe"] + [f"w{i}" for i in range(12)]
    say = lambda: " ".join(pick.choices(words, weights=[9, 7, 7, 3, 3] + [1] * 12, k=pick.randint(1, 5)))
    names = [(str(i), say().title()) for i in range(250)]
    asked = sorted({say() for _ in range(250)} | {"pain", "PAIN of", "nowhere pain", "#"})
    book = spark.createDataFrame([("MDR", c, n, "C" + c, 1) for c, n in names], "sab string, code string, name string, cui string, sab_rank int")
    got = {r["term"]: (len(r["name"]), r["code"], r["name"]) for r in lookup._best_holding(terms(spark, *asked), book, block).collect()}
    want = {t: held_by(t, names) for t in asked}
    assert got == {t: w for t, w in want.items() if w}


def test_a_word_in_most_names_is_no_single_task(spark):
    """One word in 100,000 names and 10,000 terms: rare second words, and second words that are frequent too."""
    names = spark.range(100_000).selectExpr("'MDR' AS sab", "cast(id AS string) AS code", "concat('pain ', if(id % 2 = 0, 'acute ', ''), 'x', id % 9000, ' y', id) AS name", "'' AS cui", "1 AS sab_rank")
    asked = spark.range(10_000).selectExpr("CASE WHEN id < 2 THEN if(id = 0, 'pain', 'acute pain') WHEN id % 6 = 0 THEN concat('pain acute x', id) ELSE concat('pain x', id) END AS term")
    got = {r["term"]: r["code"] for r in lookup._best_holding(asked, names).collect()}
    assert (got["pain"], got["acute pain"], got["pain x7"], got["pain acute x6"]) == ("1", "0", "7", "6")
    assert len(got) == 9000  # no name has a word from x9000 on


def test_second_pass_sends_no_vocabulary_to_all(spark, tmp_path):
    """Files of many names may look small enough to be broadcast; only keys of long lists may."""
    spark.range(50).selectExpr("'MDR' AS sab", "cast(id AS string) AS code", "concat('Name#', id) AS name", "'' AS cui").write.parquet(f"{tmp_path}/vocab")
    spark.range(60).selectExpr("id AS seq", "concat('name#', id) AS adr_term", "'0' AS meddra_code").write.parquet(f"{tmp_path}/rows")
    out = lookup.meddra_second_pass(spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/vocab"))
    assert {r["original_term"]: r["meddra_code"] for r in out.collect()} == {f"name#{i}": str(i if i < 50 else min(i % 10, 5)) for i in range(60)}
    joins = [line for line in out._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in line]
    assert any("SortMergeJoin" in j for j in joins) and all("piece" in j for j in joins if "Broadcast" in j)
    near = lookup._one_edit(out.selectExpr("original_term AS _t").distinct(), spark.read.parquet(f"{tmp_path}/vocab").selectExpr("name AS _n").distinct())
    assert "Broadcast" not in near._jdf.queryExecution().sparkPlan().toString()
