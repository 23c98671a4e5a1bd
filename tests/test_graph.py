"""Dimensions, facts, slugs, triples and their checks on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from phialo.operators import graph, reports
from phialo.plans import graph_queries
from phialo.sources import tables


def rows(spark):
    data = [
        (3, "1", "Rash ", "", "", "0", "", ""),
        (1, "1", "rash", "not known", "UNKNOWN", "0", "L50", "Rash NOS"),
        (5, "1", "RASH", "Common", "skin and appendages", "10000001", "UNKNOWN", "x"),
        (2, "2", "rash", None, "weird class", None, None, None),
        (4, "2", "Pain / ache", "rare", "", "123", "R52", ""),
        (6, "", "rash", "rare", "", "", "", ""),
        (7, "9", " ", "rare", "", "", "", ""),
    ]
    return spark.createDataFrame(data, "seq long, product_id string, adr_term string, frequency string, soc string, meddra_code string, icd_code string, meddra_preferred_term string")


def drugs(spark):
    data = [(1, "1", "Abc | 5 mg", "A10BA02"), (2, "2", "Abc", ""), (3, "2", "Abc", "N05"), (4, "3", None, None), (5, "", "x", "x")]
    return graph.drug_dim(spark.createDataFrame(data, "seq long, product_id string, brand_name string, atc_code string"), spark.createDataFrame([("1", " INN ")], "product_id string, active_ingredient string"))


def test_occurrences_take_first_telling_values(spark):
    got = {(r["product_id"], r["adr_term"]): (r["frequency"], r["soc"]) for r in graph.occurrences(rows(spark)).collect()}
    assert got == {
        ("1", "rash"): ("common", "Skin and Subcutaneous Tissue Disorders"),
        ("2", "rash"): ("not known", "Weird Class"),
        ("2", "pain / ache"): ("rare", "UNKNOWN"),
    }


def test_partitions_do_not_matter(spark):
    want = sorted(map(tuple, graph.occurrences(rows(spark)).collect()))
    for n in (1, 7):
        assert sorted(map(tuple, graph.occurrences(rows(spark).repartition(n).orderBy(F.rand(n))).collect())) == want


def test_adr_dim(spark):
    got = {r["adr_term"]: tuple(r)[2:] for r in graph.adr_dim(rows(spark)).collect()}
    assert got["rash"] == ("rash nos", "10000001", "L50", "rash")
    assert got["pain / ache"] == ("pain / ache", "123", "R52", "pain_ache")


def plain_slugs(names):
    used, out = set(), []
    for n in names:
        got, k = n, 2
        while got in used:
            got, k = f"{n}_{k}", k + 1
        used.add(got)
        out.append(got)
    return out


def test_slugs_like_a_loop(spark):
    rng = random.Random(1)
    names = [rng.choice(["a", "a_2", "a_3", "a_2_2", "b", "b_c", "d_2"]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(names)), "seq long, base string")
    got = [r["slug"] for r in graph.unique_slugs(df, "base").orderBy("seq").collect()]
    assert got == plain_slugs(names)


@pytest.mark.parametrize("seed", range(4))
def test_slugs_of_names_that_meet_numbers(spark, seed):
    rng = random.Random(seed)
    endings = ["", "", "", "_2", "_3", "_4", "_9", "_2_2", "_2_3", "_02", "_1", "_0", "_3_2_2"]
    names = [rng.choice(["a", "b", "c"]) + rng.choice(endings) for _ in range(120)] + [f"product_{k}" for k in range(60)] + ["product"] * (seed * 20)
    names += [f"hot_{k}" for k in range(2, 40)] + ["hot"] * 60
    rng.shuffle(names)
    df = spark.createDataFrame(list(enumerate(names)), "seq long, base string").repartition(5)
    got = [r["slug"] for r in graph.unique_slugs(df, "base").orderBy("seq").collect()]
    assert got == plain_slugs(names)


def test_no_slugs(spark):
    assert graph.unique_slugs(spark.createDataFrame([], "seq long, base string"), "base").count() == 0



def test_drug_dim(spark):
    got = {r["product_id"]: (r["label"], r["atc_code"], r["slug"], r["active_ingredient"]) for r in drugs(spark).collect()}
    assert got == {"1": ("Abc", "A10BA02", "abc", "inn"), "2": ("Abc", "N05", "abc_3", ""), "3": ("product_3", "UNKNOWN", "product_3", "")}


def test_graph_end_to_end(spark, tmp_path):
    d, a, o = drugs(spark), graph.adr_dim(rows(spark)), graph.occurrences(rows(spark))
    s = graph.smpc_dim(d)
    facts = graph.occurrence_fact(o, d, a, s)
    t = graph.triples(d, a, s, facts)
    # 65 constant triples, 5 or 6 a drug, 6 a reaction, 4 a document, 8 an occurrence
    assert graph.schema_triples(spark).count() == 65 and t.count() == 65 + 6 + 5 + 5 + 2 * 6 + 3 * 4 + 3 * 8
    assert graph.validate_graph(t).first()["verdict"] == "VALID"
    occ = facts.first()["occ_id"]
    assert graph.validate_graph(t.where(~((F.col("s") == occ) & (F.col("p") == "soc")))).first()["verdict"] == "INVALID"
    extra = spark.createDataFrame([("x", "y", "see OpenPVSignal", "literal")], t.schema)
    assert graph.validate_graph(t.unionByName(extra)).first()["verdict"] == "INVALID"
    assert graph.dangling(facts, s.where("product_id <> '2'")).collect()[0]["smpc_id"] == "smpc_2"
    report = reports.quality_report(d, a, s, facts)
    assert reports.quality_verdict(report).first()["verdict"] == "INFO"
    q7 = graph_queries.patient_scenario(facts, d, a, ["1", "3"], "10000001").collect()
    assert [(r["pid"], r["adrLabel"]) for r in q7] == [("1", "rash"), ("3", None)]
    assert [tuple(r) for r in graph_queries.adr_per_drug(facts, d).collect()] == [("Abc", 3)]
    tables.write_turtle(d, a, s, facts, str(tmp_path / "ttl"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "ttl").glob("part-*")))
    assert text.startswith("@prefix : <") and text.index(":abc rdf:type") < text.index(":abc_3 rdf:type") < text.index(":pain_ache rdf:type") < text.index(":occ_1_")
    assert '    :activeIngredient "inn" .' in text


def test_steps_of_ranges_compose():
    pick = random.Random(3)
    for _ in range(500):
        bars = [pick.randint(-3, 14) for _ in range(pick.randint(0, 12))]
        breaks = graph.skipped(bars)
        for before in range(20):
            after = before
            for bar in bars:
                after += after < bar
            assert after == before + len(breaks) - sum(x <= before for x in breaks)


def test_slugs_of_many_numbered_names_take_a_fixed_number_of_jobs(spark):
    """A hot base whose numbers are mostly taken, in an order that lets each skip decide the next."""
    pick = random.Random(8)
    names = ["product"] * 1500 + [f"product_{k}" for k in range(2, 1500) if k % 5] + [f"product_{k}_2" for k in range(2, 60)]
    pick.shuffle(names)
    df = spark.createDataFrame(list(enumerate(names)), "seq long, base string")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("slugs", "slugs")
    got = [r["slug"] for r in graph.unique_slugs(df, "base").orderBy("seq").collect()]
    many = len(jobs.getJobIdsForGroup("slugs"))
    assert got == plain_slugs(names)
    few = spark.createDataFrame(list(enumerate(["product", "product_2", "product", "product_2_2", "product_2"])), "seq long, base string")
    spark.sparkContext.setJobGroup("few", "few")
    assert [r["slug"] for r in graph.unique_slugs(few, "base").orderBy("seq").collect()] == plain_slugs(["product", "product_2", "product", "product_2_2", "product_2"])
    assert many <= len(jobs.getJobIdsForGroup("few")) + 40
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
