"""Pairing against the plain greedy loop; manual matches; runs."""

import random

import pytest

from phialo.functions import text as T
from phialo.plans import compare, evaluation


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, product_id string, adr_term string, frequency string, soc string")


def greedy(gold, pred):
    """TP pairs with equal frequencies first, then by order."""
    tp = fq = 0
    free = list(pred)
    rest = []
    for f in gold:
        if f in free:
            free.remove(f)
            tp, fq = tp + 1, fq + 1
        else:
            rest.append(f)
    more = min(len(rest), len(free))
    return tp + more, len(free) - more, len(rest) - more, fq


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_pairing_like_a_loop(spark, monkeypatch, hot):
    monkeypatch.setattr(evaluation, "HOT", hot)
    rng = random.Random(9)
    side = lambda n: [(str(rng.randrange(3)), rng.choice(["A & b", "a and B", "c"]), rng.choice(["rare", "Very-common", "very common"]), "x") for _ in range(n)]
    gold, pred = side(60), side(70)
    matches = evaluation.match_table(evaluation.eval_rows(frame(spark, gold)), evaluation.eval_rows(frame(spark, pred)))
    s = evaluation.eval_summary(matches).first()
    norm = {"A & b": 0, "a and B": 0, "c": 1}
    want = [0, 0, 0, 0]
    for pid in "012":
        for k in (0, 1):
            g, p = ([f.lower().replace("-", " ") for q, t, f, _ in rows if q == pid and norm[t] == k] for rows in (gold, pred))
            want = [a + b for a, b in zip(want, greedy(g, p), strict=True)]
    assert [s["TP"], s["FP"], s["FN"], s["freq"]] == want


def test_manual_strict_and_lenient(spark):
    gold = evaluation.eval_rows(frame(spark, [("1", "x", "", ""), ("1", "y", "", ""), ("EXAMPLE", "z", "", ""), ("1", " ", "", "")]))
    pred = evaluation.eval_rows(frame(spark, [("1", "x including y", "", "")]))
    manual = spark.createDataFrame([(0, "1", "X", "x including y"), (1, "1", "y", "X including y"), (2, "1", "q", "x including y")], "seq long, product_id string, gold_term string, pred_term string")
    count = lambda lenient: tuple(evaluation.eval_summary(evaluation.match_table(gold, pred, manual, lenient=lenient)).first()[c] for c in ("TP", "FP", "FN"))
    assert count(False) == (1, 0, 1) and count(True) == (2, 0, 0)


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_rows_are_dealt_once(spark, monkeypatch, hot):
    """Pairing, scope and manual rows: one shuffle by product, and the same results where products are hot."""
    monkeypatch.setattr(evaluation, "HOT", hot)
    gold = evaluation.eval_rows(frame(spark, [("1", "a", "rare", "x"), ("1", "b", "rare", "x"), ("1", "a", "common", "x"), ("3", "c", "", "y")]))
    pred = evaluation.eval_rows(frame(spark, [("1", "A", "common", "z"), ("1", "q", "rare", "x"), ("2", "a", "rare", "x"), ("1", "r", "", "x"), ("1", "q", "", "x")]))
    manual = spark.createDataFrame([(0, "1", "b", "q"), (1, "2", "a", "r"), (2, "1", "a", "q")], "seq long, product_id string, gold_term string, pred_term string")
    rows = lambda df: sorted((r["product_id"], r["status"], r["gold_term"], r["pred_term"], r["freq_ok"]) for r in df.collect())
    plain = evaluation.match_table(gold, pred, scope=True)
    assert rows(plain) == sorted([("1", "TP", "a", "A", 1), ("1", "FN", "a", "", None), ("1", "FN", "b", "", None), ("3", "FN", "c", "", None), ("1", "FP", "", "q", None), ("1", "FP", "", "q", None), ("1", "FP", "", "r", None)], key=lambda r: r[:4])
    moved = evaluation.match_table(gold, pred, manual, lenient=True, scope=True)
    assert rows(moved) == sorted(
        [("1", "TP", "a", "A", 1), ("1", "TP", "a", "q", 1), ("1", "TP", "b", "q", 1), ("3", "FN", "c", "", None), ("1", "FP", "", "q", None), ("1", "FP", "", "q", None), ("1", "FP", "", "r", None)], key=lambda r: r[:4]
    )
    if hot > 3:
        for df in (plain, moved):
            plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
            assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert ("2" in {r["product_id"] for r in evaluation.match_table(gold, pred).collect()}) and "2" not in {r["product_id"] for r in plain.collect()}


def test_soc_map_and_empty(spark):
    gold, pred = evaluation.eval_rows(frame(spark, [("1", "x", "", "Skin")])), evaluation.eval_rows(frame(spark, [("1", "x", "", "skin disorders")]))
    names = spark.createDataFrame([(0, "skin", "Skin  disorders")], "seq long, raw string, canonical string")
    assert evaluation.eval_summary(evaluation.match_table(gold, pred, soc_map=names)).first()["soc"] == 1
    none = evaluation.eval_summary(evaluation.match_table(gold.where("false"), pred.where("false"))).first()
    assert none["TP"] == 0 and none["f1"] != none["f1"] and none["precision_ci95"]["low"] != none["precision_ci95"]["low"]


def test_runs(spark):
    rows = [(r, "1", t, "rare", "s") for r, ts in enumerate((["a", "b"], ["A ", "c"], ["a"])) for t in ts]
    df = spark.createDataFrame(rows, "run int, product_id string, adr_term string, frequency string, soc string")
    assert {r["runs"]: r["keys"] for r in compare.run_membership(df).collect()} == {3: 1, 1: 2}
    keys = compare.run_keys(df)
    one = compare.compare_sets(keys.where("run = 0").drop("run"), keys.where("run = 1").drop("run")).first()
    assert (one["left"], one["right"], one["common"], one["only_left"], one["only_right"]) == (2, 2, 1, 1, 1)
    assert compare.run_row_counts(df).count() == 3


def test_displays(spark):
    row = spark.range(1).select(T.interval_text(T.wilson(T.F.lit(5), T.F.lit(10))).alias("x")).first()
    assert row["x"] == "[23.7%, 76.3%]"
