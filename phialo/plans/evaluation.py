"""Gold rows against predictions: pairing, totals, intervals.

Rows carry ``seq``; "in order" means by it.  Keys are (product_id, key) with key the
comparison form of the term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phialo import scratch
from phialo.functions import text as T
from phialo.operators.graph import running_sum


def eval_rows(df: DataFrame) -> DataFrame:
    """rows with product and term, no example rows, fields stripped, is_head default 0."""
    pid, term = T.strip(T.or_empty(F.col("product_id").cast("string"))), T.strip(T.or_empty(F.col("adr_term")))
    head = T.or_empty(F.col("is_head").cast("string")) if "is_head" in df.columns else F.lit("")
    clean = df.select(
        "seq",
        pid.alias("product_id"),
        term.alias("adr_term"),
        T.strip(T.or_empty(F.col("frequency"))).alias("frequency"),
        T.strip(T.or_empty(F.col("soc"))).alias("soc"),
        T.strip(F.when(head == "", F.lit("0")).otherwise(head)).alias("is_head"),
    )
    return clean.where("product_id <> '' AND adr_term <> '' AND upper(product_id) <> 'EXAMPLE'")


def exclude_heads(gold: DataFrame) -> DataFrame:
    """without umbrella terms."""
    return gold.where("is_head <> '1'")


def scope_predictions(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions of products that the gold rows cover."""
    return pred.join(gold.select("product_id").distinct(), "product_id", "left_semi")


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"key": T.eval_term(F.col("adr_term")), "freq": T.eval_frequency(F.col("frequency"))})


def manual_moves(gold: DataFrame, pred: DataFrame, manual: DataFrame, lenient: bool) -> DataFrame:
    """(product_id, moves) of keyed rows: the predicted terms ``pk`` that go to gold terms ``gk``, in the order of ``move``.

    A strict run moves a term once, a lenient run to every gold term.
    """
    pairs = manual.select("seq", T.or_empty(F.col("product_id").cast("string")).alias("product_id"), T.eval_term(F.col("gold_term")).alias("gk"), T.eval_term(F.col("pred_term")).alias("pk"))
    # a repeated gold term keeps its first place and takes its last prediction
    pairs = pairs.groupBy("product_id", "gk").agg(F.min("seq").alias("move"), F.max_by("pk", "seq").alias("pk")).where("gk <> pk")
    pairs = pairs.join(gold.select("product_id", F.col("key").alias("gk")).distinct(), ["product_id", "gk"], "left_semi")
    pairs = pairs.join(pred.select("product_id", F.col("key").alias("pk")).distinct(), ["product_id", "pk"], "left_semi")
    if not lenient:
        once = Window.partitionBy("product_id", "pk").orderBy("move")
        pairs = pairs.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    # stored, so that its shuffles are gone before the rows are dealt
    return scratch.table(pairs.groupBy("product_id").agg(F.collect_list(F.struct("pk", "gk", F.col("move").cast("long").alias("move"))).alias("moves")), "moves")


#: Predictions of a moved term are behind those that are there; the term's own key is emptied, also of what was moved into it.
MOVED = """
 CASE WHEN side = 1 AND exists(moves, m -> m.pk = key)
 THEN transform(filter(moves, m -> m.pk = key AND NOT exists(moves, x -> x.pk = m.gk)), m -> struct(m.gk AS key, m.move AS move))
 ELSE array(struct(key, -1L AS move)) END"""

#: Rows of one product that a task numbers by itself; where a product has more, all are numbered in ranges.
HOT = 1_000_000
BUCKETS = 16384
OWN = ("adr_term", "frequency", "soc")


def has_hot(rows: DataFrame) -> bool:
    """Whether a product has more than ``HOT`` rows; only products of large buckets are counted one by one."""
    bucket = F.expr(f"pmod(xxhash64(product_id), {BUCKETS})")
    with scratch.shuffles_go(rows.sparkSession):
        large = [r["b"] for r in rows.groupBy(bucket.alias("b")).count().where(F.col("count") > HOT).collect()]  # BUCKETS rows at most
        return bool(large) and bool(rows.where(bucket.isin(large)).groupBy("product_id").count().where(F.col("count") > HOT).head(1))


def pair_rows(gold: DataFrame, pred: DataFrame, moves: DataFrame | None = None, scope: bool = False) -> DataFrame:
    """(product_id, in_gold, in_pred, same_freq, gold_*, pred_*) of paired and single rows.

    Equal frequencies pair first: the n-th gold row of a frequency with the n-th prediction
    of it.  What is left pairs by order.  Rows of both sides, and what manual rows move, are dealt
    once, by product; numbers, pairs and ``scope`` (J7) need no other shuffle, and keys are made
    behind it.  Where a product has more than ``HOT`` rows, rows are numbered in ranges instead and
    joined, so that no task holds them.
    """
    own = lambda df, side: df.select("product_id", "seq", *OWN, F.lit(side).alias("side"))
    product = Window.partitionBy("product_id")
    hot = has_hot(gold.select("product_id").unionAll(pred.select("product_id")))
    if hot:
        rows = own(gold, 0).unionByName(own(scope_predictions(pred, gold) if scope else pred, 1))
        rows = rows.join(moves, "product_id", "left") if moves is not None else rows
    else:
        rows = own(gold, 0).unionByName(own(pred, 1))
        if moves is not None:
            rows = rows.unionByName(moves.withColumn("side", F.lit(2)), allowMissingColumns=True)
            rows = rows.withColumn("moves", F.first("moves", ignorenulls=True).over(product))
        if scope:
            rows = rows.withColumn("_covered", F.max(F.col("side") == 0).over(product)).where("_covered").drop("_covered")
        rows = rows.where("side < 2")
    rows = keyed(rows).withColumn("move", F.lit(-1).cast("long"))
    if moves is not None:
        rows = rows.withColumn("_to", F.explode(F.expr(MOVED))).withColumns({"key": F.col("_to.key"), "move": F.col("_to.move")}).drop("_to", "moves")

    def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
        if not hot:
            return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("move", "seq")))
        df = df.withColumns({"_by": F.struct(*by), "_order": F.struct("move", "seq"), "_one": F.lit(1)})
        return running_sum(df, "_by", "_order", "_one", name).drop("_by", "_order", "_one")

    first = numbered(rows, ["product_id", "key", "freq", "side"], "n")
    values = {f"{n}_{c}": F.when(F.col("side") == i, F.col(c)) for i, n in enumerate(("gold", "pred")) for c in OWN}
    values |= {"in_gold": F.col("side") == 0, "in_pred": F.col("side") == 1, "move": F.col("move"), "seq": F.col("seq")}
    first = first.groupBy("product_id", "key", "freq", "n").agg(*[F.max(v).alias(c) for c, v in values.items()])
    first = first.withColumn("same_freq", F.col("in_gold") & F.col("in_pred"))
    rest = numbered(first.drop("n"), ["product_id", "key", "same_freq", "in_gold"], "n")
    kept = [c for c in values if c not in ("move", "seq")]
    return rest.groupBy("product_id", "key", "same_freq", "n").agg(*[F.max(c).alias(c) for c in kept]).drop("key", "n")


def match_table(gold: DataFrame, pred: DataFrame, manual: DataFrame | None = None, soc_map: DataFrame | None = None, lenient: bool = False, scope: bool = False) -> DataFrame:
    """One row for each true positive, false negative and false positive.

    ``scope``: predictions of products without gold rows don't count (J7).
    """
    moves = manual_moves(keyed(gold), keyed(pred), manual, lenient) if manual is not None else None
    both = F.col("in_gold") & F.col("in_pred")
    rows = pair_rows(gold, pred, moves, scope).select(
        "product_id",
        F.when(both, "TP").when(F.col("in_gold"), "FN").otherwise("FP").alias("status"),
        *[F.coalesce(f"{n}_{c}", F.lit("")).alias(f"{n}_{m}") for c, m in (("adr_term", "term"), ("frequency", "frequency"), ("soc", "soc")) for n in ("gold", "pred")],
        F.when(both, F.col("same_freq").cast("int")).alias("freq_ok"),
        T.eval_term(F.col("gold_soc")).alias("_gs"),
        T.eval_term(F.col("pred_soc")).alias("_ps"),
    )
    if soc_map is not None:  # S11; the map is a hand-made list
        names = soc_map.groupBy(T.eval_term(F.col("raw")).alias("_raw")).agg(F.max_by(T.eval_term(F.col("canonical")), "seq" if "seq" in soc_map.columns else F.lit(0)).alias("_to"))
        for c in ("_gs", "_ps"):
            rows = rows.join(names, F.col(c) == F.col("_raw"), "left").withColumn(c, F.coalesce("_to", c)).drop("_raw", "_to")
    ok = F.when(F.col("status") == "TP", (F.col("_gs") == F.col("_ps")).cast("int"))
    return rows.withColumn("soc_ok", ok).drop("_gs", "_ps").withColumn("error_category", F.lit(""))


def eval_per_product(matches: DataFrame) -> DataFrame:
    """A10: TP, FP, FN, precision and recall of each product."""
    counts = matches.groupBy("product_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("TP", "FP", "FN")])
    return counts.withColumns({"precision": T.ratio(F.col("TP"), F.col("TP") + F.col("FP")), "recall": T.ratio(F.col("TP"), F.col("TP") + F.col("FN"))})


def eval_summary(matches: DataFrame) -> DataFrame:
    """A10: one row of totals, rates and 95 % intervals."""
    tp = F.col("status") == "TP"
    t = matches.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("TP", "FP", "FN")],
        F.count_if(tp & (F.col("freq_ok") == 1)).alias("freq"),
        F.count_if(tp & (F.col("soc_ok") == 1)).alias("soc"),
        F.count_if(tp & (F.col("freq_ok") == 1) & (F.col("soc_ok") == 1)).alias("both"),
    )
    c = F.col
    t = t.withColumns({"n_pred": c("TP") + c("FP"), "n_gold": c("TP") + c("FN"), "n_tp": c("TP")})
    t = t.withColumns({"precision": T.ratio(c("TP"), c("n_pred")), "recall": T.ratio(c("TP"), c("n_gold"))})
    rates = {
        "precision_ci95": T.wilson(c("TP"), c("n_pred")),
        "recall_ci95": T.wilson(c("TP"), c("n_gold")),
        "f1": F.when(c("TP") > 0, 2 * c("precision") * c("recall") / (c("precision") + c("recall"))).otherwise(F.lit(float("nan"))),
    }
    for name, k in (("frequency", "freq"), ("soc", "soc"), ("all_fields", "both")):
        rates |= {f"{name}_accuracy": T.ratio(c(k), c("TP")), f"{name}_ci95": T.wilson(c(k), c("TP"))}
    return t.withColumns(rates)


def error_tally(matches: DataFrame) -> DataFrame:
    """Reviewed errors by category, most common first."""
    some = matches.where("status IN ('FP', 'FN')").withColumn("error_category", T.strip(T.or_empty(F.col("error_category")))).where("error_category <> ''")
    return some.groupBy("error_category").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "error_category")
