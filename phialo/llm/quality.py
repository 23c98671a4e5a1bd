"""Quality rules with adaptive thresholds (DataFrame functions only).

Every text gets a few counts.  The counts become integer rates, and each rate goes into a
log-linear bucket sketch per language and source (bucket counts: sketches of parts merge by
adding them up).  Quantiles read from the sketches give each group its own limits, and these
are joined back to the documents.

The limit of a rate is ``q3 + reach * w``.  ``reach`` is ``SPREAD`` times the wider of two
distances, first to third quartile and third quartile to ninth decile.  Where the ninth decile
is the third quartile (a rate that nearly nobody has), those that have it are a tail of their
own, and the limit lies halfway to where that tail begins: the lower decile of the sketch
above zero.  So every limit comes from the sketches.  A group of n rows counts n parts of its
own q3 and reach and ``PRIOR`` parts of its language's (all sources merged), so that few rows
say little, without a step at any size; and where the language's limit is the lower one it
holds, so that a junk source cannot excuse itself.  A rate over few words scatters more: ``w``
is the root of the language's median length over the document's, 1 at least.  Counts in
``FREE`` (two symbols, one repeated line) are never held against a text.

Defined results: a null text counts as empty (no words, so it fails the base rule); null
``lang`` or ``source`` form groups of their own; repeated rows are judged one by one; an
empty table gives an empty table; further columns of the input are kept, and where their
names clash with the result's own columns, the result's win (``good_documents`` gives back
the input's columns).  Inside, an input row travels as one struct, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phialo import scratch

SPACE = r"[\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*BASE, "n_lines", "n_upper", "base_failed")
RULES = ("symbols", "dup_lines", "repeats", "upper", "word_length")
FREE = {"symbols": ("n_symbols", 2), "dup_lines": ("n_dup_lines", 1)}
SPREAD, PRIOR = 3, 100
#: Limits of so many groups are broadcast (some 200 bytes each); more are joined by salted keys.
MOST_GROUPS, SALTS = 100_000, 64
#: Sketch buckets: exact below 2**SUB_BITS, then 2**(SUB_BITS-1) buckets for each doubling.
SUB_BITS = 6


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, counts): every row of ``docs`` as a struct, with the counts of its whole text."""
    own = ["row"]
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.array_remove(F.split(t, SPACE), "").alias("_words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
    )
    step = step.select(
        *own,
        "n_symbols",
        "n_upper",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        # one hash for each window of three words; the last two positions start none
        F.when(
            F.size("_words") > 3,
            F.expr("transform(slice(_words, 1, size(_words) - 2), (w, i) -> xxhash64(w, _words[i + 1], _words[i + 2]))"),
        ).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines"]
    step = step.select(*own, *counts, "_windows", F.size(F.array_distinct("_windows")).alias("_kinds"))
    # only texts with a repeated window are sorted; ties in the hash lie side by side
    step = step.select(
        *own,
        *counts,
        F.when(
            F.size("_windows") > F.col("_kinds"),
            F.expr("sort_array(transform(_windows, (h, i) -> named_struct('h', h, 'i', i)))"),
        ).alias("_sorted"),
    )
    step = step.select(
        *own,
        *counts,
        F.expr(
            "sort_array(transform(filter(_sorted, (e, k) -> e.h <=> get(_sorted, k - 1).h or e.h <=> get(_sorted, k + 1).h), e -> e.i))"
        ).alias("_starts"),
    )
    repeated = F.expr(
        "aggregate(_starts, named_struct('n', 0L, 'end', 0L),"
        " (s, i) -> named_struct('n', s.n + i + 3 - greatest(s.end, cast(i as bigint)), 'end', cast(i + 3 as bigint)), s -> s.n)"
    )
    step = step.select(*own, *counts, F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return step.withColumn("base_failed", failed)


def rates() -> dict[str, Column]:
    """Integer rates of the counts; defined for rows with words."""

    def per(a: Column, b: Column, scale: int) -> Column:
        return F.when(b > 0, F.floor(scale * a / b)).otherwise(0).cast("long")

    c = F.col
    return {
        "symbols": per(c("n_symbols"), c("n_words"), 1000),
        "dup_lines": per(c("n_dup_lines"), c("n_lines"), 1000),
        "repeats": per(c("n_repeat_words"), c("n_words"), 1000),
        "upper": per(c("n_upper"), c("word_chars"), 1000),
        "word_length": per(c("word_chars"), c("n_words"), 100),
    }


def sized() -> dict[str, Column]:
    """What goes into the sketches: the rates and the length."""
    return {**rates(), "words": F.col("n_words")}


def bucket(x: Column) -> Column:
    """Sketch bucket of a non-negative integer, as the bucket's highest value."""
    drop = F.greatest(F.length(F.bin(x)) - SUB_BITS, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop) + 1, drop) - 1


def sketches(counts: DataFrame, lang: str, source: str) -> DataFrame:
    """Bucket counts for each group of (row, counts): lang, source, metric, bucket, n."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in sized().items()])
    return (
        counts.where(~F.col("base_failed"))
        .select(F.col("row")[lang].alias("lang"), F.col("row")[source].alias("source"), F.explode(pairs).alias("p"))
        .groupBy("lang", "source", "p.metric", "p.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups, by addition."""
    return sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Rows, q1, q2, q3, q9 (ninth decile) and tail (lower decile above zero), as buckets, of every group; a sketch has few buckets."""
    w = Window.partitionBy(*by, "metric")
    ranked = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    ranked = ranked.withColumn("none", F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(w))
    tail = F.min(F.when((F.col("bucket") > 0) & (10 * (F.col("upto") - F.col("none")) >= F.col("all") - F.col("none")), F.col("bucket")))
    reached = lambda a, b: F.min(F.when(b * F.col("upto") >= a * F.col("all"), F.col("bucket")))
    return ranked.groupBy(*by, "metric").agg(
        F.max("all").alias("rows"), reached(1, 4).alias("q1"), reached(1, 2).alias("q2"), reached(3, 4).alias("q3"), reached(9, 10).alias("q9"), F.coalesce(tail, F.lit(0)).alias("tail")
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source): typical words, and from and reach of every rate's limit."""
    spread = SPREAD * F.greatest(F.col("q3") - F.col("q1"), F.col("q9") - F.col("q3"))
    reach = F.greatest(spread, F.when(F.col("q9") == F.col("q3"), F.col("tail") / 2).otherwise(0))
    own = quantiles(sketch, ["lang", "source"]).select("lang", "source", "metric", "rows", F.col("q3").alias("own_from"), reach.alias("own_reach"))
    whole = quantiles(merge(sketch, ["lang"]), ["lang"])
    whole = whole.select(F.col("lang").alias("_l"), F.col("metric").alias("_m"), F.col("q2").alias("half"), F.col("q3").alias("from"), reach.alias("reach"))
    both = own.join(whole, own["lang"].eqNullSafe(whole["_l"]) & (own["metric"] == whole["_m"]))
    mixed = lambda a, b: (F.col("rows") * F.col(a) + PRIOR * F.col(b)) / (F.col("rows") + PRIOR)
    limit = lambda a, b: F.struct((a + b).alias("sum"), a.cast("double").alias("from"), b.cast("double").alias("reach"))
    lower = F.least(limit(mixed("own_from", "from"), mixed("own_reach", "reach")), limit(F.col("from"), F.col("reach")))
    return both.groupBy("lang", "source").agg(
        F.max(F.when(F.col("metric") == "words", F.col("half"))).alias("typical"), *[F.max(F.when(F.col("metric") == k, lower)).alias(k) for k in RULES]
    )


def with_limits(counted: DataFrame, limits: DataFrame, lang: str, source: str) -> DataFrame:
    """(row, counts, limits) for every row: broadcast up to MOST_GROUPS groups, else salted."""
    groups = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct("typical", *RULES).alias("limits"))
    same = F.col("row")[lang].eqNullSafe(F.col("_lang")) & F.col("row")[source].eqNullSafe(F.col("_source"))
    if limits.count() <= MOST_GROUPS:
        return counted.join(F.broadcast(groups), same, "left")
    salted = counted.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    spread = groups.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, same & (F.col("_salt") == F.col("_slot")), "left")


def judged(docs: DataFrame, text: str, lang: str, source: str, keep_text: bool) -> DataFrame:
    """(row, counts, base_failed, kept) of ``docs``; counted once, in a stored table."""
    counted = text_counts(docs, text)
    if not keep_text:
        counted = counted.withColumn("row", F.col("row").dropFields(text)) if docs.columns != [text] else counted
    counted = scratch.table(counted, "quality_counts")
    limits = scratch.table(thresholds(sketches(counted, lang, source)), "limits")
    joined = with_limits(counted, limits, lang, source)
    wider = F.sqrt(F.greatest(F.lit(1.0), F.try_divide(F.col("limits.typical"), F.col("n_words"))))
    good = F.lit(True)
    for name, rate in rates().items():
        within = rate <= F.col(f"limits.{name}.from") + F.col(f"limits.{name}.reach") * wider
        if name in FREE:
            within = within | (F.col(FREE[name][0]) <= FREE[name][1])
        good = good & F.coalesce(within, F.lit(True))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(good)
    return joined.select("row", *RESULTS, kept.alias("kept"))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts and verdict (``kept``) of every row of ``docs``, without the text."""
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in {text, *RESULTS, "kept"}]
    return judged(docs, text, lang, source, keep_text=False).select(*own, *RESULTS, "kept")


def good_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    return judged(docs, text, lang, source, keep_text=True).where("kept").select("row.*")
