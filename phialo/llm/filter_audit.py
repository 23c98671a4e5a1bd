"""How filters interact: what each removes in every order of application.

A document is the set of filters that it fails.  The sets of filters applied so far are the
states of the subset lattice, and applying one more filter is an edge.  What an edge removes
depends on its state alone, not on the order that led there, so documents are counted once by
the set they fail and these counts are summed up for each edge.  Counting paths forwards
(orders that reach a state) and backwards (orders that leave it) gives the number of orders
through each edge: it weighs the edge's removals for the Shapley sum.  The steps of a single
order are read from the same edges.

Defined results: a null text counts as empty (it fails A only, unless a smaller id is empty
too); a null source is the empty part; a null id has no smaller one; rows that repeat id and
text are equal to no smaller id; of repeated labels one is enough; an empty table gives an
empty table; further columns are not read, so no name can clash.  Texts count as identical if
length and SHA-256 are.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> list[Column]:
    """Conditions A to D of a text that is not null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 200, 100 * distinct < 50 * n, 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents of a part that fail just these filters, as bits."""
    t = F.coalesce(F.col("text"), F.lit(""))
    bits = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(failures(t))), F.lit(0))
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), bits.alias("bits"), F.length(t).alias("size"), F.unhex(F.sha2(t, 256)).alias("mark"))
    # joined by the id as well, so that no task meets all copies of a text
    first = rows.groupBy("size", "mark").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copies = F.when(F.col("doc_id").isNull() | F.col("first"), F.lit(0)).otherwise(F.lit(1 << 4))
    each = rows.join(first, ["size", "mark", "doc_id"], "left").join(known, "doc_id", "left").select("part", (F.col("bits") + copies).alias("failed"), "good", "toxic")
    return each.groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For every set of n filters: orders that lead to it, and orders of the filters still to come."""
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(1, full + 1):
        reach[state] = sum(reach[state ^ (1 << f)] for f in range(n) if state >> f & 1)
    for state in range(full - 1, -1, -1):
        leave[state] = sum(leave[state | (1 << f)] for f in range(n) if not state >> f & 1)
    return reach, leave


def edges(sets: DataFrame, n: int) -> DataFrame:
    """(part, state, filter, orders, kept, removed, redundant, unique_fails, good_lost, toxic_lost): one row for each part and edge of the lattice."""
    reach, leave = path_counts(n)
    all_edges = F.array(
        *[
            F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(reach[s] * leave[s | 1 << f]).alias("orders"))
            for s in range(1 << n) for f in range(n) if not s >> f & 1
        ]
    )
    own = F.expr("shiftleft(1, edge.filter)")
    fails, before = F.col("failed").bitwiseAND(own) != 0, F.col("failed").bitwiseAND(F.col("edge.state")) != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0)))
    return (
        sets.select("*", F.explode(all_edges).alias("edge"))
        .groupBy("part", "edge.state", "edge.filter", "edge.orders")
        .agg(
            total(~fails & ~before).alias("kept"),
            total(fails & ~before).alias("removed"),
            total(fails & before).alias("redundant"),
            total(F.col("failed") == own).alias("unique_fails"),
            total(fails & ~before, "good").alias("good_lost"),
            total(fails & ~before, "toxic").alias("toxic_lost"),
        )
    )


def interactions(sets: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from ``failed_sets``' counts.

    The orders are a fixed table of n! * n rows, small enough to send whole for the handful
    of filters that an audit of all orders is for; each part has n * 2^(n-1) edges.
    """
    n = len(letters)
    if n > 6:
        raise ValueError("all orders of more than six filters are too many rows")
    by_edge = edges(sets, n)
    shapley = by_edge.groupBy("part", "filter").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    steps = [("".join(letters[f] for f in order), step + 1, sum(1 << f for f in order[:step]), order[step]) for order in permutations(range(n)) for step in range(n)]
    table = sets.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    return by_edge.join(shapley, ["part", "filter"]).join(F.broadcast(table), ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of the five filters over all documents."""
    return interactions(failed_sets(docs, labels))
