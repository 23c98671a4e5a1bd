"""Samples that don't depend on partitions, and ordered picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phialo.functions import text as T


def hash_order(id: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")).cast("binary"))


def sample_n(df: DataFrame, n: int = 50, seed: int = 42, id: str = "product_id") -> DataFrame:
    """N rows in the order of a seeded hash, sorted by id."""
    return df.orderBy(hash_order(id, seed), id).limit(n).orderBy(*T.id_order(F.col(id).cast("string")))


def sample_second_set(df: DataFrame, counts: DataFrame, done: DataFrame, most: int = 100, n: int = 5, seed: int = 42, id: str = "product_id") -> DataFrame:
    """N products not annotated yet with at most ``most`` reactions."""
    free = df.join(done.select(id), id, "left_anti").join(counts, id, "left").na.fill({"n": 0}).where(F.col("n") <= most)
    return sample_n(free, n, seed, id)


def pick_candidates(df: DataFrame, rules: list[tuple[str, Column]], order: list[str], id: str = "product_id") -> DataFrame:
    """For each rule in turn the least row (by ``order``) that no rule before took; ids are unique.

    A rule of k loses at most k - 1 rows to those before it, so the k least rows of each rule
    are enough.  One pass finds them (every task passes on k rows of a rule at most), and the
    k * k rows are settled in one.
    """
    k = len(rules)
    met = F.filter(F.array(*[F.when(rule, F.lit(i)) for i, (_, rule) in enumerate(rules)]), lambda x: x.isNotNull())
    each = df.select(F.struct(*df.columns).alias("row"), F.explode(met).alias("pick"))
    by_order = Window.partitionBy("pick").orderBy(*[F.col("row")[c] for c in order])
    least = each.withColumn("place", F.row_number().over(by_order)).where(F.col("place") <= k)
    settled = least.agg(F.sort_array(F.collect_list(F.struct("pick", "place", "row"))).alias("all"))

    def turn(taken: Column, i: Column, all_: Column) -> Column:
        free = lambda x: (x["pick"] == i) & ~F.exists(taken, lambda y: F.coalesce(y["row"][id] == x["row"][id], F.lit(False)))
        return F.concat(taken, F.slice(F.filter(all_, free), 1, 1))

    turns = F.array(*map(F.lit, range(k)))
    picked = F.transform(F.array("all"), lambda a: F.aggregate(turns, F.slice(a, 1, 0), lambda taken, i: turn(taken, i, a)))
    reasons = F.array(*[F.lit(reason) for reason, _ in rules])
    return settled.select(F.explode(F.get(picked, F.lit(0))).alias("z")).select("z.row.*", F.get(reasons, F.col("z.pick")).alias("reason"), "z.pick")


def first_n(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """L1: the first n rows in order."""
    return df.orderBy(seq).limit(n)


def numeric_sort(df: DataFrame, id: str) -> DataFrame:
    """L2: digit strings in number order, then the others."""
    return df.orderBy(*T.id_order(F.col(id)))
