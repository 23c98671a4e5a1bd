"""MinHash near-duplicates by a multi-index Hamming join.

A document's set are its distinct five-word shingles, as 64-bit hashes.  Its signature are 48
minima of 16 bits, in 12 chunks of four.  Two signatures that differ in at most 23 places
have a chunk with at most one difference (pigeonhole), so each chunk is stored under the four
keys that leave one place out, and every pair up to that distance meets under some key.
Pairs at a resemblance of 0.75 differ in 12 places on average (standard deviation 3); the
chance that such a pair meets nowhere is below 1e-6.  Pairs that meet and differ in more than
``FARTHEST`` places are dropped; the others are confirmed on their full sets.

Equal sets are one class, so copies cost one row each.  Within a key's bucket the members
are first held against the bucket's best-connected member, not against each other.  In
buckets whose members are then still in several components, the members outside the largest
component are counted against all others on their full sets, by lists of who has which
shingle, in blocks of a bounded number of shingles: a member of the largest component goes to
one row of blocks only, so what is sent grows with the square of the rest, not of the bucket.
Only links that join two components become rows, so a block gives fewer rows than it has
members; these links have been confirmed, so none hides another.

Defined results: a null text and a text without words have an empty set, which is linked
with nothing; with fewer than five words the whole sequence is the one shingle; repeated
rows are copies of each other; a null id never is the smallest of a component; an empty
table gives an empty table; other columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phialo import scratch
from phialo.llm import batches, wordhash
from phialo.llm.components import components

PLACES, CHUNKS = 48, 12
FARTHEST = 28
#: Shingles of a bucket's members that are held in one task, for each of two sides.
BLOCK = 500_000
SIGNATURE = [f"s{c}" for c in range(CHUNKS)]
_rng = np.random.default_rng(20240502)
_TIMES = _rng.integers(1, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(1, 2**63, PLACES, dtype=np.uint64)


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, where each starts, and the 64-bit name of each set."""
    values, bounds = wordhash.distinct(*wordhash.shingles(*wordhash.words(column)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wordhash.mix(values), dtype=np.uint64)])
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wordhash.mix(values * np.uint64(3)), dtype=np.uint64)])
    n = np.diff(bounds).astype(np.uint64)
    name = wordhash.mix(wordhash.mix(np.diff(sums[bounds]) + n) + np.diff(other[bounds]))
    return values, bounds, name


def _sign(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        for part in batches.slices(batch, "text"):
            values, bounds, name = _sets(part.column(1))
            n = np.diff(bounds)
            full = np.flatnonzero(n > 0)
            symbols = np.zeros((len(n), PLACES), np.uint64)
            for k in range(PLACES if len(full) else 0):
                least = np.minimum.reduceat((values ^ _XOR[k]) * _TIMES[k], bounds[:-1][full])
                symbols[full, k] = wordhash.mix(least) >> np.uint64(48)
            chunks = symbols.reshape(len(n), CHUNKS, 4)
            longs = (chunks << np.array([48, 32, 16, 0], np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(name.view(np.int64))]
            columns += [pa.array(np.ascontiguousarray(longs[:, c])) for c in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "node", *SIGNATURE])


def signatures(docs: DataFrame, id_type: str) -> DataFrame:
    """(id, n_shingles, node, s0..) of every row (id, text)."""
    return docs.mapInArrow(_sign, f"id {id_type}, n_shingles long, node long, " + ", ".join(f"{s} long" for s in SIGNATURE))


def _name_sets(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        for part in batches.slices(batch, "text"):
            values, bounds, name = _sets(part.column(0))
            sets = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(sets, pa.binary())], names=["node", "set"])


def keys() -> Column:
    """The keys of a signature: for each chunk, four that leave out one place."""
    masks = [F.lit(~(0xFFFF << s) if s < 48 else 0x0000FFFFFFFFFFFF).cast("long") for s in (0, 16, 32, 48)]
    return F.array(*[F.xxhash64(F.lit(4 * c + j), F.col(SIGNATURE[c]).bitwiseAND(m)) for c in range(CHUNKS) for j, m in enumerate(masks)])


def distance(a: str, b: str) -> Column:
    """Places in which two signatures differ."""
    total = F.lit(0)
    for s in SIGNATURE:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        for shift in (0, 16, 32, 48):
            total = total + (F.call_function("shiftrightunsigned", x, F.lit(shift)).bitwiseAND(F.lit(0xFFFF)) != 0).cast("int")
    return total


def _confirm(percent: int):
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            us, vs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(us), dtype=bool)
            for i in range(len(us)):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([pa.array(us[keep]), pa.array(vs[keep])], names=["u", "v"])

    return run


def near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose sizes and signatures allow the similarity."""
    a, b = classes.alias("a"), classes.alias("b")
    sized = 100 * F.least("a.n_shingles", "b.n_shingles") >= percent * F.greatest("a.n_shingles", "b.n_shingles")
    both = pairs.join(a, F.col("u") == F.col("a.node")).join(b, F.col("v") == F.col("b.node"))
    return both.where(sized & (distance("a", "b") <= FARTHEST)).select("u", "v")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose full sets are similar."""
    full = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("set_u")), "u")
    full = full.join(sets.select(F.col("node").alias("v"), F.col("set").alias("set_v")), "v").select("u", "v", "set_u", "set_v")
    return full.mapInArrow(_confirm(percent), "u long, v long")


def joining_links(node: np.ndarray, comp: np.ndarray, asks: np.ndarray, sets: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links of the members that ask to members of other components, none of which follows from the others."""
    sizes = np.array([len(x) // 8 for x in sets])
    values = np.frombuffer(b"".join(sets), np.uint64)
    member = np.repeat(np.arange(len(sets)), sizes)
    _, number = np.unique(values, return_inverse=True)
    having = member[np.argsort(number, kind="stable")]  # members by shingle
    times = np.bincount(number)
    starts = np.cumsum(times) - times
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    _, group = np.unique(comp, return_inverse=True)
    leader = list(range(int(group.max(initial=-1)) + 1))

    def top(g: int) -> int:
        while leader[g] != g:
            leader[g] = g = leader[leader[g]]
        return g

    out = []
    for i in np.flatnonzero(asks):
        own = number[bounds[i] : bounds[i + 1]]
        n = times[own]
        places = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(having[places], minlength=len(sets))
        hit = 100 * both >= percent * (sizes[i] + sizes - both)
        for j in np.flatnonzero(hit & (group != group[i])):
            a, b = top(group[i]), top(group[j])
            if a != b:
                leader[max(a, b)] = min(a, b)
                out.append((min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))))
    return out


def open_links(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components in buckets that still hold several components."""
    named = members.select("key", "node").join(labels.select("node", "component"), "node", "left").join(classes.select("node", "n_shingles"), "node")
    named = named.select("key", "node", F.coalesce("component", "node").alias("comp"), "n_shingles")
    parts = named.groupBy("key", "comp").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("shingles"), F.bit_xor(F.xxhash64("node")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("m2")
    )
    # buckets with the same members say the same: one of them is enough
    open_ = parts.groupBy("key").agg(
        F.sum("size").alias("size"),
        F.sum("shingles").alias("shingles"),
        F.count(F.lit(1)).alias("comps"),
        F.max(F.struct("shingles", "comp")).alias("main"),
        F.bit_xor("m1").alias("m1"),
        F.bit_xor("m2").alias("m2"),
    )
    open_ = open_.where("size > 2 AND comps > 1").groupBy("size", "shingles", "m1", "m2").agg(F.min(F.struct("key", "main")).alias("k"))
    blocks = lambda shingles: F.ceil(shingles / BLOCK).cast("int")
    open_ = open_.select("k.key", F.col("k.main.comp").alias("main"), blocks(F.col("shingles")).alias("blocks"), blocks(F.col("shingles") - F.col("k.main.shingles")).alias("asking"))
    rows = named.select("key", "node", "comp").join(open_, "key").withColumn("asks", F.col("comp") != F.col("main"))
    # who asks goes to a row of blocks, everybody to a column: any two of which one asks meet
    own = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    asked = rows.select("key", "node", "comp", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("a"), own(1, "blocks").alias("b"))
    asks = rows.where("asks").select("key", "node", "comp", "asks", own(2, "asking").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    sent = asked.unionByName(asks).groupBy("key", "a", "b", "node", "comp").agg(F.max("asks").alias("asks")).join(sets, "node")

    def across(group: pd.DataFrame) -> pd.DataFrame:
        links = joining_links(group["node"].to_numpy(), group["comp"].to_numpy(), group["asks"].to_numpy(), list(group["set"]), percent)
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return sent.groupBy("key", "a", "b").applyInPandas(across, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Rows are linked where 100 * |both| >= percent * |either| for their shingle sets
    (``percent`` of 75 or more: below it the signature's guarantee weakens).
    """
    source = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    signed = scratch.table(signatures(source, docs.schema[id].dataType.simpleString()), "signatures")
    some = signed.where("n_shingles > 0")
    classes = some.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"), F.min("id").alias("first"), *[F.max(s).alias(s) for s in SIGNATURE])
    classes = scratch.table(classes, "classes")
    every = classes.select("node", F.explode(keys()).alias("key"))
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = scratch.table(every.join(shared, "key"), "members")
    # the member with the most company is the bucket's centre: in a family of edits, the original
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    centre = members.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("c")).select("key", F.col("c.node").alias("v"))
    stars = members.select("key", F.col("node").alias("u")).join(centre, "key").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = scratch.table(near(stars.distinct(), classes, percent), "pairs")
    # the full sets of the classes that share a key with another
    wanted = members.select("node").distinct().join(classes.select("node", "first"), "node").select(F.col("first").alias("id"), "node")
    ids = wanted.select("id").distinct()
    texts = source.join(ids, source["id"].eqNullSafe(ids["id"]), "left_semi").select("text")
    sets = texts.mapInArrow(_name_sets, "node long, set binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = scratch.table(sets, "sets")
    links = scratch.table(confirmed(pairs, sets, percent), "links")
    first = components(links)
    more = scratch.table(open_links(members, first, classes, sets, percent), "more")
    scratch.drop(pairs, members, classes, sets, links)
    # the first components are stars already: only the links across them are left to settle
    labels = components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    scratch.drop(first, more)
    placed = signed.select("id", "n_shingles", "node").join(labels, "node", "left").withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")))
    # only components with several rows are looked up; the others are their own
    least = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    out = placed.join(least.drop("rows"), "component", "left")
    component = F.coalesce("least", "id")
    return out.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
