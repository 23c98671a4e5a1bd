"""Exact duplicates by naming blocks (DataFrame functions only).

A text's bytes are cut into blocks of a fixed size.  The distinct blocks of all texts are
sorted within the parts that a shuffle deals them to, and each gets an integer, its name.
Then adjacent names of a text pair up, the distinct pairs are sorted and named in the same
way, and so on until every text has one name.  Two texts of equally many blocks have the same
name if and only if they are equal: names stand for contents that were compared as they are,
not for hashes.  A SHA-256 only carries a block's name back to its places, so that texts are
shuffled once; that no two blocks share one is checked, and an error otherwise.

A part holds the same blocks in the same order whenever it is made again, so a lost executor
changes no name.  Work shrinks by half with each round; rounds are log2 of the most blocks of
a text.  A block or a text that a third of all rows hold is one row once the map side has
combined it; the ways back are plain joins of stored tables, whose large partitions Spark
splits.

Defined results: a null text counts as empty, and empty texts are one group; of equal texts
the row with the largest id stays, a null id only where no other is, and of rows that repeat
id and text one stays; an empty table gives an empty table; other columns are not carried, so
no name can clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phialo import scratch

BLOCK_BYTES = 1024


def blocks(data: str, size: int) -> Column:
    """Blocks of a binary column, at least one; the array hands each step the bytes themselves, not a copy."""
    cut = f"transform(sequence(0, int((greatest(length(s), 1) - 1) div {size})), i -> substring(s, i * {size} + 1, {size}))"
    return F.expr(f"get(transform(array({data}), s -> {cut}), 0)")


def digest(block: Column) -> Column:
    return F.unhex(F.sha2(block, 256))


def named(things: DataFrame, by: list[str], *carried: Column) -> DataFrame:
    """Stored distinct rows of ``things``, sorted and numbered: a name is a row's part and its place there."""
    ordered = things.select(*by).distinct().sortWithinPartitions(*by)
    return scratch.table(ordered.select(*(carried or by), F.monotonically_increasing_id().alias("name")), "names")


def paired(places: DataFrame) -> DataFrame:
    """Stored pairs (key, n, pos, a, b, done) of adjacent names of (key, n, pos, name).

    n: pairs of the text.  An odd last name has -1 beside it; a text that has one name is done.
    """
    beside = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
    pairs = places.groupBy("key", "n", F.expr("pos div 2").alias("half")).agg(beside(0).alias("a"), F.coalesce(beside(1), F.lit(-1)).alias("b"))
    return scratch.table(pairs.select("key", F.expr("(n + 1) div 2").alias("n"), F.col("half").alias("pos"), "a", "b", (F.col("n") == 1).alias("done")), "pairs")


def identities(docs: DataFrame, id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stored (key, id, sha256, n, name) of every row; n and name together are one text's own.

    ``normalise`` is what texts go through before they are compared.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(id).alias("id"), (normalise(t) if normalise else t).cast("binary").alias("data"))
    cut = blocks("data", block_bytes)
    marks = F.transform(cut, digest)
    held = scratch.table(texts.select(F.monotonically_increasing_id().alias("key"), "id", F.sha2("data", 256).alias("sha256"), marks.alias("marks")), "texts")
    names = named(texts.select(F.explode(cut).alias("block")), ["block"], digest(F.col("block")).alias("mark"))
    if names.groupBy("mark").count().where("count > 1").head(1):
        raise RuntimeError("two different blocks share a SHA-256")
    places = held.select("key", F.size("marks").cast("long").alias("n"), F.posexplode("marks").alias("pos", "mark"))
    pairs = paired(places.join(names, "mark").select("key", "n", "pos", "name"))
    scratch.drop(names)
    ends, most = [pairs], pairs.agg(F.max("n")).head()[0]
    for _ in range((most - 1).bit_length() + 1 if most else 0):
        pairs = pairs.where("NOT done")
        names = named(pairs, ["a", "b"])
        pairs = paired(pairs.join(names, ["a", "b"]).select("key", "n", "pos", "name"))
        scratch.drop(names)
        ends.append(pairs)
    last = ends[0].where("done").select("key", F.col("a").alias("name"))
    for more in ends[1:]:
        last = last.unionAll(more.where("done").select("key", F.col("a").alias("name")))
    found = scratch.table(held.join(last, "key").select("key", "id", "sha256", F.size("marks").alias("n"), "name"), "identities")
    scratch.drop(held, *ends)
    return found


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row of ``docs``."""
    rows = identities(docs, id, text, normalise, block_bytes)
    groups = rows.groupBy("n", "name").agg(F.max(F.struct("id", "key")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(scratch.table(groups, "groups"), ["n", "name"]).select(
        F.col("id").alias(id), F.col("keep.id").alias("keep_id"), "group_size", (F.col("keep.key") == F.col("key")).alias("kept"), F.col("sha256").alias("text_sha256")
    )
