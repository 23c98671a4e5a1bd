"""Chat formatting: logged snapshots of one growing conversation collapse to the longest.

Every turn gets a hash of its place, role and text; the running combination of these over a
conversation's turns are its prefix hashes, and the last one names the whole conversation.
A conversation whose name is a proper prefix of another goes (anti-join on distinct prefix
hashes), equal conversations leave the one with the smallest id, and what is left is
rendered.  DataFrame functions only.

Defined results: turns go by ``turn``, then role, then text, nulls first; a null role or text
counts as empty; repeated rows are turns of their own; a null id is one conversation of its
own and the last choice among equal ones; an empty table gives an empty table; columns beyond
the four named ones are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phialo import scratch

#: Fixed values of the rendered form.
TURN_START, TURN_END = "<|{}|>\n", "<|end|>\n"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, n, role, text, h1, h2, last): each turn with its place and the hash of all up to it.

    The window only keeps running values, so a conversation's length doesn't matter.  A hash
    of a turn holds its place, so the running exclusive-or depends on the order of turns.
    """
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    placed = turns.withColumn("n", F.row_number().over(order))
    by_place = Window.partitionBy("conv").orderBy("n")
    upto = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = [F.xxhash64(F.lit(seed), "n", "role", "text", F.length("role")) for seed in (1, 2)]
    running = [F.bit_xor(p).over(upto).alias(f"h{k + 1}") for k, p in enumerate(parts)]
    return placed.select("conv", "n", "role", "text", *running, F.lead("n").over(by_place).isNull().alias("last"))


def collapse(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored prefixes of ``turns``, and (conv, turns) of the conversations that stay."""
    held = scratch.table(prefixes(turns), "prefixes")
    # the last prefix is the whole conversation, the others are proper prefixes of it
    alone = held.where("last").groupBy("n", "h1", "h2").agg(F.min("conv").alias("conv"))
    proper = held.where("NOT last").select("n", "h1", "h2").distinct()
    return held, alone.join(proper, ["n", "h1", "h2"], "left_anti").select("conv", F.col("n").alias("turns"))


def render(held: DataFrame, kept: DataFrame) -> DataFrame:
    """One row for each conversation that stays: conv, n_turns, chat."""
    start = TURN_START.split("{}")
    said = F.concat(F.lit(start[0]), F.col("role"), F.lit(start[1]), F.col("text"), F.lit("\n" + TURN_END))
    turns = held.join(kept.select(F.col("conv").alias("_kept")), held["conv"].eqNullSafe(F.col("_kept")), "left_semi")
    lists = turns.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("n", said.alias("said")))).alias("all"))
    return lists.select("conv", F.size("all").cast("long").alias("n_turns"), F.array_join(F.col("all.said"), "").alias("chat"))


def format_chats(conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, n_turns, chat) of every maximal conversation; a rendered chat is one row's text."""
    named = conversations.select(
        F.col(id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    held, kept = collapse(named)
    return render(held, kept).withColumnRenamed("conv", id)
