"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents longer than the capacity are cut; every other piece is one item.  Lengths are
whole numbers up to the capacity, so the packing is planned on the histogram of lengths,
which has at most ``capacity`` entries whatever the number of documents.  Large items (over
a third of the capacity: at most two fit together) are matched greedily, each with the
largest partner that fits; the smaller items, longest first, go to the tightest gap.  A step
of the plan fills a run of bins alike, so the plan stays within a few rows for each length.
Items then find their bins by their rank among the items of their length.

Defined results: a null or empty text is the end id alone; repeated rows are packed one by
one; an empty table gives an empty table; clashing columns of the input give way.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from phialo import scratch
from phialo.llm import batches

#: Most words whose ids a worker keeps; the store is halved beyond them.
STORED = 800_000
PLAN = "length int, first long, past long, per_bin long, bin long, at long"


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, past rank, items in a bin, first bin, offset)."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    steps: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int, int]] = []  # (gap, first bin, bins, offset), sorted
    bins = 0

    def place(length: int, items: int, per_bin: int, first_bin: int, at: int) -> None:
        steps.append((length, used[length], used[length] + items, per_bin, first_bin, at))
        used[length] += items
        left[length] -= items

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        for b in reversed(large[: bisect_left(large, capacity - a + 1)]):
            if b > a or not left[a]:
                continue
            pairs = left[a] // 2 if a == b else min(left[a], left[b])
            if pairs:
                place(a, pairs, 1, bins, 0)
                place(b, pairs, 1, bins, a)
                insort(gaps, (capacity - a - b, bins, pairs, a + b))
                bins += pairs
        if n := left[a]:
            place(a, n, 1, bins, 0)
            insort(gaps, (capacity - a, bins, n, a))
            bins += n
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while n := left[s]:
            i = bisect_left(gaps, (s,))
            if i == len(gaps):
                fresh = -(-n // (capacity // s))
                insort(gaps, (capacity, bins, fresh, 0))
                bins += fresh
                continue
            gap, first, count, at = gaps.pop(i)
            k = min(gap // s, n)
            filled = min(count, n // k)
            place(s, filled * k, k, first, at)
            if gap > k * s:
                insort(gaps, (gap - k * s, first, filled, at + k * s))
            if count > filled:
                insort(gaps, (gap, first + filled, count - filled, at))
    return steps


@lru_cache(1)
def _words(tokenizer: str) -> Callable[[list[list[str]]], dict[str, bytes]]:
    """A function from lists of words to the ids of all of them; one for all tasks of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    model = Tokenizer.from_file(tokenizer)
    stored: dict[str, bytes] = {}
    cores: dict[str, bytes] = {}

    def parts(word: str) -> tuple[str, str]:
        """Letters in lower case and the signs behind them, where they are coded apart.

        Letters up to U+00FF are changed by no rule but lower case, and a run of these signs
        behind a letter is a token string of its own.
        """
        core = word.rstrip(".,!")
        return (core.lower(), word[len(core) :]) if core.isalpha() and max(core) < "\u0100" else (word, "")

    def coded(split: list[list[str]]) -> dict[str, bytes]:
        batches.trim(stored, STORED)
        batches.trim(cores, STORED)
        stored[""] = cores[""] = b""
        cut = {w: parts(w) for words in split for w in words if w not in stored}
        new = list({p for pair in cut.values() for p in pair if p not in cores})
        for start in range(0, len(new), 10_000):
            some = new[start : start + 10_000]
            for p, e in zip(some, model.encode_batch_fast(some, add_special_tokens=False), strict=True):
                cores[p] = array("I", e.ids).tobytes()
        for w, (core, signs) in cut.items():
            stored[w] = cores[core] + cores[signs]
        return stored

    return coded


def _tokenise(tokenizer: str, end_id: int, capacity: int):
    def make():
        coded = _words(tokenizer)
        end = array("I", [end_id]).tobytes()

        def work(texts: list[str]) -> dict:
            # white space never shares a token with its neighbours, so words stand alone
            split = [x.replace("\n", " ").split(" ") for x in texts]
            ids_of = coded(split)
            lengths, crcs = [], []
            for words in split:
                ids = b"".join(map(ids_of.__getitem__, words)) + end
                cut = [ids[i : i + 4 * capacity] for i in range(0, len(ids), 4 * capacity)]
                lengths.append([len(x) // 4 for x in cut])
                crcs.append([zlib.crc32(x) for x in cut])
            return {"_lengths": lengths, "_crcs": crcs}

        return work

    return make


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, text: str = "text") -> DataFrame:
    """One row for each piece: the other columns, piece, start, length, ids_crc32."""
    added = T.StructType().add("_lengths", T.ArrayType(T.IntegerType())).add("_crcs", T.ArrayType(T.LongType()))
    cut = batches.with_columns(docs, text, added, _tokenise(tokenizer, end_id, capacity))
    own = [c for c in cut.columns if c not in {"_lengths", "_crcs", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}]
    each = cut.select(*own, F.posexplode(F.arrays_zip("_lengths", "_crcs")).alias("piece", "_z"))
    return each.select(
        *own,
        "piece",
        (F.col("piece").cast("long") * capacity).alias("start"),
        F.col("_z._lengths").cast("long").alias("length"),
        F.col("_z._crcs").alias("ids_crc32"),
    )


def pack(items: DataFrame, capacity: int = 4096) -> DataFrame:
    """``items`` (a row each, with ``length``) with sequence_id and offset.

    Ranks within a length come in two steps, so that no task holds all items of a length:
    row numbers within the part that wrote them, and sums of the parts before.
    """
    held = scratch.table(items.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "pieces")
    sizes = held.groupBy("length", "_part").count()
    before = sizes.select(
        "length",
        "_part",
        (F.sum("count").over(Window.partitionBy("length").orderBy("_part")) - F.col("count")).alias("_before"),
    )
    histogram = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    steps = held.sparkSession.createDataFrame(plan(histogram, capacity), PLAN)
    number = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_row")) - 1
    ranked = held.withColumn("_number", number).join(before, ["length", "_part"]).withColumn("_rank", F.col("_number") + F.col("_before"))
    # the plan has a few rows for each of at most `capacity` lengths: its size has a fixed bound
    s = F.broadcast(steps).alias("s")
    placed = ranked.alias("r").join(s, F.expr("r.length = s.length AND _rank >= s.first AND _rank < s.past"))
    nth = F.expr("_rank - s.first")
    return placed.select(
        *[F.col(f"r.{c}") for c in items.columns],
        (F.col("s.bin") + F.floor(nth / F.col("s.per_bin"))).cast("long").alias("sequence_id"),
        (F.col("s.at") + F.col("r.length") * F.pmod(nth, F.col("s.per_bin"))).cast("long").alias("offset"),
    )
