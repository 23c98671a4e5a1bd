"""Bottom-k sketches of shingle hashes.

A text's sketch are the ``k`` smallest of its distinct five-word shingle hashes (48 bits
each, case of A-Z put aside).  The sketch of a union is the k smallest of both sketches, so
sketches of parts merge.  Two sketches give an estimate of the resemblance (the share of the
union's k smallest that both have), of the containment and of the number of distinct
shingles.  With fewer than k shingles all estimates are exact.

``edited_pairs`` sketches every text, its edited form and looks at the next document.  Ids
are dealt into ranges, the document just below a range joins it as a guest, and each range
is read in ascending order with one document in mind: texts are shuffled once and no task
holds more than a batch.  The ranges' highest ids are one stored array, of a few for each
shuffle partition, which is broadcast; a row finds its range by halving it.

Defined results: a null text is empty; an empty set's likeness is 1 to another empty one and
0 to anything else; rows of one id all take the next smaller id as their next document (its
smallest text), and the smallest id takes the largest; a null id comes after all others; an
empty table gives an empty table; further columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phialo import scratch
from phialo.llm import batches, wordhash

K = 128
BITS = 48
RANGES_PER_PARTITION = 4


def sketches(column: pa.Array, k: int = K) -> list[np.ndarray]:
    """Sorted 48-bit sketch of each text."""
    values, bounds = wordhash.distinct(*wordhash.shingles(*wordhash.words(column)))
    values = values >> np.uint64(64 - BITS)
    return [values[a : min(b, a + k)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def written(sketch: np.ndarray) -> str:
    """A sketch as text: six big-endian bytes for each hash, in base64."""
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return base64.b64encode(raw.tobytes()).decode()


def read(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of what two sketches stand for."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated size of the intersection over size of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    again = np.flatnonzero(both[1:] == both[:-1])
    # the i-th repeat stands at place again[i] - i among the distinct values
    of = min(k, len(both) - len(again))
    return float((again - np.arange(len(again)) < of).sum() / of)


def distinct_count(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * 2.0**BITS / (float(sketch[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first one's shingles that the second has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merged(a, b, k), k) / distinct_count(a, k))


def sketch_texts(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """``docs`` (without the text) with ``sketch``, an array of long."""
    from pyspark.sql import types as T

    added = T.StructType().add("sketch", T.ArrayType(T.LongType()))
    make = lambda: lambda texts: {"sketch": [s.astype(np.int64) for s in sketches(pa.array(texts, pa.large_string()), k)]}
    return batches.with_columns(docs, text, added, make)


def merge_sketches(parts: DataFrame, by: list[str], k: int = K, salts: int = 32) -> DataFrame:
    """One sketch for each group, merged in two steps so that a large group is spread."""
    union: Column = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, k).alias("sketch")
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("sketch"), F.lit(salts)))
    return salted.groupBy(*by, "_salt").agg(union).groupBy(*by).agg(union)


def _pairs(k: int):
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_range, last_id, last_guest = object(), object(), None
        mind: tuple = ("", None)  # text and sketch of the document that the current id takes as its next
        first: tuple = ("", None)  # of the current id's smallest text
        for batch in batches_:
            for part in batches.slices(batch, "text"):
                own = sketches(part.column(3), k)
                ranges, guests, ids, texts = (part.column(c).to_pylist() for c in range(4))
                nexts, edited, hosts = [], [], []
                for i, (r, guest, doc, text) in enumerate(zip(ranges, guests, ids, texts, strict=True)):
                    text = texts[i] = text or ""
                    if r != last_range or doc != last_id or guest != last_guest:
                        # rows come by range, guest first, then ascending ids, smallest text first
                        mind = first if r == last_range else (text, own[i])
                        first, last_range, last_id, last_guest = (text, own[i]), r, doc, guest
                    if not guest:
                        half = len(text) // 2
                        edited.append(text[: len(text) - half] + mind[0][:half])
                        nexts.append(mind[1])
                        hosts.append(i)
                changed = sketches(pa.array(edited, pa.large_string()), k)
                pairs = list(zip(hosts, changed, nexts, strict=True))
                columns = [
                    part.column(2).take(pa.array(hosts, pa.int64())),
                    pa.array([len(texts[i]) for i in hosts], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                    pa.array([written(own[i]) for i in hosts], pa.string()),
                    pa.array([written(c) for c in changed], pa.string()),
                    pa.array([resemblance(own[i], c, k) for i, c, _ in pairs], pa.float64()),
                    pa.array([resemblance(own[i], x, k) for i, _, x in pairs], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _first_not_below(value: str, array: str) -> Column:
    """Place of the first element of an ascending array that isn't below a value (the last one if all are)."""
    start = F.struct(F.lit(0).alias("lo"), F.greatest(F.size(array) - 1, F.lit(0)).alias("hi"))

    def halved(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.coalesce(F.get(F.col(array), mid) < F.col(value), F.lit(False)) & (s["lo"] < s["hi"])
        return F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(F.when(s["lo"] < s["hi"], mid).otherwise(s["hi"])).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(array)))), start, halved, lambda s: s["lo"])


def edited_pairs(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited form, likeness to that and to the next document.

    The edited form has the last half of the code points (rounded down) replaced by as many
    of the next document's first ones, or all of them.
    """
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()
    source = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = source.select("id").where("id IS NOT NULL").repartitionByRange(ranges, "id").select("id", F.spark_partition_id().alias("range"))
    highest = dealt.groupBy("range").agg(F.max("id").alias("top"))
    tops = scratch.table(highest.agg(F.array_sort(F.collect_list("top")).alias("tops")), "tops")  # one row: as many values as ranges
    rows = source.crossJoin(F.broadcast(tops)).withColumn("own", F.when(F.col("id").isNull(), 0).otherwise(_first_not_below("id", "tops")))
    # the highest id of a range is the guest of the one above; the highest of all, of the lowest
    guest = F.when(F.get("tops", F.col("own")) == F.col("id"), F.pmod(F.col("own") + 1, F.size("tops")))
    stays = F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("guest")))
    goes = F.array(F.struct(guest.cast("int").alias("range"), F.lit(True).alias("guest")))
    sent = rows.withColumn("to", F.explode(F.when(guest.isNotNull(), F.concat(stays, goes)).otherwise(stays)))
    sent = sent.select("to.range", "to.guest", "id", "text").repartition("range")
    order = [F.col("range"), F.col("guest").desc(), F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = sent.sortWithinPartitions(*order).mapInArrow(_pairs(k), schema)
    return out.withColumnRenamed("id", id)
