"""Whitening of embeddings by exact integer covariances.

Entries become integers x = floor(256 * c).  The distinct x-vectors are the fit list.  A task
takes blocks of them, shifts every dimension so that its least entry is 0, and packs each bit
plane of a dimension across the block's rows into 64-bit words: the cross-product of two
dimensions is the sum over pairs of planes of 2^(b + c) times the ones of the planes' AND.
Shifts are undone in integers.  A task gives one number for each pair of dimensions, however
many rows it had; Spark sums them up in limbs of 40 bits, so sums are exact at any size.  The
driver gets d * d numbers for vectors of d dimensions, centres them as integers
(n * sum xy - sum x * sum y) and solves the eigenproblem; rows are then projected in tasks.

Defined results: vectors that are null or hold null or non-finite entries are dropped; of the
others only those of the most frequent length (of distinct vectors; the longer one of a tie)
are in the space, and the rest is dropped; repeated rows are one vector of the fit list and
each get their rows; a component without variance (a constant or dependent dimension) is null
and explains 0; x saturates at the limits of a long, and a deviation beyond them is null; an
empty table gives an empty table; other columns are not carried, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phialo import scratch

SCALE = 256
LIMB = 40


@dataclass(frozen=True)
class Model:
    """n: vectors of the fit list; sums: of each dimension; eigenvalues by falling size with their components as rows; trace of the covariance."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float


def integer_vectors(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, x) of the rows whose vector is whole."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", odd))
    return rows.select("id", F.transform("v", lambda c: F.floor(SCALE * c).cast("long")).alias("x"))


def vectors(column: pa.Array, d: int) -> np.ndarray:
    """The lists of ``column`` as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of non-negative ``y`` (rows, dimensions) packed into words, with each plane's dimension and bit."""
    n, d = y.shape
    bits = [int(top).bit_length() for top in y.max(axis=0)]
    dims, at = np.repeat(np.arange(d), bits), np.concatenate([np.arange(b) for b in bits]) if sum(bits) else np.zeros(0, int)
    planes = np.zeros((len(dims), -(-n // 64) * 8), np.uint8)
    for k, (dim, bit) in enumerate(zip(dims, at, strict=True)):
        packed = np.packbits((y[:, dim] >> np.uint64(bit)).astype(np.uint8) & 1)
        planes[k, : len(packed)] = packed
    return planes.view(np.uint64), dims, at


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products (upper triangle) of integer rows, as Python integers."""
    n, d = x.shape
    low = x.min(axis=0)
    y = x.astype(np.uint64) - low.astype(np.uint64)  # modulo 2^64, so right for any range
    planes, dims, at = bit_planes(y)
    weights = np.array([1 << int(b) for b in at], object)
    small = 2 * int(at.max(initial=0)) + 2 + n.bit_length() < 63
    if small:
        weights = weights.astype(np.int64)
    kind = np.int64 if small else object
    products, sums = np.zeros((d, d), kind), np.zeros(d, kind)
    for k, dim in enumerate(dims):
        first = np.searchsorted(dims, dim)
        ones = np.bitwise_count(planes[first:] & planes[k]).sum(axis=1, dtype=np.int64)
        np.add.at(products[dim], dims[first:], ones.astype(kind) * weights[first:] * weights[k])
        sums[dim] += ones[k - first].astype(kind) * weights[k]
    low, t = low.astype(object), sums.astype(object)
    whole = products.astype(object) + np.outer(low, t) + np.outer(t, low) + n * np.outer(low, low)
    return t + n * low, np.triu(whole)


def limbs(i: int, j: int, value: int) -> Iterator[tuple[int, int, int, int]]:
    """A signed integer as (i, j, limb, signed value) rows."""
    sign, value, k = (-1 if value < 0 else 1), abs(int(value)), 0
    while value:
        yield i, j, k, sign * (value & ((1 << LIMB) - 1))
        value, k = value >> LIMB, k + 1


def cross_sums(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, sums and cross-products of the vectors ``x`` of ``fit``; (-1, -1) holds n and (-1, j) the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            if batch.num_rows:
                s, p = scatter(vectors(batch.column(0), d))
                n, sums, products = n + batch.num_rows, sums + s, products + p
        rows = [*limbs(-1, -1, n)]
        for i in range(d):
            rows += limbs(-1, i, sums[i])
            for j in range(i, d):
                rows += limbs(i, j, products[i, j])
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["i", "j", "k", "v"])

    parts = fit.select("x").mapInArrow(run, "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v"))
    n, sums, products = 0, [0] * d, np.zeros((d, d), object)
    for i, j, k, v in parts.collect():  # d * d numbers of a few limbs, however many rows there are
        value = v << LIMB * k
        if j < 0:
            n += value
        elif i < 0:
            sums[j] += value
        else:
            products[i, j] += value
            if i < j:
                products[j, i] += value
    return n, sums, products


def solve(n: int, sums: list[int], products: np.ndarray) -> Model:
    """Eigenvectors of the covariance, whose entries are integers over n * n until they become doubles."""
    s = np.array(sums, object)
    centred = n * products - np.outer(s, s)
    covariance = np.array([[int(v) / (n * n) for v in row] for row in centred], float)
    values, columns = np.linalg.eigh(covariance)
    values, rows = values[::-1].copy(), columns.T[::-1].copy()
    values[values <= values[0] * len(values) * np.finfo(float).eps] = 0.0  # what is left of an eigenvalue 0
    return Model(n, sums, values, rows, sum(int(centred[i, i]) for i in range(len(sums))) / (n * n))


def projected(rows: DataFrame, model: Model, k: int) -> DataFrame:
    """(id, deviation, w) of (id, x): w has the first k whitened components."""
    n, d, sums = model.n, len(model.sums), model.sums
    held = model.eigenvalues[:k] > 0
    axes = model.components[:k] / np.sqrt(np.where(held, model.eigenvalues[:k], 1.0))[:, None]
    kind = rows.schema["id"]
    schema = f"id {kind.dataType.simpleString()}, deviation long, w array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors(batch.column(1), d)
            if not len(x):
                continue
            far = n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(abs(s) for s in sums)
            exact = np.int64 if far * far * d < 1 << 63 else object
            off = n * x.astype(exact) - np.array(sums, exact)
            deviation = (off * off).sum(axis=1)
            if exact is object:
                deviation = [v if v < 1 << 63 else None for v in deviation]
            white = (off / n).astype(float) @ axes.T
            lists = [[v if h else None for v, h in zip(row, held, strict=True)] for row in white.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.array(lists, pa.list_(pa.float64()))], ["id", "deviation", "w"])

    return rows.select("id", "x").mapInArrow(run, schema)


def identity_error(fit: DataFrame, model: Model, k: int) -> float | None:
    """The largest difference between the covariance of the fit list's whitened vectors and the identity."""
    there = [c for c in range(k) if model.eigenvalues[c] > 0]
    if not there:
        return None
    white = projected(fit.select(F.lit(0).alias("id"), "x"), model, k).select(*[F.col("w")[c].alias(f"w{c}") for c in there])
    covariances = white.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a in there for b in there if a <= b]).head()
    return max(abs(covariances[f"c{a}_{b}"] - (a == b)) for a in there for b in there if a <= b)


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each whole vector and component."""
    rows = integer_vectors(df, id, vector)
    fit = scratch.table(rows.select("x").distinct(), "fit")
    length = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    kind = df.schema[id].dataType.simpleString()
    if length is None or not length["d"]:
        return df.sparkSession.createDataFrame([], f"`{id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    d, k = length["d"], min(components, length["d"])
    fit = fit.where(F.size("x") == d)
    model = solve(*cross_sums(fit, d))
    explained = [float(v / model.trace) if model.trace else 0.0 for v in model.eigenvalues[:k]]
    error = identity_error(fit, model, k)
    white = projected(rows.where(F.size("x") == d), model, k).select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return white.select(
        F.col("id").alias(id),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, explained))[F.col("at")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
