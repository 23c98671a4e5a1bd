"""Whitening against plain integers and numpy."""

import math

import numpy as np
import pytest

from phialo.llm import whitening

REAL = "/root/testdata/sf0.001/embeddings.parquet"


def plain(rows, k):
    """(id, component) -> (n, deviation, whitened, explained), from Python integers."""
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in whole})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    v = np.array([[sum(x[a] * x[b] for x in fit) * n - s[a] * s[b] for b in range(d)] for a in range(d)], float) / (n * n)
    values, columns = np.linalg.eigh(v)
    values, columns = values[::-1], columns[:, ::-1]
    out = {}
    for i, x in whole:
        off = [n * x[j] - s[j] for j in range(d)]
        for c in range(min(k, d)):
            out[i, c + 1] = (n, sum(o * o for o in off), float(np.dot(np.array(off) / n, columns[:, c])) / math.sqrt(values[c]), values[c] / np.trace(v))
    return out


def compare(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want)
    signs = {}
    for r in got:
        n, deviation, white, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and math.isclose(r.explained, explained, rel_tol=1e-9) and r.identity_error < 1e-9
        sign = signs.setdefault(r.component, 1 if abs(r.whitened - white) < abs(r.whitened + white) else -1) if abs(white) > 1e-6 else 1
        assert abs(r.whitened - signs.get(r.component, sign) * white) < 1e-6


def test_real_vectors(spark):
    df = spark.read.parquet(REAL)
    compare(whitening.whiten(df).collect(), plain([(r.vec_id, r.embedding) for r in df.collect()], 4))


def test_dropped_repeated_and_clashing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=3) * (1, 2, 0.5)]) for i in range(60)]
    rows += [(100, rows[0][1]), (101, None), (102, [1.0, None, 2.0]), (103, [1.0, math.nan, 2.0]), (104, [math.inf, 1.0, 1.0]), (105, rows[5][1]), (106, rows[5][1]), (107, [-0.0, 0.0, -1e-9])]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<double>, n string, x int")
    compare(whitening.whiten(df).collect(), plain(rows, 4))


def test_other_lengths_constant_dimensions_and_empty_tables(spark):
    rows = [(1, [1.0, 5.0, 2.0]), (2, [2.0, 5.0, 4.0]), (3, [4.0, 5.0, 8.0]), (4, [1.0]), (5, []), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df).collect()}
    assert {i for i, _ in got} == {1, 2, 3} and got[1, 2].whitened is None and got[1, 3].whitened is None and got[1, 2].explained == 0
    assert math.isclose(sum(got[i, 1].whitened ** 2 for i in (1, 2, 3)) / 3, 1) and math.isclose(got[1, 1].explained, 1)
    for none in (df.where("vec_id > 4"), df.limit(0), df.where("vec_id = 4")):
        assert [r.whitened for r in whitening.whiten(none).collect()] == [None] * none.where("size(embedding) > 0").count()


def test_huge_entries_do_not_overflow(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [3.5e15, 2.0]), (4, [0.0, 9.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    # beside 1e36 the variance of the second dimension is no more than rounding
    assert len(got) == 8 and all(r.deviation is None for r in got if r.vec_id < 3) and all(math.isfinite(r.whitened) if r.component == 1 else r.whitened is None for r in got)


@pytest.mark.parametrize("low,high", [(-3, 3), (-(2**62), 2**62), (5, 6), (-(2**31), 2**31), (0, 1)])
def test_scatter_is_exact(low, high):
    x = np.random.default_rng(1).integers(low, high, size=(131, 4))
    sums, products = whitening.scatter(x)
    y = x.astype(object)
    assert list(sums) == list(y.sum(axis=0)) and (products == np.triu(y.T @ y)).all()
