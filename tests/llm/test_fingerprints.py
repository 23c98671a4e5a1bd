"""Sketches against full sets of words, and next documents against a sorted list."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from phialo.llm import fingerprints as fp


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, got):
    """rows: (id, text), ids may repeat; got: rows of the result."""
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(t or "")
    order = sorted(by_id, key=lambda i: (i is not None, i), reverse=True)
    expected = []
    for n, i in enumerate(order):
        nxt = min(by_id[order[(n + 1) % len(order)]])
        for t in by_id[i]:
            half = len(t) // 2
            e = t[: len(t) - half] + nxt[:half]
            expected.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), round(likeness(t, e), 1), t, e, nxt))
    found = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got)
    assert found == sorted(x[:3] for x in expected)
    values = {(x[0], x[1], x[2]): x for x in expected}
    for r in got:
        *_, t, e, nxt = values[str(r["doc_id"]), r["n_chars"], r["edited_sha256"]]
        for have, a, b in ((r["near_edited"], t, e), (r["near_next"], t, nxt)):
            exact = len(shingles(a)) < fp.K and len(shingles(b)) < fp.K and len(shingles(a) | shingles(b)) <= fp.K
            assert abs(have - likeness(a, b)) < (1e-9 if exact else 0.25), (a[:50], b[:50])
        assert r["fingerprint"] == fp.written(fp.sketches(pa.array([t]))[0]) and r["edited_fingerprint"] == fp.written(fp.sketches(pa.array([e]))[0])


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], fp.edited_pairs(docs).collect())


def test_edges(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "é🙂x", "one two three four five six", "w " * 900, "A b C d E f"]
    rows = [(rng.choice([*range(60), None]), rng.choice(texts)) for _ in range(150)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, guest string, id int")
    check(rows, fp.edited_pairs(docs).collect())
    check([(7, "a b c d e f g")], fp.edited_pairs(spark.createDataFrame([(7, "a b c d e f g")], "doc_id long, text string")).collect())
    check([(None, "x y")], fp.edited_pairs(spark.createDataFrame([(None, "x y")], "doc_id long, text string")).collect())
    assert fp.edited_pairs(docs.where("false")).count() == 0


def test_long_texts_and_repeated_rows(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, long), (2, "a b c d e f"), (2, "a b c d e f"), (3, long[:200_000])]
    got = fp.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, got)
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 2}) == 1


def test_estimates_and_merging(spark):
    words = [f"w{i}" for i in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    sa, sb = fp.sketches(pa.array([a, b]), 1024)
    assert abs(fp.resemblance(sa, sb, 1024) - 1 / 3) < 0.05
    assert abs(fp.containment(sa, sb, 1024) - 0.5) < 0.07
    assert abs(fp.distinct_count(sa, 1024) / 3996 - 1) < 0.1
    assert (fp.read(fp.written(sa)) == sa).all()
    docs = spark.createDataFrame([(1, a), (1, b), (2, ""), (2, None)], "g int, text string")
    got = {r["g"]: r["sketch"] for r in fp.merge_sketches(fp.sketch_texts(docs, k=64), ["g"], 64).collect()}
    assert got[1] == list(np.union1d(sa[:64], sb[:64])[:64].astype(np.int64)) and got[2] == []
