"""Near-duplicates against all pairs by sets of words, and components on small graphs."""

import random

import pytest

from phialo.llm import near_duplicates
from phialo.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows]
    leader = list(range(len(rows)))

    def top(x):
        while leader[x] != x:
            x = leader[x]
        return x

    at = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(k)
    for k, (_, s) in enumerate(sets):
        for j in {j for x in s for j in at[x] if j < k}:
            both = len(s & sets[j][1])
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                leader[top(k)] = top(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, len(s), least[top(k)], least[top(k)] == i) for k, (i, s) in enumerate(sets))


def result(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(near_duplicates.near_duplicates(docs)) == plain(rows)


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**9)}"
    return out


@pytest.mark.parametrize("block", [500_000, 3000])
def test_families_and_edges(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rng = random.Random(5)
    texts = [None, "", "  \n", "one two", "One TWO", "one two three", "ÄÖ ÄÖ", "äö äö"]
    for size, edits in ((120, 2), (200, 4), (60, 1), (150, 6)):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        chain = base
        for _ in range(40):
            texts.append(" ".join(edited(base, rng, edits)))  # around one original that is missing
            chain = edited(chain, rng, edits)
            texts.append(" ".join(chain))  # each near the one before
    texts += texts[20:30] + ["x " * 4000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(k, texts[i], "clash", 1) for k, i in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, node int")
    assert result(near_duplicates.near_duplicates(docs)) == plain([r[:2] for r in rows])


def test_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")
    rows = near_duplicates.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in rows) == [("3", 3, True), ("3", 3, True), ("4", 4, True), ("None", 3, False)]
    assert near_duplicates.near_duplicates(docs.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 300), (300, 200), (7, 7), (50, 60)]
    got = dict((r["node"], r["component"]) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 200: 100, 300: 100, 50: 50, 60: 50}
