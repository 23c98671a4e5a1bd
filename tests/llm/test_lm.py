"""The model against dictionaries of counts, the lists against plain ones."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phialo.llm import lm
from phialo.llm.elias_fano import EliasFano, encode


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**60), max_size=2000), st.integers(0, 2000), st.integers(0, 2000))
def test_elias_fano(values, a, b):
    values = np.sort(np.array(values, np.uint64))
    one = EliasFano(np.frombuffer(encode(values), np.uint8))
    a, b = sorted((min(a, len(values)), min(b, len(values))))
    assert one.n == len(values) and (one.range(a, b) == values[a:b]).all()


def test_trie():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 400, (5000, 2), dtype=np.uint64), axis=0)
    code = rng.integers(1, 255, len(pairs)).astype(np.uint8)
    contexts = np.unique(pairs[:, 0])
    weights = rng.integers(1, 255, len(contexts)).astype(np.uint8)
    trie = lm.Trie(np.frombuffer(lm.Trie.build(pairs[:, 0], pairs[:, 1], code, weights), np.uint8))
    known = {tuple(p): c for p, c in zip(pairs.tolist(), code.tolist(), strict=True)}
    asked = np.sort(rng.integers(0, 500, 3000, dtype=np.uint64))
    word = rng.integers(0, 500, 3000, dtype=np.uint64)
    for at_once in (1 << 16, 7):
        got, w = trie.find(asked, word, at_once)
        assert got.tolist() == [known.get((int(a), int(b)), 0) for a, b in zip(asked, word, strict=True)]
        of = dict(zip(contexts.tolist(), weights.tolist(), strict=True))
        assert w.tolist() == [of.get(int(a), 0) for a in asked]


def plain(rows):
    """Counts in dictionaries: bigrams, and trigrams that occur twice or more."""
    tokens = [(i, zlib.crc32(str(i).encode()) % 7 == 2, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    grams = lambda ts, n: list(zip(*[([b"<s>"] * (n - 1) + ts)[k:] for k in range(n)], strict=False))
    one, many = Counter(), {2: Counter(), 3: Counter()}
    for _, held, ts in tokens:
        if not held:
            one.update(ts)
            for k in many:
                many[k].update(grams(ts, k))
    n, v = sum(one.values()), len(one)
    d = {k: lm.discounts([sum(c == m for c in many[k].values()) for m in range(5)]) for k in many}
    total, kept = {2: Counter(), 3: Counter()}, {2: Counter(), 3: Counter()}
    for k in many:
        for gram, c in many[k].items():
            total[k][gram[:-1]] += c
            if c >= lm.LEAST[k]:
                kept[k][gram[:-1]] += c - d[k][min(c, 3)]
    out = {}
    for i, held, ts in tokens:
        base = [(one[t] + 1) / (n + v + 1) for t in ts]
        p = base
        for k in (2, 3):
            step = []
            for gram, q in zip(grams(ts, k), p, strict=True):
                c, x = many[k].get(gram, 0), gram[:-1]
                a = (c - d[k][min(c, 3)]) / total[k][x] if c >= lm.LEAST[k] else 0
                step.append(a + (1 - kept[k][x] / total[k][x] if x in total[k] else 1) * q)
            p = step
        out[i] = (held, len(ts), sum(one[t] > 0 for t in ts), n, sum(map(math.log10, base)), sum(map(math.log10, p)))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_scores(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "Never seen zzzz"), (9004, "a " * 3000)], docs.schema))
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    sizes = {"block_tokens": 3000, "shard_tokens": 9000} if small else {}
    got = {r["doc_id"]: r for r in lm.score_texts(docs.withColumn("block", docs["doc_id"]), **sizes).collect()}
    assert got.keys() == want.keys()
    gains = []
    for i, (held, n, known, train, base, score) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert abs(r["base_score"] - base) < 1e-6 * n
        # codes are equal steps of log10, some 0.02 here; discounts are those of the whole corpus
        assert abs(r["score"] - score) < 0.02 * n, (i, r["score"], score)
        gains.append((r["score"] - r["base_score"]) / n if held else 0)
    assert max(gains) > 0.5 and np.mean(gains) > 0


def test_order_is_learnt(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    text = lambda: " ".join(w for _ in range(60) for k in [rng.randrange(49)] for w in words[k : k + 2])
    docs = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")
    rows = lm.score_texts(docs).collect()
    assert all(r["score"] > r["base_score"] + 0.3 * r["n_tokens"] for r in rows if r["held_out"])


def test_three_words_are_learnt(spark):
    """The word after two: b is followed by c after a, by d after x."""
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["a b c", "x b d"]) for _ in range(40))
    docs = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")
    rows = [r for r in lm.score_texts(docs).collect() if r["held_out"]]
    # one choice of two for three words; bigrams alone have two
    assert rows and all(r["score"] / r["n_tokens"] > -0.13 for r in rows)


def test_stored_tries_are_mapped_and_hold_every_kept_trigram(spark, tmp_path):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefgh", k=30))) for i in range(100)], "doc_id long, text string")
    seen = []
    learn, lm.learn = lm.learn, lambda *a: seen.append(learn(*a)) or seen[-1]
    drop, lm.scratch.drop = lm.scratch.drop, lambda *a: None
    try:
        lm.score_texts(docs, shard_tokens=500).count()
    finally:
        lm.learn, lm.scratch.drop = learn, drop
    counts = {2: Counter(), 3: Counter()}
    for r in docs.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            ts = [*r["text"].split(), None]
            for k in counts:
                counts[k].update(zip(*[(["<s>"] * (k - 1) + ts)[m:] for m in range(k)], strict=False))
    for k, model in zip((2, 3), seen, strict=True):
        stored = model.collect()
        assert len(stored) > 3
        sizes, times = 0, []
        for r in stored:
            path = tmp_path / f"{k}-{r['shard']}"
            path.write_bytes(r["trie"])
            sizes += lm.Trie(np.memmap(path, np.uint8, "r")).codes.size
            times += lm.unpacked(r["times"]).tolist()
        want = sorted(c for c in counts[k].values() if c >= lm.LEAST[k])
        assert sizes == len(want) and sorted(times) == want


def test_no_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (2, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert lm.score_texts(docs).count() == 3 and lm.score_texts(docs.where("false")).count() == 0


def test_scores_do_not_depend_on_shards_or_blocks(spark):
    """Up to the codes' steps, and for words that one shard size deals by their successors."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = []
    for sizes in ({}, {"shard_tokens": 4000}, {"shard_tokens": 30_000, "block_tokens": 2500}):
        found.append({r["doc_id"]: (r["score"] / r["n_tokens"], r["base_score"]) for r in lm.score_texts(docs, **sizes).collect()})
    for other in found[1:]:
        assert all(abs(other[i][0] - s) < 0.005 and abs(other[i][1] - b) < 1e-6 * abs(b) for i, (s, b) in found[0].items())


def test_codes_reach_down_to_one_in_all_tokens():
    for most in (50, 10**6, 10**11):
        codes = lm.Codes(most)
        p = 10.0 ** -np.linspace(0, np.log10(most), 1000)
        back = codes.read(codes.of(p))
        assert np.abs(np.log10(back / p)).max() <= np.log10(most) / 254 / 2 + 1e-9 and codes.of(np.zeros(1))[0] == 0


def test_hot_contexts_with_few_successors(spark):
    """Most places of a hot context hold no successor, and are asked for words that never followed it."""
    rows = [(i, f"a b c a b w{i} a b d a") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    for r in lm.score_texts(docs, shard_tokens=200, block_tokens=150).collect():
        assert abs(r["score"] - want[r["doc_id"]][-1]) < 0.02 * r["n_tokens"]


def test_orders_and_packing_equal_numpys():
    import time

    rnd = np.random.default_rng(5)
    for n, most in ((0, 9), (1, 1), (3000, 7), (200_000, 2**40), (50_000, 2**63)):
        context, word = rnd.integers(0, most, n, dtype=np.uint64), rnd.integers(0, 1 + most // 3, n, dtype=np.uint64) % np.uint64(1 << 28)
        context[n // 2 :] = context[: n - n // 2]
        assert np.array_equal(lm.by_context(context, word), np.lexsort((word, context)))
        assert np.array_equal(lm.in_order(context), np.argsort(context, kind="stable"))
        for keys in (context, word.astype(np.int64)):
            for have, want in zip(lm.distinct(keys), np.unique(keys, return_inverse=True), strict=True):
                assert np.array_equal(have, want)
            assert np.array_equal(lm.unpacked(lm.packed(keys)), keys.view(np.int64))
    for numbers in ([0] * 9, [2**64 - 1, 0], [255, 256]):
        assert lm.unpacked(lm.packed(np.array(numbers, np.uint64))).view(np.uint64).tolist() == numbers
    # one sort of numbers with their places takes less than two sorts of places
    context, word = rnd.integers(0, 2**40, 10**6, dtype=np.uint64), rnd.integers(0, 2**20, 10**6, dtype=np.uint64)
    took = []
    for f in (lambda: np.lexsort((word, context)), lambda: lm.by_context(context, word)):
        began = time.process_time()
        f()
        took.append(time.process_time() - began)
    assert took[1] < 0.8 * took[0], took
