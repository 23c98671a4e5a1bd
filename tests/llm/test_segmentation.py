"""N-best segmentation against enumeration, and round trips."""

import numpy as np
import public_tokenizers
import pytest

from phialo.llm import segmentation
from phialo.llm.piece_model import Pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def enumerate_all(pieces, whole, unknown):
    if not whole:
        return [(0.0, ())]
    out = []
    for k in range(1, min(len(whole), pieces.longest) + 1):
        s = pieces.scores.get(whole[:k], unknown if k == 1 else None)
        if s is not None:
            own = (pieces.ids[whole[:k]],) if whole[:k] in pieces.ids else tuple(pieces.byte_ids[b] for b in whole[:k].encode())
            out += [(s + rest, own + ids) for rest, ids in enumerate_all(pieces, whole[k:], unknown)]
    return out


def applied(ids, edits):
    out, shift = list(ids), 0
    for at, drop, new in edits:
        out[at + shift : at + shift + drop] = new
        shift += len(new) - drop
    return tuple(out)


@pytest.mark.parametrize("text", ["in the end", "a, b", "Größe 🙂x", "  two", "thetion"])
def test_against_enumeration(text):
    pieces = Pieces(MODEL)
    lattice = segmentation.Lattice(pieces, 6)
    raw, options = lattice.text(pieces.words(text))
    ids = np.frombuffer(raw, np.int32).tolist()
    every = sorted(enumerate_all(pieces, "▁" + text.replace(" ", "▁"), lattice.unknown), reverse=True)
    assert [s for s, _ in options] == [s for s, _ in every[:6]]
    found = [applied(ids, edits) for _, edits in options]
    assert found[0] == tuple(ids) and len(set(found)) == len(found)
    assert all((s, f) in every for (s, _), f in zip(options, found, strict=True))


def n_best(pieces, unknown, part, n):
    """Scores of the n best segmentations by lists of n at each place."""
    best = [[0.0]] + [[] for _ in part]
    for end in range(1, len(part) + 1):
        for at in range(max(0, end - pieces.longest), end):
            s = pieces.scores.get(part[at:end], unknown if end == at + 1 else None)
            if s is not None:
                best[end] += [x + s for x in best[at]]
        best[end] = sorted(best[end], reverse=True)[:n]
    return best[-1]


def test_parts_of_documents_against_lists_of_n():
    import duckdb

    lattice = segmentation.Lattice(Pieces(MODEL), 4)
    texts = [r[0] or "" for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    seen = {p for t in texts for w in lattice.pieces.words(t) for p in lattice.pieces.parts(w)}
    assert len(seen) > 5000
    at_once = segmentation.Lattice(lattice.pieces, 4)
    at_once.learn({w for t in texts for w in lattice.pieces.words(t)})
    for k, part in enumerate(sorted(seen)):
        want = n_best(lattice.pieces, lattice.unknown, part, 4)
        ids, score, loss = lattice.best(part)
        assert at_once[part] == (ids, score, loss)
        assert score == want[0] and loss == (want[0] - want[1] if len(want) > 1 else float("inf"))
        if k % 20 == 0:
            found = lattice.part(part)
            assert [s for s, _ in found] == want and len({i for _, i in found}) == len(found) and found[0][1] == ids


def test_parts_of_all_lengths_in_one_pass_and_after_trimming():
    import random

    rnd, pieces = random.Random(3), Pieces(MODEL)
    names = [p for p in pieces.ids if len(p) > 1]
    parts = list({"".join(rnd.choices(names, k=9))[: 2 + k % 39] for k in range(6000)})
    lattice = segmentation.Lattice(pieces, 4)
    ids, sizes, scores, losses = lattice.bests(parts)
    wants, ends = [lattice.best(p) for p in parts], np.cumsum(sizes)
    for k, (raw, score, loss) in enumerate(wants):
        assert (ids[ends[k] - sizes[k] : ends[k]].tobytes(), scores[k], losses[k]) == (raw, score, loss)
    assert sum(map(len, parts)) > segmentation.AT_ONCE
    lattice.learn(parts)
    lattice.trim(1000)
    assert len(lattice.numbers) == 500 == lattice.losses.n and lattice.flat.n == int(lattice.sizes.values.sum())
    again = segmentation.Lattice(pieces, 4)
    assert [lattice[p] for p in parts] == [again[p] for p in parts]


def test_words_of_texts_equal_the_pieces_own():
    lattice = segmentation.Lattice(Pieces(MODEL), 4)
    texts = ["", " ", "a  b ", "▁x▁ ▁", "", "日本🙂 \n\tq", "a" * 50 + " é", "  "]
    whole, words, which, bounds = lattice.split(texts)
    for k, t in enumerate(texts):
        assert [words[i] for i in which[bounds[k] : bounds[k + 1]]] == lattice.pieces.words(t)
    ids, ends, options = lattice.texts(words, which, bounds)
    assert lattice.spells(whole, ids, ends).all() and len(options) == len(texts)
    for k, t in enumerate(texts):
        assert (ids[ends[k] : ends[k + 1]].tobytes(), options[k]) == lattice.text(lattice.pieces.words(t))
    ids[ends[2]] += 1
    assert lattice.spells(whole, ids, ends).tolist() == [k != 2 for k in range(len(texts))]


@pytest.mark.parametrize("letter", ["a", "ab"])
def test_long_runs_take_time_and_memory_in_proportion(letter):
    import time
    import tracemalloc

    pieces, took, held = Pieces(MODEL), [], []
    for n in (12_500, 50_000):
        part = letter * (n // len(letter))
        lattice = segmentation.Lattice(pieces, 4)
        began = time.process_time()
        raw, options = lattice.text(pieces.words(part))
        took.append(time.process_time() - began)
        tracemalloc.start()
        segmentation.Lattice(pieces, 4).text(pieces.words(part))
        held.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert segmentation.decode(pieces, np.frombuffer(raw, np.int32).tolist()) == part
        assert [s for s, _ in options] == sorted((s for s, _ in options), reverse=True)
    assert took[1] < 8 * took[0] + 1 and held[1] < 200e6, (took, held)


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "in the end"), (1, "in the end"), (2, None)], "doc_id long, text string")
    rows = segmentation.encode(docs, MODEL).collect()
    assert len(rows) == 3 and rows[0]["ids"] == rows[1]["ids"] or rows[2]["ids"]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    edge = [(10**6 + i, t) for i, t in enumerate([None, "", " ", "\n", "日本🙂 <s> x\x00▁y", "a" * 3000, "  a  b "])]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(edge, "doc_id long, text string")).withColumn("ids", docs["doc_id"] * 0)
    coded = segmentation.encode(docs, MODEL)
    rows = {r["doc_id"]: r for r in coded.collect()}
    assert len(rows) == 207 and all(r["round_trip"] for r in rows.values())
    assert all([x["score"] for x in r["nbest"]] == sorted((x["score"] for x in r["nbest"]), reverse=True) for r in rows.values())
    assert rows[10**6]["ids"] == [] == rows[10**6 + 1]["ids"]
    back = {r["doc_id"]: r["text"] for r in segmentation.decode_ids(coded.select("doc_id", "ids"), MODEL).collect()}
    assert all(back[r["doc_id"]] == (r["text"] or "").replace("▁", " ") for r in docs.collect())
    assert segmentation.encode(docs.where("false"), MODEL).count() == 0
