"""N-best segmentation of texts over a SentencePiece vocabulary, and decoding.

A text's lattice has an edge for every piece at every place (and, where no piece of one
character exists, for the character itself, at a score below all pieces, coded as bytes).
The score of a segmentation is the sum of its pieces' stored scores.  The forward pass gives
the best score from the start to each place (Viterbi); the search then runs backwards from
the end, and because these scores are the exact rest of a path, A-star pops whole
segmentations in order of score.  Heap entries point at the entry they came from, a place is
popped at most n times and hands on at most n pieces, so time and memory grow with a part's
length, whatever it holds.  No piece spans the places where parts are cut, so a text's
n best are put together from the n best of its parts: only the parts with the smallest loss
to their second best can differ from the best, and only these are searched.

Equal scores go by the search's order: what is nearer to the start first, then what was found first.

Defined results: a null or empty text has one segmentation without pieces; repeated rows are
done one by one; an empty table gives an empty table; clashing columns of the input give way.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush, nlargest, nsmallest
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phialo.llm import batches, wordhash
from phialo.llm.piece_model import SPACE, STORED, Pieces

Path = tuple[float, bytes]  # score or loss, ids as bytes
Option = tuple[float, list[tuple[int, int, list[int]]]]  # score, edits (place, dropped, new ids)
INF = float("inf")
WIDTH = 4  # bytes of an id
#: Parts of up to so many characters are done many at once, as arrays of about so many characters in all.
SHORT = 40
AT_ONCE = 100_000
#: Fewer parts are done one by one.
FEW = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _raw(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Run:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.n, self.held = 0, np.zeros(1 << 10, kind)

    def add(self, values: np.ndarray) -> None:
        if (end := self.n + len(values)) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(end, self.held.dtype)])
        self.held[self.n : end] = values
        self.n = end

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.n]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans, one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Lattice:
    """Numbers of words and their parts, and by number: ids of the best segmentation, its score, its loss to the second best."""

    def __init__(self, pieces: Pieces, n: int):
        self.pieces, self.n = pieces, n
        self.unknown = min(pieces.scores.values()) - 10.0
        self.ids = {p: _raw([i]) for p, i in pieces.ids.items()}
        self.numbers: dict[str, int] = {}
        #: Ids of all entries, one after the other; where each entry's ids start, their number, score and loss.
        self.flat, self.starts, self.sizes, self.scores, self.losses = Run(np.int32), Run(np.int64), Run(np.int64), Run(float), Run(float)
        self.turned: dict[str, list[Path]] = {}
        #: Lengths of the longer pieces by their first three characters.
        lengths: dict[str, set[int]] = {}
        for p in pieces.scores:
            if len(p) > 2:
                lengths.setdefault(p[:3], set()).add(len(p))
        self.lengths = {k: sorted(v) for k, v in lengths.items()}
        self.longest = max(map(len, pieces.scores))
        hashes = {}
        for p, s in pieces.scores.items():
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for code in wordhash.mix(np.array([ord(c) for c in p], np.uint64) + np.uint64(1)):
                    h = h * _BASE + code
            hashes[int(h)] = (s, pieces.ids[p])
        #: Hashes of all pieces, ascending, their scores and ids, and a bitmap of their leading 20 bits.
        self.known = np.array(sorted(hashes), np.uint64)
        self.score_of = np.array([hashes[int(h)][0] for h in self.known])
        self.id_of = np.array([hashes[int(h)][1] for h in self.known], np.int32)
        leading = (self.known >> np.uint64(44)).astype(np.int64)
        self.leading = np.zeros(1 << 20, bool)
        self.leading[leading] = True
        #: The first hash with each leading 20 bits, and how many have the same ones at most.
        self.first = np.searchsorted(leading, np.arange(1 << 20)).astype(np.int32)
        self.crowd = int(np.bincount(leading).max())
        self.powers = np.multiply.accumulate(np.array([1] + [_BASE] * self.longest, np.uint64))
        #: Pairs of characters that some piece holds, and what each id adds to a text.
        self.inside = np.array(sorted(ord(a) << 32 | ord(b) for a, b in pieces.inside), np.uint64)
        self.spelled = pa.array([bytes([pieces.byte_of[i]]) if i in pieces.byte_of else x.encode() for i, x in enumerate(pieces.names)], pa.large_binary())

    def trim(self, most: int) -> None:
        """Halve the entries where they are more; what came first is met most often."""
        if len(self.numbers) > most:
            batches.trim(self.numbers, most)
            n = len(self.numbers)
            self.flat.n = int(self.starts.values[n])
            for one in (self.starts, self.sizes, self.scores, self.losses):
                one.n = n

    def _add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray, scores: np.ndarray, losses: np.ndarray) -> None:
        self.numbers.update(zip(names, range(self.starts.n, self.starts.n + len(names)), strict=True))
        self.starts.add(self.flat.n + np.cumsum(sizes) - sizes)
        for one, values in ((self.flat, ids), (self.sizes, sizes), (self.scores, scores), (self.losses, losses)):
            one.add(values)

    def bests(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``best`` of many short parts: ids, their numbers, scores and losses.

        The same passes, with arrays of all parts at each step.  The parts stand in columns, longest
        first, so those that reach a row are the first ones; rows follow each other without gaps.
        """
        n = len(parts)
        lengths = np.fromiter(map(len, parts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        size, long = int(lengths[order[0]]), lengths[order]
        # parts that reach each place, where the place's row begins, and the row and column of each entry
        reach = np.searchsorted(-long, -np.arange(size + 1), "right")
        begin = np.concatenate([[0], np.cumsum(reach)])
        row, column = np.repeat(np.arange(size + 1), reach), _spans(np.zeros(size + 1, np.int64), reach)
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        codes = wordhash.mix(codes[(np.cumsum(lengths) - lengths)[order][column[n:]] + row[n:] - 1].astype(np.uint64) + np.uint64(1))
        sums = np.zeros(begin[-1], np.uint64)
        for at in range(1, size + 1):
            a, b = begin[at], begin[at + 1]
            sums[a:b] = sums[begin[at - 1] :][: b - a] * _BASE + codes[a - n : b - n]
        first, second = np.full(begin[-1], -INF), np.full(begin[-1], -INF)
        back, own, first[:n] = np.zeros(begin[-1], np.uint8), np.zeros(begin[-1], np.int32), 0.0
        for at in range(size):
            # all ends that a piece from here can have are one run of entries
            low, high = begin[at + 1], begin[min(at + self.longest, size) + 1]
            here = begin[at] + column[low:high]
            h = sums[low:high] - sums[here] * self.powers[row[low:high] - at]
            leading = (h >> np.uint64(44)).view(np.int64)
            some = np.flatnonzero(self.leading[leading])
            h, place = h[some], self.first[leading[some]]
            for _ in range(self.crowd - 1):
                place = np.minimum(place + (self.known[place] < h), len(self.known) - 1)
            hit = self.known[place] == h
            some, place = some[hit], place[hit]
            s, ids = self.score_of[place], self.id_of[place]
            alone = np.ones(reach[at + 1], bool)
            alone[some[: np.searchsorted(some, len(alone))]] = False
            if alone.any():
                lone = np.flatnonzero(alone)
                some, s, ids = np.append(some, lone), np.append(s, np.full(len(lone), self.unknown)), np.append(ids, np.full(len(lone), -1, np.int32))
            end, here = low + some, here[some]
            v, old = first[here] + s, first[end]
            better = v > old
            second[end] = np.where(better, np.maximum(old, second[here] + s), np.maximum(second[end], v))
            first[end] = np.where(better, v, old)
            back[end[better]], own[end[better]] = at, ids[better]
        # back from all ends at once
        last = begin[long] + np.arange(n)
        end, active, steps = long.copy(), np.arange(n), []
        counts = np.zeros(n, np.int64)
        while len(active):
            at = begin[end] + active
            steps.append((active, own[at]))
            counts[active] += 1
            end = back[at].astype(np.int64)
            active, end = active[end > 0], end[end > 0]
        sizes, scores, losses = np.empty(n, np.int64), np.empty(n), np.empty(n)
        sizes[order], scores[order], losses[order] = counts, first[last], first[last] - second[last]
        ends = np.cumsum(sizes)[order]
        ids = np.empty(int(sizes.sum()), np.int32)
        for k, (active, some) in enumerate(steps):
            ids[ends[active] - 1 - k] = some
        return ids, sizes, scores, losses

    def learn(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words; the new ones are taken in, their short parts together."""
        get = self.numbers.get
        found = list(map(get, words))
        if new := [w for w, k in zip(words, found, strict=True) if k is None]:
            self._learn(new)
            found = [get(w) if k is None else k for w, k in zip(words, found, strict=True)]
        return np.array(found, np.int64)

    def _learn(self, new: list[str]) -> None:
        whole = "".join(new)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        pairs = codes[:-1] << np.uint64(32) | codes[1:]
        cut = np.ones(len(codes) + 1, bool)
        if len(self.inside):
            cut[1:-1] = self.inside[np.minimum(np.searchsorted(self.inside, pairs), len(self.inside) - 1)] != pairs
        cut[ends] = True
        cuts = np.flatnonzero(cut)
        bounds = np.searchsorted(cuts, np.append(0, ends))
        sizes, first = np.diff(bounds), bounds[:-1]
        several = sizes > 1
        own = _spans(first[several], sizes[several])
        split = [whole[a:b] for a, b in zip(cuts[own].tolist(), cuts[own + 1].tolist(), strict=True)]
        joined = list(compress(new, several))
        parts = list(compress(new, ~several)) if joined else new
        parts = list(dict.fromkeys([*parts, *(x for x in set(split) if x not in self.numbers)]))
        sizes = sizes[several]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        short = (lengths > 1) & (lengths <= SHORT)
        some, ends = list(compress(parts, short)), np.cumsum(lengths[short])
        marks = [*np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, AT_ONCE), "right").tolist(), len(some)]
        for a, b in zip(marks[:-1], marks[1:], strict=True):
            self._add_bests(some[a:b])
        for x in compress(parts, ~short):
            self._add_best(x)
        if joined:
            # words of several parts are put together from their parts' entries
            own = np.fromiter(map(self.numbers.__getitem__, split), np.int64, len(split))
            of_word, many = np.cumsum(sizes) - sizes, self.sizes.values[own]
            ids = self.flat.values[_spans(self.starts.values[own], many)]
            scores, losses = self.scores.values[own], self.losses.values[own]
            self._add(joined, ids, np.add.reduceat(many, of_word), np.add.reduceat(scores, of_word), np.minimum.reduceat(losses, of_word))

    def _add_bests(self, parts: list[str]) -> None:
        if len(parts) >= FEW:
            ids, sizes, scores, losses = self.bests(parts)
            if (ids >= 0).all():  # else lone characters inside become bytes
                return self._add(parts, ids, sizes, scores, losses)
        for x in parts:
            self._add_best(x)

    def _add_best(self, part: str) -> None:
        raw, score, loss = self.best(part)
        self._add([part], np.frombuffer(raw, np.int32), np.array([len(raw) // WIDTH]), np.array([score]), np.array([loss]))

    def __getitem__(self, word: str) -> tuple[bytes, float, float]:
        (k,) = self.learn([word])
        a, n = self.starts.values[k], self.sizes.values[k]
        return self.flat.values[a : a + n].tobytes(), float(self.scores.values[k]), float(self.losses.values[k])

    def ids_of(self, piece: str) -> bytes:
        """Ids of a piece, or of a lone character's bytes."""
        return self.ids.get(piece) or _raw([self.pieces.byte_ids[b] for b in piece.encode()])

    def edges(self, part: str, at: int) -> list[tuple[int, float]]:
        """(end, score) of all pieces that start at a place."""
        scores, size = self.pieces.scores, len(part)
        out = [(at + 1, scores.get(part[at], self.unknown))]
        for k in (2, *self.lengths.get(part[at : at + 3], ())):
            if at + k <= size and (s := scores.get(part[at : at + k])) is not None:
                out.append((at + k, s))
        return out

    def best(self, part: str) -> tuple[bytes, float, float]:
        """Ids and score of a part's best segmentation, and its loss to the second best.

        Viterbi with the best two scores to each place: what is second at a place came from
        the second at the place before, or lost there to another piece.
        """
        size, score, lengths, unknown = len(part), self.pieces.scores.get, self.lengths.get, self.unknown
        if size == 1:
            return self.ids_of(part), score(part, unknown), INF
        first, second, back = [0.0] + [-INF] * size, [-INF] * (size + 1), [0] * (size + 1)
        for at in range(size):
            f = first[at]
            v = f + score(part[at], unknown)
            end = at + 1
            if v > (old := first[end]):
                other = v - f + second[at]
                second[end] = other if other > old else old
                first[end], back[end] = v, at
            elif v > second[end]:
                second[end] = v
            if end == size:
                break
            if (s := score(part[at : at + 2])) is not None:
                end, v = at + 2, f + s
                if v > (old := first[end]):
                    other = s + second[at]
                    second[end] = other if other > old else old
                    first[end], back[end] = v, at
                elif v > second[end]:
                    second[end] = v
            for k in lengths(part[at : at + 3], ()):
                if (end := at + k) > size:
                    break
                if (s := score(part[at:end])) is not None:
                    v = f + s
                    if v > (old := first[end]):
                        other = s + second[at]
                        second[end] = other if other > old else old
                        first[end], back[end] = v, at
                    elif v > second[end]:
                        second[end] = v
        end, found = size, []
        while end:
            found.append(self.ids_of(part[back[end] : end]))
            end = back[end]
        found.reverse()
        return b"".join(found), first[size], first[size] - second[size]

    def part(self, part: str) -> list[Path]:
        """The n best segmentations of a part, by A-star from the end."""
        size = len(part)
        forward = [0.0] + [-INF] * size
        into: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for at in range(size):
            for end, s in self.edges(part, at):
                into[end].append((at, s))
                forward[end] = max(forward[end], forward[at] + s)
        ids, score, _ = self.best(part)
        out: list[Path] = [(score, ids)]
        # (score still reachable, negated; place; order; score so far; (piece's start, what it leads to))
        heap: list = [(-forward[size], size, 0, 0.0, (size, None))]
        popped, order = [0] * (size + 1), 0
        while heap and len(out) < self.n:
            _, at, _, score, node = heappop(heap)
            if at == 0:
                cuts = []
                while node:
                    cuts.append(node[0])
                    node = node[1]
                own = b"".join([self.ids_of(part[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                if own != ids:
                    out.append((score, own))
                continue
            popped[at] += 1
            if popped[at] > self.n:
                continue
            for reach, start, s in nlargest(self.n, [(forward[start] + s + score, start, s) for start, s in into[at]]):
                order += 1
                heappush(heap, (-reach, start, order, score + s, (start, node)))
        return out

    def options(self, word: str) -> list[Path]:
        """(loss, ids) of a word's n best segmentations."""
        if (out := self.turned.get(word)) is None:
            out = [(0.0, b"")]
            for part in self.pieces.parts(word):
                x = self.part(part)
                out = nsmallest(self.n, [(loss + x[0][0] - s, ids + own) for loss, ids in out for s, own in x])
            self.turned[word] = out
        return out

    def text(self, words: list[str]) -> tuple[bytes, list[Option]]:
        """Ids of the best segmentation of a text's words; the n best."""
        own = {w: k for k, w in enumerate(dict.fromkeys(words))}
        ids, _, options = self.texts(list(own), np.array([own[w] for w in words], np.int64), np.array([0, len(words)]))
        return ids.tobytes(), options[0]

    def texts(self, words: list[str], which: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[Option]]]:
        """Ids of the best segmentations of texts, where each text's start, and the n best of each.

        ``words`` are distinct; ``which`` tells the words of all texts, one text after the other.
        """
        numbers = self.learn(words)[which]
        sizes, scores, losses = self.sizes.values[numbers], self.scores.values[numbers], self.losses.values[numbers]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat.values[_spans(self.starts.values[numbers], sizes)]
        options = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            turned = [a + k for k in self.least(losses[a:b])]
            places = (before[turned] - before[a]).tolist()
            options.append(self.turn(float(scores[a:b].sum()), [words[k] for k in which[turned]], places, sizes[turned].tolist()))
        return ids, before[bounds], options

    def least(self, losses: np.ndarray) -> list[int]:
        """Places of the words that can differ from their best in one of the n best: those with the n - 1 smallest losses."""
        many = self.n - 1
        some = np.arange(len(losses))
        if 0 < many < len(losses):
            some = np.flatnonzero(losses <= np.partition(losses, many - 1)[many - 1])
        some = some[np.argsort(losses[some], kind="stable")][:many]
        return sorted(some[losses[some] < INF].tolist())

    def turn(self, total: float, words: list[str], places: list[int], sizes: list[int]) -> list[Option]:
        """Score and edits of the n best segmentations of a text, by its words that may differ and their places."""
        options: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        choices = [self.options(w) for w in words]
        for k, own in enumerate(choices):
            more = [(loss + x, (*picks, (k, j)) if j else picks) for loss, picks in options for j, (x, _) in enumerate(own)]
            options = nsmallest(self.n, more)
        edits = lambda picks: [(places[k], sizes[k], np.frombuffer(choices[k][j][1], np.int32).tolist()) for k, j in picks]
        return [(total - loss, edits(picks)) for loss, picks in options]

    def split(self, texts: list[str]) -> tuple[pa.Array, list[str], np.ndarray, np.ndarray]:
        """Texts with U+2581 for spaces; their distinct words, which stand where, and where each text's words start."""
        whole = pa.array([SPACE + t.replace(" ", SPACE) if t else "" for t in texts], pa.large_string())
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[: len(texts) + 1]
        if not offsets[-1]:
            return whole, [], np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        starts = np.zeros(offsets[-1] + 1, bool)
        if self.pieces.by_words:
            data, (a, b, c) = np.frombuffer(whole.buffers()[2], np.uint8)[: offsets[-1]], SPACE.encode()
            starts[:-3] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
            starts[3:-1] &= ~starts[:-4].copy()
        starts[offsets] = True
        starts = np.flatnonzero(starts)
        words = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), whole.buffers()[2]).dictionary_encode()
        return whole, words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(), np.searchsorted(starts, offsets)

    def spells(self, whole: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether the ids of each text give it byte by byte."""
        spelled = self.spelled.take(pa.array(ids))
        ends = np.frombuffer(spelled.buffers()[1], np.int64)[: len(ids) + 1][bounds]
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(whole), [None, pa.py_buffer(ends), spelled.buffers()[2]])
        return pc.equal(text, whole.cast(pa.large_binary())).to_numpy(zero_copy_only=False)


def decode(pieces: Pieces, ids: list[int]) -> str:
    """The text of ids; bytes that are no UTF-8 become the replacement character."""
    names, byte_of = pieces.names, pieces.byte_of
    if byte_of.keys().isdisjoint(ids):
        whole = "".join(map(names.__getitem__, ids))
    else:
        raw = bytearray()
        for i in ids:
            if (b := byte_of.get(i)) is None:
                raw += names[i].encode()
            else:
                raw.append(b)
        whole = raw.decode(errors="replace")
    return whole.replace(SPACE, " ")[1:]


ALTERNATIVE = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "edits",
            T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("drop", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])),
        ),
    ]
)


@lru_cache(1)
def _lattice(model: str, n: int) -> Lattice:
    """One for all tasks of a Python worker."""
    return Lattice(Pieces(model), n)


def encode(docs: DataFrame, model: str, n: int = 4, text: str = "text") -> DataFrame:
    """``docs`` (without the text) with ``ids`` of the best segmentation, ``nbest`` and ``round_trip``.

    ``nbest`` has up to ``n`` segmentations, best first, each with its score and what differs
    from ``ids``: at place ``at``, ``drop`` ids give way to others.  ``round_trip`` says that
    decoding ``ids`` gives the text (with U+2581 as a space).
    """
    added = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("nbest", T.ArrayType(ALTERNATIVE)).add("round_trip", "boolean")

    def make():
        lattice = _lattice(model, n)
        pieces = lattice.pieces

        def work(texts: list[str]) -> dict:
            lattice.trim(STORED)
            batches.trim(lattice.turned, STORED)
            whole, words, which, bounds = lattice.split(texts)
            ids, bounds, options = lattice.texts(words, which, bounds)
            same = lattice.spells(whole, ids, bounds)
            for k in np.flatnonzero(~same):
                same[k] = decode(pieces, ids[bounds[k] : bounds[k + 1]].tolist()) == texts[k].replace(SPACE, " ")
            nbest = [[{"score": s, "edits": [{"at": a, "drop": d, "ids": i} for a, d, i in edits]} for s, edits in x] for x in options]
            return {"ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), "nbest": nbest, "round_trip": pa.array(same)}

        return work

    return batches.with_columns(docs, text, added, make)


def decode_ids(coded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``coded`` with ``text`` decoded from a column of ids; null ids give a null text."""
    @F.pandas_udf("string")
    def text_of(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(model)
        for column in columns:
            yield column.map(lambda x: None if x is None else decode(pieces, [int(i) for i in x]))

    return coded.withColumn("text", text_of(F.col(ids)))
