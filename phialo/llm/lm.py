"""A trigram model of the corpus in stored Elias-Fano tries, and the scores of all texts.

Texts become blocks: a sorted vocabulary of word hashes, and tokens as numbers in it.  Words
are dealt into shards by their hash; a shard adds up the blocks' counts, numbers its words and
answers each block: counts, and numbers that name words in all of the corpus.  Then each level, bigrams and trigrams, takes two passes: one deals what blocks learn
by a hash of the context, and stores each shard's counts and then its trie; the other deals
what blocks ask and answers it from the stored trie by one byte for each n-gram.  Nothing of
the model's size is sent to the driver or broadcast: it is a table of shards in the shared
folder, whose number grows with the corpus.

Hot contexts: a block knows how often the whole corpus has each of its words (and then
bigrams), so it knows by itself which contexts would take a ``HOT_SHARE`` of a shard or more.
These are dealt by the next word too, into as many places as they have such shares; what
their places keep is added up by Spark and sent to all of them, so that each place knows the
context's weight.  No list of hot contexts exists on the driver or in a closure.

Trigrams: those that occur at least twice (``LEAST``) are kept, and all of them are.  Both
bigrams of such a trigram occur twice too, so blocks deal and ask only trigrams of which that
holds; of the others they ask the context's weight at most.

A trie holds, in one run of bytes that is read in place: the shard's words and contexts
(sorted numbers and hashes), for each context where its successors begin (monotone pointers), the
successors' numbers made monotone by adding a base for each context, all as Elias-Fano lists,
and one byte for each smoothed probability and each context's weight.  A context's successors
are searched relative to the context's base.

Probability, with v the word before w, and u the one before v:
P(w | u v) = a(uv, w) + g(uv) * P(w | v), P(w | v) = a(v, w) + g(v) * base(w),
a(x, w) = (c(x, w) - D) / c(x), D by the count (1, 2, 3 and more), estimated for each level
from how many n-grams of the whole corpus occur once to four times, g(x) = what a leaves of
one; a and g are stored as 8-bit codes of their logarithms, from one over the corpus's tokens
to 1.  So scores don't depend on the number of shards or blocks.  A context that isn't in the
model has g = 1.

Defined results: a null or empty text is the end token alone; repeated rows are learnt and
scored one by one; a null id counts as the empty text for the fold; an empty table gives an
empty table; further columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phialo import scratch
from phialo.llm import batches, wordhash
from phialo.llm.elias_fano import EliasFano, encode

BLOCK_TOKENS = 1_250_000
#: Tokens of all texts for each shard of bigrams or trigrams; a shard of words has five times as many.
SHARD_TOKENS = 1_000_000
#: A context with this share of a shard's tokens is dealt by its successors too.
HOT_SHARE = 0.1
#: Times that an n-gram must occur to be kept, by its length.
LEAST = {2: 1, 3: 2}
END = np.uint64(0x454E44)
#: The context of a text's first word; words have numbers from 1.
START = np.uint64(2**64 - 1)
#: Stands for all words whose n-gram can't be in the model: the context alone is asked.
NONE = np.uint64(0)
#: Forty bits tell a shard's contexts apart: a word's number, or a hash of two, whose other bits help to choose the shard.
SHORT = 5
SHORT_BITS = np.uint64((1 << 8 * SHORT) - 1)


class Codes:
    """8-bit codes of probabilities: 0 is "absent", 1..255 are equal steps of log10 from one over ``most`` to 1."""

    def __init__(self, most: int):
        self.lowest = float(np.log10(max(most, 10)))

    def of(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            logs = np.log10(x)
        return np.where(x > 0, 1 + np.rint((np.maximum(logs, -self.lowest) / self.lowest + 1) * 254), 0).astype(np.uint8)

    def read(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([[0.0], 10.0 ** ((np.arange(255) / 254 - 1) * self.lowest)])[codes]


@lru_cache(1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One pair for a Python worker."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 as compressed byte planes, without those that hold zeros only; the first byte counts planes."""
    numbers = numbers.astype(np.uint64)
    width = -(-int(numbers.max()).bit_length() // 8) if len(numbers) else 0
    # a number takes a byte at least, so that all zeros keep their length
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, : max(width, 1)].T)
    return bytes([max(width, 1)]) + _zstd()[0].compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    data = memoryview(data)
    planes = np.frombuffer(_zstd()[1].decompress(data[1:]), np.uint8).reshape(data[0], -1)
    numbers = np.zeros((planes.shape[1], 8), np.uint8)
    numbers[:, : data[0]] = planes.T
    return numbers.reshape(-1).view(np.int64)


def _with_places(keys: np.ndarray) -> tuple[np.ndarray | None, int]:
    """Non-negative keys sorted with their places in the low bits, and how many bits these are; None if 64 bits don't hold both."""
    bits = max(len(keys) - 1, 1).bit_length()
    if len(keys) and int(keys.max()).bit_length() + bits > 64:
        return None, bits
    return np.sort(keys.astype(np.uint64) << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64)), bits


def in_order(keys: np.ndarray) -> np.ndarray:
    """``argsort`` of non-negative keys, stable."""
    both, bits = _with_places(keys)
    if both is None:
        return np.argsort(keys, kind="stable")
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``unique`` of non-negative keys, and each key's number in it."""
    both, bits = _with_places(keys)
    if both is None:
        numbers, values = pd.factorize(keys)
        order = np.argsort(values)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return values[order], rank[numbers]
    place, both = (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)
    new = np.ones(len(keys), bool)
    new[1:] = both[1:] != both[:-1]
    numbers = np.empty(len(keys), np.int64)
    numbers[place] = np.cumsum(new) - 1
    return both[new].astype(keys.dtype), numbers


def by_context(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order of n-grams by context, then word, stable."""
    words, numbers = distinct(word)
    return in_order(distinct(context)[1] * max(len(words), 1) + numbers)


# --- blocks -----------------------------------------------------------------------------


def _encode(folds: int, left_out: int, most: int):
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, lengths, tokens = [], [], [], []

        def block() -> pa.RecordBatch:
            flat = np.concatenate(tokens)
            vocabulary, numbers = distinct(flat)
            columns = [
                pa.array([ids], pa.list_(id_type)),
                pa.array([held], pa.list_(pa.bool_())),
                pa.array([lengths], pa.list_(pa.int32())),
                pa.array([vocabulary.view(np.int64)], pa.list_(pa.int64())),
                pa.array([packed(numbers)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "held", "lengths", "vocabulary", "tokens"])

        id_type = None
        for batch in batches_:
            id_type = batch.schema.field(0).type
            for part in batches.slices(batch, "text"):
                hashes, bounds = wordhash.words(part.column(1))
                some = part.column(0).to_pylist()
                ids += some
                held += [zlib.crc32(b"" if i is None else str(i).encode()) % folds == left_out for i in some]
                lengths += (np.diff(bounds) + 1).tolist()
                tokens.append(np.insert(hashes, bounds[1:], END))
                if sum(map(len, tokens)) >= most:
                    yield block()
                    ids, held, lengths, tokens = [], [], [], []
        if ids:
            yield block()

    return run


def blocks_of(docs: DataFrame, kind: str, folds: int, left_out: int, most: int = BLOCK_TOKENS) -> DataFrame:
    """Stored blocks of (id, text) rows, each with a name."""
    schema = f"ids array<{kind}>, held array<boolean>, lengths array<int>, vocabulary array<long>, tokens binary"
    made = docs.mapInArrow(_encode(folds, left_out, most), schema)
    return scratch.table(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys start, and the length at the end."""
    n = len(keys[0])
    change = np.zeros(max(n - 1, 0), dtype=bool)
    for x in keys:
        change |= x[1:] != x[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]]).astype(np.int64) if n else np.zeros(1, np.int64)


def _places(name: np.ndarray, place: np.ndarray, shards: int) -> np.ndarray:
    """Shards of contexts; ``place`` is from 1 for hot ones and 0 for the others."""
    where = wordhash.mix(name ^ np.uint64(0x5EED))
    return wordhash.mix(np.where(place > 0, where ^ wordhash.mix(place), where)) % np.uint64(shards)


class Grams:
    """Distinct n-grams of a block in a fixed order: by shard and context.

    ``before`` numbers each token's context, ``names`` and ``totals`` are hashes and counts in
    the corpus by that number; ``asked`` tells the tokens whose n-gram can be in the model.
    ``of_token`` is the place of each asked token's n-gram.
    """

    def __init__(self, before: np.ndarray, names: np.ndarray, totals: np.ndarray, tokens: np.ndarray, words: np.ndarray, asked: np.ndarray | None, shards: int, hot: float):
        size = max(len(words), 1)
        keys = before.astype(np.int64) * size + tokens
        pairs, of_token = distinct(keys if asked is None else keys[asked])
        number, word = pairs // size, words[pairs % size]
        name, total = names[number], totals[number]
        spread = total >= hot
        place = np.zeros(len(name), np.uint64)
        place[spread] = wordhash.mix(word[spread]) % (total[spread] // max(hot, 1) + 1).astype(np.uint64) + np.uint64(1)
        shard = _places(name, place, shards)
        short = name & SHORT_BITS
        # n-grams of one context stand together, so contexts are ordered by themselves
        starts = _runs(number)
        rank = np.empty(len(starts) - 1, np.int64)
        rank[in_order(short[starts[:-1]])] = np.arange(len(rank))
        order = in_order(shard.astype(np.int64) * max(len(rank), 1) + np.repeat(rank, np.diff(starts)))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.of_token = place[of_token]
        self.shard, self.context, self.word = shard[order].astype(np.int64), short[order], word[order]
        self.name, self.total, self.spread = name[order], total[order], spread[order]

    def runs(self) -> np.ndarray:
        return _runs(self.shard, self.context)


class Block:
    """One row of blocks: numbers of tokens, and what the answers so far tell of them."""

    def __init__(self, batch: pa.RecordBatch, row: int, shards: int, hot: float, learnt: int):
        of = lambda name: batch.column(batch.schema.get_field_index(name))[row]
        self.name, self.shards, self.hot, self.texts_learnt = of("block").as_py(), shards, hot, learnt
        self.ids, self.held = of("ids").values, of("held").values
        self.lengths = of("lengths").values.to_numpy().astype(np.int64)
        self.tokens = unpacked(of("tokens").as_buffer())
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.learnt = np.repeat(~self.held.to_numpy(zero_copy_only=False), self.lengths)
        self.counts = unpacked(of("counts").as_buffer())
        self.numbers = unpacked(of("numbers").as_buffer()).view(np.uint64)
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[self.starts] = len(self.numbers)
        self.two = Grams(before, np.append(self.numbers, START), np.append(self.counts, learnt), self.tokens, self.numbers, None, shards, hot)
        self.answers: dict[int, list] = {
            n: sorted(of(f"answers{n}").as_py() or [], key=lambda x: x["shard"]) for n in (2, 3) if batch.schema.get_field_index(f"answers{n}") >= 0
        }

    def three(self) -> tuple[Grams, np.ndarray]:
        """Trigrams (NONE for words that can't be in the model), and the tokens whose context can be in it."""
        two, end = self.two, len(self.two.word)
        times = np.concatenate([unpacked(x["times"]) for x in self.answers[2]] + [np.zeros(0, np.int64)])
        of_pair = np.append(times, self.texts_learnt)
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = two.of_token[:-1]
        before[self.starts] = end
        asked = of_pair[before] >= LEAST[3]
        words = np.where(times[two.of_token] >= LEAST[3], self.tokens, len(self.numbers))
        names = wordhash.mix(two.name * np.uint64(3) + wordhash.mix(two.word ^ np.uint64(0x3BD)))
        return Grams(before, np.append(names, START), of_pair, words, np.append(self.numbers, NONE), asked, self.shards, self.hot), asked

    def level(self, n: int) -> tuple[Grams, np.ndarray]:
        return (self.two, np.ones(len(self.tokens), bool)) if n == 2 else self.three()

    def read(self, n: int, grams: Grams, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """a and g of each distinct n-gram."""
        a = codes.read(np.frombuffer(b"".join(x["codes"] for x in self.answers[n]), np.uint8))
        weight = np.frombuffer(b"".join(x["weights"] for x in self.answers[n]), np.uint8)
        return a, np.repeat(np.where(weight > 0, codes.read(weight), 1.0), np.diff(grams.runs()))


def _deal(n: int, learn: bool, shards: int, hot: float, texts: int):
    """For each block and shard, what it learns (n-grams with counts) or asks."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for row in range(batch.num_rows):
                block = Block(batch, row, shards, hot, texts)
                grams, asked = block.level(n)
                counts = np.bincount(grams.of_token[block.learnt[asked]], minlength=len(grams.word)) if learn else np.ones(len(grams.word), np.int64)
                some = (counts > 0) & ((grams.word != NONE) | (not learn))
                shard, context, word, counts = grams.shard[some], grams.context[some], grams.word[some], counts[some]
                name, total, spread = grams.name[some], grams.total[some], grams.spread[some]
                columns: dict[str, list] = {k: [] for k in ("shard", "contexts", "successors", "words", *(("times", "totals", "hot") if learn else ()))}
                for a, b in zip((starts := _runs(shard))[:-1], starts[1:], strict=True):
                    own = _runs(context[a:b])
                    first = a + own[:-1]
                    columns["shard"].append(int(shard[a]))
                    columns["contexts"].append(packed(context[first]))
                    columns["successors"].append(packed(np.diff(own)))
                    columns["words"].append(packed(word[a:b]))
                    if learn:
                        columns["times"].append(packed(counts[a:b]))
                        columns["totals"].append(packed(total[first]))
                        # names of hot contexts, whose places are added up; 0 for the others
                        columns["hot"].append(packed(np.where(spread[first], name[first], np.uint64(0))))
                arrays = [pa.array(columns.pop("shard"), pa.int32()), *(pa.array(x, pa.binary()) for x in columns.values())]
                arrays.append(pa.array([block.name] * len(arrays[0]), pa.int64()))
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", *columns, "block"])

    return run


# --- words ---------------------------------------------------------------------------------


def _word_shards(vocabulary: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of a block's words by shard (then hash), and their shards in it."""
    shard = (wordhash.mix(vocabulary + np.uint64(1)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, shard[order]


def _ask_words(shards: int):
    """For each block and shard: hashes of words, training counts."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for row in range(batch.num_rows):
                block, held, lengths, vocabulary, tokens = (batch.column(c)[row] for c in range(5))
                words = vocabulary.values.to_numpy().view(np.uint64)
                learnt = np.repeat(~held.values.to_numpy(zero_copy_only=False), lengths.values.to_numpy())
                counts = np.bincount(unpacked(tokens.as_buffer())[learnt], minlength=len(words)).astype(np.uint32)
                order, shard = _word_shards(words, shards)
                words, counts, starts = words[order], counts[order], _runs(shard)
                parts = list(zip(starts[:-1], starts[1:], strict=True))
                columns = [pa.array(shard[starts[:-1]], pa.int32()), pa.array([block.as_py()] * len(parts), pa.int64())]
                columns += [pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()) for x in (words, counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "block", "words", "times"])

    return run


def _answer_words(rows: pd.DataFrame) -> pd.DataFrame:
    """Total counts and places in the shard of the words that blocks ask for; the last row counts distinct learnt words."""
    words = np.frombuffer(b"".join(rows["words"]), np.uint64)
    times = np.frombuffer(b"".join(rows["times"]), np.uint32)
    known, number = distinct(words)
    total = np.bincount(number, weights=times, minlength=len(known)).astype(np.int64)
    ends = np.cumsum([0] + [len(x) // 8 for x in rows["words"]])
    shard = int(rows["shard"].iloc[0])
    out = [(int(b), shard, packed(total[number[a:z]]), packed(number[a:z]), 0) for b, a, z in zip(rows["block"], ends[:-1], ends[1:], strict=True)]
    out.append((-1, shard, b"", b"", int((total > 0).sum())))
    return pd.DataFrame(out, columns=["block", "shard", "counts", "places", "known"])


def _place_words(shards: int):
    """Blocks with counts and numbers (from 1) of their words, in place of hashes and their shards' answers."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            *names, last = batch.schema.names
            counts, numbers = [], []
            for row in range(batch.num_rows):
                order, shard = _word_shards(batch.column("vocabulary")[row].values.to_numpy().view(np.uint64), shards)
                answers = sorted(batch.column(last)[row].as_py(), key=lambda x: x["shard"])
                for out, of in ((counts, "counts"), (numbers, "places")):
                    values = np.zeros(len(order), np.int64)
                    found = np.concatenate([unpacked(x[of]) for x in answers])
                    values[order] = found if of == "counts" else found * shards + shard + 1
                    out.append(packed(values))
            names = [x for x in names if x != "vocabulary"]
            columns = [batch.column(x) for x in names] + [pa.array(x, pa.binary()) for x in (counts, numbers)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "counts", "numbers"])

    return run


# --- tries ------------------------------------------------------------------------------


class Trie:
    """Levels over one run of bytes, such as a stored row or a memory-mapped file."""

    def __init__(self, data: np.ndarray):
        self.lists, at = [], 0
        for _ in range(4):
            self.lists.append(one := EliasFano(data[at:]))
            at += -(-one.size // 8) * 8
        self.words, self.contexts, self.pointers, self.successors = self.lists
        self.weights = data[at : at + self.contexts.n]
        self.codes = data[at + self.contexts.n : at + self.contexts.n + self.successors.n]
        self.names = self.words.range(0, self.words.n)

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, code: np.ndarray, weights: np.ndarray, contexts: np.ndarray | None = None) -> bytes:
        """Of distinct n-grams by context and word; ``weights`` are codes by context.

        ``contexts`` ascend, and may hold some without successors.
        """
        names, numbers = distinct(word)
        contexts = context[_runs(context)[:-1]] if contexts is None else contexts
        base = np.searchsorted(contexts, context).astype(np.uint64) * np.uint64(len(names))
        out = b""
        for values in (names, contexts, np.append(np.searchsorted(context, contexts), len(context)), base + numbers.astype(np.uint64)):
            part = encode(values)
            out += part + bytes(-len(part) % 8)
        return out + weights.tobytes() + code.tobytes()

    def places(self, context: np.ndarray, word: np.ndarray, at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """Places of n-grams and of their contexts (-1: absent); contexts ascend."""
        found, of_context = np.full(len(word), -1, np.int64), np.full(len(word), -1, np.int64)
        number = np.searchsorted(self.names, word)
        known = number < len(self.names)
        known[known] = self.names[number[known]] == word[known]
        asked_at = 0
        for start in range(0, self.contexts.n, at_once):
            stop = min(start + at_once, self.contexts.n)
            some = self.contexts.range(start, stop)
            until = len(context) if stop == self.contexts.n else int(np.searchsorted(context, some[-1], "right"))
            mine = np.arange(asked_at, until)
            asked_at = until
            if not len(mine):
                continue
            k = np.minimum(np.searchsorted(some, context[mine]), len(some) - 1)
            there = some[k] == context[mine]
            mine, k = mine[there], k[there]
            of_context[mine] = start + k
            # successors of these contexts only; each is searched from its context's base
            first, last = (int(self.pointers.range(x, x + 1)[0]) for x in (start, stop))
            values = self.successors.range(first, last)
            target = (start + k).astype(np.uint64) * np.uint64(len(self.names)) + number[mine].astype(np.uint64)
            if not len(values):
                continue
            place = np.minimum(np.searchsorted(values, target), len(values) - 1)
            hit = known[mine] & (values[place] == target)
            found[mine[hit]] = first + place[hit]
        return found, of_context

    def find(self, context: np.ndarray, word: np.ndarray, at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """Codes of n-grams (0: absent) and of their contexts' weights; contexts ascend."""
        found, of_context = self.places(context, word, at_once)
        read = lambda codes, at: np.where(at >= 0, codes[at], 0).astype(np.uint8) if len(codes) else np.zeros(len(at), np.uint8)
        return read(self.codes, found), read(self.weights, of_context)


def discounts(n: list[int]) -> np.ndarray:
    """What is taken off counts of 1, 2, and 3 or more (index 1 to 3), by how many occur 1 to 4 times (index 1 to 4)."""
    if not n[1] or not n[2]:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n[1] / (n[1] + 2 * n[2])
    d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k * y for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.02) for k, x in zip((1, 2, 3), d, strict=True))])


def _gathered(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[int], list[np.ndarray]]:
    """Contexts and words of a shard's packets, where each packet ends, successors of each context by packet."""
    many = [unpacked(x) for x in rows["successors"]]
    contexts = [np.repeat(unpacked(c).view(np.uint64), m) for c, m in zip(rows["contexts"], many, strict=True)]
    ends = np.cumsum([0] + [len(c) for c in contexts]).tolist()
    return np.concatenate(contexts), np.concatenate([unpacked(x) for x in rows["words"]]).view(np.uint64), ends, many


def _sum_up(least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A shard's kept n-grams with their counts, what its hot contexts hold, and counts of counts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        context, word, _, many = _gathered(rows)
        times = np.concatenate([unpacked(x) for x in rows["times"]])
        wide = lambda name: np.concatenate([np.repeat(unpacked(x), m) for x, m in zip(rows[name], many, strict=True)])
        total, hot = wide("totals"), wide("hot")
        order = by_context(context, word)
        new = _runs(context[order], word[order])[:-1]
        count = np.add.reduceat(times[order], new)
        keep = count >= least
        at = order[new][keep]
        c, w, count, total, hot = context[at], word[at], count[keep], total[at], hot[at]
        starts = _runs(c)
        first = starts[:-1]
        sums = [np.add.reduceat(x.astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for x in (count, count == 1, count == 2, count > 2)]
        of = hot[first]
        # a context's sums: tokens kept, and how many successors have each discount
        held = [{"context": int(of[i]), "total": int(total[first[i]]), "tokens": int(sums[0][i]), "n1": int(sums[1][i]), "n2": int(sums[2][i]), "n3": int(sums[3][i])} for i in np.flatnonzero(of)]
        numbers = [packed(c[first]), packed(np.diff(starts)), packed(w), packed(count), packed(total[first])]
        tail = [int(count[count > 1].sum()), *(int((count == k).sum()) for k in (2, 3, 4))]
        names = ["shard", "contexts", "successors", "words", "times", "totals", "held", "repeated", "n2", "n3", "n4"]
        return pd.DataFrame([(int(rows["shard"].iloc[0]), *numbers, held, *tail)], columns=names)

    return run


SUMS = "array<struct<context:long,total:long,tokens:long,n1:long,n2:long,n3:long>>"


def _build(take: np.ndarray, codes: Codes) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A shard's trie from its counts and the sums of its hot contexts over all shards."""

    def one(r) -> tuple[bytes, bytes]:
        context, word, many, count, total = np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        if r.contexts is not None:
            context, word = unpacked(r.contexts).view(np.uint64), unpacked(r.words).view(np.uint64)
            many, count, total = (unpacked(x) for x in (r.successors, r.times, r.totals))
        off = take[np.minimum(count, 3)]
        kept = np.add.reduceat(count - off, np.cumsum(np.append(0, many))[:-1]) if len(many) else np.zeros(0)
        known, all_kept, all_total = context, kept, total
        if r.everywhere is not None and len(r.everywhere):
            hot = np.array([x["context"] for x in r.everywhere], np.int64).view(np.uint64) & SHORT_BITS
            known = np.union1d(context, hot)
            all_kept, all_total = np.zeros(len(known)), np.ones(len(known), np.int64)
            at = np.searchsorted(known, context)
            all_kept[at], all_total[at] = kept, total
            at = np.searchsorted(known, hot)
            all_kept[at] = [x["tokens"] - take[1] * x["n1"] - take[2] * x["n2"] - take[3] * x["n3"] for x in r.everywhere]
            all_total[at] = [x["total"] for x in r.everywhere]
        # what is left to the shorter n-gram is never nothing
        weights = np.maximum(codes.of(np.clip(1 - all_kept / all_total, 0.0, 1.0)), 1).astype(np.uint8)
        code = codes.of((count - off) / np.repeat(total, many))
        return Trie.build(np.repeat(context, many), word, code, weights, known), packed(count)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for r in rows.itertuples():
                yield pd.DataFrame([(r.shard, *one(r))], columns=["shard", "trie", "times"])

    return run


def _all_places(shards: int, hot: float):
    """The shards of all places of each hot context."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for r in rows.to_dict("records"):
                many = int(r["total"] // max(hot, 1)) + 1
                name = np.array([r["context"]], np.int64).view(np.uint64)
                shard = np.unique(_places(np.repeat(name, many), np.arange(1, many + 1, dtype=np.uint64), shards))
                yield pd.DataFrame({"shard": shard.astype(np.int32), **r})

    return run


def _answer(asks: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """A shard's stored trie answers every packet: codes, the contexts' weights, counts."""
    if not len(asks):
        return pd.DataFrame(columns=["block", "shard", "codes", "weights", "times"])
    context, word, ends, many = _gathered(asks)
    codes, weights, times = np.zeros(len(word), np.uint8), np.zeros(len(word), np.uint8), np.zeros(len(word), np.int64)
    if len(model):
        trie = Trie(np.frombuffer(model["trie"].iloc[0], np.uint8))
        order = by_context(context, word)
        found, of_context = trie.places(context[order], word[order])
        hit, there = found >= 0, of_context >= 0
        codes[order[hit]] = trie.codes[found[hit]]
        weights[order[there]] = trie.weights[of_context[there]]
        times[order[hit]] = unpacked(model["times"].iloc[0])[found[hit]]
    out = [
        (int(b), int(s), codes[a:z].tobytes(), weights[a:z][np.cumsum(np.append(0, m))[:-1]].tobytes(), packed(times[a:z]))
        for b, s, a, z, m in zip(asks["block"], asks["shard"], ends[:-1], ends[1:], many, strict=True)
    ]
    return pd.DataFrame(out, columns=["block", "shard", "codes", "weights", "times"])


# --- model and scores -------------------------------------------------------------------


def learn(blocks: DataFrame, n: int, sizes: tuple[int, float, int], tokens: int, codes: Codes) -> DataFrame:
    """Stored tries of one level: (shard, trie, times)."""
    dealt = blocks.mapInArrow(_deal(n, True, *sizes), "shard int, contexts binary, successors binary, words binary, times binary, totals binary, hot binary, block long")
    schema = f"shard int, contexts binary, successors binary, words binary, times binary, totals binary, held {SUMS}, repeated long, n2 long, n3 long, n4 long"
    counted = scratch.table(dealt.groupBy("shard").applyInPandas(_sum_up(LEAST[n]), schema), f"counts{n}")
    repeated, *some = counted.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("repeated", "n2", "n3", "n4")]).first()
    # every token ends one n-gram, so those that don't repeat are the rest
    take = discounts([0, tokens - repeated, *some])
    parts = ["tokens", "n1", "n2", "n3"]
    held = counted.select(F.explode("held").alias("x")).select("x.*")
    sums = held.groupBy("context").agg(F.max("total").alias("total"), *[F.sum(x).alias(x) for x in parts])
    shards, hot, _ = sizes
    places = sums.mapInPandas(_all_places(shards, hot), f"shard int, context long, total long, {', '.join(f'{x} long' for x in parts)}")
    everywhere = places.groupBy("shard").agg(F.collect_list(F.struct("context", "total", *parts)).alias("everywhere"))
    ready = counted.drop("held", "repeated", "n2", "n3", "n4").join(everywhere, "shard", "full")
    model = scratch.table(ready.mapInPandas(_build(take, codes), "shard int, trie binary, times binary"), f"model{n}")
    scratch.drop(counted)
    return model


def ask(blocks: DataFrame, model: DataFrame, n: int, sizes: tuple[int, float, int]) -> DataFrame:
    """Stored answers of one level's tries to every block's packets."""
    asks = blocks.mapInArrow(_deal(n, False, *sizes), "shard int, contexts binary, successors binary, words binary, block long")
    answered = asks.groupBy("shard").cogroup(model.groupBy("shard")).applyInPandas(_answer, "block long, shard int, codes binary, weights binary, times binary")
    return scratch.table(answered, f"answers{n}")


def _score(codes: Codes, sizes: tuple[int, float, int], n: int, v: int):
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for row in range(batch.num_rows):
                block = Block(batch, row, *sizes)
                tokens, starts = block.tokens, block.starts
                base = (block.counts + 1) / (n + v + 1)
                a, g = block.read(2, block.two, codes)
                p = a[block.two.of_token] + g[block.two.of_token] * base[tokens]
                three, asked = block.three()
                a, g = block.read(3, three, codes)
                p[asked] = a[three.of_token] + g[three.of_token] * p[asked]
                columns = [
                    block.ids,
                    block.held,
                    pa.array(block.lengths),
                    pa.array(np.add.reduceat((block.counts[tokens] > 0).astype(np.int64), starts)),
                    pa.array(np.full(len(starts), n, np.int64)),
                    pa.array(np.add.reduceat(np.log10(base)[tokens], starts)),
                    pa.array(np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(
    docs: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 7, left_out: int = 2, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Score of every text by a model of the texts whose fold isn't ``left_out``.

    Fold: crc32 of the id as text, modulo ``folds``.
    """
    kind = docs.schema[id].dataType.simpleString()
    plain = blocks_of(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), kind, folds, left_out, block_tokens)
    lengths = F.zip_with("lengths", "held", lambda n, held: F.when(held, 0).otherwise(n))
    total = lambda x: F.coalesce(F.sum(F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)), F.lit(0))
    texts = F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0))
    everything, n, texts = plain.agg(total("lengths"), total(lengths), texts).first()
    shards, word_shards = max(1, -(-everything // shard_tokens)), max(1, -(-everything // (5 * shard_tokens)))
    asked = plain.select("block", "held", "lengths", "vocabulary", "tokens").mapInArrow(_ask_words(word_shards), "shard int, block long, words binary, times binary")
    schema = "block long, shard int, counts binary, places binary, known long"
    counted = scratch.table(asked.groupBy("shard").applyInPandas(_answer_words, schema), "counts")
    v = counted.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    answers = counted.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("shard", "counts", "places")).alias("answers"))
    both = plain.join(answers, "block").select(*plain.columns, "answers")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema if f.name != "vocabulary")
    blocks = scratch.table(both.mapInArrow(_place_words(word_shards), f"{fields}, counts binary, numbers binary"), "words")
    scratch.drop(plain, counted)
    sizes, codes = (shards, HOT_SHARE * shard_tokens, texts), Codes(n)
    for level in (2, 3):
        model = learn(blocks, level, sizes, n, codes)
        answered = ask(blocks, model, level, sizes)
        scratch.drop(model)
        kept = F.struct("shard", "codes", "weights", *(["times"] if level == 2 else []))
        answers = answered.groupBy("block").agg(F.collect_list(kept).alias(f"answers{level}"))
        more = scratch.table(blocks.join(answers, "block", "left"), f"answered{level}")
        scratch.drop(blocks, answered)
        blocks = more
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.mapInArrow(_score(codes, sizes, n, v), schema).withColumnRenamed("id", id)
