"""Token counts by byte-pair merging with a heap and a linked list; no ids are made.

The symbols of a part start as its characters.  A heap holds the adjacent pairs whose join
is a piece, by rank and then place; the lowest is popped and merged, a linked list gives the
new neighbours, and pairs that no longer stand are skipped.  The count is the number of
symbols at the start less the merges; a character that stays alone and is no piece counts
its UTF-8 bytes.  Counts of equal words are kept within a worker, up to a fixed number.

Defined results: null and empty texts have no bytes and no tokens; repeated rows are counted
one by one; an empty table gives an empty table; clashing columns of the input give way.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from phialo.llm import batches
from phialo.llm.piece_model import STORED, Pieces


class Counter(dict):
    """Counts of words; a missing one is made from its parts."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.rank = {p: -s for p, s in pieces.scores.items()}
        self.of_parts: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        n = 0
        for part in self.pieces.parts(word):
            if (c := self.of_parts.get(part)) is None:
                c = self.of_parts[part] = self.merged(part)
            n += c
        self[word] = n
        return n

    def merged(self, part: str) -> int:
        n, rank = len(part), self.rank
        symbols: list[str | None] = list(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i : i + 2]) for i in range(n - 1) if (r := rank.get(part[i : i + 2])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != pair:
                continue
            merges += 1
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(join := pair + symbols[k])) is not None:
                    heappush(heap, (r, i, join))
            if (h := before[i]) >= 0 and (r := rank.get(join := symbols[h] + pair)) is not None:
                heappush(heap, (r, h, join))
        unknown = sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in rank)
        return n - merges + unknown

    def text(self, text: str) -> int:
        return sum(map(self.__getitem__, self.pieces.words(text)))


@lru_cache(1)
def _counter(model: str) -> Counter:
    """One for all tasks of a Python worker."""
    return Counter(Pieces(model))


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """``docs`` (without the text) with n_bytes, n_tokens and over_limit of every whole text.

    ``model`` is the path of a SentencePiece BPE model that every executor can open.
    """
    added = T.StructType().add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def make():
        counter = _counter(model)

        def work(texts: list[str]) -> dict:
            batches.trim(counter, STORED)
            batches.trim(counter.of_parts, STORED)
            n = [counter.text(x) for x in texts]
            return {"n_bytes": [len(x.encode()) for x in texts], "n_tokens": n, "over_limit": [k > limit for k in n]}

        return work

    return batches.with_columns(docs, text, added, make)
