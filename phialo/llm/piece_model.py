"""What the operators on SentencePiece models share: pieces, scores, safe places to cut.

A model file is read by the library; only its pieces and scores are used.  A text becomes
one string as the model's identity rules say: U+2581 for each space and one in front of a
text that isn't empty.  It is cut where no piece holds the two neighbouring characters: no
merge and no piece of a lattice can cross such a place, so the parts are independent.
"""

from __future__ import annotations

import re

import sentencepiece

SPACE = "▁"
#: Most entries that a worker keeps of earlier parts; the store is halved beyond them.
STORED = 800_000


class Pieces:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.names = [model.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.scores = {self.names[i]: model.get_score(i) for i in plain}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.longest = max(map(len, self.ids))
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        # words can be cut off in front of their spaces if no piece has a space behind another character
        self.by_words = not any(pair[1] == SPACE and pair[0] != SPACE for pair in self.inside)
        self._words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def words(self, text: str) -> list[str]:
        """Independent parts of a text, cut in front of spaces."""
        if not text:
            return []
        whole = SPACE + text.replace(" ", SPACE)
        return self._words.findall(whole) if self.by_words else [whole]

    def parts(self, word: str) -> list[str]:
        """Independent parts of a word, cut wherever no piece holds both neighbours."""
        out, start, inside = [], 0, self.inside
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inside:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out
