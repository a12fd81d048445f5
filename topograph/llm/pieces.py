"""A SentencePiece vocabulary read from a model file, and what encoding and counting share.

The text is segmented under the unigram model over the file's pieces and scores: the segmentation with the highest sum of scores wins;
among equal sums, at each end position the piece that starts first (the longest) wins, which is the tokenizer's own rule. Scores
are summed exactly, in double precision. A character that no piece covers costs the least score less 10 and becomes its UTF-8 bytes'
pieces. The text gets one space in front and no other change (identity normalisation); a literal U+2581 is not
taken for a space but spelled in bytes, so that decoding returns the text exactly. As no piece has a space mark after another
character, runs of spaces with the characters up to the next space ("words") are segmented on their own.
"""

from __future__ import annotations

import re
from functools import lru_cache

import sentencepiece

WORD = re.compile(" *[^ ]+| +")
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Vocabulary:
    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [-1] * 256
        self.strings: list[bytes] = [b""] * self.size
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.strings[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece = piece.replace("▁", " ")
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
                self.strings[i] = piece.encode()
        if -1 in self.byte_ids or any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a vocabulary with byte pieces, and with spaces only at the start of pieces, is needed")
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores.values()) - 10.0

    def spell(self, character: str) -> list[int]:
        return [self.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def words(text: str | None) -> list[str]:
    return WORD.findall(" " + text) if text else []
