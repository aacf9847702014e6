"""Token ids of whole texts, by a byte-level BPE file of the ``tokenizers`` library.

The tokenizer drops white space and never looks across it, and within a run without
white space it never looks across the pieces of its pattern. So runs and pieces are
remembered with their ids, and only a piece that is new to a worker reaches the
tokenizer's model. That holds for texts of Latin letters, ASCII and the like; any other
text, and one that spells a special token, goes through the tokenizer whole. Both ways
give the same ids; a test holds them together.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

DTYPE = np.dtype("<u4")
KEPT = 400_000  # runs, and pieces, remembered at most; then it starts anew
LONGEST = 60  # longer ones are not remembered
#: What the short way is proven for: below U+0180, where NFC changes nothing, without
#: the one letter that grows in lower case and the controls that Python counts as space.
PLAIN = re.compile("[\x00-\x1b\x20-įı-ſ]*")
# The tokenizer's pattern, spelled for that range and lower case.
LETTER = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{LETTER}{NUMBER}]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: bytes that are
    visible Latin-1 characters stand for themselves, the others for U+0100 and on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = sorted(set(range(256)) - shown)
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Memory(dict):
    """Results of ``make`` by their argument, as bytes of ids."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        out = self.make(text)
        if len(text) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[text] = out
        return out


class Coder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.pieces = Memory(self._piece)
        self.runs = Memory(self._run)

    def _piece(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(spelled)], DTYPE).tobytes()

    def _run(self, run: str) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[p] for p in PIECE.findall(run)])

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            found = self.runs
            return np.frombuffer(b"".join([found[r] for r in text.lower().split()]), DTYPE)
        return np.array(self.whole(text), DTYPE)


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One tokenizer per worker and file."""
    return Coder(path)
