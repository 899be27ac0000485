"""Two public tokenizers inside tasks, and the places where a text may be cut for both of them."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Folder of the vocabulary files; the default of a parameter.
VOCABULARIES = "/opt/tokenizers"
_A, _B = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: A space between two characters that are no blanks.  The byte-level vocabulary's pattern starts a new
#: piece there, and no piece of the other vocabulary has its mark of a space behind another character
#: (checked when it is loaded), so no token of either crosses the place before such a space, and what
#: follows is split as if the text began there.
SAFE = re.compile(" (?=[^\\s▁])(?<=[^\\s▁] )")


def vocabularies(folder: str = VOCABULARIES) -> tuple[bytes, bytes]:
    """The files' contents, read once by the driver, so that executors need not hold them."""
    out = []
    for name in (_A, _B):
        with open(os.path.join(folder, name), "rb") as file:
            out.append(file.read())
    return out[0], out[1]


def safe_words(text: str) -> list[str]:
    """``text`` cut at all safe spaces, which are left out; a space goes before each when encoded."""
    return SAFE.split(text)


def next_safe(text: str, start: int) -> int:
    """The first safe space from ``start`` on, or the end."""
    found = SAFE.search(text, start)
    return found.start() if found else len(text)


def last_safe(text: str, start: int, end: int) -> int:
    """The last safe space from ``start`` to ``end``, both included; -1 if there is none."""
    last = text.rfind(" ", start, end + 1)
    while last >= start and not SAFE.match(text, last):
        last = text.rfind(" ", start, last)
    return last if last >= start else -1


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers: ids of a text and the byte lengths of its tokens."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        self.b = SentencePieceProcessor(model_proto=pieces)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError("a piece holds a space behind other characters: texts could not be cut")
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_lengths = np.array([len(b) for b in self.a_bytes])
        self.b_lengths = np.array([len(b) for b in self.b_bytes])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for space+``text``; None where the bytes of either differ from it."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        whole = b" " + text.encode()
        if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


@lru_cache(maxsize=1)
def pair(byte_level: bytes, pieces: bytes) -> Pair:
    """One of each tokenizer for a Python worker."""
    return Pair(byte_level, pieces)
