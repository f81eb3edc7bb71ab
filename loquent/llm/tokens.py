"""Token ids of whole texts with a tokenizers file, the same as the library gives for the whole text.

Byte-level BPE splits a text into pieces before it merges, and a piece is merged by itself. So texts are split by the
format's pattern, and the library's model is asked once for each piece that a worker meets. Texts with characters on whose
kind versions of Unicode may differ, or with added tokens, are encoded whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Pieces remembered by a worker: about so many of late, and as many of before. Longer ones than LONG are not.
CACHE, LONG = 300_000, 256
#: Characters whose kind not all versions of Unicode agree on.
LATE = re.compile("[^\x00-\x1b\x20-\x7e\xa0-˿Ͱ-ͳΆ-ҁ]")


def _early(category: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(0x482)) if unicodedata.category(c)[0] == category and not LATE.match(c))


_l, _n, _s = _early("L"), _early("N"), r"\t-\r \xa0"
#: How byte-level files split texts of other characters than those: a fixed pattern of the format, with its classes spelt out.
PIECES = re.compile(rf" ?[{_l}]+|'(?:[stmd]|re|ve|ll)| ?[{_n}]+| ?[^{_s}{_l}{_n}]+|[{_s}]+(?![^{_s}])|[{_s}]+")


class _Known(dict):
    """Ids of the pieces met of late, and of before as much again; `turn` forgets the rest. What is not there is learnt."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn, self.before, self.long = learn, {}, {}

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONG:
            if piece not in self.long:
                self.long[piece] = self.learn(piece)
            return self.long[piece]
        ids = self[piece] = self.before.get(piece) or self.learn(piece)
        return ids

    def turn(self) -> None:
        self.long = {}
        if len(self) > CACHE:
            self.before = dict(self)
            self.clear()


class Encoder:
    """ids(texts) gives each text's ids as bytes of little-endian unsigned integers, with `end` appended.

    They have 32 bits, or with `short` 16 if the vocabulary allows that (`kind`).
    """

    def __init__(self, path: str, end: int = 0, short: bool = False):
        # Spark deals out the work; threads inside a task would only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if short and self.size <= 1 << 16 else "<u4")
        self.end = np.array(end, self.kind).tobytes()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cut = str(self.tokenizer.pre_tokenizer)
        self.plain = self.tokenizer.normalizer is None and cut.startswith("ByteLevel(") and "add_prefix_space=False" in cut and "use_regex=True" in cut
        # The character that stands for each byte; printable ones other than the space stand for themselves.
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
        self.byte = dict(zip([b for b in range(256) if b not in set(shown)], range(256, 512), strict=False))
        self.space = chr(self.byte[32])
        # Each access makes a new object.
        self.asked = self.tokenizer.model.tokenize
        self.known = _Known(self._learn)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, piece: str) -> bytes:
        """The ids of a piece, which is one word to the model."""
        written = piece.replace(" ", self.space) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.byte)
        return array("H" if self.kind.itemsize == 2 else "I", [t.id for t in self.asked(written)]).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        self.known.turn()
        at, out = self.known.__getitem__, []
        # A text at a time, so that its pieces are still in the processor's cache when they are looked up.
        for t in texts:
            if self.plain and not LATE.search(t) and not any(a in t for a in self.added):
                out.append(b"".join(map(at, PIECES.findall(t))) + self.end)
            else:
                out.append(self._whole(t) + self.end)
        return out


@lru_cache(maxsize=2)
def encoder(path: str, end: int = 0, short: bool = False) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path, end, short)
