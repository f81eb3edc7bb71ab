"""Byte-level BPE, encoding and decoding of whole texts, from a tokenizers file.

Texts are split into pieces as the file's pre-tokenizer does, and a piece is merged by itself. Each task keeps an index
of the pieces it has not met before: every pair of neighbouring symbols with all its positions. The ranks that occur are
applied in ascending order, each to all its positions at once, and the lists of the pairs next to them are updated. A
merge only makes pairs of a higher rank (checked when the file is read), so one ascending pass is the whole encoding.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loquent.llm import textbuf as tb
from loquent.llm.columns import free_name
from loquent.llm.tokens import LATE, PIECES

#: Pieces remembered by a worker: about so many of late, and as many of before. Longer ones than LONG are not.
CACHE, LONG = 250_000, 256
#: Bytes of text whose new pieces share an index, and ids decoded at once.
INDEXED, DECODED = 8 << 20, 1 << 20
# How byte-level files split texts; a fixed pattern of the format.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_KINDS = [regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s", ".")]
_NONE = np.int32(1 << 30)


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level files: itself if it is printable, else one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    others = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(others)) for b in range(256)]


class Remembered:
    """What was found of late, and of before as much again; `turn` forgets the rest."""

    def __init__(self):
        self.late: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def __contains__(self, key: str) -> bool:
        return key in self.late or key in self.before

    def __getitem__(self, key: str) -> bytes:
        if key not in self.late:
            self.late[key] = self.before[key]
        return self.late[key]

    def put(self, found: dict[str, bytes]) -> None:
        self.late.update(found)

    def turn(self) -> None:
        if len(self.late) > CACHE:
            self.late, self.before = {}, self.late


class Bpe:
    """The merges of one file. `pieces(text)` splits, `ids(texts)` encodes, `texts(ids, offsets)` decodes.

    Only byte-level files without normalizer, prefix space and options of their added tokens are taken; others raise
    ValueError, as do merges that are not in the order in which they can apply.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, cut = told["model"], told["pre_tokenizer"] or {}
        if told["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        if any(t[x] for t in told["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with options")
        vocab, byte = model["vocab"], {c: b for b, c in enumerate(byte_characters())}
        made = {vocab[c]: -1 for c in byte if c in vocab}
        self.letter = np.array([vocab.get(c, -1) for c in byte], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys, new = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int32)
        for rank, (a, b) in enumerate(pairs):
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            if both in made or made.get(left, rank) >= rank or made.get(right, rank) >= rank:
                raise ValueError(f"merge {rank} cannot be applied in ascending order")
            made[both] = rank
            keys[rank], new[rank] = left << 32 | right, both
        order = np.argsort(keys)
        self.keys, self.ranks, self.new = keys[order], order.astype(np.int32), new
        self.same = np.array([a == b for a, b in pairs], bool)
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.cuts = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        held = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in (vocab | self.added).items()}
        self.held = [held.get(i, b"") for i in range(max(held, default=-1) + 1)]
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.agreed: dict[str, bool] = {}
        self.known = Remembered()

    def _agrees(self, c: str) -> bool:
        """Whether the library takes a character for the same kind as the pattern does."""
        if c not in self.agreed:
            own = next(k for k, p in enumerate(_KINDS) if k == 3 or p.fullmatch(c))
            told = next((k for k, x in enumerate(("a", "1", None, "!")) if x and len(self.library.pre_tokenize_str(x + c)) == 1), 2)
            self.agreed[c] = own == told
        return self.agreed[c]

    def pieces(self, text: str) -> list[str]:
        if not LATE.search(text):
            return PIECES.findall(text)
        if all(map(self._agrees, set(LATE.findall(text)))):
            return _PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; _NONE for those that never merge."""
        keys = left.astype(np.int64) << 32 | right
        if not len(self.keys):
            return np.full(len(keys), _NONE, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0), self.ranks[at], _NONE)

    def merge(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit integers, by one index over all of them."""
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        # A separator of -1 stands before each piece and after the last; links lead over what was merged.
        at = np.concatenate([[0], np.cumsum(lengths + 1)])
        symbol = np.full(int(at[-1]) + 1, -1, np.int32)
        inside = np.ones(len(symbol), bool)
        inside[at] = False
        symbol[inside] = self.letter[np.frombuffer(b"".join(raw), np.uint8)]
        after, prior = np.arange(1, len(symbol) + 1, dtype=np.int32), np.arange(-1, len(symbol) - 1, dtype=np.int32)
        current = np.full(len(symbol), _NONE, np.int32)
        current[:-1] = self._rank(symbol[:-1], symbol[1:])
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            starts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
            ends = [*starts[1:].tolist(), len(ranks)]
            for a, b, rank in zip(starts.tolist(), ends, ranks[starts].tolist(), strict=True):
                if rank in index:
                    index[rank].append(places[a:b])
                else:
                    index[rank] = [places[a:b]]
                    heapq.heappush(active, rank)

        live = np.flatnonzero(current < _NONE).astype(np.int32)
        if len(live):
            enter(live, current[live])
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            places = lists[0] if len(lists) == 1 else np.concatenate(lists)
            places = places[current[places] == rank]
            if self.same[rank] and len(places) > 1:
                # In a run of one symbol every other pair merges, from the left.
                places = np.unique(places)
                begins = np.concatenate([[True], after[places[:-1]] != places[1:]])
                own = np.arange(len(places))
                places = places[(own - np.maximum.accumulate(np.where(begins, own, 0))) % 2 == 0]
            if not len(places):
                continue
            gone = after[places]
            beyond = after[gone]
            symbol[places], after[places], prior[beyond] = self.new[rank], beyond, places
            symbol[gone], current[gone] = -2, _NONE
            touched = np.concatenate([places, prior[places]])
            ranks = self._rank(symbol[touched], symbol[after[touched]])
            changed = ranks != current[touched]
            touched, ranks = touched[changed], ranks[changed]
            current[touched] = ranks
            fresh = ranks < _NONE
            if fresh.any():
                enter(touched[fresh], ranks[fresh])
        kept = symbol >= 0
        ends = (np.concatenate([[0], np.cumsum(kept)])[at] * 4).tolist()
        ids = symbol[kept].astype("<i4").tobytes()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        self.known.turn()
        split: list[list[str | bytes]] = []
        mixed: set[int] = set()
        met: dict[str, str] = {}

        def cut(text: str) -> list[str]:
            found = self.pieces(text)
            return list(map(met.setdefault, found, found))

        for text in texts:
            if self.cuts and self.cuts.search(text):
                parts: list[str | bytes] = []
                end = 0
                for m in self.cuts.finditer(text):
                    parts += [*cut(text[end : m.start()]), np.array(self.added[m.group()], "<i4").tobytes()]
                    end = m.end()
                mixed.add(len(split))
                split.append(parts + cut(text[end:]))
            else:
                split.append(cut(text))
        ids = {p: self.known[p] for p in met if p in self.known}
        new = [p for p in met if p not in ids]
        found = dict(zip(new, self.merge(new), strict=True))
        self.known.put({p: x for p, x in found.items() if len(p) <= LONG})
        ids.update(found)
        at = ids.__getitem__
        return [b"".join(map(at, parts)) if k not in mixed else b"".join([p if isinstance(p, bytes) else at(p) for p in parts]) for k, parts in enumerate(split)]

    def text(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids that are not in the file stand for nothing."""
        held = self.held
        ids = ids[(ids >= 0) & (ids < len(held))]
        return b"".join(map(held.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """One for each worker process and file."""
    return Bpe(path)


def _lists(found: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))


def encode(docs: DataFrame, spark: SparkSession, path: str, name: str = "ids", decoded: str | None = None) -> DataFrame:
    """`docs` (with `text`) and the column `name`: the ids of the whole text, array<int>; its text column is left out.

    With `decoded`, the text of these ids is a column of that name, made in the same task. A null text counts as empty and
    has no ids; the strings of added tokens in a text become their ids. Repeated rows are encoded each, an empty table
    gives an empty one, other columns pass through, and new names get underscores where `docs` has such a column. No
    shuffle: a task takes its own rows, INDEXED bytes of text at once, or one row if that is longer; a row may be as long
    as 2**31 / 40 bytes.
    """
    name = free_name(docs, name)
    decoded = decoded and free_name(docs.withColumn(name, F.lit(0)), decoded)
    kept = [f for f in docs.schema.fields if f.name != "text"]
    # A null text still gives an empty list.
    made = [StructField(name, ArrayType(IntegerType(), False)), *([StructField(decoded, StringType())] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path)
        for part in tb.slices(batches, "text", INDEXED):
            found = own.ids(part.column(part.schema.get_field_index("text")).fill_null("").to_pylist())
            at = 0
            while at < len(found):
                to, size = at + 1, len(found[at])
                while to < len(found) and size + len(found[to]) <= 4 * DECODED:
                    size += len(found[to])
                    to += 1
                rest, ids = part.slice(at, to - at), found[at:to]
                new = [_lists(ids), *([pa.array([own.text(np.frombuffer(x, "<i4")) for x in ids], pa.string())] if decoded else [])]
                yield pa.RecordBatch.from_arrays([*(rest.column(rest.schema.get_field_index(f.name)) for f in kept), *new], [f.name for f in [*kept, *made]])
                at = to

    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col("text")).mapInArrow(run, StructType([*kept, *made]))


def decode(rows: DataFrame, spark: SparkSession, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """`rows` and the column `name`: the text of the column `ids`, which is left out. Null ids give null; a null, negative
    or unknown id stands for nothing."""
    name = free_name(rows, name)
    kept = [f for f in rows.schema.fields if f.name != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path)
        for part in batches:
            column = part.column(part.schema.get_field_index(ids))
            offsets, flat = column.offsets.to_numpy(), column.values.fill_null(-1).to_numpy(zero_copy_only=False)
            null = column.is_null().to_pylist()
            texts = [None if none else own.text(flat[a:b]) for none, a, b in zip(null, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in kept), pa.array(texts, pa.string())], [*(f.name for f in kept), name])

    return rows.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{ids}`")).mapInArrow(run, StructType([*kept, StructField(name, StringType())]))
