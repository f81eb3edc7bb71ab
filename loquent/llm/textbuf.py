"""Whole-batch text helpers: an Arrow string column is seen as one byte array with document offsets.

Every helper works on all bytes of a batch at once, so no Python loop runs per character or per word.
Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the memory of the arrays derived from them (8 bytes and more per byte).
SLICE_BYTES = 2 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Of every byte: whether it separates words, for words of the form [^\x20\x09-\x0D]+.
SPACE = _space
_alnum = np.zeros(256, bool)
_alnum[0x80:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _alnum[ord(_a) : ord(_b) + 1] = True
#: Of every byte: whether it separates words, for words of letters, digits and non-ASCII bytes.
NOT_ALNUM = ~_alnum
_codes = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_folded = _codes.copy()
_folded[65:91] = _codes[97:123]
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    had = _powers.get(base)
    if had is None or len(had) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        _powers[base] = had = np.multiply.accumulate(full)
    return had[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the offset of each row with the end after them."""
    column = column.fill_null("") if column.null_count else column
    column = column if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    data = column.buffers()[2] if n else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def prefix_hash(raw: np.ndarray, fold: bool = True) -> np.ndarray:
    """Sums from which the hash of any byte range follows in O(1); see range_hash."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_folded if fold else _codes)[raw] * powers(len(raw), _BASE), out=sums[1:])
    return sums


def inverse_powers(n: int) -> np.ndarray:
    """Multiplied with these, differences of prefix sums do not depend on where they stand."""
    return powers(n, _INVERSE)


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end): equal bytes (after case folding, if chosen) give equal hashes anywhere."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), _INVERSE)[starts] + (ends - starts).astype(np.uint64) * _GOLD)


def words(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word, with the end after them."""
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separator[raw]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z as a-z, and the first word of each document."""
    starts, ends, first = words(raw, offsets, separator)
    return range_hash(prefix_hash(raw), starts, ends), first


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence."""
    hashes, first = word_hashes(raw, offsets)
    weights = powers(k + 2, 0xD1342543DE82EF95)[1:]
    many = max(0, len(hashes) - k + 1)
    rolled = np.zeros(many, np.uint64)
    for j in range(k):
        rolled += hashes[j : j + many] * weights[j]
    rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            yield mix(np.array([int((hashes[a:b] * weights[: b - a]).sum(dtype=np.uint64))], np.uint64) ^ np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
