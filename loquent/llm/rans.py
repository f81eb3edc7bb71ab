"""Static range asymmetric numeral system over token ids, in numpy.

One frequency table serves all blocks. A block is coded by interleaved lanes (lane j codes ids j, j + lanes, ...) that
share one word stream, so that each step handles all lanes at once. Every CHECK_STEPS steps a checkpoint holds the
lanes' states and the place in the stream: decoding can begin at any checkpoint, and segments and blocks are decoded
independently of each other. A CRC-32 of header and stream and one of the ids guard each block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
LOW = np.uint64(1 << 31)
LANES, CHECK_STEPS = 1024, 128
_HEAD = struct.Struct("<4sIIIIII")  # magic, ids, lanes, words, checkpoints, CRC of the ids, CRC of the rest
_MAGIC = b"RNS1"


class Table:
    """Frequencies scaled to 2**SCALE, at least 1 for every id that occurs."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        self.ids, counts = np.asarray(ids, np.uint32)[order], np.asarray(counts, np.float64)[order]
        total = 1 << SCALE
        if len(self.ids) > total // 2:
            raise ValueError("too many different ids for the table")
        freq = np.maximum(1, np.floor(counts / max(counts.sum(), 1) * total)).astype(np.int64)
        while len(freq) and (gap := total - int(freq.sum())):
            by = np.argsort(-freq, kind="stable")
            if gap > 0:
                freq[by[0]] += gap
            else:
                cut = np.minimum(freq[by] - 1, np.maximum(1, (freq[by] * (-gap / total)).astype(np.int64)))
                cut = np.minimum(cut, np.maximum(0, -gap - np.concatenate(([0], np.cumsum(cut)[:-1]))))
                freq[by] -= cut
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64) if len(freq) else freq.astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
        #: From a state of so much on, words are written before an id is coded.
        self.limit = ((LOW >> np.uint64(SCALE)) << np.uint64(32)) * self.freq
        #: The place of each id in the table, or -1.
        self.place = np.full(int(self.ids.max(initial=0)) + 2, -1, np.int32)
        self.place[self.ids] = np.arange(len(self.ids))


def encode(table: Table, ids: np.ndarray) -> bytes:
    """One block."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    symbol = table.place[np.minimum(ids, len(table.place) - 1)]
    if (symbol < 0).any():
        raise ValueError("an id is not in the frequency table")
    state = np.full(lanes, LOW, np.uint64)
    stream, points, written = [], [], 0
    for t in range(steps - 1, -1, -1):
        s = symbol[t * lanes : (t + 1) * lanes]
        x, f = state[: len(s)], table.freq[s]
        out = np.flatnonzero(x >= table.limit[s])
        if len(out):
            high = x[out]
            stream.append(high.astype(np.uint32))
            written += len(out)
            x[out] = high >> np.uint64(32)
        q = x // f
        x += q * (np.uint64(1 << SCALE) - f)
        x += table.start[s]
        if t % CHECK_STEPS == 0:
            points.append((written, state.copy()))
    body = np.concatenate(stream[::-1]).tobytes() if stream else b""
    points = points[::-1]
    marks = np.array([written - p for p, _ in points], np.uint32).tobytes() + b"".join(x.tobytes() for _, x in points)
    rest = marks + body
    head = (n, lanes, written, len(points), zlib.crc32(np.ascontiguousarray(ids, np.uint32)))
    return _HEAD.pack(_MAGIC, *head, zlib.crc32(struct.pack("<IIIII", *head) + rest)) + rest


def decode(table: Table, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block, or of the segments between its checkpoints first and last."""
    magic, n, lanes, words, many, crc, check = _HEAD.unpack_from(block)
    rest = memoryview(block)[_HEAD.size :]
    if magic != _MAGIC or zlib.crc32(bytes(struct.pack("<IIIII", n, lanes, words, many, crc)) + bytes(rest)) != check:
        raise ValueError("a block is damaged")
    at = np.frombuffer(rest, np.uint32, many)
    states = np.frombuffer(rest, np.uint64, many * lanes, many * 4).reshape(many, lanes)
    stream = np.frombuffer(rest, np.uint32, words, many * 4 + many * lanes * 8)
    last = many if last is None else last
    steps = -(-n // lanes)
    whole = first == 0 and last == many
    out = np.empty(n, np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    if first < last:
        state, p = states[first].copy(), int(at[first])
        for t in range(first * CHECK_STEPS, min(steps, last * CHECK_STEPS)):
            size = min(lanes, n - t * lanes)
            x = state[:size]
            low = x & mask
            s = table.slot[low]
            out[t * lanes : t * lanes + size] = s
            x = table.freq[s] * (x >> np.uint64(SCALE)) + low - table.start[s]
            more = np.flatnonzero(x < LOW)
            if len(more):
                x[more] = (x[more] << np.uint64(32)) | stream[p : p + len(more)]
                p += len(more)
            state[:size] = x
    out = table.ids[out[first * CHECK_STEPS * lanes : min(n, last * CHECK_STEPS * lanes)]] if n else out
    if whole and zlib.crc32(out) != crc:
        raise ValueError("a block's ids are damaged")
    return out
