"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters, digits and non-ASCII characters, A-Z as a-z. A seed is a mask over consecutive word
positions; positions with 0 are ignored, so a window still matches when words there were replaced. Windows of the
benchmark items are hashed under every mask and joined with those of the documents; each hit fixes an alignment of an
item with a document, and the words around it are compared. A document is contaminated by an item if at least
`SIMILARITY` of the item's words stand in it in place, or of any `RUN` words in a row of a longer item, taken over
alignments of the same item that are near each other (so inserted or missing words do not hide it).

Defined results: null and empty texts and items match nothing; items shorter than the longest mask are also matched as
exact whole sequences; repeated rows give repeated results; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from loquent.llm import textbuf as tb
from loquent.llm.columns import free_name, with_text_column

MASKS = ("11111", "1101101", "1110011", "11001011")
SIMILARITY = 0.8
#: So many words in a row of a long item are enough.
RUN = 50
#: Alignments of one item at most so many words apart are read as one occurrence with words inserted or left out.
DRIFT = 8
#: Items are broadcast in blocks of at most so many and so many bytes of text; a larger benchmark takes more passes.
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 32 << 20
_FILTER_BITS = 22


def _seeded(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash under one mask of the window that starts at each word; too short at the end of the array."""
    n = max(0, len(hashes) - len(mask) + 1)
    out = np.full(n, len(mask) * 1009 + int(mask, 2), np.uint64)
    weights = tb.powers(len(mask) + 1, 0xA0761D6478BD642F)
    for j, kept in enumerate(mask):
        if kept == "1":
            out += hashes[j : j + n] * weights[j + 1]
    return tb.mix(out)


class Index:
    """Seeds of one block of items: a fixed-size filter, then a sorted table of (hash, item, position)."""

    def __init__(self, ids: list, texts: list[str]):
        raw, offsets = tb.buffers(pa.array(texts, pa.large_string()))
        self.words, self.first = tb.word_hashes(raw, offsets, tb.NOT_ALNUM)
        self.ids = ids
        longest = max(map(len, MASKS))
        sizes = np.diff(self.first)
        self.masks = [*MASKS, *("1" * n for n in sorted({int(s) for s in sizes if 0 < s < longest}) if "1" * n not in MASKS)]
        keys, at = [], []
        for mask in self.masks:
            h = _seeded(self.words, mask)
            own = np.searchsorted(self.first, np.arange(len(h)), "right") - 1
            ok = np.arange(len(h)) + len(mask) <= self.first[own + 1]
            if mask not in MASKS:  # whole short items only
                ok &= sizes[own] == len(mask)
            keys.append(h[ok])
            at.append(np.flatnonzero(ok))
        self.keys, self.at = np.concatenate(keys), np.concatenate(at)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.at = self.keys[order], self.at[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word of the documents, word of the items) at which some seed agrees."""
        left, right = [], []
        for mask in self.masks:
            h = _seeded(hashes, mask)
            maybe = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
            a = np.searchsorted(self.keys, h[maybe], "left")
            b = np.searchsorted(self.keys, h[maybe], "right")
            maybe, a, n = maybe[b > a], a[b > a], (b - a)[b > a]
            own = np.searchsorted(first, maybe, "right") - 1
            ok = maybe + len(mask) <= first[own + 1]
            maybe, a, n = maybe[ok], a[ok], n[ok]
            left.append(np.repeat(maybe, n))
            right.append(self.at[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return np.concatenate(left), np.concatenate(right)

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, int]]:
        """(document, item, similarity, first word there) of each item that a document contains."""
        left, right = self.hits(hashes, first)
        if not len(left):
            return []
        doc = np.searchsorted(first, left, "right") - 1
        item = np.searchsorted(self.first, right, "right") - 1
        shift = left - first[doc] - (right - self.first[item])
        found: dict[tuple[int, int], list[int]] = {}
        for d, i, s in np.unique(np.stack([doc, item, shift], 1), axis=0).tolist():
            found.setdefault((d, i), []).append(s)
        out = []
        for (d, i), shifts in found.items():
            words = self.words[self.first[i] : self.first[i + 1]]
            text = hashes[first[d] : first[d + 1]]
            best, start, group, last = 0.0, 0, None, None
            for s in shifts:  # ascending
                if last is None or s - last > DRIFT:
                    group = np.zeros(len(words), bool)
                    begin = s
                last = s
                lo, hi = max(0, -s), min(len(words), len(text) - s)
                group[lo:hi] |= words[lo:hi] == text[lo + s : hi + s]
                value = group.mean()
                if len(group) > RUN:
                    sums = np.concatenate(([0], np.cumsum(group)))
                    value = max(value, (sums[RUN:] - sums[:-RUN]).max() / RUN)
                if value > best:
                    best, start = float(value), max(0, begin)
            if best >= SIMILARITY:
                out.append((d, i, best, start))
        return out


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull() & (F.trim("text") != "")).orderBy("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text)
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield Index(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Index(ids, texts)


_LEAK = pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int32())])
_LEAKS = ArrayType(StructType([StructField("item_id", LongType()), StructField("similarity", DoubleType()), StructField("start_word", IntegerType())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, name: str = "leaks") -> DataFrame:
    """The documents' columns and `name`: each benchmark item that the text contains, with similarity and place. A column of
    that name (case does not count) is kept, and the new one gets underscores after its name.

    The text is read once per block of items and is never shuffled; one block (the usual case) adds no join.
    """
    name, own, found = free_name(docs, name), docs.columns, []
    for k, index in enumerate(_blocks(benchmark)):
        shared = spark.sparkContext.broadcast(index)

        def make(text: pa.Array, shared=shared) -> pa.Array:
            index = shared.value
            hashes, first = tb.word_hashes(*tb.buffers(text), tb.NOT_ALNUM)
            lists: list[list[dict]] = [[] for _ in range(len(text))]
            for d, i, similarity, start in index.matches(hashes, first):
                lists[d].append({"item_id": index.ids[i], "similarity": similarity, "start_word": start})
            return pa.array(lists, pa.list_(_LEAK))

        found.append(free_name(docs, f"__{name}_{k}"))
        docs = with_text_column(docs, found[-1], _LEAKS, make)
    joined = F.concat(*(F.col(f"`{c}`") for c in found)) if found else F.array().cast(_LEAKS)
    return docs.select(*(F.col(f"`{c}`") for c in own), F.array_sort(joined).alias(name))
