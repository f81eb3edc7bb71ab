"""Language identification of mixed-language text.

Each word gets a score for each language from its character n-grams (1 to 3, with word edges). The scripts of a word
narrow the candidates to languages that use its script. Viterbi over the words, with a penalty for every switch, labels
spans; the language with most letters in its spans is the document's.

Defined results: null text, or text without a letter, is `und` with score 0 and no spans; a word without letters, or
whose script no learned language uses, leans to no language; ties go to the language first in alphabetical order;
repeated rows give repeated results; without any training row every document is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquent.llm import textbuf as tb

#: About so many documents at most are used to learn the character statistics; all documents are labelled.
FIT_DOCS = 20_000
#: Buckets of each n-gram order.
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Log probability of a change of language from one word to the next.
SWITCH = 8.0
#: A language uses a script if at least this share of its letters is written in it.
SCRIPT_SHARE = 0.02
#: First code point, end and name of the ranges told apart; the rest is "other".
SCRIPTS = (
    (0x0041, 0x0250, "latin"), (0x0370, 0x0400, "greek"), (0x0400, 0x0530, "cyrillic"), (0x0530, 0x0590, "armenian"), (0x0590, 0x0600, "hebrew"), (0x0600, 0x0780, "arabic"), (0x0900, 0x0980, "devanagari"), (0x0980, 0x0A00, "bengali"), (0x0B80, 0x0C00, "tamil"), (0x0E00, 0x0E80, "thai"),
    (0x10A0, 0x1100, "georgian"), (0x1100, 0x1200, "hangul"), (0x1E00, 0x1F00, "latin"), (0x1F00, 0x2000, "greek"), (0x3040, 0x3100, "kana"), (0x3400, 0xA000, "han"), (0xAC00, 0xD7B0, "hangul"),
)
SCRIPT_NAMES = ("none", *dict.fromkeys(name for *_, name in SCRIPTS), "other")
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: the lower-case one, and its script as an index of SCRIPT_NAMES (0: not a letter)."""
    if not _tables:
        lower = np.arange(0x110000, dtype=np.uint32)
        script = np.zeros(0x110000, np.uint8)
        for c in range(0x20000):
            x = chr(c)
            if x.isalpha():
                script[c] = len(SCRIPT_NAMES) - 1
                if len(y := x.lower()) == 1:
                    lower[c] = ord(y)
        script[0x20000:0x32000] = len(SCRIPT_NAMES) - 1
        for a, b, name in SCRIPTS:
            part = script[a:b]
            part[part > 0] = SCRIPT_NAMES.index(name)
        _tables.append((lower, script))
    return _tables[0]


class Words:
    """The words of a batch as code points."""

    def __init__(self, column: pa.Array):
        raw, offsets = tb.buffers(column)
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets]
        lower, script = _characters()
        points = np.minimum(points, 0x10FFFF)
        space = points <= 32
        inside = np.zeros(len(points) + 2, bool)
        inside[1:-1] = ~space
        cut = np.zeros(len(points) + 1, bool)
        cut[at] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        self.first = np.searchsorted(self.starts, at)
        self.script = script[points]
        self.points = lower[points].astype(np.uint64)
        self.points[self.script == 0] = 32  # everything that is no letter counts as an edge
        letters = np.concatenate(([0], np.cumsum(self.script > 0)))
        self.letters = letters[self.ends] - letters[self.starts]

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(order, bucket of the n-gram that ends at each letter or edge after one, positions)."""
        p = np.concatenate((np.full(3, 32, np.uint64), self.points))
        letter = self.script > 0
        after = np.zeros(len(letter), bool)
        after[1:] = letter[:-1]
        for k, order in enumerate(ORDERS):
            at = np.flatnonzero(letter if order == 1 else letter | after)
            h = np.full(len(at), order, np.uint64)
            for j in range(order):
                h = h * np.uint64(0x100000001B3) + p[at + 3 - j]
            yield k, (tb.mix(h) % np.uint64(BUCKETS)).astype(np.int64) + k * BUCKETS, at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-gram buckets (key >= 0) and of letters by script (key < 0) of each language in this partition."""
    grams: dict[str, np.ndarray] = {}
    for part in tb.slices(batches):
        langs = np.array(part.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            own = part.column("text").filter(pa.array(langs == lang))
            words = Words(own)
            total = grams.setdefault(lang, np.zeros(len(ORDERS) * BUCKETS + len(SCRIPT_NAMES), np.int64))
            for _, bucket, _ in words.grams():
                total[: len(ORDERS) * BUCKETS] += np.bincount(bucket, minlength=len(ORDERS) * BUCKETS)
            total[len(ORDERS) * BUCKETS :] += np.bincount(words.script, minlength=len(SCRIPT_NAMES))
    for lang, total in grams.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])


def train(docs: DataFrame, most: int = FIT_DOCS) -> dict:
    """Character statistics of each value of `lang`, from about `most` rows chosen by a hash of the text."""
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    share = min(1.0, most / max(1, docs.count()))
    chosen = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < max(1, int(share * (1 << 40)))) if share < 1 else docs
    got = chosen.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    size = len(ORDERS) * BUCKETS
    counts = np.zeros((size + len(SCRIPT_NAMES), len(langs)))
    counts[got["bucket"].to_numpy(np.int64), [langs.index(x) for x in got["lang"]]] = got["n"].to_numpy()
    table = np.zeros((size, len(langs)), np.float32)
    for k in range(len(ORDERS)):
        part = counts[k * BUCKETS : (k + 1) * BUCKETS]
        table[k * BUCKETS : (k + 1) * BUCKETS] = np.log((part + 0.5) / (part.sum(0) + 0.5 * BUCKETS))
    scripts = counts[size:]
    scripts[0] = 0
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    uses[0] = False
    return {"langs": langs, "table": table - table.mean(1, keepdims=True) if langs else table, "uses": uses}


def word_scores(model: dict, words: Words) -> np.ndarray:
    """Log scores (words x languages), 0 apart for words that tell nothing."""
    out = np.zeros((len(words.starts), len(model["langs"])), np.float32)
    n = len(words.starts)
    if not n:
        return out
    for _, bucket, at in words.grams():
        own = np.searchsorted(words.starts, at, "right") - 1
        inside = (own >= 0) & (at <= words.ends[own])
        own, rows = own[inside], model["table"][bucket[inside]]
        if len(own):
            change = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[change]] += np.add.reduceat(rows, change, axis=0)
    for s in range(1, len(SCRIPT_NAMES)):
        use = model["uses"][s]
        seen = np.concatenate(([0], np.cumsum(words.script == s)))
        has = seen[words.ends] > seen[words.starts]
        if not use.any():
            out[has] = 0
        elif not use.all():
            out[np.ix_(has, ~use)] -= 50
    out[words.letters == 0] = 0
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best language of each word, all documents in step; documents are rows first[d]..first[d+1] of scores."""
    n, sizes = len(scores), np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")  # documents with more than t words
    came = np.empty(n, np.int16)
    switched = np.zeros(scores.shape, bool)
    value = np.zeros((len(begin), scores.shape[1]), np.float32)
    for t in range(steps):
        k = active[t]
        at, v = begin[:k] + t, value[:k]
        top = v.argmax(1)
        best = v[np.arange(k), top] - penalty
        if t:
            switched[at] = v < best[:, None]
            came[at] = top
            np.maximum(v, best[:, None], out=v)
        v += scores[at]
    out = np.zeros(n, np.int16)
    now = value.argmax(1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at, label = begin[:k] + t, now[:k]
        out[at] = label
        now[:k] = np.where(switched[at, label], came[at], label)
    return out


def identify(docs: DataFrame, model: dict, spark: SparkSession) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters in its spans, 0 to 1) and the spans (words, language)."""
    shared = spark.sparkContext.broadcast(model)
    span = pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = np.array([*model["langs"], "und"], object)
        many = len(langs) - 1
        for part in tb.slices(batches):
            words = Words(part.column("text"))
            rows = part.num_rows
            first, own = words.first, np.repeat(np.arange(rows), np.diff(words.first))
            label = viterbi(word_scores(model, words), first) if many and len(own) else np.zeros(len(own), np.int16)
            share = np.bincount(own * (many + 1) + label, weights=words.letters, minlength=rows * (many + 1)).reshape(rows, many + 1)[:, :many] if len(own) else np.zeros((rows, many))
            total = share.sum(1)
            best = np.where(total > 0, share.argmax(1), many) if many else np.zeros(rows, np.int64)
            score = np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0) if many else np.zeros(rows)
            change = np.ones(len(own), bool)
            change[1:] = (label[1:] != label[:-1]) | (own[1:] != own[:-1])
            change &= (total > 0)[own]
            at = np.flatnonzero(change)
            ends = np.minimum(np.append(at[1:], len(own)), first[own[at] + 1]) if len(at) else at
            base = first[own[at]]
            spans = pa.StructArray.from_arrays([pa.array((at - base).astype(np.int32)), pa.array((ends - base).astype(np.int32)), pa.array(langs[label[at]], pa.string())], fields=list(span))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs[best], pa.string()), pa.array(score), lists], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start_word: int, end_word: int, lang: string>>")


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 4 == 2
