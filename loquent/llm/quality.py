"""Quality classifier by Bradley-Terry pairwise ranking.

Documents get a linear score w.x over text features. w maximises the likelihood of preference pairs (a document
labelled 1 beats one labelled 0), that is, logistic loss on feature differences. The cut is a quantile of the fitted
scores, and the logistic curve through it gives 0..1 with `CUT` at that quantile.

Defined results: a null or empty text has all features 0 and is scored like any other; without labels of both kinds
every score is 0.5; repeated rows give repeated results; several labels of one document count as its largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loquent.llm import textbuf as tb
from loquent.llm.columns import with_text_column

#: At most about so many labelled rows are used to fit; the rest of the corpus is scored, not sampled.
FIT_ROWS = 20_000
#: Preference pairs drawn from them.
FIT_PAIRS = 200_000
#: The score at the chosen quantile: below it a document is rejected.
CUT = 0.3
WINDOW = 24
_common = np.zeros(256, bool)
_common[[ord(c) for c in ".,;:!?'\"()-\n\r\t "]] = True
_common |= tb._alnum
_upper = np.zeros(256, bool)
_upper[65:91] = True
_lower = np.zeros(256, bool)
_lower[97:123] = True
_lower[0x80:] = True
NAMES = ("odd_words", "odd_peak", "caps", "caps_peak", "echo", "echo_peak", "again", "bang", "digits", "upper", "lines", "long_words", "short_words", "few_words")


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES' values and of their square roots for each document; all lie in 0..1."""
    n = len(offsets) - 1
    starts, ends, first = tb.words(raw, offsets)
    hashes = tb.range_hash(tb.prefix_hash(raw), starts, ends)
    a, b, count = first[:-1], first[1:], np.maximum(first[1:] - first[:-1], 1)

    def sums(of: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(of, dtype=np.int64)))

    def inside(of: np.ndarray) -> np.ndarray:
        s = sums(of)
        return s[ends] - s[starts]

    own = np.repeat(np.arange(n), b - a)
    size = ends - starts
    odd = inside(~_common[raw]) > 0
    caps = (inside(_upper[raw]) >= 2) & (inside(_lower[raw]) == 0)
    echo = np.zeros(len(starts), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
    again = np.zeros(n)
    triple = tb.mix(hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7)) if len(hashes) > 2 else np.zeros(0, np.uint64)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if y - x > 2:
            again[i] = 1 - len(np.unique(triple[x : y - 2])) / (y - 2 - x)
    columns = []
    for flag in (odd, caps, echo):
        s = sums(flag)
        columns.append((s[b] - s[a]) / count)
        wide = np.minimum(WINDOW, b - a)
        last = np.maximum(np.repeat(b - wide, b - a), 0)
        at = np.minimum(np.arange(len(flag)), last)
        share = (s[at + np.repeat(wide, b - a)] - s[at]) / np.maximum(np.repeat(wide, b - a), 1)
        peak = np.zeros(n)
        some = b > a
        if some.any():
            peak[some] = np.maximum.reduceat(share, a[some])
        columns.append(peak)
    letters = np.maximum(offsets[1:] - offsets[:-1], 1)

    def of_bytes(flag: np.ndarray) -> np.ndarray:
        s = sums(flag)
        return s[offsets[1:]] - s[offsets[:-1]]

    s = sums(size)
    mean = (s[b] - s[a]) / count
    columns += [again, of_bytes(raw == 33) / letters, of_bytes((raw >= 48) & (raw < 58)) / letters, of_bytes(_upper[raw]) / letters, np.minimum(1, of_bytes(raw == 10) / count), np.clip((mean - 6) / 20, 0, 1), np.clip((4 - mean) / 4, 0, 1), 1 / (1 + count)]
    x = np.stack(columns, 1)
    return np.hstack([x, np.sqrt(x)])


def fit(x: np.ndarray, y: np.ndarray, pairs: int = FIT_PAIRS, ridge: float = 1e-3, rounds: int = 25) -> dict:
    """Bradley-Terry weights by Newton steps, and the cut as a quantile of the scores of the fitted rows."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return {"w": np.zeros(x.shape[1] if x.ndim == 2 else 2 * len(NAMES)), "cut": 0.0, "quantile": None}
    draw = np.random.default_rng(7)
    d = good[draw.integers(len(good), size=pairs)] - bad[draw.integers(len(bad), size=pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ (1 - p) / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = x @ w
    order = np.sort(s)
    at = np.linspace(0, 1, 501)
    cuts = np.quantile(order, at)
    right = [(s[y == 1] >= c).mean() + (s[y == 0] < c).mean() for c in cuts]
    k = int(np.argmax(right))
    low, high = s[s < cuts[k]], s[s >= cuts[k]]
    cut = (low.max() + high.min()) / 2 if len(low) and len(high) else cuts[k]
    return {"w": w, "cut": float(cut), "quantile": float(at[k])}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    if model["quantile"] is None:
        return np.full(len(x), 0.5)
    return 1 / (1 + (1 - CUT) / CUT * np.exp(-np.clip(x @ model["w"] - model["cut"], -500, 500)))


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> dict:
    """A model from the rows of `labels` (doc_id, quality), at most about `most` of them, chosen by a hash of doc_id."""
    labels = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    share = min(1.0, most / max(1, labels.count()))
    # The sample is bounded by `most`, so it may be broadcast.
    chosen = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < max(1, int(share * (1 << 40)))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            x = features(*tb.buffers(part.column("text")))
            flat = pa.array(x.ravel().astype(np.float64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), lists], ["doc_id", "quality", "x"])

    got = rows.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(measure, "doc_id long, quality int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist()) if len(got) else np.zeros((0, 2 * len(NAMES)))
    return fit(x, got["quality"].to_numpy())


def score(docs: DataFrame, model: dict, spark: SparkSession) -> DataFrame:
    """doc_id, score double (0..1), predicted int (1 if score >= CUT) for each document; no shuffle."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            s = scores(shared.value, features(*tb.buffers(part.column("text"))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def score_rows(docs: DataFrame, model: dict, spark: SparkSession, name: str) -> DataFrame:
    """All columns of `docs`, and the score as the column `name`."""
    shared = spark.sparkContext.broadcast(model)
    return with_text_column(docs, name, DoubleType(), lambda text: pa.array(scores(shared.value, features(*tb.buffers(text)))))


def held_out(column: str = "doc_id", by: int = 5, rest: int = 0):
    return F.crc32(F.col(column).cast("string")) % by == rest
