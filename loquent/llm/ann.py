"""Nearest neighbours by score-aware (anisotropic) product quantisation, four-bit table scans and exact reranking.

Vectors are scaled to length 1 and cut into short parts; each part is one of 16 centroids. Centroids and codes minimise
|r|^2 + (eta - 1) <r, x>^2 for the residual r of x: the part of the error along the vector, which changes large inner
products most, costs eta times as much. A search adds up table entries for all codes and reranks the best exactly.

Defined results: vectors that are null, empty, zero, hold a null or non-finite component, or differ in length from the
most common length take no part; ties go to the smaller id; of identical vectors the smallest ids are found; with fewer
candidates than asked for, all are returned; repeated ids are separate candidates, but never a query's own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loquent.llm.scratch import Scratch

#: Rows at most, about, that the centroids are fitted on; every row is indexed.
FIT_ROWS = 20_000
#: Inner products of this size and more (of unit vectors) are to come out right.
THRESHOLD = 0.2
#: Dimensions of a part.
PART = 2
#: Candidates reranked exactly for each query and block of vectors; blocks of vectors and of queries.
RERANK, VECTORS, QUERIES = 64, 4096, 1024
#: Table sums that differ by less tie; and pairs whose exact products are made at once.
TIE, EXACT = 1e-5, 1 << 17


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    v = F.col("embedding")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))


def _parts(x: np.ndarray) -> np.ndarray:
    width = -(-x.shape[1] // (2 * PART)) * 2 * PART
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))).reshape(len(x), -1, PART)


def encode(x: np.ndarray, centroids: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes (rows x parts, 0..15) of unit vectors, part by part with the other parts' error along x held fixed."""
    p = _parts(x)
    error = ((p[:, :, None] - centroids[None]) ** 2).sum(3)
    codes = error.argmin(2).astype(np.uint8)
    rows = np.arange(len(x))
    along = np.einsum("nmd,nmkd->nmk", p, p[:, :, None] - centroids[None])
    total = along[rows[:, None], np.arange(p.shape[1])[None], codes].sum(1)
    for _ in range(rounds):
        for m in range(p.shape[1]):
            rest = total - along[rows, m, codes[:, m]]
            codes[:, m] = (error[:, m] + (eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
            total = rest + along[rows, m, codes[:, m]]
    return codes


def fit(x: np.ndarray, rounds: int = 8, seed: int = 3) -> dict:
    """Centroids (parts x 16 x PART) for unit vectors, by turns of encoding and weighted least squares."""
    eta = (x.shape[1] - 1) * THRESHOLD**2 / (1 - THRESHOLD**2)
    eta = max(1.0, eta)
    p = _parts(x)
    draw = np.random.default_rng(seed)
    centroids = p[draw.integers(len(x), size=16)].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        codes = encode(x, centroids, eta, 1)
        chosen = centroids[np.arange(p.shape[1])[None], codes]
        along = ((p - chosen) * p).sum(2)
        total = along.sum(1)
        for m in range(p.shape[1]):
            own, rest = p[:, m], total - along[:, m]
            outer = own[:, :, None] * own[:, None, :]
            right = own * (1 + (eta - 1) * ((own**2).sum(1) + rest))[:, None]
            for k in range(16):
                at = codes[:, m] == k
                if at.any():
                    left = at.sum() * np.eye(PART) + (eta - 1) * outer[at].sum(0)
                    centroids[m, k] = np.linalg.solve(left + 1e-9 * np.eye(PART), right[at].sum(0))
                else:
                    centroids[m, k] = own[draw.integers(len(own))]
    return {"centroids": centroids, "eta": eta, "dim": x.shape[1]}


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def build(vectors: DataFrame, spark: SparkSession, scratch: Scratch) -> tuple[DataFrame | None, dict | None]:
    """The index (vec_id, embedding, codes: two codes a byte) of all usable vectors, and its model."""
    sizes = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return None, None
    dim, count = sizes[0]
    vectors = vectors.filter(F.size("embedding") == dim)
    share = min(1.0, FIT_ROWS / count)
    # Bounded by FIT_ROWS.
    sample = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < max(1, int(share * 1_000_000))) if share < 1 else vectors
    got = sample.toPandas().sort_values("vec_id", kind="stable")
    x = np.array(got["embedding"].tolist() or [np.ones(dim)])
    model = fit(x / np.linalg.norm(x, axis=1, keepdims=True))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, VECTORS):
                part = batch.slice(at, VECTORS)
                x = _matrix(part.column("embedding"), dim)
                codes = encode(x / np.linalg.norm(x, axis=1, keepdims=True), shared.value["centroids"], shared.value["eta"])
                packed = codes[:, 0::2] | (codes[:, 1::2] << 4)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array([r.tobytes() for r in packed], pa.binary())], ["vec_id", "embedding", "codes"])

    return scratch.table(vectors.mapInArrow(run, "vec_id long, embedding array<double>, codes binary"), "index"), model


def _tables(model: dict, queries: np.ndarray) -> np.ndarray:
    """Inner products of each query (unit) with every pair of neighbouring centroids: queries x bytes x 256."""
    single = np.einsum("qmd,mkd->qmk", _parts(queries), model["centroids"]).astype(np.float32)
    low, high = single[:, 0::2], single[:, 1::2]
    return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(queries), low.shape[1], 256)


def search(index: DataFrame, model: dict, ids: np.ndarray, queries: np.ndarray, k: int, spark: SparkSession) -> DataFrame:
    """For each query the k nearest of every task's rows (query_id, vec_id, score); one pass over the index."""
    norms = np.linalg.norm(queries, axis=1)
    shared = spark.sparkContext.broadcast((model, ids, queries, norms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids, queries, norms = shared.value
        tables = _tables(model, queries / norms[:, None])
        best: pd.DataFrame | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, VECTORS):
                part = batch.slice(at, VECTORS)
                own = part.column("vec_id").to_numpy()
                x = _matrix(part.column("embedding"), model["dim"])
                order = np.argsort(own, kind="stable")
                # Of identical vectors only the k + 1 smallest ids can be among the k nearest (one may be the query).
                kept = order[pd.Series([r.tobytes() for r in x[order]]).groupby(lambda i, v=x[order]: v[i].tobytes()).cumcount().to_numpy() <= k]
                own, x = own[kept], x[kept]
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(part.num_rows, -1)[kept]
                found = np.zeros((len(ids), len(own)), np.float32)
                for m in range(codes.shape[1]):
                    found += tables[:, m][:, codes[:, m]]
                found[own[None] == ids[:, None]] = -np.inf
                many, long_ = min(RERANK, len(own)), np.linalg.norm(x, axis=1)
                # All that come as near as the last of the best, so that no tie is cut; some queries at a time.
                least = -np.partition(-found, many - 1, axis=1)[:, many - 1] - TIE
                near = (found >= least[:, None]) & np.isfinite(found)
                group = np.cumsum(near.sum(1)) // EXACT
                for first, last in zip(*(np.searchsorted(group, np.unique(group), side) for side in ("left", "right")), strict=True):
                    q, v = np.nonzero(near[first:last])
                    q += first
                    exact = np.einsum("pd,pd->p", x[v], queries[q]) / (norms[q] * long_[v])
                    rows = pd.DataFrame({"query_id": ids[q], "vec_id": own[v], "score": exact})
                    best = rows if best is None else pd.concat([best, rows])
                    best = best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, spark: SparkSession) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of each query among all vectors but its own."""
    scratch = Scratch(spark)
    vectors, queries = usable(vectors), usable(queries)
    index, model = build(vectors, spark, scratch)
    out = None
    if index is not None:
        ids, rows = [], []

        def flush() -> None:
            nonlocal out
            part = search(index, model, np.array(ids), np.array(rows), k, spark)
            out = part if out is None else out.unionByName(part)
            ids.clear()
            rows.clear()

        # The stated query set against all rows, in blocks; a block holds at most QUERIES vectors.
        for row in queries.filter(F.size("embedding") == model["dim"]).dropDuplicates(["vec_id"]).orderBy("vec_id").toLocalIterator():
            ids.append(row.vec_id)
            rows.append(row.embedding)
            if len(ids) == QUERIES:
                flush()
        if ids:
            flush()
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scratch.finish(out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
