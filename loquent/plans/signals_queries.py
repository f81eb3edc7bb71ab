"""Signals in blocks: documents as the bytes of a source, vectors as samples and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquent.operators import signals as G
from loquent.plans.registry import Tables, query
from loquent.plans.streams_queries import work_folder

_LEAST, _MOST = 16_000, 48_000


@query(
    "a4_rebatched_chunks",
    f"""WITH RECURSIVE d AS (SELECT source, doc_id, coalesce(strlen(text), 0) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, coalesce(strlen(text), 0)) AS i FROM documents),
r AS (SELECT source, doc_id, i, n AS s FROM d WHERE i = 1 UNION ALL SELECT d.source, d.doc_id, d.i, d.n + CASE WHEN r.s < {_LEAST} THEN r.s ELSE greatest(r.s - {_MOST}, 0) END FROM r JOIN d ON d.source IS NOT DISTINCT FROM r.source AND d.i = r.i + 1)
SELECT source, doc_id, CAST(sum(least(s, {_MOST})) OVER (PARTITION BY source ORDER BY i) - least(s, {_MOST}) AS BIGINT) AS start, least(s, {_MOST}) AS bytes FROM r WHERE s >= {_LEAST}""",
)
def _(t: Tables):
    """The texts of a source are blocks of bytes; a chunk has at least 16,000 and at most 48,000 of them."""
    blocks = t.documents.select("source", "doc_id", F.octet_length("text").alias("bytes"))
    return G.rebatched(blocks, work_folder(t), "source", ["doc_id"], "bytes", _LEAST, _MOST)


def samples(t: Tables) -> DataFrame:
    return t.embeddings.select((F.col("vec_id") % 4).alias("stream"), F.expr("vec_id div 4").alias("block"), F.col("embedding").alias("samples"))


@query(
    "a6_resampled_blocks",
    """WITH x AS (SELECT vec_id % 4 AS stream, vec_id // 4 * 64 + i - 1 AS k, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)),
n AS (SELECT DISTINCT vec_id % 4 AS stream, unnest(range((vec_id // 4 * 10240 + 440) // 441, ((vec_id // 4 + 1) * 10240 + 440) // 441)) AS n FROM embeddings),
w AS (SELECT stream, n, n * 441 // 160 + j - 44 AS k, (n * 441 % 160) / 160.0 - (j - 44) AS u, 160 / 441.0 AS c FROM n, range(0, 90) t(j)),
h AS (SELECT stream, n, k, CASE WHEN abs(u) >= 45 THEN 0 ELSE c * CASE WHEN u = 0 THEN 1 ELSE sin(pi() * c * u) / (pi() * c * u) END * cos(pi() * u / 90) ** 2 END AS h FROM w)
SELECT stream, n, round(sum(h * coalesce(v, 0)), 6) + 0.0 AS y FROM h LEFT JOIN x USING (stream, k) GROUP BY ALL""",
)
def _(t: Tables):
    """Four signals of blocks of 64 samples, from 44.1 to 16 kHz; every output sample is a row."""
    blocks = G.resampled(samples(t), "stream", "block", "samples", 64, 44_100)
    first = F.floor((F.col("block") * 10_240 + 440) / 441)
    rows = blocks.select("stream", "block", F.posexplode("samples").alias("at", "y"))
    return rows.select("stream", (first + F.col("at")).alias("n"), (F.round("y", 6) + F.lit(0.0)).alias("y"))


_WEIGHTS = "a AS (SELECT vec_id, list_transform(embedding, lambda x: 1 / (1 + exp(-12 * CAST(x AS DOUBLE)))) AS a FROM embeddings), s AS (SELECT vec_id, a, list_reduce(a, lambda x, y: x + y) AS s FROM a)"
_MEAN = "0.5 * list_reduce(own, lambda x, y: x + y) / len(list_filter(own, lambda v: v <> 0))"
_RESCALED = f"""r AS (SELECT vec_id, 0 AS round, list_transform(a, lambda v: v * (round_even(s, 0) / s)) AS a FROM s UNION ALL
SELECT vec_id, round + 1, list_reduce(list_prepend(a, list_transform(list_filter(range(1, len(a) + 1), lambda i: a[i] > 0.999), lambda i: [CAST(i AS DOUBLE)])), lambda own, p: CASE WHEN own[CAST(p[1] AS BIGINT)] >= 0.999 THEN list_transform(own, lambda v: CASE WHEN v <> 0 THEN v * 0.5 + {_MEAN} ELSE v * 0.5 END) ELSE own END) FROM r WHERE round < 10)"""


def rescaled(t: Tables) -> DataFrame:
    """Weights of each vector, brought to a whole sum."""
    alphas = F.transform("embedding", lambda x: 1 / (1 + F.exp(F.lit(-12.0) * x.cast("double"))))
    rows = t.embeddings.select("vec_id", alphas.alias("a"))
    total = F.aggregate("a", F.lit(0.0).cast("double"), lambda s, v: s + v)
    return rows.select("vec_id", G.rescaled(F.col("a"), F.bround(total)).alias("a"))


@query("n17_rescaled_alphas", f"WITH RECURSIVE {_WEIGHTS}, {_RESCALED} SELECT vec_id, i, round(a[i], 9) AS alpha FROM r, range(1, 65) t(i) WHERE round = 10")
def _(t: Tables):
    rows = rescaled(t).select("vec_id", F.posexplode("a").alias("i", "alpha"))
    return rows.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("alpha", 9).alias("alpha"))


@query(
    "w23_rescaled_fires",
    f"WITH RECURSIVE {_WEIGHTS}, {_RESCALED}, i AS (SELECT vec_id, len(a) AS n, list_transform(range(1, len(a)), lambda k: list_reduce(a[1:k], lambda x, y: x + y)) AS i FROM r WHERE round = 10), f AS (SELECT vec_id, n, list_position(list_transform(i, lambda v: v - floor(i[-1] / 0.999) >= 0), true) - 1 AS first FROM i) SELECT vec_id, coalesce(first >= n - 2, false) AS fires, first FROM f",
)
def _(t: Tables):
    """The boundary fires on weights that were rescaled first."""
    rows = rescaled(t).withColumn("n", F.size("a"))
    zero = F.struct(F.lit(0.0).cast("double").alias("sum"), F.array().cast("array<double>").alias("all"))
    sums = F.aggregate(F.slice("a", 1, F.col("n") - 1), zero, lambda s, v: F.struct((s["sum"] + v).alias("sum"), F.concat(s["all"], F.array(s["sum"] + v)).alias("all")))
    rows = rows.withColumn("s", sums)
    left = F.transform("s.all", lambda v: v - F.floor(F.col("s.sum") / F.lit(0.999).cast("double")) >= 0)
    first = F.nullif(F.array_position(left, F.lit(True)), F.lit(0).cast("long")) - 1
    return rows.select("vec_id", "n", first.alias("first")).select("vec_id", F.coalesce(F.col("first") >= F.col("n") - 2, F.lit(False)).alias("fires"), "first")
