"""The pipeline against a plain composition of its stages' rules."""

from __future__ import annotations

import corpus_pipeline as P
from loquent.llm import decontaminate, pii, quality
from tests.llm.test_operators import check_packing, encoded, linked_components, shingles


def test_run_equals_plain_stages(spark, edged):
    docs = spark.read.parquet(f"{edged}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{edged}/{t}.parquet") for t in ("labels", "benchmark"))
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels), spark).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] >= quality.CUT}
    root = linked_components({d: shingles(t) for d, t in texts.items()})
    texts = {d: t for d, t in texts.items() if root[d] == d}
    leaks = {r.doc_id for r in decontaminate.find_leaks(docs, bench, spark).collect() if r.leaks}
    texts = {d: t for d, t in texts.items() if d not in leaks}
    left = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    texts = {r.doc_id: r.text for r in pii.redact(left, spark, P.PII_KEY).collect()}
    rows = P.run(spark, edged).collect()
    used = check_packing(rows, encoded(texts))
    assert used <= -(-sum(r.length for r in rows) // 2048) + max(1, len(texts) // 100)


def test_stages_keep_columns_and_take_odd_rows(spark, edges, edged):
    docs = edges
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, edged)
        assert docs.columns == edges.columns, name
    assert P.STAGES[-1][1](spark, docs, edged).count() >= 1
    assert P.STAGES[-1][1](spark, edges.limit(0), edged).count() == 0


def changed(stem, words, at):
    """A text of different words, and a copy with another word in one place."""
    own = [f"{stem}{i}" for i in range(words)]
    return " ".join(own), " ".join([*own[:at], "other", *own[at + 1 :]])


def test_near_copies_are_linked_from_the_percent_given(spark):
    pairs = [changed("a", 55, 27), changed("b", 48, 24), changed("c", 90, 40)]
    alike = [len(x & y) / len(x | y) for x, y in ((shingles(a), shingles(b)) for a, b in pairs)]
    assert 0.82 < alike[0] < 0.83 and alike[1] < 0.8 and alike[2] > 0.85
    rows = [(10 * k + i, text) for k, pair in enumerate(pairs) for i, text in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, want in ((80, [0, 10, 11, 20]), (85, [0, 1, 10, 11, 20])):
        assert sorted(r.doc_id for r in P.dedup_stage(spark, docs, "", percent).collect()) == want
