"""Chunks, sample rates and weights against plain loops over whole streams."""

from __future__ import annotations

import io
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from loquent.operators import signals as G
from loquent.sources import files


def chunks(sizes, least, most):
    held = sent = 0
    for k, n in enumerate(sizes):
        held += n
        if held >= least:
            yield k, sent, min(held, most)
            sent += min(held, most)
            held -= min(held, most)


def test_what_a_run_makes_of_any_carry():
    rng = random.Random(2)
    for _ in range(300):
        least = rng.randrange(1, 30)
        most = least + rng.randrange(60)
        sizes = [rng.choice([0, rng.randrange(20), rng.randrange(100)]) for _ in range(rng.randrange(12))]
        made = G.Carry(150)
        for n in sizes:
            made.add(n, least, most)
        assert made.lows[0] == 0 and made.lows == sorted(set(made.lows))
        for carry in range(151):
            left = carry
            for n in sizes:
                left = G.carried(left, n, least, most)
            assert made(carry) == left


@pytest.mark.parametrize("mean, partitions", [(20, "3"), (70, "16")])
def test_hot_stream_is_cut_in_parts(spark, tmp_path, mean, partitions):
    """One stream holds most rows and is spread over tasks; with a mean beyond the cap the carry keeps growing."""
    rng = random.Random(mean)
    rows = [(rng.choice(["hot"] * 9 + ["b", None]), k, rng.choice([None, 0, rng.randrange(2 * mean)])) for k in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = spark.createDataFrame(rows, "part string, id long, size long")
        got = G.rebatched(blocks, f"file://{tmp_path}", "part", ["id"], "size", 30, 45).collect()
        split = spark.read.parquet(f"{tmp_path}/begins").filter("stream = 'hot'").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for name in ("hot", "b", None):
        own = [(k, n or 0) for s, k, n in rows if s == name]
        want += [(name, own[i][0], start, n) for i, start, n in chunks([n for _, n in own], 30, 45)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and split > 1


def test_no_blocks_no_chunks(spark, tmp_path):
    blocks = spark.createDataFrame([], "s string, k long, n long")
    assert G.rebatched(blocks, f"file://{tmp_path}", "s", ["k"], "n", 30, 45).collect() == []


@pytest.mark.parametrize("rate", [8_000, 16_000, 22_050, 44_100, 48_000])
def test_blocks_are_resampled_like_the_whole(spark, rate):
    rng = np.random.default_rng(rate)
    signals = {s: rng.normal(size=n) for s, n in ((1, 1000), (2, 257), (None, 90))}
    df = spark.createDataFrame([(s, x.tolist()) for s, x in signals.items()], "s int, x array<double>")
    got = {}
    for r in G.resampled(G.as_blocks(df, "s", "x", 100), "s", "block", "x", 100, rate).collect():
        got.setdefault(r.s, {})[r.block] = r.x
    for s, x in signals.items():
        ratio = 16_000 / rate
        whole = G.resample_array(x, *G.Fraction(16_000, rate).as_integer_ratio())
        assert len(whole) == int(np.ceil(len(x) * ratio - 1e-9))
        np.testing.assert_allclose(np.concatenate([got[s][b] for b in sorted(got[s])]), whole, atol=1e-12)


def test_resampling_keeps_tones_and_drops_what_is_too_high():
    at = lambda rate: np.arange(rate) / rate
    for rate in (8_000, 44_100):
        up, down = G.Fraction(16_000, rate).as_integer_ratio()
        low = G.resample_array(np.sin(2 * np.pi * 440 * at(rate)), up, down)
        np.testing.assert_allclose(low[500:-500], np.sin(2 * np.pi * 440 * at(16_000))[500:-500], atol=5e-3)
    high = G.resample_array(np.sin(2 * np.pi * 12_000 * at(44_100)), 160, 441)
    assert np.abs(high[500:-500]).max() < 5e-3


def test_missing_and_null_samples_are_silence(spark):
    df = spark.createDataFrame([(1, 0, [1.0] * 100), (1, 2, [None, 1.0] * 50), (1, None, [1.0])], "s int, b long, x array<double>")
    got = {r.b: r.x for r in G.resampled(df, "s", "b", "x", 100, 8_000).collect()}
    line = np.concatenate([np.ones(100), np.zeros(100), np.tile([0.0, 1.0], 50)])
    whole = G.resample_array(line, 2, 1)
    assert got.keys() == {0, 2}
    np.testing.assert_allclose(got[0] + got[2], np.concatenate([whole[:200], whole[400:]]), atol=1e-12)
    with pytest.raises(ValueError):
        G.resampled(df, "s", "b", "x", 10, 44_100)


def test_wav_files_at_sixteen_kilohertz(spark, tmp_path):
    held = io.BytesIO()
    with wave.open(held, "wb") as w:
        w.setparams((2, 2, 44_100, 0, "NONE", ""))
        w.writeframes(np.repeat((np.sin(np.arange(5000) / 20) * 9000).astype("<i2"), 2).tobytes())
    (tmp_path / "a.wav").write_bytes(held.getvalue())
    read = files.read_wav(spark, str(tmp_path))
    mono = np.array(read.first().samples)
    rows = G.resampled(G.as_blocks(read, "path", "samples", 512), "path", "block", "samples", 512, read.first().rate).orderBy("block").collect()
    np.testing.assert_allclose(np.concatenate([r.samples for r in rows]), G.resample_array(mono, 160, 441), atol=1e-6)


def test_weights_are_evened_out(spark):
    rng = random.Random(1)
    cases = [[rng.choice([0.0, rng.random(), 3 * rng.random()]) for _ in range(rng.randrange(1, 9))] for _ in range(200)] + [[], [0.0, 0.0], [0.2], [5.0]]
    df = spark.createDataFrame([(k, x, float(round(sum(x)))) for k, x in enumerate(cases)], "k int, x array<double>, target double")
    got = {r.k: r.y for r in df.select("k", G.rescaled(F.col("x"), F.col("target")).alias("y")).collect()}
    for k, x in enumerate(cases):
        own = [v * round(sum(x)) / sum(x) for v in x] if sum(x) else x
        for _ in range(10):
            for i in [i for i, v in enumerate(own) if v > 0.999]:
                if own[i] >= 0.999:
                    mean = 0.5 * sum(own) / sum(v != 0 for v in own)
                    own = [v * 0.5 + mean * (v != 0) for v in own]
        np.testing.assert_allclose(got[k], own, atol=1e-9)
