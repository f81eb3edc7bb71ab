"""Blocks of a signal: cutting into chunks with a byte cap, and another sample rate.

Both take a stream of any length apart: rows lie sorted by range, and what a task must know of those before it is small.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


# Chunks


def carried(carry: int, size: int, least: int, most: int) -> int:
    """Bytes left over after a block of `size` came to `carry` bytes: all if there are too few, else what is beyond `most`."""
    held = carry + size
    return held if held < least else max(0, held - most)


class Carry:
    """What a run of blocks makes of any carry from 0 to `top`: pieces that begin at `lows`, each a shift of the carry or one
    value. Blocks are added one by one; pieces that have become alike are joined, and most soon are, as carries end in 0."""

    def __init__(self, top: int):
        self.top, self.lows, self.shifts, self.values = top, [0], [True], [0]

    def add(self, size: int, least: int, most: int) -> None:
        lows, shifts, values = [], [], []

        def put(low: int, shift: bool, value: int) -> None:
            if not shifts or (shifts[-1], values[-1]) != (shift, value):
                lows.append(low)
                shifts.append(shift)
                values.append(value)

        ends = [*self.lows[1:], self.top + 1]
        for low, end, shift, value in zip(self.lows, ends, self.shifts, self.values, strict=True):
            if not shift:
                put(low, False, carried(value, size, least, most))
                continue
            gain = value + size
            for begin, stop, moves, moved in ((low, least - gain, True, gain), (max(low, least - gain), most + 1 - gain, False, 0), (max(low, most + 1 - gain), end, True, gain - most)):
                if begin < min(stop, end):
                    put(begin, moves, moved)
        self.lows, self.shifts, self.values = lows, shifts, values

    def __call__(self, carry: int) -> int:
        k = bisect_right(self.lows, carry) - 1
        return carry + self.values[k] if self.shifts[k] else self.values[k]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of (part, stream, ..., size) as runs of one part and stream."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=lambda row: row[:2])


def rebatched(blocks: DataFrame, folder: str, stream: str, order: Sequence[str], size: str, least: int, most: int) -> DataFrame:
    """Chunks cut from the blocks of each stream as they come (A4): stream, `order` of the block that completes the chunk,
    start (bytes of the stream before it) and bytes.

    Blocks add up; once `least` bytes are held, at most `most` of them are a chunk and the rest is carried over. What is
    held at the end is no chunk. Null sizes count as 0, a null stream is a stream of its own; blocks equal in `order` go by
    size. `folder` is one that all executors share.

    A stream is split over tasks. Each run of blocks in a partition tells its bytes and how much its carry may grow; that
    bounds the carry it may begin with. Then it tells what it makes of any such carry (`Carry`); composed from run to run,
    that gives the carry each really begins with, and runs are cut side by side.
    """
    spark, inner = blocks.sparkSession, [f"order_{k}" for k in range(len(order))]
    kind, keys = blocks.schema[stream].dataType.simpleString(), ["stream", *inner, "size"]
    rows = blocks.select(F.col(stream).alias("stream"), *(F.col(c).alias(k) for c, k in zip(order, inner, strict=True)), F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("size"))
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{folder}/blocks")
    own = StructType([*rows.schema.fields, *StructType.fromDDL("id long").fields])
    laid = spark.read.schema(own).parquet(f"{folder}/blocks").select(F.shiftright("id", 33).alias("part"), *keys, "id")

    def dealt(names: Sequence[str], more: DataFrame | None = None) -> DataFrame:
        """Partitions as they were written, in order; `more` comes first in its run."""
        both = laid.select("part", "stream", *names, "id", "size") if more is None else laid.withColumn("top", F.lit(None).cast("long")).withColumn("sent", F.lit(None).cast("long")).select("part", "stream", *names, "id", "size", "top", "sent").unionByName(more, True)
        return both.repartition("part").sortWithinPartitions("part", "stream", "id")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (part, name), run in _runs(batches):
            total = growth = best = 0
            for *_, n in run:
                total += n
                growth += n - most
                best = max(best + n - most, 0)
            out.append((part, name, total, growth, best))
        if out:
            yield _batch(out, told_schema)

    told_schema = StructType.fromDDL(f"part long, stream {kind}, total long, growth long, best long")
    told = dealt([]).mapInArrow(tell, told_schema)

    def tops(rows: pd.DataFrame) -> pd.DataFrame:
        rows, top, sent = rows.sort_values("part"), 0, 0
        out = []
        for part, total, growth, best in zip(rows["part"], rows["total"], rows["growth"], rows["best"], strict=True):
            out.append((top, sent))
            top, sent = max(least - 1 + best, top + growth), sent + total
        rows["top"], rows["sent"] = zip(*out, strict=True)
        return rows[["part", "stream", "top", "sent"]]

    # As many rows a stream as partitions that hold some of it.
    bounds = told.groupBy("stream").applyInPandas(tops, f"part long, stream {kind}, top long, sent long")
    bounds.write.mode("overwrite").parquet(f"{folder}/bounds")
    bounds = spark.read.schema(bounds.schema).parquet(f"{folder}/bounds").withColumn("id", F.lit(-1).cast("long"))

    def map_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (part, name), run in _runs(batches):
            head = next(run)
            made = Carry(head[-2])
            for row in run:
                made.add(row[3], least, most)
            out.append((part, name, head[-1], made.lows, made.shifts, made.values))
        if out:
            yield _batch(out, maps_schema)

    maps_schema = StructType.fromDDL(f"part long, stream {kind}, sent long, lows array<long>, shifts array<boolean>, moved array<long>")
    maps = dealt([], bounds).mapInArrow(map_runs, maps_schema)

    def carries(rows: pd.DataFrame) -> pd.DataFrame:
        rows, carry, out = rows.sort_values("part"), 0, []
        for lows, shifts, values in zip(rows["lows"], rows["shifts"], rows["moved"], strict=True):
            out.append(carry)
            made = Carry(0)
            made.lows, made.shifts, made.values = list(lows), list(shifts), list(values)
            carry = int(made(carry))
        rows["top"] = out
        return rows[["part", "stream", "top", "sent"]]

    begins = maps.groupBy("stream").applyInPandas(carries, f"part long, stream {kind}, top long, sent long")
    begins.write.mode("overwrite").parquet(f"{folder}/begins")
    begins = spark.read.schema(begins.schema).parquet(f"{folder}/begins").withColumn("id", F.lit(-1).cast("long"))
    width = len(order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (_, name), run in _runs(batches):
            head = next(run)
            carry, sent = head[-2], head[-1] - head[-2]
            for row in run:
                held = carry + row[3 + width]
                if held >= least:
                    out.append((name, *row[2 : 2 + width], sent, min(held, most)))
                    sent += min(held, most)
                carry = carried(carry, row[3 + width], least, most)
                if len(out) >= 10_000:
                    yield _batch(out, cut_schema)
                    out = []
        if out:
            yield _batch(out, cut_schema)

    cut_schema = StructType([StructField(stream, blocks.schema[stream].dataType), *(StructField(c, blocks.schema[c].dataType) for c in order), *StructType.fromDDL("start long, bytes long").fields])
    return dealt(inner, begins).mapInArrow(cut, cut_schema)


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


# Sample rates


def filter_bank(up: int, down: int, zeros: int = 16) -> np.ndarray:
    """Weights of 2 * reach neighbours for each of `up` phases: a windowed sinc below the lower rate's half."""
    cutoff = min(1.0, up / down)
    reach = math.ceil(zeros / cutoff)
    distance = np.arange(up)[:, None] / up - (np.arange(2 * reach)[None] - reach + 1)
    return cutoff * np.sinc(cutoff * distance) * np.where(np.abs(distance) < reach, np.cos(np.pi * distance / (2 * reach)) ** 2, 0)


def resample_array(samples: np.ndarray, up: int, down: int, begin: int = 0, before: np.ndarray | None = None, after: np.ndarray | None = None, zeros: int = 16) -> np.ndarray:
    """Samples at `up` / `down` of the rate for the stretch that begins at sample `begin`; beyond what is given is silence."""
    bank = filter_bank(up, down, zeros)
    reach = bank.shape[1] // 2
    sides = [np.zeros(reach), np.asarray(samples, float), np.zeros(reach)]
    if before is not None and len(before):
        sides[0][-len(before) :] = before
    if after is not None and len(after):
        sides[2][: len(after)] = after
    line = np.concatenate(sides)
    first, last = -(-begin * up // down), -(-(begin + len(samples)) * up // down)
    at = np.arange(first, last, dtype=np.int64) * down
    base, phase = at // up - begin, at % up
    near = line[(base + 1)[:, None] + np.arange(2 * reach)[None]]
    return np.einsum("ij,ij->i", near, bank[phase])


def resampled(blocks: DataFrame, stream: str, block: str, samples: str, size: int, rate: int, to: int = 16_000) -> DataFrame:
    """Blocks of a signal of `rate` samples a second at the rate `to`: stream, block, and samples as array<double>.

    Block b holds samples b * size to (b + 1) * size of its stream; a missing one is silence, as are nulls, and one that is
    shorter ends in silence, save that the last output samples are those up to its own end. A block gets the edges of its
    two neighbours, as rows of their own that meet it by key, so a long stream is spread over all tasks. Blocks must be at
    least as long as the filter reaches (ValueError). Each block number may stand once in a stream.
    """
    ratio = Fraction(to, rate)
    up, down = ratio.numerator, ratio.denominator
    reach = filter_bank(up, down).shape[1] // 2
    if size < reach:
        raise ValueError(f"blocks of {size} samples are shorter than the filter's reach of {reach}")
    some = F.transform(F.coalesce(F.col(samples), F.array()), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    rows = blocks.filter(F.col(block).isNotNull()).select(F.col(stream).alias("stream"), F.col(block).cast("long").alias("block"), some.alias("samples"))
    # Shorter blocks are filled up for those after them.
    whole = F.concat("samples", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("samples")))
    tail, head = F.slice(whole, size - reach + 1, reach), F.slice(F.col("samples"), 1, reach)
    pieces = F.explode(F.array(
        F.struct(F.col("block").alias("to"), F.lit(1).alias("side"), F.col("samples").alias("x")),
        F.struct((F.col("block") + 1).alias("to"), F.lit(0).alias("side"), tail.alias("x")),
        F.struct((F.col("block") - 1).alias("to"), F.lit(2).alias("side"), head.alias("x")),
    ))
    side = lambda k: F.first(F.when(F.col("p.side") == k, F.col("p.x")), True).alias(f"x{k}")
    met = rows.select("stream", pieces.alias("p")).groupBy("stream", F.col("p.to").alias("block")).agg(side(0), side(1), side(2)).filter("x1 is not null")
    schema = StructType([StructField(stream, blocks.schema[stream].dataType), *StructType.fromDDL(f"{block} long").fields, StructField(samples, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [resample_array(np.array(x), up, down, b * size, np.array(before or []), np.array(after or [])) for b, before, x, after in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([y.tolist() for y in out], pa.list_(pa.float64()))], schema.names)

    return met.select("stream", "block", "x0", "x1", "x2").mapInArrow(run, schema)


def as_blocks(signals: DataFrame, stream: str, samples: str, size: int) -> DataFrame:
    """Whole signals, such as those of WAV files, in blocks: stream, block, samples."""
    many = F.ceil(F.size(samples) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), lambda i: F.slice(F.col(samples), i * size + 1, size))
    return signals.filter(F.size(samples) > 0).select(stream, F.posexplode(cut).alias("block", samples))


# Weights


def rescaled(alphas: Column, target: Column, threshold: float = 0.999, rounds: int = 10) -> Column:
    """Weights scaled to the sum `target`, and those above `threshold` evened out.

    In a round every place that was above the threshold at its begin, and still is at it when its turn comes, halves all
    weights and adds half their mean over those that are not 0. There are at most `rounds` rounds, as many as are needed.
    Null stays null; weights whose sum is 0 stay as they are.
    """
    limit = F.lit(float(threshold))
    add = lambda x: F.aggregate(x, F.lit(0.0).cast("double"), lambda a, v: a + v)
    sum_of = add(alphas)
    scaled = F.when(sum_of == 0, alphas).otherwise(F.transform(alphas, lambda v: v * (target / sum_of)))

    def even(x: Column) -> Column:
        mean = F.lit(0.5) * add(x) / F.size(F.filter(x, lambda v: v != 0))
        return F.transform(x, lambda v: F.when(v != 0, v * F.lit(0.5) + mean).otherwise(v * F.lit(0.5)))

    def one(x: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: F.element_at(x, i) > limit)
        return F.aggregate(places, x, lambda own, i: F.when(F.element_at(own, i) >= limit, even(own)).otherwise(own))

    return F.when(F.size(alphas) == 0, alphas).otherwise(F.aggregate(F.array_repeat(F.lit(0), rounds), scaled, lambda x, _: one(x)))
