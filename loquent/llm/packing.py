"""Best-fit packing of token sequences by linear grouping.

Lengths are whole numbers up to the sequence size, so the plan works on counts by length: a table of at most `size`
entries, whatever the number of documents. Large lengths are split into groups of equal cardinality and rounded up to
the largest of their group. A linear program over configurations (which groups fill one sequence), solved by column
generation, gives how often each configuration is used. Actual lengths take the places of the rounded ones, the last
place best-fit, and what that leaves is grouped and solved again; small ones are fitted last. The plan is a list of
patterns (lengths in order, number of sequences); each piece finds its place from its rank among those of its length.

Defined results: a null text counts as empty and has the end id alone; repeated rows are packed each; a document
longer than a sequence is cut, its first piece taking what is left over; an empty table gives no sequence.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loquent.llm import textbuf as tb
from loquent.llm.scratch import Scratch
from loquent.llm.tokens import encoder

SIZE = 2048
#: Lengths over SIZE / LARGE are grouped; the others are fitted last. At most so many programs are solved one after the other.
LARGE = 5
GROUPS = 32
PROGRAMS, CARRIED = 12, 0.8
#: Pieces of one length are ranked in shares of about so many rows.
SHARE = 1000


def configurations(sizes: list[int], need: list[int], size: int, rounds: int = 600) -> list[tuple[tuple[int, ...], float]]:
    """Configurations (how many of each size) and how often each is used in the linear program's solution."""
    m = len(sizes)
    basis = np.diag([float(size // s) for s in sizes])
    x = np.array(need, float) / np.diag(basis)
    widths = np.array(sizes)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(m))
        # The configuration of most worth by unbounded knapsack over the room used.
        worth, took = np.zeros(size + 1), np.full(size + 1, -1)
        for room in range(widths.min(), size + 1):
            fits = widths <= room
            values = np.where(fits, worth[np.maximum(room - widths, 0)] + prices, -np.inf)
            best = int(values.argmax())
            if values[best] > worth[room - 1] + 1e-12:
                worth[room], took[room] = values[best], best
            else:
                worth[room] = worth[room - 1]
        if worth[size] <= 1 + 1e-7:
            break
        column, room = np.zeros(m), size
        while room > 0:
            if took[room] < 0:
                room -= 1
            else:
                column[took[room]] += 1
                room -= sizes[took[room]]
        change = np.linalg.solve(basis, column)
        up = change > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, change, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * change, 0)
        x[out] = step
        basis[:, out] = column
    return [(tuple(int(round(v)) for v in basis[:, k]), float(x[k])) for k in range(m) if x[k] > 1e-9]


class _Bins:
    """Sequences as patterns (lengths so far, count), found by their room."""

    def __init__(self, size: int):
        self.size, self.by_room, self.rooms = size, {}, []

    def add(self, pattern: tuple[int, ...], count: int) -> None:
        if count:
            room = self.size - sum(pattern)
            own = self.by_room.get(room)
            if own is None:
                own = self.by_room[room] = {}
                insort(self.rooms, room)
            own[pattern] = own.get(pattern, 0) + count

    def best_fit(self, length: int, count: int) -> None:
        """Put `count` pieces one by one where least room is left over, in new sequences if need be."""
        while count:
            k = bisect_left(self.rooms, length)
            if k == len(self.rooms):
                per = self.size // length
                self.add((length,) * per, count // per)
                self.add((length,) * (count % per), 1 if count % per else 0)
                return
            room = self.rooms[k]
            own = self.by_room[room]
            pattern, there = own.popitem()
            if not own:
                del self.by_room[room]
                self.rooms.pop(k)
            per = max(1, min(room // length, count // there if count >= there else 1))
            used = min(there, count // per)
            self.add(pattern, there - used)
            self.add(pattern + (length,) * per, used)
            count -= used * per

    def patterns(self) -> list[tuple[tuple[int, ...], int]]:
        return sorted((p, c) for own in self.by_room.values() for p, c in own.items())


def _grouped(left: dict[int, int], large: list[int], groups: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Groups of equal cardinality over descending lengths: each one's largest length and how many there are, and the group
    of each length."""
    total, seen, last = sum(left[n] for n in large), 0, None
    sizes: list[int] = []
    need: list[int] = []
    group: dict[int, int] = {}
    for n in large:
        own = min(groups - 1, seen * groups // total)
        if own != last:
            sizes.append(n)
            need.append(0)
            last = own
        group[n] = len(sizes) - 1
        need[-1] += left[n]
        seen += left[n]
    return sizes, need, group


def _substituted(config: list[int], times: int, members: list[list[int]], ascending: list[int], left: dict[int, int], size: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Actual lengths in the places of a configuration, with how often: the largest of each group, and in the last place
    the largest at all that fits, which takes up what rounding left over."""
    while times > 0:
        taken: dict[int, int] = {}
        for k in config[:-1]:
            while members[k] and not left[members[k][0]]:
                members[k].pop(0)
            own = next((n for n in members[k] if left[n] > taken.get(n, 0)), None)
            if own is None:
                return
            taken[own] = taken.get(own, 0) + 1
        at = bisect_right(ascending, size - sum(n * c for n, c in taken.items())) - 1
        while at >= 0 and left[ascending[at]] <= taken.get(ascending[at], 0):
            if not left[ascending[at]]:
                ascending.pop(at)
            at -= 1
        if at < 0:
            return
        taken[ascending[at]] = taken.get(ascending[at], 0) + 1
        run = min(times, *(left[n] // c for n, c in taken.items()))
        for n, c in taken.items():
            left[n] -= c * run
        yield tuple(sorted((n for n, c in taken.items() for _ in range(c)), reverse=True)), run
        times -= run


def plan(counts: dict[int, int], size: int = SIZE, groups: int = GROUPS, report: dict | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a sequence, number of such sequences) that hold exactly `counts` pieces of each length.

    As last places take larger lengths than the program foresaw, a share CARRIED of each configuration's uses is carried out, and
    what is left is grouped and solved again. `report`, if given, is told the first program's number of sequences for the
    rounded lengths, how many programs were solved, the share of large pieces that configurations place, and the share of
    sequences that were broken up and fitted again at the end.
    """
    report = {} if report is None else report
    left = {n: c for n, c in counts.items() if c}
    bins = _Bins(size)
    bins.add((size,), left.pop(size, 0))
    total = sum(c for n, c in left.items() if n * LARGE > size)
    report |= {"program": 0.0, "programs": 0, "placed": 1.0, "refitted": 0.0}
    placed = 0
    while large := sorted((n for n, c in left.items() if c and n * LARGE > size), reverse=True):
        sizes, need, group = _grouped(left, large, groups)
        solution = configurations(sizes, need, size)
        report["program"] = report["program"] or sum(times for _, times in solution)
        report["programs"] += 1
        last = report["programs"] == PROGRAMS or sum(need) <= 2 * len(sizes)
        members: list[list[int]] = [[] for _ in sizes]
        for n in large:
            members[group[n]].append(n)
        ascending, now = large[::-1], placed
        for config, times in sorted(solution, key=lambda c: -c[1]):
            places = [k for k, c in enumerate(config) for _ in range(c)]
            for pattern, run in _substituted(places, int(times) if last else math.ceil(times * CARRIED), members, ascending, left, size):
                bins.add(pattern, run)
                placed += run * len(pattern)
        if last or placed == now:
            break
    report["placed"] = placed / total if total else 1.0
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        bins.best_fit(n, left[n])
    return _tightened(bins.patterns(), size, report)


def _tightened(patterns: list[tuple[tuple[int, ...], int]], size: int, report: dict) -> list[tuple[tuple[int, ...], int]]:
    """Break up the emptiest sequences and as many of those with the most short pieces, a tenth of all at most, and fit
    their pieces again, largest first, where that saves sequences."""
    total = sum(c for _, c in patterns)
    for part in (0.01, 0.02, 0.05):
        emptiest = sorted((p for p in patterns if sum(p[0]) < size), key=lambda p: sum(p[0]))
        finest = sorted(patterns, key=lambda p: -sum(n * LARGE <= size for n in p[0]))
        rest, loose, bins, broken = dict(patterns), {}, _Bins(size), 0
        for order in (emptiest, finest):
            budget = int(part * total)
            for pattern, _ in order:
                use = min(rest[pattern], budget)
                budget -= use
                broken += use
                rest[pattern] -= use
                for n in pattern if use else ():
                    loose[n] = loose.get(n, 0) + use
        for pattern, count in rest.items():
            bins.add(pattern, count)
        for n in sorted(loose, reverse=True):
            bins.best_fit(n, loose[n])
        if (now := sum(c for _, c in bins.patterns())) < total:
            report["refitted"] = max(report["refitted"], broken / total)
            patterns, total = bins.patterns(), now
    return patterns


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """doc_id, row (a number of the input row), piece, start, length, ids_crc32 of every piece; no ids are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in tb.slices(batches):
            doc, row, piece, start, length, crc = [], [], [], [], [], []
            for d, r, ids in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), enc.ids(batch.column("text").to_pylist()), strict=True):
                n, view = len(ids) // 4, memoryview(ids)
                cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    doc.append(d)
                    row.append(r)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(view[a * 4 : b * 4]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((doc, row, piece, start, length, crc), kinds, strict=True)], names)

    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return numbered.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, spark: SparkSession, path: str, size: int = SIZE) -> DataFrame:
    """The pieces with sequence_id and offset. Texts are read once and not shuffled; only piece rows are."""
    scratch = Scratch(spark)
    cut = scratch.table(pieces(docs, path, size), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    ranges, sequence = [], 0
    at: dict[int, int] = {}
    for pattern, copies in plan(counts, size):
        offset = 0
        for n, many in ((n, pattern.count(n)) for n in sorted(set(pattern), reverse=True)):
            ranges.append((n, at.get(n, 0), many, sequence, offset))
            at[n] = at.get(n, 0) + many * copies
            offset += n * many
        sequence += copies
    # Sorted arrays by length of where ranks of that length go. A row for each length of a pattern: patterns come from
    # counts by length, so the table does not grow with the pieces once all lengths occur.
    table = np.array(sorted(ranges), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)

    # Rank of a piece among those of its length: shares of a length are ranked apart, then shifted by the shares before.
    shares = spark.createDataFrame([(n, -(-c // SHARE)) for n, c in counts.items()], "length long, shares long")  # at most `size` rows
    salted = cut.join(F.broadcast(shares), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "piece"), "shares")).drop("shares")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "row")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = salted.withColumn("nth", F.row_number().over(order) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("nth") + F.col("base")).drop("nth", "base", "salt", "row")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            inner = rank - row[:, 1]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(row[:, 3] + inner // row[:, 2]), pa.array(row[:, 4] + inner % row[:, 2] * length)], [*names, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return scratch.finish(ranked.select(*columns, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
