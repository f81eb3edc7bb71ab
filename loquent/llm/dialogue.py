"""Repair of conversations by the cheapest edits: keep, rerole, delete, insert.

A repaired conversation is empty, or an optional system turn and then user and assistant in turn. Rows become symbols of
role and fault; equal neighbours are one run. Costs to go are a vector over four states, and a run of n rows advances it
by the min-plus powers 1, 2, 4, ... of its symbol's transition. Then choices are unrolled from the front, the least letter
first, which gives the least of the cheapest audits.

Runs are collapsed where rows lie after a sort by range, so before anything is dealt by conversation. Of a conversation
a task holds its runs and its audit (which is one value of the result); texts stream through it row by row.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loquent.llm.scratch import Scratch

_SPACE, _ENDS = " \t\n\x0b\x0c\r", ".!?"
#: States: nothing yet, after system, after user, after assistant. A symbol is 4 * initial + fault.
_INITIALS, (_NONE, _BLANK, _DUPLICATE, _TRUNCATED) = "sua", range(4)
#: Of each state the one that an inserted or changed role leads to, and what it costs to end there.
_NEXT, _END = (2, 2, 3, 2), (0, 10, 5, 0)
_KEPT = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}
INSERT, DELETE, REROLE, LEFT_TRUNCATED = 5, 2, 1, 5
Vector = tuple[int, int, int, int]


def _row(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """What may be done with a row in a state: letter (ascending), next state, cost."""
    initial, fault = divmod(symbol, 4)
    out = [("D", state, DELETE)]
    if fault in (_NONE, _TRUNCATED):
        more = LEFT_TRUNCATED if fault == _TRUNCATED else 0
        if state in _KEPT[initial]:
            out.append(("K", _KEPT[initial][state], more))
        out.append(("R", _NEXT[state], REROLE + more))
    return out


@lru_cache(None)
def _power(symbol: int, k: int) -> tuple[Vector, ...]:
    """The transition of 2**k rows of a symbol, insertions before each row included."""
    if k:
        half = _power(symbol, k - 1)
        return tuple(tuple(min(half[a][m] + half[m][b] for m in range(4)) for b in range(4)) for a in range(4))
    far = 1 << 40
    out = []
    for state in range(4):
        best, at, spent = [far] * 4, state, 0
        for _ in range(4):
            for _, to, cost in _row(symbol, at):
                best[to] = min(best[to], spent + cost)
            at, spent = _NEXT[at], spent + INSERT
        out.append(tuple(best))
    return tuple(out)


@lru_cache(1 << 16)
def _advance(symbol: int, n: int, ahead: Vector) -> tuple[Vector, int]:
    """Costs to go before n rows from those after them, as differences from the least, and that least."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            ahead = tuple(min(a + b for a, b in zip(row, ahead, strict=True)) for row in _power(symbol, k))
    least = min(ahead)
    return tuple(x - least for x in ahead), least


@lru_cache(1 << 16)
def _unroll(symbol: int, n: int, state: int, ahead: Vector) -> tuple[str, int]:
    """The letters for n rows of a symbol, and the state after them."""
    if n > 1:
        half = n // 2
        middle, _ = _advance(symbol, n - half, ahead)
        first, state = _unroll(symbol, half, state, middle) if half <= 64 else _unroll.__wrapped__(symbol, half, state, middle)
        second, state = _unroll(symbol, n - half, state, ahead) if n - half <= 64 else _unroll.__wrapped__(symbol, n - half, state, ahead)
        return first + second, state
    here, least = _advance(symbol, 1, ahead)
    letters = ""
    while True:
        choices = [(letter, to, cost + ahead[to]) for letter, to, cost in _row(symbol, state)]
        choices.append(("I", _NEXT[state], INSERT + here[_NEXT[state]] + least))
        letter, to = min((letter, to) for letter, to, cost in choices if cost == here[state] + least)
        letters, state = letters + letter, to
        if letter != "I":
            return letters, state


def audit(symbols: array, counts: array) -> tuple[int, str]:
    """The least cost of repairing the runs, and the least audit of that cost."""
    ahead: list[Vector] = [_END]
    cost = 0
    for symbol, n in zip(reversed(symbols), reversed(counts), strict=True):
        found, least = _advance(symbol, n, ahead[-1])
        ahead.append(found)
        cost += least
    cost += ahead.pop()[0]
    letters, state = [], 0
    for symbol, n in zip(symbols, counts, strict=True):
        after = ahead.pop()
        some, state = _unroll(symbol, n, state, after) if n <= 64 else _unroll.__wrapped__(symbol, n, state, after)
        letters.append(some)
    return cost, "".join(letters) + "I" * (_END[state] // INSERT)


def counted(symbols: array, counts: array) -> tuple[int, int, int, int]:
    """Rows blank, duplicate and truncated, and neighbours whose roles may not follow each other."""
    faults, illegal, before = [0] * 4, 0, None
    for symbol, n in zip(symbols, counts, strict=True):
        initial, fault = divmod(symbol, 4)
        faults[fault] += n
        illegal += n - 1 + (before is not None and (before, initial) not in ((0, 1), (1, 2), (2, 1)))
        before = initial
    return faults[_BLANK], faults[_DUPLICATE], faults[_TRUNCATED], illegal


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with the faults that a repair must find, by a checksum of conversation and turn: rows dropped, emptied,
    without ends of sentences, repeated or given to the user. Nulls of the checksum, role and text count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    role = F.when(kind == 4, "user").otherwise(said("role"))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), _ENDS, "")).otherwise(said("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    return rows.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _fault() -> tuple[Column, Column]:
    """Whether a text is blank, and whether its last character that is no space ends no sentence."""
    held = F.rtrim(F.col("text"), F.lit(_SPACE))
    return held == "", ~F.right(held, F.lit(1)).isin(*_ENDS)


class Repair:
    """Cheapest repairs of all conversations of `rows` (conv_id, turn, role, text).

    Rows of a conversation are taken by turn, nulls first; equal turns by role and then by a digest of the row, so that
    equal rows are neighbours. A row's first fault counts: blank, duplicate (its role and text stood earlier in the
    conversation), truncated. Null roles and texts count as empty. Null conv_id is a conversation of its own. An empty
    table gives empty ones. Other columns are not read.
    """

    def __init__(self, spark: SparkSession, rows: DataFrame):
        self.spark, self.scratch = spark, Scratch(spark)
        empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        blank, cut = _fault()
        told = rows.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
        told = told.withColumn("same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
        keys = ["conv_id", "turn", "role", "same"]
        # Written once: ids and order stay if an executor is lost.
        told = told.withColumn("blank", blank).withColumn("cut", cut).repartitionByRange(*keys).sortWithinPartitions(*keys)
        self.rows = self.scratch.table(told.withColumn("id", F.monotonically_increasing_id()), "rows")
        self.audits = self.scratch.table(self._audits(), "audits")

    def gaps(self) -> DataFrame:
        """conv_id and the turns missing between its least and greatest one."""
        turns = self.rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
        missing = F.max("turn") - F.min("turn") + 1 - F.count("turn")
        return turns.groupBy("conv_id").agg(F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"))

    def _audits(self) -> DataFrame:
        """conv_id, blank, duplicate, truncated, illegal, cost, audit."""
        slim = self.rows.select("conv_id", "id", "same", "blank", "cut", F.substring("role", 1, 1).alias("initial"))
        # Where a message stands more than once in a conversation, its first place; counted before the shuffle.
        first = slim.groupBy("conv_id", "same").agg(F.min("id").alias("first"), F.count("*").alias("many")).filter("many > 1")
        first = first.select(F.col("conv_id").alias("own_conv"), F.col("same").alias("own_same"), "first")
        seen = slim.join(first, F.col("conv_id").eqNullSafe(F.col("own_conv")) & (F.col("same") == F.col("own_same")), "left")
        fault = F.when(F.col("blank"), _BLANK).when(F.col("id") > F.col("first"), _DUPLICATE).when(F.col("cut"), _TRUNCATED).otherwise(_NONE)
        initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
        kind = self.rows.schema["conv_id"].dataType.simpleString()
        rows = seen.select("conv_id", "id", (initial * 4 + fault).cast("byte").alias("symbol")).repartitionByRange("id").sortWithinPartitions("id")
        runs = rows.mapInArrow(_runs, f"conv_id {kind}, id long, symbol byte, many long")
        dealt = runs.repartition("conv_id").sortWithinPartitions("conv_id", "id")
        return dealt.mapInArrow(_conversations, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string")

    def repaired(self) -> DataFrame:
        """The rows after the edits: conv_id, place (from 0), role, text. Partitions hold whole conversations in order."""
        kind = self.rows.schema["conv_id"].dataType.simpleString()
        none = F.lit(None).cast("string")
        heads = self.audits.select("conv_id", F.lit(-1).cast("long").alias("id"), none.alias("role"), F.col("audit").alias("text"))
        both = heads.unionByName(self.rows.select("conv_id", "id", "role", "text"))
        return both.repartition("conv_id").sortWithinPartitions("conv_id", "id").mapInArrow(_edited, f"conv_id {kind}, place long, role string, text string")

    def digests(self) -> DataFrame:
        """conv_id and repaired_sha256 of its rows `role:text`, joined by line breaks. A digest is made in order by its
        nature: texts stream through one task, none is held."""
        kind = self.rows.schema["conv_id"].dataType.simpleString()
        return self.repaired().mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal symbols of a conversation inside one partition."""
    for batch in batches:
        out: list[list] = []
        for conv, row, symbol in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out and out[-1][0] == conv and out[-1][2] == symbol:
                out[-1][3] += 1
            else:
                out.append([conv, row, symbol, 1])
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int8()), pa.array(columns[3], pa.int64())], ["conv_id", "id", "symbol", "many"])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit of each conversation from its runs in order; runs that meet where partitions did are joined."""
    symbols, counts = array("b"), array("q")
    own, begun, kind, out = None, False, None, []
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def done() -> tuple:
        return (own, *counted(symbols, counts), *audit(symbols, counts))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 5, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, symbol, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if begun and conv != own:
                out.append(done())
                symbols, counts = array("b"), array("q")
            own, begun = conv, True
            if symbols and symbols[-1] == symbol:
                counts[-1] += n
            else:
                symbols.append(symbol)
                counts.append(n)
        if out:
            yield batch_of(out)
            out = []
    if begun:
        yield batch_of([done()])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows after the edits of their conversation's audit, which comes before them."""
    own, letters, at, state, place, kind, begun = None, "", 0, 0, 0, None, False
    out: list[tuple] = []

    def add(role: str, text: str) -> None:
        nonlocal place
        out.append((own, place, role, text))
        place += 1

    def insert() -> None:
        nonlocal at, state
        while letters[at : at + 1] == "I":
            state = _NEXT[state]
            add("user" if state == 2 else "assistant", "")
            at += 1

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (kind, pa.int64(), pa.string(), pa.string()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "place", "role", "text"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, row, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row < 0:
                if begun:
                    insert()
                own, letters, at, state, place, begun = conv, text, 0, 0, 0, True
                continue
            insert()
            letter = letters[at]
            at += 1
            if letter == "R":
                state = _NEXT[state]
                add("user" if state == 2 else "assistant", text)
            elif letter == "K":
                state = _KEPT[_INITIALS.index(role[0])][state]
                add(role, text)
        if out:
            yield flush()
    if begun:
        insert()
    if out:
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, state, kind, out = None, None, None, []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.string())], ["conv_id", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place == 0:
                if state is not None:
                    out.append((own, state.hexdigest()))
                own, state = conv, hashlib.sha256()
            state.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if out:
            yield flush()
    if state is not None:
        out.append((own, state.hexdigest()))
        yield flush()


def repair(rows: DataFrame, all_rows: DataFrame, spark: SparkSession) -> DataFrame:
    """One row for each conversation of `all_rows`: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256; zeros, an empty audit and the digest of nothing for those without rows in `rows`."""
    own = Repair(spark, rows)
    out = all_rows.select("conv_id").distinct()
    for part in (own.gaps(), own.audits, own.digests()):
        part = part.withColumnRenamed("conv_id", "own_conv")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("own_conv")), "left").drop("own_conv")
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    told = out.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in zero), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return own.scratch.finish(told)
