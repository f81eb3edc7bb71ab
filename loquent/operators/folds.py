"""Order-dependent operators as folds: rows are dealt by key, sorted, and streamed through a state machine.

A partition holds many keys, and of a key only the machine's state, never the group, so long streams need little memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loquent.operators import machines as M
from loquent.operators import sequences as Q


def fold(df: DataFrame, key: str, order: list[str], inputs: list[str], machine: Callable[[], object], outputs: str, arranged: bool = False) -> DataFrame:
    """`machine()` for each key; push(row) and close() give tuples of `outputs` (a schema without the key).

    A null key is a key of its own, after the sort before all others. Nulls and NaN of inputs come as None; whole numbers
    stay whole, whatever their size. With `arranged`, rows lie by key and order in their partitions already, as rows do that
    were made from sorted ones without a shuffle since: nothing is dealt or sorted again, so no task holds its rows.
    """
    schema = StructType([StructField(key, df.schema[key].dataType), *StructType.fromDDL(outputs).fields])
    arrow = to_arrow_schema(schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            rows: list[tuple] = []
            for k, *row in zip(*(batch.column(c).to_pylist() for c in (key, *inputs)), strict=True):
                if state is None or k != own:
                    if state is not None:
                        rows += [(own, *r) for r in state.close()]
                    own, state = k, machine()
                rows += [(k, *r) for r in state.push(tuple(None if x != x else x for x in row))]
            yield batch_of(rows)
        if state is not None:
            yield batch_of([(own, *r) for r in state.close()])

    rows = df.select(key, *dict.fromkeys([*order, *inputs]))
    return (rows if arranged else rows.repartition(key).sortWithinPartitions(key, *order)).mapInArrow(run, schema)


def agree(hypotheses: DataFrame, sure: float | None = None, policy: str = "pad", arranged: bool = False) -> DataFrame:
    """stream_id and the committed tokens; with `agreed` false, what was left at the end (S1, S5). Rows without text are
    silences from start to end, taken by `policy` (S27)."""
    return fold(hypotheses, "stream_id", ["hyp_id", "pos"], ["hyp_id", "pos", "start", "end", "text", "probability"], lambda: M.Agreement(sure, policy), "hyp_id long, pos long, start double, end double, text string, probability double, agreed boolean", arranged)


def trimmed(rows: DataFrame, limit: float, way: str = "sentence", arranged: bool = False) -> DataFrame:
    """stream_id, iteration, where its buffer is cut, how many committed tokens are forgotten, and why."""
    return fold(rows, "stream_id", ["iteration", "seq", "kind"], ["iteration", "kind", "at", "text"], lambda: M.Trim(limit, way), "iteration long, cut double, forgotten long, reason string", arranged)


def voice_activity(frames: DataFrame, **settings: float) -> DataFrame:
    return fold(frames, "stream_id", ["sample"], ["sample", "prob"], lambda: M.VoiceActivity(**settings), "event string, sample long")


def breaker(calls: DataFrame, **policy: object) -> DataFrame:
    return fold(calls, "service", ["at", "id"], ["at", "ok"], lambda: M.Breaker(**policy), "at double, state string, passed boolean")


def restarts(attempts: DataFrame, **policy: object) -> DataFrame:
    return fold(attempts, "service", ["at", "id"], ["at"], lambda: M.Restarts(**policy), "at double, allowed boolean")


_TOKEN = ["seq", "start", "end", "text"]


def lines(tokens: DataFrame, arranged: bool = False) -> DataFrame:
    return fold(tokens, "stream_id", ["seq"], [*_TOKEN, "speaker"], M.Lines, "line long, start double, end double, text string, speaker int", arranged)


def speaker_lines(tokens: DataFrame, attributed: bool = True, arranged: bool = False) -> DataFrame:
    """tokens: stream_id, seq, start, end, text, speaker, horizon. The last token's speaker is told to all of a stream, unless
    the caller does so as `last_speaker`, which rows that stay arranged need."""
    whole = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = tokens if "last_speaker" in tokens.columns else tokens.withColumn("last_speaker", F.last("speaker").over(whole))
    return fold(rows, "stream_id", ["seq"], ["start", "end", "text", "speaker", "horizon", "last_speaker"], lambda: M.SpeakerLines(attributed), "line long, start double, end double, text string, speaker int, behind double", arranged)


def blanks_to_silence(tokens: DataFrame, least: float = 4.0, arranged: bool = False) -> DataFrame:
    return fold(tokens, "stream_id", ["seq"], _TOKEN, lambda: M.Blanks(least), "seq long, start double, end double, text string, speaker int", arranged)


def monotonic(tokens: DataFrame, arranged: bool = False) -> DataFrame:
    return fold(tokens, "stream_id", ["seq"], ["seq", "start", "end"], M.Monotonic, "seq long, start double, end double", arranged)


def sentences(tokens: DataFrame, arranged: bool = False) -> DataFrame:
    return fold(tokens, "stream_id", ["seq"], _TOKEN, M.Sentences, "sentence long, start double, end double, text string", arranged)


def truncate_words(tokens: DataFrame, usual: float, arranged: bool = False) -> DataFrame:
    return fold(tokens, "stream_id", ["seq"], _TOKEN, lambda: M.Truncate(usual), "seq long, start double, end double, text string", arranged)


def cues(tokens: DataFrame, arranged: bool = False, **layout: float) -> DataFrame:
    """Subtitle cues of each stream."""
    return fold(tokens, "stream_id", ["seq"], ["start", "end", "text"], lambda: M.Cues(**layout), "cue long, start double, end double, text string", arranged)


def fill_silence(tokens: DataFrame, least_ms: int = 4000, arranged: bool = False) -> DataFrame:
    """Rows of speaker -2 for gaps of at least least_ms, the one before the first token included (W3). Whole milliseconds."""
    columns = ["seq", "start_ms", "end_ms", "text", "speaker"]
    return fold(tokens, "stream_id", ["seq"], columns, lambda: M.Gaps(least_ms), "seq long, start_ms long, end_ms long, text string, speaker int", arranged)


@F.pandas_udf(ArrayType(StringType()))
def trim_tail(words: pd.Series) -> pd.Series:
    return words.map(lambda w: Q.trim_tail(list(w)))


@F.pandas_udf(ArrayType(StringType()))
def merge_marks(words: pd.Series) -> pd.Series:
    return words.map(lambda w: Q.merge_marks(list(w)))


@F.pandas_udf(StringType())
def common_substring(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else Q.common_substring(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(ArrayType(StructType([StructField("i", IntegerType()), StructField("j", IntegerType())])))
def warp(x: pd.Series, y: pd.Series) -> pd.Series:
    """Cheapest alignment of two number sequences by absolute difference."""
    import numpy as np

    return pd.Series([[{"i": int(i), "j": int(j)} for i, j in Q.warp(np.abs(np.asarray(a, float)[:, None] - np.asarray(b, float)[None]))] for a, b in zip(x, y, strict=True)])


def snap_to_marks(tokens: DataFrame, changes: DataFrame) -> DataFrame:
    """Speaker changes moved to the nearest punctuation, then tokens by range (J6, J7, intent of D8).

    tokens: stream_id, seq, start_ms, text; changes: stream_id, start_ms, speaker. Only windows and one sort a stream.
    """
    mark = tokens.filter(F.trim("text").rlike("[.!?]$")).select("stream_id", F.col("start_ms").alias("at"), F.lit(True).alias("is_mark"), F.lit(None).cast("int").alias("speaker"))
    both = mark.unionByName(changes.select("stream_id", F.col("start_ms").alias("at"), F.lit(False).alias("is_mark"), "speaker"))
    w = Window.partitionBy("stream_id").orderBy("at", "is_mark")
    before = F.last(F.when(F.col("is_mark"), F.col("at")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(F.when(F.col("is_mark"), F.col("at")), True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumn("b", before).withColumn("a", after).filter(~F.col("is_mark"))
    snapped: Column = F.when(F.col("a").isNull() | (F.col("at") - F.col("b") <= F.col("a") - F.col("at")), F.coalesce("b", "at")).otherwise(F.col("a"))
    points = near.select("stream_id", F.when(F.col("b").isNull() & F.col("a").isNull(), F.col("at")).otherwise(snapped).alias("start_ms"), F.lit(None).cast("long").alias("seq"), "speaker")
    rows = tokens.select("stream_id", "start_ms", "seq", F.lit(None).cast("int").alias("speaker")).unionByName(points)
    # A mark itself still belongs to the speaker before the change.
    order = Window.partitionBy("stream_id").orderBy("start_ms", F.col("seq").isNull(), "speaker").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("speaker", F.coalesce(F.last("speaker", True).over(order), F.lit(-1))).filter("seq is not null").select("stream_id", "seq", "speaker")
