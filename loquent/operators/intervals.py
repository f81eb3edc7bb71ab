"""Operators over timed tokens, segments and frames: overlap joins, runs, gaps, windows.

Tokens: stream_id, seq, start_ms, end_ms, text, speaker. Segments: stream_id, seg, start_ms, end_ms, speaker. Times are
whole milliseconds, so that results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the time cells that turn an overlap condition into an equality.
CELL_MS = 10_000


def _cells(df: DataFrame, start: str, end: str, cell: int) -> DataFrame:
    return df.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.greatest(F.col(start), F.col(end)) / cell))))


def overlaps(tokens: DataFrame, segments: DataFrame, cell: int = CELL_MS) -> DataFrame:
    """Pairs that overlap, ends not touching. Both sides are spread over time cells, and a pair is kept in the cell in
    which the later of them starts: an equi join without duplicates instead of a range join."""
    left = _cells(tokens, "start_ms", "end_ms", cell)
    right = _cells(segments.select("stream_id", "seg", F.col("start_ms").alias("s_start"), F.col("end_ms").alias("s_end"), F.col("speaker").alias("s_speaker")), "s_start", "s_end", cell)
    pairs = left.join(right, ["stream_id", "__cell"])
    hit = (F.col("s_end") > F.col("start_ms")) & (F.col("s_start") < F.col("end_ms")) & (F.col("__cell") == F.floor(F.greatest("start_ms", "s_start") / cell))
    return pairs.filter(hit).drop("__cell")


def assign_speakers(tokens: DataFrame, segments: DataFrame, tie: str = "last", default: int = -1, lag: bool = False) -> DataFrame:
    """Each token's speaker by overlap; of several segments the last or the first one wins (J4, J5, D6). With lag, the
    segments are first shifted by the first segment's start less the first token's (J8)."""
    if lag:
        first_token = tokens.groupBy("stream_id").agg(F.min("start_ms").alias("__t"))
        first_seg = segments.groupBy("stream_id").agg(F.min("start_ms").alias("__s"))
        shift = first_token.join(first_seg, "stream_id").select("stream_id", (F.col("__s") - F.col("__t")).alias("__lag"))
        segments = segments.join(shift, "stream_id").withColumn("start_ms", F.col("start_ms") - F.col("__lag")).withColumn("end_ms", F.col("end_ms") - F.col("__lag")).drop("__lag")
    pick = F.max_by if tie == "last" else F.min_by
    found = overlaps(tokens.select("stream_id", "seq", "start_ms", "end_ms"), segments).groupBy("stream_id", "seq").agg(pick("s_speaker", "seg").alias("__found"))
    return tokens.join(found, ["stream_id", "seq"], "left").withColumn("speaker", F.coalesce("__found", F.lit(default))).drop("__found")


def drop_inside(words: DataFrame, silences: DataFrame, cell: int = CELL_MS) -> DataFrame:
    """Words whose start lies in no silence; both ends of a silence count as inside."""
    spread = _cells(silences.select("stream_id", F.col("start_ms").alias("s_start"), F.col("end_ms").alias("s_end")), "s_start", "s_end", cell)
    keyed = words.withColumn("__cell", F.floor(F.col("start_ms") / cell))
    inside = (keyed["stream_id"] == spread["stream_id"]) & (keyed["__cell"] == spread["__cell"]) & (F.col("start_ms") >= F.col("s_start")) & (F.col("start_ms") <= F.col("s_end"))
    return keyed.join(spread, inside, "left_anti").drop("__cell")


def islands(df: DataFrame, keys: list[str], order: str, changed: Column, name: str = "island") -> DataFrame:
    """Numbers runs: a run starts wherever `changed` holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("__new", F.when(F.coalesce(changed, F.lit(True)), 1).otherwise(0))
    return marked.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merge_runs(segments: DataFrame) -> DataFrame:
    """Neighbouring segments of one speaker become one."""
    w = Window.partitionBy("stream_id").orderBy("seg")
    runs = islands(segments.withColumn("__before", F.lag("speaker").over(w)), ["stream_id"], "seg", F.col("speaker") != F.col("__before"))
    return runs.groupBy("stream_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("speaker").alias("speaker"))


def frames_to_segments(frames: DataFrame, frame_ms: int) -> DataFrame:
    """The loudest speaker of each frame, merged while the speaker stays and frames follow closely."""
    best = frames.withColumn("speaker", F.array_position("scores", F.array_max("scores")).cast("int") - 1)
    w = Window.partitionBy("stream_id").orderBy("frame")
    gap = (F.col("frame") - F.lag("frame").over(w) - 1) * frame_ms
    best = best.withColumn("__gap", gap).withColumn("__before", F.lag("speaker").over(w))
    runs = islands(best, ["stream_id"], "frame", (F.col("speaker") != F.col("__before")) | (F.col("__gap") >= frame_ms / 2))
    return runs.groupBy("stream_id", "island").agg((F.min("frame") * frame_ms).alias("start_ms"), ((F.max("frame") + 1) * frame_ms).alias("end_ms"), F.first("speaker").alias("speaker"))


def trailing_silence(tokens: DataFrame, now_ms: Column, least_ms: int = 8000) -> DataFrame:
    """A row of silence where the last token ended at least least_ms before now."""
    last = tokens.groupBy("stream_id").agg(F.max("end_ms").alias("start_ms"), F.max("seq").alias("seq"))
    return last.withColumn("end_ms", now_ms).filter(F.col("end_ms") - F.col("start_ms") >= least_ms).select("stream_id", "seq", "start_ms", "end_ms", F.lit("").alias("text"), F.lit(-2).alias("speaker"))


def next_mark(tokens: DataFrame, within: int = 4) -> Column:
    """The seq of the next punctuation among the following tokens."""
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(1, within)
    return F.min(F.when(F.trim("text").rlike("[.!?]$"), F.col("seq"))).over(w)


def emit_on_change(df: DataFrame, key: str, order: str, *signature: str) -> DataFrame:
    """Rows that differ from the one before."""
    w = Window.partitionBy(key).orderBy(order)
    print_ = F.to_json(F.struct(*signature))
    return df.withColumn("__is", print_).withColumn("__was", F.lag("__is").over(w)).filter(F.col("__was").isNull() | (F.col("__was") != F.col("__is"))).drop("__is", "__was")


def suffix_within(df: DataFrame, key: str, order: str, size: Column, budget: int, crossing: bool) -> DataFrame:
    """The last rows of each key whose sizes fit the budget; with crossing, the one that crosses it too."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    upto = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = upto - size < budget if crossing else upto <= budget
    return df.withColumn("__kept", kept).filter("__kept").drop("__kept")


def first_accepted(candidates: DataFrame, key: str, order: str, accepted: Column, value: str) -> DataFrame:
    """The first candidate that passes, else the last."""
    return candidates.groupBy(key).agg(F.coalesce(F.min_by(value, F.when(accepted, F.col(order))), F.max_by(value, order)).alias(value))


def word_anomaly(probability: Column, duration: Column) -> Column:
    """1 for improbable words, plus what a word is too short or too long."""
    return F.when(probability < 0.15, 1.0).otherwise(0.0) + F.when(duration < 0.133, (0.133 - duration) * 15).otherwise(0.0) + F.when(duration > 2.0, duration - 2.0).otherwise(0.0)


def clip_pairs(text: Column, content_frames: Column) -> Column:
    """`0,5.2,7` as (start, end) frames; an odd tail ends with the content."""
    points = F.transform(F.split(text, ","), lambda x: F.bround(x.cast("double") * 100).cast("long"))
    points = F.when(F.size(points) % 2 == 1, F.concat(points, F.array(content_frames))).otherwise(points)
    return F.transform(F.sequence(F.lit(0), (F.size(points) / 2).cast("int") - 1), lambda k: F.struct(F.element_at(points, 2 * k + 1).alias("start"), F.element_at(points, 2 * k + 2).alias("end")))
