"""Queries over timed tokens made from conversations: word k of a conversation spans 300 k .. 300 k + 250 ms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loquent.operators import folds as D
from loquent.operators import intervals as I
from loquent.plans.registry import Tables, query

TOKENS = """tokens AS (SELECT conv_id AS stream_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS BIGINT) AS seq, turn, word AS text FROM
 (SELECT conv_id, turn, unnest(range(len(string_split(text, ' ')))) AS pos, unnest(string_split(text, ' ')) AS word FROM conversations)),
timed AS (SELECT stream_id, seq, turn, text, seq * 300 + turn * 1500 AS start_ms, seq * 300 + turn * 1500 + 250 AS end_ms, -1 AS speaker FROM tokens)"""
SEGMENTS = """segs AS (SELECT stream_id, turn AS seg, min(start_ms) - 400 AS start_ms, max(end_ms) + 400 AS end_ms, CAST(turn % 2 + 1 AS INTEGER) AS speaker FROM timed GROUP BY 1, 2)"""


def turns(t: Tables):
    """stream_id, turn, texts (one, but for rows of the same turn), size and how many words the turns before have.

    Rows lie by stream and turn in their partitions, and rows made from one of them may follow in its place: what is made of
    words this way is arranged for folds, and no task sorts words, of which there are far more than turns.
    """
    rows = t.conversations.filter("text is not null").select(F.col("conv_id").alias("stream_id"), "turn", "text").repartition("stream_id")
    rows = rows.groupBy("stream_id", "turn").agg(F.collect_list("text").alias("texts"))
    rows = rows.withColumn("size", F.aggregate("texts", F.lit(0).cast("long"), lambda n, x: n + F.size(F.split(x, " "))))
    before = F.sum("size").over(Window.partitionBy("stream_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", F.coalesce(before, F.lit(0)))


def words_of(texts):
    """The words of a turn; of several texts the first words, then the second ones, as they are numbered by turn and place."""
    split = F.transform(texts, lambda x: F.split(x, " "))
    last = F.array_max(F.transform(split, lambda x: F.size(x))) - 1
    mixed = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda k: F.filter(F.transform(split, lambda x: F.get(x, k)), lambda w: w.isNotNull())))
    return F.when(F.size(texts) == 1, F.split(texts[0], " ")).otherwise(mixed)


def spoken(rows, *more: str):
    """Tokens of `turns`, in their place: stream_id, seq, turn, text, start_ms, end_ms, speaker, and what else is asked for."""
    words = rows.select("*", F.posexplode(words_of(F.col("texts"))).alias("pos", "text")).withColumn("seq", F.col("before") + F.col("pos"))
    start = F.col("seq") * 300 + F.col("turn") * 1500
    return words.select("stream_id", "seq", "turn", "text", start.alias("start_ms"), (start + 250).alias("end_ms"), F.lit(-1).alias("speaker"), *more)


def tokens(t: Tables):
    return spoken(turns(t))


def segments(t: Tables):
    return tokens(t).groupBy("stream_id", F.col("turn").alias("seg")).agg((F.min("start_ms") - 400).alias("start_ms"), (F.max("end_ms") + 400).alias("end_ms"), (F.first("turn") % 2 + 1).cast("int").alias("speaker"))


def _overlap(pick: str) -> str:
    return f"WITH {TOKENS}, {SEGMENTS} SELECT t.stream_id, t.seq, coalesce({pick}(s.speaker, s.seg), -1) AS speaker FROM timed t LEFT JOIN segs s ON s.stream_id = t.stream_id AND s.end_ms > t.start_ms AND s.start_ms < t.end_ms GROUP BY 1, 2"


@query("j4_overlap_last_wins", _overlap("arg_max"))
def _(t: Tables):
    return I.assign_speakers(tokens(t), segments(t), "last").select("stream_id", "seq", "speaker")


@query("j5_overlap_first_wins", _overlap("arg_min"))
def _(t: Tables):
    return I.assign_speakers(tokens(t), segments(t), "first").select("stream_id", "seq", "speaker")


@query("j8_lagged_assignment", f"WITH {TOKENS}, {SEGMENTS}, lag AS (SELECT t.stream_id, s.s - t.t AS l FROM (SELECT stream_id, min(start_ms) AS t FROM timed GROUP BY 1) t JOIN (SELECT stream_id, min(start_ms) AS s FROM segs GROUP BY 1) s ON s.stream_id = t.stream_id) SELECT t.stream_id, t.seq, coalesce(arg_max(s.speaker, s.seg), -1) AS speaker FROM timed t LEFT JOIN (SELECT segs.*, l FROM segs JOIN lag USING (stream_id)) s ON s.stream_id = t.stream_id AND s.end_ms - l > t.start_ms AND s.start_ms - l < t.end_ms GROUP BY 1, 2")
def _(t: Tables):
    return I.assign_speakers(tokens(t), segments(t), "last", lag=True).select("stream_id", "seq", "speaker")


_SIL = "sil AS (SELECT stream_id, turn, min(start_ms) AS start_ms, min(start_ms) + 900 AS end_ms FROM timed WHERE turn % 2 = 1 GROUP BY 1, 2)"


def _silences(t: Tables):
    return tokens(t).filter("turn % 2 = 1").groupBy("stream_id", "turn").agg(F.min("start_ms").alias("start_ms"), (F.min("start_ms") + 900).alias("end_ms"))


for _name in ("c18_drop_in_silence", "j9_range_anti_join"):

    @query(_name, f"WITH {TOKENS}, {_SIL} SELECT stream_id, seq FROM timed t WHERE NOT EXISTS (SELECT 1 FROM sil s WHERE s.stream_id = t.stream_id AND t.start_ms >= s.start_ms AND t.start_ms <= s.end_ms)")
    def _(t: Tables):
        return I.drop_inside(tokens(t), _silences(t)).select("stream_id", "seq")


@query("c17_no_speech_segments", "SELECT conv_id, turn, CAST(unnest(range(len(string_split(text, ' ')))) AS BIGINT) AS pos FROM conversations WHERE NOT (turn % 10 / 10.0 > 0.3)")
def _(t: Tables):
    nested = t.conversations.withColumn("no_speech", F.col("turn") % 10 / 10)
    return nested.filter(~(F.col("no_speech") > 0.3)).select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "w")).select("conv_id", "turn", F.col("pos").cast("long"))


@query("c25_final_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' AND role <> 'system' GROUP BY 1")
def _(t: Tables):
    lines = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("lines"))
    kept = F.filter("lines", lambda x: (F.trim(x["text"]) != "") & (x["role"] != "system"))
    return lines.withColumn("kept", kept).filter(F.size("kept") > 0).select("conv_id", F.array_join(F.col("kept.text"), "\n").alias("text"))


@query("w1_merge_runs", f"WITH {TOKENS}, {SEGMENTS}, two AS (SELECT stream_id, seg, start_ms, end_ms, CAST(seg // 2 % 2 AS INTEGER) AS speaker FROM segs), marked AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY stream_id ORDER BY seg) THEN 0 ELSE 1 END AS new FROM two), runs AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY seg) AS island FROM marked) SELECT stream_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(speaker) AS speaker FROM runs GROUP BY stream_id, island")
def _(t: Tables):
    two = segments(t).withColumn("speaker", (F.floor(F.col("seg") / 2) % 2).cast("int"))
    return I.merge_runs(two).select("stream_id", "start_ms", "end_ms", "speaker")


@query("w2_frames_to_segments", "WITH f AS (SELECT label AS stream_id, vec_id AS frame, CAST(list_position(embedding[1:4], list_max(embedding[1:4])) - 1 AS INTEGER) AS speaker FROM embeddings), m AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w AND (frame - lag(frame) OVER w - 1) * 80 < 40 THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY stream_id ORDER BY frame)), r AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY frame) AS island FROM m) SELECT stream_id, min(frame) * 80 AS start_ms, (max(frame) + 1) * 80 AS end_ms, min(speaker) AS speaker FROM r GROUP BY stream_id, island")
def _(t: Tables):
    frames = t.embeddings.select(F.col("label").alias("stream_id"), F.col("vec_id").alias("frame"), F.slice("embedding", 1, 4).alias("scores"))
    return I.frames_to_segments(frames, 80).select("stream_id", "start_ms", "end_ms", "speaker")


@query("w2_frames_of_all_speakers", "WITH f AS (SELECT label AS stream_id, vec_id AS frame, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS speaker FROM embeddings), m AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w AND (frame - lag(frame) OVER w - 1) * 80 < 40 THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY stream_id ORDER BY frame)), r AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY frame) AS island FROM m) SELECT stream_id, min(frame) * 80 AS start_ms, (max(frame) + 1) * 80 AS end_ms, min(speaker) AS speaker FROM r GROUP BY stream_id, island")
def _(t: Tables):
    frames = t.embeddings.select(F.col("label").alias("stream_id"), F.col("vec_id").alias("frame"), F.col("embedding").alias("scores"))
    return I.frames_to_segments(frames, 80).select("stream_id", "start_ms", "end_ms", "speaker")


@query("w3_fill_silence", f"WITH {TOKENS}, g AS (SELECT *, coalesce(lag(end_ms) OVER (PARTITION BY stream_id ORDER BY seq), 0) AS b FROM timed) SELECT stream_id, seq, start_ms, end_ms, text, speaker FROM timed UNION ALL SELECT stream_id, seq, b AS start_ms, start_ms AS end_ms, '' AS text, -2 AS speaker FROM g WHERE start_ms - b >= 1550")
def _(t: Tables):
    return D.fill_silence(tokens(t), 1550, arranged=True)


@query("w4_trailing_silence", f"WITH {TOKENS} SELECT stream_id, max(seq) AS seq, max(end_ms) AS start_ms, CAST(100000 AS BIGINT) AS end_ms FROM timed GROUP BY 1 HAVING 100000 - max(end_ms) >= 8000")
def _(t: Tables):
    return I.trailing_silence(tokens(t), F.lit(100000).cast("long")).select("stream_id", "seq", "start_ms", "end_ms")


@query("w8_next_punctuation", f"WITH {TOKENS} SELECT stream_id, seq, min(CASE WHEN regexp_matches(trim(text), '[.!?]$') THEN seq END) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS mark FROM timed")
def _(t: Tables):
    rows = tokens(t)
    return rows.select("stream_id", "seq", I.next_mark(rows).alias("mark"))


@query("w14_last_changes", "SELECT user_id, CAST(to_json(list(event_id ORDER BY ts, event_id)[-10:]) AS VARCHAR) AS last FROM events GROUP BY 1")
def _(t: Tables):
    got = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("all"))
    return got.select("user_id", F.to_json(F.slice(F.col("all.event_id"), -F.least(F.size("all"), F.lit(10)), 10)).alias("last"))


@query("w15_restart_density", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) <= 3 AS allowed FROM events")
def _(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(-86_400_000_000, 0)
    us = t.events.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    return us.select("event_id", (F.count("*").over(w) <= 3).alias("allowed"))


@query("w20_word_anomaly", "SELECT event_id, round(CASE WHEN value / 50 < 0.15 THEN 1e0 ELSE 0e0 END + CASE WHEN value / 20 < 0.133e0 THEN (0.133e0 - value / 20) * 15 ELSE 0e0 END + CASE WHEN value / 20 > 2e0 THEN value / 20 - 2e0 ELSE 0e0 END, 9) AS score FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.round(I.word_anomaly(F.col("value") / 50, F.col("value") / 20), 9).alias("score"))


@query("w23_cumulative_firing", "SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) >= 99900 AS fired FROM events")
def _(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", (F.sum(F.round(F.col("value") * 100).cast("long")).over(w) >= 99900).alias("fired"))


@query("w24_jump_times", f"WITH {TOKENS} SELECT stream_id, seq, start_ms FROM (SELECT *, lag(turn) OVER (PARTITION BY stream_id ORDER BY seq) AS b FROM timed) WHERE b IS NULL OR turn > b")
def _(t: Tables):
    w = Window.partitionBy("stream_id").orderBy("seq")
    return tokens(t).withColumn("b", F.lag("turn").over(w)).filter("b is null or turn > b").select("stream_id", "seq", "start_ms")


@query("w26_clip_pairs", "SELECT event_id, CAST(0 AS BIGINT) AS start, CAST(520 AS BIGINT) AS stop FROM events UNION ALL SELECT event_id, CAST(700 AS BIGINT) AS start, event_id + 1000 AS stop FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.explode(I.clip_pairs(F.lit("0,5.2,7"), F.col("event_id") + 1000)).alias("p")).select("event_id", "p.start", F.col("p.end").alias("stop"))


@query("w17_prompt_suffix", f"WITH {TOKENS}, s AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY stream_id ORDER BY seq DESC) - length(text) - 1 AS before FROM timed) SELECT stream_id, string_agg(text, ' ' ORDER BY seq) AS prompt FROM s WHERE before < 200 GROUP BY 1")
def _(t: Tables):
    kept = I.suffix_within(tokens(t), "stream_id", "seq", F.length("text") + 1, 200, True)
    from loquent.operators.aggregates import ordered_concat

    return ordered_concat(kept, ["stream_id"], "seq", "text", " ", "prompt")


@query("w27_token_budget", f"WITH {TOKENS}, s AS (SELECT *, sum(length(text)) OVER (PARTITION BY stream_id ORDER BY seq DESC) AS upto FROM timed) SELECT stream_id, seq FROM s WHERE upto <= 100")
def _(t: Tables):
    return I.suffix_within(tokens(t), "stream_id", "seq", F.length("text"), 100, False).select("stream_id", "seq")


@query("w28_first_accepted", "SELECT user_id, coalesce(arg_min(event_id, ts) FILTER (WHERE value > 30), arg_max(event_id, ts)) AS event_id FROM events GROUP BY 1")
def _(t: Tables):
    return I.first_accepted(t.events, "user_id", "ts", F.col("value") > 30, "event_id")


@query("w29_word_times", f"WITH {TOKENS} SELECT stream_id, turn, arg_max(start_ms, seq) AS start_ms, arg_max(start_ms, seq) + 100 AS end_ms FROM timed GROUP BY 1, 2")
def _(t: Tables):
    return tokens(t).groupBy("stream_id", "turn").agg(F.max_by("start_ms", "seq").alias("start_ms")).withColumn("end_ms", F.col("start_ms") + 100)


@query("w30_drop_blank_segments", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS id FROM conversations WHERE trim(text) NOT IN ('', '.') AND length(text) > 60")
def _(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn")
    kept = t.conversations.filter(~F.trim("text").isin("", ".") & (F.length("text") > 60))
    return kept.select("conv_id", "turn", (F.row_number().over(w) - 1).alias("id"))


@query("w21_hallucination_gaps", f"WITH {TOKENS}, {SEGMENTS}, g AS (SELECT *, start_ms - lag(end_ms) OVER w AS b, lead(start_ms) OVER w - end_ms AS a FROM segs WINDOW w AS (PARTITION BY stream_id ORDER BY seg)), f AS (SELECT stream_id, min(seg) AS cut FROM g WHERE coalesce(b, 9999) >= 700 AND coalesce(a, 9999) >= 700 AND end_ms - start_ms < 3000 GROUP BY 1) SELECT g.stream_id, g.seg FROM g LEFT JOIN f USING (stream_id) WHERE cut IS NULL OR seg < cut")
def _(t: Tables):
    w = Window.partitionBy("stream_id").orderBy("seg")
    g = segments(t).withColumn("b", F.col("start_ms") - F.lag("end_ms").over(w)).withColumn("a", F.lead("start_ms").over(w) - F.col("end_ms"))
    odd = (F.coalesce("b", F.lit(9999)) >= 700) & (F.coalesce("a", F.lit(9999)) >= 700) & (F.col("end_ms") - F.col("start_ms") < 3000)
    first = F.min(F.when(odd, F.col("seg"))).over(Window.partitionBy("stream_id"))
    return g.withColumn("cut", first).filter("cut is null or seg < cut").select("stream_id", "seg")


@query("w22_slice_at_marks", f"WITH {TOKENS}, m AS (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY stream_id ORDER BY seq) LIKE '%.' THEN 1 ELSE 0 END AS new FROM timed), r AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY seq) AS part FROM m) SELECT stream_id, CAST(part AS BIGINT) AS part, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM r GROUP BY 1, 2")
def _(t: Tables):
    w = Window.partitionBy("stream_id").orderBy("seq")
    rows = tokens(t).withColumn("b", F.coalesce(F.lag("text").over(w).endswith("."), F.lit(False)))
    return I.islands(rows, ["stream_id"], "seq", F.col("b"), "part").groupBy("stream_id", "part").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))


@query("w25_growth_only", "SELECT conv_id, turn, CASE WHEN b IS NULL THEN text WHEN starts_with(text, b) THEN substr(text, length(b) + 1) ELSE text END AS typed FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)")
def _(t: Tables):
    b = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.withColumn("b", b)
    return rows.select("conv_id", "turn", F.when(F.startswith("text", "b"), F.col("text").substr(F.length("b") + 1, F.length("text"))).otherwise(F.col("text")).alias("typed"))


@query("t24_first_last_times", f"WITH {TOKENS} SELECT stream_id, min(start_ms) AS first_ms, max(end_ms) AS last_ms FROM timed GROUP BY 1")
def _(t: Tables):
    nested = tokens(t).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start_ms", "end_ms"))).alias("words"))
    return nested.select("stream_id", F.element_at("words", 1)["start_ms"].alias("first_ms"), F.element_at("words", -1)["end_ms"].alias("last_ms"))


@query("s12_emit_on_change", "SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def _(t: Tables):
    return I.emit_on_change(t.events, "user_id", "event_id", "event_type").select("event_id")


@query("s14_progress", f"WITH {TOKENS} SELECT stream_id, greatest(max(end_ms), max(start_ms) + 100) AS progress FROM timed GROUP BY 1")
def _(t: Tables):
    return tokens(t).groupBy("stream_id").agg(F.greatest(F.max("end_ms"), F.max("start_ms") + 100).alias("progress"))


@query("s15_remaining_time", f"WITH {TOKENS} SELECT stream_id, greatest(0e0, round((100000 - max(end_ms)) / 1000e0, 1)) AS remaining FROM timed GROUP BY 1")
def _(t: Tables):
    return tokens(t).groupBy("stream_id").agg(F.greatest(F.lit(0.0).cast("double"), F.round((F.lit(100000) - F.max("end_ms")).cast("double") / 1000, 1)).alias("remaining"))


@query("s16_segment_retention", f"WITH {TOKENS}, {SEGMENTS} SELECT stream_id, seg FROM (SELECT *, max(end_ms) OVER (PARTITION BY stream_id) AS p FROM segs) WHERE end_ms >= p - 30000")
def _(t: Tables):
    s = segments(t).withColumn("p", F.max("end_ms").over(Window.partitionBy("stream_id")))
    return s.filter(F.col("end_ms") >= F.col("p") - 30000).select("stream_id", "seg")


@query("s20_final_routing", "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'final' ELSE 'partial' END AS route FROM conversations")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", F.when(F.col("role") == "assistant", "final").otherwise("partial").alias("route"))


@query("s28_placeholder_token", "SELECT conv_id, turn, text FROM conversations WHERE role <> 'system' UNION ALL SELECT conv_id, turn, '' AS text FROM conversations WHERE role = 'system'")
def _(t: Tables):
    on = t.conversations.filter("role <> 'system'").select("conv_id", "turn", "text")
    return on.unionByName(t.conversations.filter("role = 'system'").select("conv_id", "turn", F.lit("").alias("text")))


@query("s29_undiarized_tail", f"WITH {TOKENS}, {SEGMENTS}, a AS (SELECT t.stream_id, t.seq, t.end_ms, coalesce(arg_max(s.speaker, s.seg), -1) AS speaker FROM timed t LEFT JOIN (SELECT * FROM segs WHERE seg < 2) s ON s.stream_id = t.stream_id AND s.end_ms > t.start_ms AND s.start_ms < t.end_ms GROUP BY 1, 2, 3), h AS (SELECT stream_id, max(end_ms) AS horizon FROM segs WHERE seg < 2 GROUP BY 1) SELECT a.stream_id, seq, speaker IN (-1, 0) AND end_ms >= horizon AS buffered FROM a JOIN h USING (stream_id)")
def _(t: Tables):
    early = segments(t).filter("seg < 2")
    horizon = early.groupBy("stream_id").agg(F.max("end_ms").alias("horizon"))
    got = I.assign_speakers(tokens(t), early, "last").join(horizon, "stream_id")
    return got.select("stream_id", "seq", (F.col("speaker").isin(-1, 0) & (F.col("end_ms") >= F.col("horizon"))).alias("buffered"))
