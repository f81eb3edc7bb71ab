"""Sources and sinks over the test tables: written to a shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquent.plans import fold_sql as Q
from loquent.plans.registry import Tables, query
from loquent.plans.streams_queries import work_folder
from loquent.sources import files as S
from loquent.streaming import streams as R


@query("a12_json_lines", "SELECT event_id, value FROM events WHERE event_type <> 'error'")
def _(t: Tables):
    """Lines of JSON among blank and broken ones."""
    out = work_folder(t)
    good = F.to_json(F.struct("event_id", "value"))
    lines = t.events.select(F.explode(F.array(F.when(F.col("event_type") == "error", F.substring(good, 1, 12)).otherwise(good), F.lit(" "))).alias("value"))
    lines.write.text(out)
    return S.read_json_lines(t.spark, out, "event_id long, value double")[0]


@query("a16_last_lines", "SELECT 'event ' || event_id AS value FROM events ORDER BY event_id DESC LIMIT 500")
def _(t: Tables):
    out = work_folder(t)
    rows = t.events.repartitionByRange("event_id").sortWithinPartitions("event_id")
    rows.select(F.concat(F.lit("event "), F.col("event_id")).alias("value")).write.text(out)
    return S.tail(t.spark, out).select("value")


@query("b9_log_and_replay", "SELECT event_id, value FROM events WHERE event_type <> 'view'")
def _(t: Tables):
    """Two appends to the write-ahead log; what was not acknowledged comes again."""
    out, rows = work_folder(t), t.events.select("event_id", "value", "event_type")
    for part in (F.col("event_type") == "error", F.col("event_type") != "error"):
        S.append_log(rows.filter(part).select("event_id", "value"), out)
    return S.replay_log(t.spark, out, "event_id long, value double", rows.filter("event_type = 'view'"))


@query("b21_settings", "SELECT n_name AS key, '{\"region\":' || n_regionkey || '}' AS value FROM nation")
def _(t: Tables):
    out = work_folder(t)
    S.save_settings(t.nation.select(F.col("n_name").alias("key"), F.to_json(F.struct(F.col("n_regionkey").alias("region"))).alias("value")), out)
    return S.load_settings(t.spark, out)


def _inserted(t: Tables, before: DataFrame, new: DataFrame) -> DataFrame:
    """A table of Parquet files after an insert."""
    out = work_folder(t)
    before.write.parquet(out)
    new.write.mode("append").parquet(out)
    return t.spark.read.schema(before.schema).parquet(out)


@query("b15_insert_log", "SELECT event_id AS id, ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, props AS message FROM events UNION ALL SELECT max(event_id) + 1, max(ts), 'INFO', 'inserted' FROM events")
def _(t: Tables):
    logs = t.events.select(F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.col("props").alias("message"))
    return _inserted(t, logs, t.events.agg((F.max("event_id") + 1).alias("id"), F.max("ts").alias("ts"), F.lit("INFO").alias("level"), F.lit("inserted").alias("message")))


@query("b16_insert_transcriptions", "SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'inserted' FROM conversations GROUP BY 1")
def _(t: Tables):
    rows = t.conversations.select("conv_id", "turn", "text")
    return _inserted(t, rows, rows.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"), F.lit("inserted").alias("text")))


@query("b17_insert_metrics", "SELECT user_id, 'value' AS metric, value FROM events UNION ALL SELECT user_id, 'count', CAST(count(*) AS DOUBLE) FROM events GROUP BY 1")
def _(t: Tables):
    rows = t.events.select("user_id", F.lit("value").alias("metric"), "value")
    return _inserted(t, rows, t.events.groupBy("user_id").agg(F.lit("count").alias("metric"), F.count("*").cast("double").alias("value")).select("user_id", "metric", "value"))


@query("s21_bounded_retries", "SELECT event_id, CASE WHEN need <= 3 THEN 'sent' ELSE 'given up' END AS state, least(need, 3) AS attempts FROM (SELECT event_id, CAST(floor(value / 20) AS INTEGER) + 1 AS need FROM events)")
def _(t: Tables):
    """Each event needs so many attempts; after three it is given up."""
    out = work_folder(t)
    need = (F.floor(F.col("value") / 20) + 1).cast("int")
    R.retry(t.spark, t.events.select("event_id", need.alias("need")), lambda df: df.withColumn("ok", F.col("attempts") >= F.col("need")), out, 3)
    rows = t.spark.read.schema("event_id long, attempts int, state string").parquet(out)
    return rows.select("event_id", "state", "attempts")


@query("b7_written_subtitles", Q.SUBTITLES)
def _(t: Tables):
    """The lines of all streams' subtitle files of one kind."""
    from loquent.plans.folds_queries import timed

    out = work_folder(t)
    cues = timed(t).select("stream_id", F.col("seq").alias("number"), "start", "end", "text")
    S.write_subtitles(cues, out, "srt")
    return S.read_subtitles(t.spark, out, "srt").groupBy("stream_id").agg(F.count("*").alias("lines"), F.count_if(F.col("value").contains(" --> ")).alias("cues"))


@query("a14_messages_of_a_type", "SELECT event_id, value FROM events WHERE event_type = 'click'")
def _(t: Tables):
    """Messages of one type out of a stream of several."""
    out = work_folder(t)
    t.events.select(F.to_json(F.struct(F.col("event_type").alias("type"), "event_id", "value")).alias("value")).write.text(f"{out}/in")
    R.run_all(R.read_messages(t.spark, f"{out}/in", "event_id long, value double", "click"), f"{out}/checkpoint", f"{out}/rows")
    return t.spark.read.schema("event_id long, value double").parquet(f"{out}/rows")


@query("s25_bridge", "SELECT event_id, 'event.' || event_type AS routing_key, props AS payload FROM events WHERE event_type <> 'signup'")
def _(t: Tables):
    """Consume, map to an envelope, publish; a few files in a micro-batch (A4)."""
    out = work_folder(t)
    t.events.write.parquet(f"{out}/in")
    rows = R.read_table(t.spark, f"{out}/in", t.events.schema, files=2).filter("event_type <> 'signup'")
    rows = rows.select("event_id", F.concat(F.lit("event."), F.col("event_type")).alias("routing_key"), F.col("props").alias("payload"))
    R.run_all(rows, f"{out}/checkpoint", R.publish(lambda batch: batch.withColumn("ok", F.lit(True)), f"{out}/sent", f"{out}/failed"))
    return t.spark.read.parquet(f"{out}/sent").drop("batch")
