"""Structured Streaming readers, windows and sinks; flows over several micro-batches are in `flows`.

Watermarks are an addition: rows need not come in order. Event times must be `timestamp`; readers cast them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, schema, ts: str | None = None, files: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream (A4: at most `files` in a micro-batch), or one file of a folder if the path
    ends in .parquet; `ts` is cast for watermarks."""
    reader = spark.readStream.schema(schema)
    folder, _, name = path.rpartition("/")
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    df = reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else reader.parquet(path)
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if ts else df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines as they come."""
    return spark.readStream.text(path)


def read_messages(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    """JSON messages of one type (A13, A14); lines of another shape drop out."""
    rows = spark.readStream.text(path).select(F.from_json("value", f"type string, {schema}").alias("m"))
    return rows.filter(F.col("m.type") == kind).select("m.*")


def daily_totals(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Live counts by user and day (S26), update mode."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 day").alias("day")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("failures"))


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Activity by gaps (S8, S10 as session windows)."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))


def run_all(df: DataFrame, checkpoint: str, out: str | Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Everything that is there, then stop (S18); to a Parquet folder or a foreachBatch function."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(out).start() if callable(out) else writer.format("parquet").option("path", out).start()
    query.awaitTermination()


def publish(send: Callable[[DataFrame], DataFrame], sent: str, failed: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: `send` gives rows with `ok`; results go to `sent`, the rest to `failed` to be tried again (B8,
    B13, S21, S22). Batches are told apart by their number, so a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        done = send(batch).persist()
        done.filter("ok").drop("ok").write.mode("overwrite").parquet(f"{sent}/batch={number}")
        done.filter("not ok").drop("ok").write.mode("overwrite").parquet(f"{failed}/batch={number}")
        done.unpersist()

    return each


def retry(spark: SparkSession, rows: DataFrame, send: Callable[[DataFrame], DataFrame], out: str, most: int = 3) -> None:
    """Send `rows` and send again what failed, `most` times at most (S21): `send` gives them with `ok`, and sees `attempts`.
    Results go to `out` with their state, "sent" or "given up"; each round's rows are a table of their own, so a lost
    executor repeats one round."""
    left = rows.withColumn("attempts", F.lit(1))
    for turn in range(1, most + 1):
        path = f"{out}-round-{turn}"
        send(left).write.mode("overwrite").parquet(path)
        done = spark.read.parquet(path)
        over = F.col("ok") if turn < most else F.lit(True)
        done.filter(over).withColumn("state", F.when(F.col("ok"), "sent").otherwise("given up")).drop("ok").write.mode("append").parquet(out)
        left = done.filter("not ok").drop("ok").withColumn("attempts", F.col("attempts") + 1)
