"""Streams run to their end over the test tables; tests compare stateful ones with the batch folds."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquent.operators import machines as M
from loquent.plans import fold_sql as Q
from loquent.plans.registry import Tables, query
from loquent.streaming import flows as W
from loquent.streaming import streams as S

STEPS = 3


def work_folder(t: Tables) -> str:
    """A folder that all executors share, as in the checkpoint setting; our own only where it is unset."""
    found = t.spark.sparkContext.getConf().get("spark.checkpoint.dir") or t.spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        # Executors of other machines would not see a folder of this one.
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="loquent-stream-")
    return f"{found.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _events(t: Tables) -> DataFrame:
    return S.read_table(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema, "ts")


def _kept(t: Tables, df: DataFrame, mode: str) -> DataFrame:
    """The last complete result of a stream of bounded size."""
    out = work_folder(t)
    S.run_all(df, f"{out}/checkpoint", lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/rows"), mode)
    return t.spark.read.parquet(f"{out}/rows")


def in_steps(t: Tables, rows: DataFrame, folder: str, run: Callable[[DataFrame], None], shuffled: float = 0, ended: bool = False) -> None:
    """Rows arrive by their time in STEPS steps, up to `shuffled` seconds late; after each, `run` is given the stream."""
    by = F.unix_micros("ts") + (F.crc32(F.col("event_id").cast("string")) % 1000 * int(shuffled * 1000)).cast("long")
    step = W.steps(rows, by, STEPS)
    stream = S.read_table(t.spark, W.landing(t.spark, folder), rows.schema)
    for _ in W.arrive(rows, folder, step, STEPS):
        run(stream)
    if ended:
        W.end(t.spark, folder, rows.schema)
        run(stream)


def _in_order(t: Tables, order: list[str], inputs: list[str], machine: Callable[[], object], outputs: str, rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A machine of each key, the second column, over a stream that stops and goes on between steps."""
    out, told = work_folder(t), rows(t.events.withColumn("ts", F.col("ts").cast("timestamp")))
    stream = lambda df: W.in_order(df, told.columns[1], order, inputs, machine, outputs, "1 hour")
    in_steps(t, told, f"{out}/in", lambda df: S.run_all(stream(df), f"{out}/checkpoint", f"{out}/rows"), 3600, True)
    return t.spark.read.parquet(f"{out}/rows")


@query("s26_live_daily_totals", "SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failures FROM events GROUP BY 1, 2")
def _(t: Tables):
    return _kept(t, S.daily_totals(_events(t)), "complete").select("user_id", F.to_date("day.start").alias("date"), "n", "failures")


@query("s10_activity_sessions", "WITH m AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m) SELECT user_id, count(*) AS n, min(ts) AS begin FROM r GROUP BY user_id, s")
def _(t: Tables):
    return _kept(t, S.sessions(_events(t)), "complete").select("user_id", "n", F.col("s.start").cast("timestamp_ntz").alias("begin"))


@query("s8_streamed_voice_activity", Q.STREAMED_VOICE)
def _(t: Tables):
    """Frames come in three steps, up to an hour out of order; a user's sound is one stream."""
    return _in_order(t, ["sample"], ["sample", "prob"], lambda: M.VoiceActivity(quiet=2048), "event string, sample long", lambda events: events.select("event_id", F.col("user_id").alias("stream_id"), "ts", (F.col("event_id") * 512).alias("sample"), (F.col("value") / 50).alias("prob")))


@query("s13_streamed_breaker", Q.breaker(3, 86400.0))
def _(t: Tables):
    """Calls come in three steps, up to an hour out of order."""
    calls = lambda events: events.select("event_id", F.col("user_id").alias("service"), "ts", (F.unix_micros("ts") / 1e6).alias("at"), (F.col("event_type") != "error").alias("ok"))
    return _in_order(t, ["at", "event_id"], ["at", "ok"], lambda: M.Breaker(failures=3, rest=86400.0), "at double, state string, passed boolean", calls)


@query("b13_publish_batches", "SELECT event_id, event_type <> 'error' AS sent FROM events")
def _(t: Tables):
    out = work_folder(t)
    send = lambda batch: batch.withColumn("ok", F.col("event_type") != "error")
    S.run_all(_events(t), f"{out}/checkpoint", S.publish(send, f"{out}/sent", f"{out}/failed"))
    read = lambda name, ok: t.spark.read.parquet(f"{out}/{name}").select("event_id", F.lit(ok).alias("sent"))
    return read("sent", True).unionByName(read("failed", False))
