"""Flows over events that arrive in several steps, each taken up by a stream that starts anew from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquent.operators import machines as M
from loquent.plans import fold_sql as Q
from loquent.plans.registry import Tables, query
from loquent.plans.streams_queries import STEPS, in_steps, work_folder
from loquent.streaming import flows as W
from loquent.streaming import streams as S

#: Steps in SQL: equal spans of time.
_STEPS = f"s AS (SELECT *, least(CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * {STEPS} / (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) + 1 FROM events)) AS BIGINT), {STEPS - 1}) AS step FROM events)"


def timed(t: Tables) -> DataFrame:
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("j12_streamed_requests", "SELECT event_id, event_type <> 'error' AND value <= 30 AS answered, CASE WHEN event_type <> 'error' AND value <= 30 THEN CAST(round(value * 1000000) AS BIGINT) END AS delay_us FROM events")
def _(t: Tables):
    """Every event asks; all but errors are answered after `value` seconds, which is too late beyond 30."""
    out = work_folder(t)
    asked = timed(t).select("event_id", "ts")
    answers = timed(t).filter("event_type <> 'error'").select("event_id", F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1_000_000).cast("long")).alias("ts"))
    parts = {}
    for name, rows in (("asked", asked), ("answers", answers)):
        folder = W.landing(t.spark, f"{out}/{name}")
        parts[name] = (folder, rows, W.arrive(rows, folder, W.steps(rows, F.unix_micros("ts"), STEPS), STEPS))
    joined = W.correlate(*(S.read_table(t.spark, folder, rows.schema) for folder, rows, _ in parts.values()), "event_id", "30 seconds", "5 minutes")
    for _ in zip(*(steps for _, _, steps in parts.values()), strict=True):
        S.run_all(joined, f"{out}/checkpoint", f"{out}/rows")
    for folder, rows, _ in parts.values():
        W.end(t.spark, folder, rows.schema)
    S.run_all(joined, f"{out}/checkpoint", f"{out}/rows")
    delay = F.unix_micros("answer_ts") - F.unix_micros("ts")
    return t.spark.read.parquet(f"{out}/rows").select("event_id", F.col("answer_event_id").isNotNull().alias("answered"), delay.alias("delay_us"))


_HANDLED = ("view", "click", "purchase")


@query(
    "a13_consumed_messages",
    "SELECT CASE WHEN event_type = 'error' THEN sha256('{\"event_id\":\"' || event_id) ELSE CAST(event_id AS VARCHAR) END AS id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'processed' ELSE 'failed' END AS state, CASE WHEN event_type = 'click' THEN props END AS response FROM events",
)
def _(t: Tables):
    """Messages of which all are delivered once and views once more in the next step; errors are broken off, sign-ups have no
    handler, and clicks want an answer."""
    out, rows = work_folder(t), timed(t)
    step = W.steps(rows, F.unix_micros("ts"), STEPS)
    reply = F.when(F.col("event_type") == "click", F.concat(F.lit("replies."), "user_id"))
    whole = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), "event_type", F.unix_micros("ts").alias("ts"), reply.alias("reply_to"), F.col("props").alias("payload")))
    text = F.when(F.col("event_type") == "error", F.concat(F.lit('{"event_id":"'), "event_id")).otherwise(whole).alias("value")
    lines = S.read_lines(t.spark, W.landing(t.spark, f"{out}/queue"))
    handle = W.acknowledge(lambda messages: messages.withColumn("response", F.col("body")), f"{out}/read")
    for k in range(STEPS):
        rows.filter(step == k).unionByName(rows.filter((step == k - 1) & (F.col("event_type") == "view"))).select(text).write.mode("append").text(f"{out}/queue")
        S.run_all(W.consume(lines, _HANDLED, "12 hours"), f"{out}/checkpoint", handle)
        S.run_all(W.unreadable(lines), f"{out}/checkpoint-unread", f"{out}/unread")
    good = t.spark.read.parquet(f"{out}/read/ledger").select("id", "state")
    ledger = good.unionByName(t.spark.read.parquet(f"{out}/unread").select("id", "state").distinct())
    replies = t.spark.read.parquet(f"{out}/read/replies").select("id", "response")
    return ledger.join(replies, "id", "left").select("id", "state", "response")


@query(
    "b8_outbox_log_and_drain",
    f"WITH {_STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, step ORDER BY ts DESC, event_id DESC) AS newest FROM s), d AS (SELECT *, CASE WHEN step = 1 AND newest > 10 THEN 'dropped' ELSE 'sent' END AS state, CASE WHEN step = 1 AND newest <= 10 THEN 2 ELSE step END AS batch FROM r) SELECT event_id, state, batch, CASE WHEN state = 'sent' THEN row_number() OVER (PARTITION BY user_id, batch, state ORDER BY ts, event_id) END AS place FROM d",
)
def _(t: Tables):
    """The link is down in the second step: the newest ten events of a user wait, and go first when it is up again."""
    out = work_folder(t)
    box = W.Outbox(t.spark, f"{out}/box", "event_id", "user_id", [F.col("ts")], lambda rows: rows.withColumn("ok", F.lit(True)), lambda k: k != 1, keep=10, newest=[F.col("ts").desc()])
    in_steps(t, timed(t).select("event_id", "user_id", "ts"), f"{out}/in", lambda stream: S.run_all(stream, f"{out}/checkpoint", box))
    place = F.col("place").cast("long")
    sent = box.rows("sent").select("event_id", F.lit("sent").alias("state"), F.col("batch").cast("long").alias("batch"), place.alias("place"))
    return sent.unionByName(box.rows("dropped").select("event_id", F.lit("dropped").alias("state"), F.col("batch").cast("long").alias("batch"), F.lit(None).cast("long").alias("place")))


_BY_PRIORITY = "PARTITION BY event_type ORDER BY step - priority, ts, event_id"


@query(
    "b12_published_by_priority",
    f"""WITH {_STEPS}, p AS (SELECT *, CAST(floor(value / 10) AS BIGINT) % 10 AS priority, (SELECT (count(*) + 29) // 30 FROM events) AS rate FROM s),
a AS (SELECT *, CASE WHEN step = 0 THEN row_number() OVER (PARTITION BY event_type, step ORDER BY step - priority, ts, event_id) END AS n FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY event_type, step > 1 ORDER BY step - priority, ts, event_id) AS m FROM a WHERE n IS NULL OR n > rate),
c AS (SELECT *, row_number() OVER ({_BY_PRIORITY}) AS k FROM b WHERE step > 1 OR m > rate)
SELECT event_id, event_type AS queue, CAST(0 AS BIGINT) AS batch, n AS place FROM a WHERE n <= rate UNION ALL SELECT event_id, event_type, 1, m FROM b WHERE step <= 1 AND m <= rate UNION ALL SELECT event_id, event_type, 2 + (k - 1) // rate, (k - 1) % rate + 1 FROM c""",
)
def _(t: Tables):
    """A thirtieth of all events a queue and batch; priority grows by one for each batch that a message waits."""
    out = work_folder(t)
    rows = timed(t).select("event_id", F.col("event_type").alias("queue"), "ts", (F.floor(F.col("value") / 10) % 10).alias("priority"))
    rate = max(1, (rows.count() + 29) // 30)
    box = W.Outbox(t.spark, f"{out}/box", "event_id", "queue", [F.col("arrived") - F.col("priority"), F.col("ts")], lambda rows: rows.withColumn("ok", F.lit(True)), rate=rate)
    in_steps(t, rows, f"{out}/in", lambda stream: S.run_all(stream, f"{out}/checkpoint", box))
    box.drain(STEPS)
    return box.rows("sent").select("event_id", "queue", F.col("batch").cast("long").alias("batch"), F.col("place").cast("long").alias("place"))


_PATIENCE = 6 * 3600


@query("s19_idle_watchdog", f"SELECT user_id, epoch_us(ts) // 1000 AS last_ms, epoch_us(ts) // 1000 + {_PATIENCE * 1000} AS noticed_ms FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM events) WHERE following IS NULL OR epoch_us(following) // 1000 - epoch_us(ts) // 1000 > {_PATIENCE * 1000}")
def _(t: Tables):
    """Users without events for six hours, told by timers; events come up to an hour out of order."""
    out = work_folder(t)
    rows = lambda stream: W.in_order(stream, "user_id", ["event_id"], ["ts_ms"], lambda: M.Idle(_PATIENCE * 1000, timed=True), "last_ms long, noticed_ms long", "1 hour", patience=_PATIENCE)
    in_steps(t, timed(t).select("event_id", "user_id", "ts"), f"{out}/in", lambda stream: S.run_all(rows(stream), f"{out}/checkpoint", f"{out}/rows"), 3600, True)
    return t.spark.read.parquet(f"{out}/rows").select("user_id", "last_ms", "noticed_ms")


def resets(t: Tables) -> DataFrame:
    """Rows of s4_no_output_resets: a user's events are audio, purchases are output."""
    return timed(t).select("event_id", "user_id", "ts", (F.unix_micros("ts") / 1e6).alias("at"), (F.col("event_type") == "purchase").alias("output"))


@query("s4_no_output_resets", Q.RESETS)
def _(t: Tables):
    """Buffers of half a day without output start anew; events come up to an hour out of order."""
    out = work_folder(t)
    rows = lambda stream: W.in_order(stream, "user_id", ["event_id"], ["at", "output"], lambda: M.NoOutput(43_200.0), "at double, begin double", "1 hour")
    in_steps(t, resets(t), f"{out}/in", lambda stream: S.run_all(rows(stream), f"{out}/checkpoint", f"{out}/rows"), 3600, True)
    return t.spark.read.parquet(f"{out}/rows").select("user_id", "at", "begin")


@query("s17_fan_out", "SELECT 'transcription' AS sink, event_id, props AS payload FROM events WHERE event_type <> 'error' UNION ALL SELECT 'diarization', event_id, 'user ' || user_id FROM events")
def _(t: Tables):
    """One source to two sinks: what is said, and by whom."""
    out = work_folder(t)
    sinks = {"transcription": lambda rows: rows.filter("event_type <> 'error'").select("event_id", F.col("props").alias("payload")), "diarization": lambda rows: rows.select("event_id", F.concat(F.lit("user "), "user_id").alias("payload"))}
    in_steps(t, timed(t), f"{out}/in", lambda stream: S.run_all(stream, f"{out}/checkpoint", W.fan_out(sinks, f"{out}/sinks")))
    return t.spark.read.parquet(f"{out}/sinks").select("sink", "event_id", "payload")


def _health(t: Tables) -> list[dict]:
    out, counters = work_folder(t), W.Counters("client")
    failed = F.col("event_type") == "error"
    counts = {"published": F.count_if(~failed), "failed": F.count_if(failed), "last_us": F.max(F.unix_micros("ts"))}
    in_steps(t, timed(t), f"{out}/in", lambda stream: counters.run(t.spark, stream, counts, lambda df: S.run_all(df, f"{out}/checkpoint", f"{out}/rows")))
    return counters.health


@query("g26_client_counters", "SELECT count(*) FILTER (event_type <> 'error') AS published, count(*) FILTER (event_type = 'error') AS failed, max(epoch_us(ts)) AS last_us FROM events")
def _(t: Tables):
    """Counts that come with the batches as they are written; nothing is read for them."""
    told = _health(t)
    return t.spark.createDataFrame([(sum(h["published"] for h in told), sum(h["failed"] for h in told), max(h["last_us"] for h in told))], "published long, failed long, last_us long")


@query("s23_batch_health", f"WITH {_STEPS} SELECT step AS batch, count(*) AS input_rows, count(*) FILTER (event_type = 'error') * 100 <= count(*) * 20 AS healthy FROM s GROUP BY 1")
def _(t: Tables):
    """One row a batch: healthy if at most a fifth fails."""
    told = [(h["batch"], h["input_rows"], h["failed"] * 100 <= h["input_rows"] * 20) for h in _health(t)]
    return t.spark.createDataFrame(told, "batch long, input_rows long, healthy boolean")


@query("s26_merged_daily_totals", "SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failures FROM events GROUP BY 1, 2")
def _(t: Tables):
    """Changed totals alone leave the stream, and only days that changed are written again."""
    out = work_folder(t)
    table = W.Merged(t.spark, f"{out}/totals", "date", ["user_id", "date"])
    rows = lambda stream: S.daily_totals(stream).select("user_id", F.to_date("day.start").alias("date"), "n", "failures")
    in_steps(t, timed(t), f"{out}/in", lambda stream: S.run_all(rows(stream), f"{out}/checkpoint", table, "update"), 3600)
    return table.read(rows(timed(t)).schema)
