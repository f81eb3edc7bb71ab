"""Queries of the aggregation layer. Money and levels are summed as whole numbers and divided once."""

from __future__ import annotations

from pyspark.sql import functions as F

from loquent.operators import aggregates as A
from loquent.plans.registry import Tables, query

CENTS = "CAST(round(value * 100) AS BIGINT)"


def _cents(column: str = "value"):
    return F.round(F.col(column) * 100).cast("long")


@query("g1_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in ("customer", "orders", "events", "documents")))
def _(t: Tables):
    parts = [getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n") for name in ("customer", "orders", "events", "documents")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("g2_by_status", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("g3_queue_size", "SELECT count(*) AS n FROM events WHERE event_type = 'view'")
def _(t: Tables):
    return t.events.filter("event_type = 'view'").agg(F.count("*").alias("n"))


@query("g4_json_average", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS DOUBLE) / count(*) AS mean_k FROM events GROUP BY 1")
def _(t: Tables):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), (F.sum(F.get_json_object("props", "$.k").cast("long")).cast("double") / F.count("*")).alias("mean_k"))


@query("g5_active_days", "SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def _(t: Tables):
    return t.events.groupBy("user_id").agg(F.countDistinct(F.to_date("ts")).alias("days"))


@query("g6_count_avg_max", f"SELECT event_type, count(value) AS n, CAST(sum({CENTS}) AS DOUBLE) / count(value) AS mean_cents, max(value) AS most FROM events GROUP BY 1")
def _(t: Tables):
    return t.events.groupBy("event_type").agg(F.count("value").alias("n"), (F.sum(_cents()).cast("double") / F.count("value")).alias("mean_cents"), F.max("value").alias("most"))


@query("g7_success_rate", "SELECT o_custkey, CAST(100 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0) AS rate FROM orders GROUP BY 1")
def _(t: Tables):
    return t.orders.groupBy("o_custkey").agg(A.ratio(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)), F.count("*")).alias("rate"))


@query("g8_daily_rollup", f"SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS command_count, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS success_count, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failure_count, CAST(sum({CENTS}) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def _(t: Tables):
    return A.daily_rollup(t.events, "user_id", "ts", F.col("event_type") == "view", F.col("event_type") == "error", _cents())


@query("g9_peak_hour", "SELECT user_id, CAST(arg_max(h, (n, -h)) AS INTEGER) AS peak_hour FROM (SELECT user_id, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables):
    return A.peak(t.events, ["user_id"], F.hour("ts"), "peak_hour")


@query("g9_breakdown", "SELECT user_id, CAST(to_json(map_from_entries(list({k: event_type, v: n} ORDER BY event_type))) AS VARCHAR) AS kinds FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables):
    return A.breakdown(t.events, ["user_id"], "event_type", "kinds").select("user_id", F.to_json("kinds").alias("kinds"))


@query("g9_distinct_commands", "SELECT user_id, CAST(ts AS DATE) AS date, count(DISTINCT event_type) AS unique_commands FROM events GROUP BY 1, 2")
def _(t: Tables):
    return t.events.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.countDistinct("event_type").alias("unique_commands"))


@query("g10_last_active", "SELECT user_id, max(ts) AS last_active FROM events GROUP BY 1")
def _(t: Tables):
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last_active"))


@query("g11_expressions", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS h, CAST(dayofweek(ts) AS INTEGER) AS dow, CAST(length(props) AS INTEGER) AS size FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.hour("ts").alias("h"), (F.dayofweek("ts") - 1).alias("dow"), F.length("props").alias("size"))


@query("g12_daily_rate", "SELECT CAST(ts AS DATE) AS date, CAST(100 * sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS DOUBLE) / nullif(count(*), 0) AS rate FROM events GROUP BY 1")
def _(t: Tables):
    return t.events.groupBy(F.to_date("ts").alias("date")).agg(A.ratio(F.sum(F.when(F.col("event_type") == "error", 0).otherwise(1)), F.count("*")).alias("rate"))


_RUN = f"SELECT event_id, user_id, CAST(sum({CENTS}) OVER a AS BIGINT) AS running_sum, max({CENTS}) OVER a AS running_max, CAST(sum({CENTS}) OVER a AS DOUBLE) / count(value) OVER a AS running_mean, CAST(sum({CENTS}) OVER l AS DOUBLE) / count(value) OVER l AS rolling_mean FROM events WINDOW a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), l AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"


@query("g14_running", _RUN)
def _(t: Tables):
    rows = t.events.select("event_id", "user_id", "ts", _cents().alias("cents"))
    return A.running(rows, "user_id", ["ts", "event_id"], F.col("cents")).drop("ts", "cents")


@query("g13_running_mean", _RUN.replace(", CAST(sum(" + CENTS + ") OVER l AS DOUBLE) / count(value) OVER l AS rolling_mean", "").replace("CAST(sum(" + CENTS + ") OVER a AS BIGINT) AS running_sum, max(" + CENTS + ") OVER a AS running_max, ", ""))
def _(t: Tables):
    rows = t.events.select("event_id", "user_id", "ts", _cents().alias("cents"))
    return A.running(rows, "user_id", ["ts", "event_id"], F.col("cents")).select("event_id", "user_id", "running_mean")


@query("g15_mean_probability", f"SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE coalesce({CENTS}, 0) END) AS DOUBLE) / count(*) AS p FROM events GROUP BY 1")
def _(t: Tables):
    value = F.when(F.col("event_type") != "error", F.coalesce(_cents(), F.lit(0))).otherwise(0)
    return t.events.groupBy("user_id").agg((F.sum(value).cast("double") / F.count("*")).alias("p"))


@query("g16_ordered_concat", "SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def _(t: Tables):
    return A.ordered_concat(t.conversations, ["conv_id"], "turn", "role", " ", "roles")


@query("g17_distinct_values", "SELECT DISTINCT event_type FROM events ORDER BY 1")
def _(t: Tables):
    return t.events.select("event_type").distinct().orderBy("event_type")


@query("g18_banded_rate", "SELECT o_custkey, CASE WHEN rate >= 95 THEN 'success' WHEN rate >= 30 THEN 'warning' ELSE 'error' END AS band FROM (SELECT o_custkey, CAST(100 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0) AS rate FROM orders GROUP BY 1)")
def _(t: Tables):
    rate = A.ratio(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)), F.count("*"))
    return t.orders.groupBy("o_custkey").agg(rate.alias("rate")).select("o_custkey", A.band(F.col("rate"), (95, "success"), (30, "warning"), rest="error").alias("band"))


@query("g19_response_band", "SELECT event_id, CASE WHEN value >= 20 THEN 'slow' WHEN value >= 5 THEN 'fair' ELSE 'fast' END AS band FROM events")
def _(t: Tables):
    return t.events.select("event_id", A.band(F.col("value"), (20, "slow"), (5, "fair"), rest="fast").alias("band"))


@query("g20_all_healthy", "SELECT user_id, bool_and(event_type <> 'error') AS healthy FROM events GROUP BY 1")
def _(t: Tables):
    return t.events.groupBy("user_id").agg(F.bool_and(F.col("event_type") != "error").alias("healthy"))


@query("g21_median_duration", "SELECT user_id, least(0.7, median(value / 100)) AS m FROM events WHERE value > 0 GROUP BY 1")
def _(t: Tables):
    return t.events.filter("value > 0").groupBy("user_id").agg(F.least(F.lit(0.7).cast("double"), F.median(F.col("value") / 100)).alias("m"))


@query("g22_word_probability", f"SELECT user_id, event_type, CAST(sum({CENTS}) AS DOUBLE) / count(*) AS p FROM events GROUP BY 1, 2")
def _(t: Tables):
    return t.events.groupBy("user_id", "event_type").agg((F.sum(_cents()).cast("double") / F.count("*")).alias("p"))


@query("g23_sequence_logprob", f"SELECT user_id, CAST(sum({CENTS}) AS BIGINT) AS total, CAST(sum({CENTS}) AS DOUBLE) / (count(*) + 1) AS mean FROM events GROUP BY 1")
def _(t: Tables):
    return t.events.groupBy("user_id").agg(F.sum(_cents()).alias("total"), (F.sum(_cents()).cast("double") / (F.count("*") + 1)).alias("mean"))


@query("g24_version", "SELECT coalesce(max(event_id), 0) AS version FROM events WHERE event_type = 'none'")
def _(t: Tables):
    return t.events.filter("event_type = 'none'").agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("version"))


@query("g25_table_check", "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT 1 FROM region LIMIT 1)")
def _(t: Tables):
    return t.region.limit(1).agg(F.count("*").alias("n"))


@query("k7_beam_topk", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 6")
def _(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return t.events.withColumn("rn", F.row_number().over(w)).filter("rn <= 6").select("user_id", "event_id", "value")


@query("k8_length_penalty", "SELECT conv_id, arg_max(turn, (CAST(-length(text) AS DOUBLE) / (turn + 1), -turn)) AS best FROM conversations GROUP BY 1")
def _(t: Tables):
    return t.conversations.groupBy("conv_id").agg(F.max_by("turn", F.struct(-F.length("text").cast("double") / (F.col("turn") + 1), -F.col("turn"))).alias("best"))


@query("k9_argmax_map", "SELECT user_id, arg_max(event_type, (n, event_type)) AS best FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables):
    m = A.breakdown(t.events, ["user_id"], "event_type", "kinds")
    top = F.array_max(F.transform(F.map_entries("kinds"), lambda e: F.struct(e["value"], e["key"].alias("k"))))
    return m.select("user_id", top["k"].alias("best"))


@query("k10_greedy", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS best FROM events GROUP BY 1")
def _(t: Tables):
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"))


@query("k11_top_usage", "SELECT l_partkey, count(*) AS uses FROM lineitem GROUP BY 1 ORDER BY uses DESC, l_partkey LIMIT 10")
def _(t: Tables):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "l_partkey").limit(10)


for _name, _n in (("w11_last_n", 10), ("w12_newest_cache", 50), ("w13_ring", 100)):

    @query(_name, f"SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= {_n}")
    def _(t: Tables, n=_n):
        from loquent.operators.relational import last_per_key

        return last_per_key(t.events, "user_id", ["ts", "event_id"], n).select("user_id", "event_id")
