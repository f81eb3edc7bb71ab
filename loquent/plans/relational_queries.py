"""Queries of the relational layer: scans, filters, joins, top-k, row transforms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from loquent.operators import relational as R
from loquent.plans.registry import Tables, query

AS_OF = datetime(2024, 1, 30, 12)


@query("a10_table_scan", "SELECT event_id, ts, event_type, value FROM events")
def _(t: Tables):
    return t.events.select("event_id", "ts", "event_type", "value")


@query("a11_scan_decode", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("a15_dual_schema_probe", "SELECT event_id, coalesce(CAST(json_extract(props, '$.transcript') AS BIGINT), CAST(json_extract(props, '$.k') AS BIGINT)) AS got FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.coalesce(F.from_json("props", "transcript long")["transcript"], F.from_json("props", "k long")["k"]).alias("got"))


@query("a19_seed_rows", "SELECT * FROM (VALUES ('admin', CAST(1 AS BIGINT)), ('guest', CAST(2 AS BIGINT))) AS v(name, id) UNION ALL (SELECT c_name AS name, c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1)")
def _(t: Tables):
    seeds = t.spark.createDataFrame([("admin", 1), ("guest", 2)], "name string, id long")
    return seeds.unionByName(t.customer.filter("c_mktsegment = 'BUILDING'").orderBy("c_custkey").limit(1).select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id")))


@query("a20_language_dimension", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' END AS language FROM documents")
def _(t: Tables):
    names = t.spark.createDataFrame([("en", "English"), ("de", "German"), ("fr", "French"), ("es", "Spanish")], "lang string, language string")
    return t.documents.select("doc_id", "lang").join(F.broadcast(names), "lang", "left").select("doc_id", "language")


@query("c1_point_lookup", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id = 42")
def _(t: Tables):
    return R.lookup(t.events, "event_id", 42).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("c2_lookup_by_name", "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007' LIMIT 1")
def _(t: Tables):
    return R.lookup(t.customer, "c_name", "Customer#000000007").limit(1).select("c_custkey", "c_name")


@query("c3_by_level", "SELECT event_id, ts FROM events WHERE event_type = 'error'")
def _(t: Tables):
    return R.where_given(t.events, event_type="error").select("event_id", "ts")


@query("c4_by_component", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#4'")
def _(t: Tables):
    return R.where_given(t.part, p_brand="Brand#4").select("p_partkey", "p_name")


@query("c5_by_profile", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7")
def _(t: Tables):
    return R.where_given(t.orders, o_custkey=7).select("o_orderkey", "o_orderdate")


@query("c6_optional_filter", "SELECT event_id FROM events WHERE user_id = 8")
def _(t: Tables):
    return R.where_given(t.events, event_type=None, user_id=8).select("event_id")


@query("c7_conjunction", "SELECT event_id FROM events WHERE event_type = 'error' AND user_id = 8 AND contains(lower(props), '9')")
def _(t: Tables):
    return R.search(R.where_given(t.events, event_type="error", user_id=8), "9", "props").select("event_id")


@query("c8_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')")
def _(t: Tables):
    return R.search(t.part, "RED", "p_name", "p_brand", "p_type").select("p_partkey")


_QUEUE = "SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'pending' ELSE 'completed' END AS status, CASE WHEN user_id % 3 = 0 THEN NULL ELSE ts END AS next_retry_at FROM events"


def _queue(t: Tables):
    return t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "pending").otherwise("completed").alias("status"), F.when(F.col("user_id") % 3 != 0, F.col("ts")).alias("next_retry_at"))


@query("c9_due_items", f"SELECT id FROM ({_QUEUE}) WHERE status = 'pending' AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '2024-01-15 00:00:00')")
def _(t: Tables):
    return R.due(_queue(t), "status", "pending", "next_retry_at", datetime(2024, 1, 15)).select("id")


@query("c10_in_list_and_range", "SELECT event_id FROM events WHERE event_type IN ('error', 'signup') AND ts > TIMESTAMP '2024-01-29 12:00:00'")
def _(t: Tables):
    return R.trailing(t.events.filter(F.col("event_type").isin("error", "signup")), "ts", AS_OF, "24 HOURS").select("event_id")


@query("c11_trailing_day", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR")
def _(t: Tables):
    return R.trailing(t.events, "ts", AS_OF, "24 HOURS").select("event_id", "ts")


@query("c12_month_to_date", "SELECT o_orderkey FROM orders WHERE o_orderdate >= date_trunc('month', TIMESTAMP '2001-07-15 00:00:00')")
def _(t: Tables):
    return R.month_to_date(t.orders, "o_orderdate", datetime(2001, 7, 15)).select("o_orderkey")


@query("c13_named_predicates", "SELECT event_id, event_type = 'error' AND value > 5 AS unresolved, value IS NOT NULL AND event_type <> 'error' AS ok, user_id % 2 = 0 AS active FROM events")
def _(t: Tables):
    named = {"unresolved": (F.col("event_type") == "error") & (F.col("value") > 5), "ok": F.col("value").isNotNull() & (F.col("event_type") != "error"), "active": F.col("user_id") % 2 == 0}
    return t.events.select("event_id", *(p.alias(n) for n, p in named.items()))


@query("c14_json_containment", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def _(t: Tables):
    return t.events.filter(F.get_json_object("props", "$.k") == "42").select("event_id")


@query("c15_full_text", "SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), 'the') AND list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), 'apache')")
def _(t: Tables):
    words = F.split(F.lower("text"), "[^a-z0-9]+")
    return t.documents.filter(F.array_contains(words, "the") & F.array_contains(words, "apache")).select("doc_id")


@query("c16_regex_checks", "SELECT c_custkey, regexp_matches(c_name, '^Customer#[0-9]{9}$') AS ok, regexp_matches(concat(lower(c_mktsegment), '@example.com'), '^[^ @]+@[^ @]+[.][^ @]+$') AS email FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", F.col("c_name").rlike("^Customer#[0-9]{9}$").alias("ok"), F.concat(F.lower("c_mktsegment"), F.lit("@example.com")).rlike("^[^ @]+@[^ @]+[.][^ @]+$").alias("email"))


@query("c20_skip_empty", "SELECT conv_id, turn FROM conversations WHERE trim(text) <> ''")
def _(t: Tables):
    return t.conversations.filter(F.trim("text") != "").select("conv_id", "turn")


@query("c21_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def _(t: Tables):
    return t.events.filter(F.col("ts") >= F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz")).select("event_id")


_WORDS = "SELECT conv_id, turn, CAST(unnest(range(len(string_split(text, ' ')))) AS BIGINT) AS pos, unnest(string_split(text, ' ')) AS word FROM conversations"


def words(t: Tables):
    """conv_id, turn, pos, word: conversations as nested segments flattened to word rows."""
    return t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


@query("c22_flatten_words", _WORDS)
def _(t: Tables):
    return words(t)


@query("c23_derived_state", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN value > 20 THEN 'recording' WHEN value > 5 THEN 'processing' ELSE 'idle' END AS state FROM events")
def _(t: Tables):
    v = F.col("value")
    return t.events.select("event_id", F.when(F.col("event_type") == "error", "error").when(v > 20, "recording").when(v > 5, "processing").otherwise("idle").alias("state"))


@query("c24_generated_duration", "SELECT o_orderkey, CASE WHEN l_shipdate IS NULL THEN NULL ELSE CAST(epoch(l_shipdate) - epoch(o_orderdate) AS BIGINT) END AS seconds, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(t: Tables):
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("o_orderkey", F.timestamp_diff("SECOND", "o_orderdate", "l_shipdate").alias("seconds"), "l_linenumber")


@query("c26_final_messages", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant'")
def _(t: Tables):
    return R.where_given(t.conversations, role="assistant").select("conv_id", "turn")


@query("c27_fallback_row", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'NONE' UNION ALL SELECT CAST(0 AS BIGINT) AS id, 'default' AS name WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'NONE')")
def _(t: Tables):
    found = t.customer.filter("c_mktsegment = 'NONE'").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return R.with_default(found, t.spark.createDataFrame([(0, "default")], "id long, name string"))


@query("j1_recent_activity", "SELECT o_orderkey, o_orderdate, c_name, o_orderstatus FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > TIMESTAMP '2001-07-15 00:00:00' - INTERVAL 24 HOUR")
def _(t: Tables):
    recent = R.trailing(t.orders, "o_orderdate", datetime(2001, 7, 15), "24 HOURS")
    return recent.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_orderdate", "c_name", "o_orderstatus")


_J2 = """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS level, count(DISTINCT CAST(o_orderdate AS DATE)) AS active_days, count(o_orderkey) AS total,
 CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / nullif(count(o_orderkey), 0) AS avg_cents,
 CAST(100 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(o_orderkey), 0) AS success_rate, max(o_orderdate) AS last_at
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderdate >= TIMESTAMP '1997-06-01 00:00:00' GROUP BY 1, 2, 3"""


@query("j2_user_statistics_summary", _J2)
def _(t: Tables):
    profiles = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("level"))
    activity = t.orders.select(F.col("o_custkey").alias("profile_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return R.usage_summary(profiles, activity, "F", F.col("ts") >= F.lit(datetime(1997, 6, 1)).cast("timestamp_ntz"))


@query("j3_top_usage", "SELECT p_name, count(*) AS uses FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_shipdate > TIMESTAMP '2001-01-01 00:00:00' GROUP BY p_name ORDER BY uses DESC, p_name LIMIT 10")
def _(t: Tables):
    used = t.lineitem.filter(F.col("l_shipdate") > F.lit(datetime(2001, 1, 1)).cast("timestamp_ntz")).groupBy("l_partkey").agg(F.count("*").alias("n"))
    return used.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_name").agg(F.sum("n").alias("uses")).orderBy(F.desc("uses"), "p_name").limit(10)


@query("j10_dictionary_lookup", "SELECT n_nationkey, coalesce(CASE n_name WHEN 'NATION_0' THEN 'Alpha' WHEN 'NATION_1' THEN 'Beta' END, n_name) AS name FROM nation")
def _(t: Tables):
    names = t.spark.createDataFrame([("NATION_0", "Alpha"), ("NATION_1", "Beta")], "n_name string, to string")
    return t.nation.join(F.broadcast(names), "n_name", "left").select("n_nationkey", F.coalesce("to", "n_name").alias("name"))


@query("j11_lookup_any_key", "SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'other' END AS code FROM documents")
def _(t: Tables):
    # The dimension once for each of its keys, so that a lookup by name, code or long code is one equality.
    dim = t.spark.createDataFrame([("English", "en", "eng_Latn"), ("French", "fr", "fra_Latn")], "name string, code string, long string")
    keys = dim.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rank"), k.alias("key")) for n, k in enumerate((F.lower("name"), F.col("code"), F.col("long")))))).alias("k"), "code")
    keys = keys.groupBy("k.key").agg(F.min_by("code", "k.rank").alias("code"))
    return t.documents.join(F.broadcast(keys), F.col("lang") == F.col("key"), "left").select("doc_id", F.coalesce("code", F.lit("other")).alias("code"))


@query("j12_correlate", "SELECT a.conv_id, a.turn AS ask, b.turn AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def _(t: Tables):
    ask = t.conversations.filter("role = 'user'").select("conv_id", F.col("turn").alias("ask"), (F.col("turn") + 1).alias("answer"))
    return ask.join(t.conversations.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("answer")), ["conv_id", "answer"]).select("conv_id", "ask", "answer")


@query("j13_name_lookup", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) = lower('RED Widget')")
def _(t: Tables):
    return R.lookup(t.part, "p_name", "RED Widget", ignore_case=True).select("p_partkey", "p_name")


@query("k1_page", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40")
def _(t: Tables):
    return R.newest(t.events, "ts", "event_id", 20, 40).select("event_id", "ts")


@query("k2_newest", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def _(t: Tables):
    return R.newest(t.orders, "o_orderdate", "o_orderkey", 50).select("o_orderkey", "o_orderdate")


@query("k3_by_name", "SELECT c_name FROM customer ORDER BY c_name LIMIT 100")
def _(t: Tables):
    return t.customer.select("c_name").orderBy("c_name").limit(100)


@query("k4_fifo", f"SELECT id FROM ({_QUEUE}) WHERE status = 'pending' ORDER BY id LIMIT 10")
def _(t: Tables):
    return R.oldest(_queue(t).filter("status = 'pending'"), "id", "id", 10).select("id")


@query("k5_nulls_last", f"SELECT id, next_retry_at FROM ({_QUEUE}) ORDER BY next_retry_at DESC NULLS LAST, id LIMIT 30")
def _(t: Tables):
    return _queue(t).select("id", "next_retry_at").orderBy(F.desc_nulls_last("next_retry_at"), "id").limit(30)


@query("k6_two_keys", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderpriority DESC, o_orderkey LIMIT 30")
def _(t: Tables):
    return t.orders.orderBy("o_orderdate", F.desc("o_orderpriority"), "o_orderkey").select("o_orderkey").limit(30)


@query("m1_append", "SELECT event_id AS id FROM events UNION ALL SELECT o_orderkey AS id FROM orders")
def _(t: Tables):
    return t.events.select(F.col("event_id").alias("id")).unionByName(t.orders.select(F.col("o_orderkey").alias("id")))


@query("m2_keep_failed", "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = e.event_id AND o_orderstatus = 'F')")
def _(t: Tables):
    return R.without(t.events.select("event_id"), t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id")), "event_id")


@query("m3_update_by_id", "SELECT c_custkey, CASE WHEN c_custkey = 5 THEN 'ADMIN' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(t: Tables):
    return R.updated(t.customer, F.col("c_custkey") == 5, c_mktsegment=F.lit("ADMIN")).select("c_custkey", "c_mktsegment")


@query("m4_delete", f"SELECT id FROM ({_QUEUE}) WHERE NOT (status = 'completed')")
def _(t: Tables):
    return _queue(t).filter(~(F.col("status") == "completed")).select("id")


@query("m5_retention_delete", "SELECT event_id FROM events WHERE NOT (event_type IN ('view', 'click') AND ts < TIMESTAMP '2024-01-23 00:00:00')")
def _(t: Tables):
    return t.events.filter(~(F.col("event_type").isin("view", "click") & (F.col("ts") < F.lit(datetime(2024, 1, 23)).cast("timestamp_ntz")))).select("event_id")


@query("m6_retry_transition", """SELECT event_id, CASE WHEN event_type = 'error' AND user_id % 5 + 1 < 4 THEN 'pending' WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS next_status,
 CASE WHEN event_type = 'error' THEN user_id % 5 + 1 ELSE user_id % 5 END AS next_retry_count,
 CASE WHEN event_type = 'error' AND user_id % 5 + 1 < 4 THEN CAST(event_id AS DOUBLE) + least(pow(2.0, user_id % 5 + 1), 300.0) END AS next_retry_at FROM events""")
def _(t: Tables):
    items = t.events.select("event_id", "event_type", (F.col("user_id") % 5).alias("retry_count"), F.lit(4).alias("max_retries"), F.col("event_id").cast("double").alias("updated_at"))
    return R.retry_transition(items, F.col("event_type") == "error").select("event_id", "next_status", "next_retry_count", "next_retry_at")


@query("m7_restart_backoff", "SELECT event_id, least(pow(2.0, least(user_id % 10, 6)), 60.0) AS seconds FROM events")
def _(t: Tables):
    return t.events.select("event_id", R.restart_backoff(F.col("user_id") % 10).alias("seconds"))


@query("m8_additive_upsert", "SELECT user_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1 UNION ALL SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1) GROUP BY 1")
def _(t: Tables):
    cut = F.lit(datetime(2024, 1, 15)).cast("timestamp_ntz")
    stored = t.events.filter(F.col("ts") < cut).groupBy("user_id").agg(F.count("*").alias("n"))
    new = t.events.filter(F.col("ts") >= cut).groupBy("user_id").agg(F.count("*").alias("n"))
    return stored.unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n"))


@query("m9_touch", "SELECT event_id, CASE WHEN event_type = 'error' THEN TIMESTAMP '2024-01-30 12:00:00' ELSE ts END AS ts FROM events")
def _(t: Tables):
    return R.updated(t.events, F.col("event_type") == "error", ts=F.lit(AS_OF).cast("timestamp_ntz")).select("event_id", "ts")


@query("m10_log_event", "SELECT CAST(-1 AS BIGINT) AS event_id, 'system' AS event_type UNION ALL SELECT event_id, event_type FROM events")
def _(t: Tables):
    return t.spark.createDataFrame([(-1, "system")], "event_id long, event_type string").unionByName(t.events.select("event_id", "event_type"))


@query("b10_unacknowledged", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def _(t: Tables):
    return R.without(t.events.select("event_id"), t.events.filter("event_type = 'view'"), "event_id")


@query("b19_upsert", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(t: Tables):
    return R.upsert_latest(t.events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("b20_export_logs", "SELECT CAST(to_json({event_id: event_id, event_type: event_type}) AS VARCHAR) AS line FROM (SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10000)")
def _(t: Tables):
    return R.newest(t.events, "ts", "event_id", 10_000).select(F.to_json(F.struct("event_id", "event_type")).alias("line"))


@query("b23_cache_key", "SELECT conv_id, turn, sha256(concat_ws('_', text, role, '1.0')) AS key FROM conversations")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", F.sha2(F.concat_ws("_", "text", "role", F.lit("1.0")), 256).alias("key"))


@query("x1_expectations", """SELECT 'name_length' AS rule, CAST(sum(CASE WHEN length(c_name) BETWEEN 1 AND 100 THEN 0 ELSE 1 END) AS BIGINT) AS broken FROM customer
UNION ALL SELECT 'segment_known' AS rule, CAST(sum(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 0 ELSE 1 END) AS BIGINT) AS broken FROM customer
UNION ALL SELECT 'balance_positive' AS rule, CAST(sum(CASE WHEN c_acctbal >= 0 THEN 0 ELSE 1 END) AS BIGINT) AS broken FROM customer""")
def _(t: Tables):
    return R.violations(t.customer, name_length=F.length("c_name").between(1, 100), segment_known=F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"), balance_positive=F.col("c_acctbal") >= 0)
