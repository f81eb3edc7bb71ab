"""Spark built-ins without a counterpart in the reference, kept under the library's interface."""

from __future__ import annotations

from pyspark.sql import functions as F

from loquent.plans.registry import Tables, query


@query("extra_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def _(t: Tables):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("extra_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(t: Tables):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("extra_set_operators", "(SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id AS k FROM events) EXCEPT SELECT CAST(7 AS BIGINT) AS k")
def _(t: Tables):
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.events.select(F.col("user_id").alias("k"))).exceptAll(t.spark.range(7, 8).select(F.col("id").alias("k")))


@query("extra_as_of", "SELECT e.event_id, arg_max(p.event_id, p.ts) AS before FROM events e JOIN events p ON p.user_id = e.user_id AND p.ts < e.ts AND p.event_type = 'view' WHERE e.event_type = 'purchase' GROUP BY 1")
def _(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    rows = t.events.withColumn("before", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), True).over(w))
    return rows.filter("event_type = 'purchase' and before is not null").select("event_id", "before")


@query("extra_percentiles", "SELECT event_type, median(value) AS p50 FROM events GROUP BY 1")
def _(t: Tables):
    return t.events.groupBy("event_type").agg(F.median("value").alias("p50"))
