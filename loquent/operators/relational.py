"""Filters, lookups, top-k, joins and row transforms of the log and activity store.

Nothing reads the clock: `as_of` is an argument. Every order that feeds a limit ends in a unique column.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, key: str, value: object, ignore_case: bool = False) -> DataFrame:
    """Rows whose key equals the value."""
    return df.filter(F.lower(key) == str(value).lower() if ignore_case else F.col(key) == value)


def where_given(df: DataFrame, **conditions: object) -> DataFrame:
    """Equality filters; a condition of None asks for nothing."""
    for column, value in conditions.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows in which any column holds the text, whatever its case."""
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.lower(F.col(column).cast("string")).contains(text.lower()), F.lit(False))
    return df.filter(hit)


def due(df: DataFrame, status: str, wanted: str, retry_at: str, now: object) -> DataFrame:
    """Queued items whose retry time has come or was never set."""
    return df.filter((F.col(status) == wanted) & (F.col(retry_at).isNull() | (F.col(retry_at) <= F.lit(now))))


def trailing(df: DataFrame, ts: str, as_of: datetime, interval: str) -> DataFrame:
    """Rows after as_of - interval (C11); the bounds are constants, so they reach the scan."""
    return df.filter(F.col(ts) > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {interval}"))


def month_to_date(df: DataFrame, ts: str, as_of: datetime) -> DataFrame:
    """Rows since the first of as_of's month."""
    return df.filter(F.col(ts) >= F.lit(as_of.replace(day=1, hour=0, minute=0, second=0, microsecond=0)).cast("timestamp_ntz"))


def newest(df: DataFrame, order: str, tie: str, limit: int, offset: int = 0) -> DataFrame:
    """ORDER BY .. DESC LIMIT OFFSET with a unique second key (K1, K2)."""
    return df.orderBy(F.col(order).desc(), F.col(tie).desc()).offset(offset).limit(limit)


def oldest(df: DataFrame, order: str, tie: str, limit: int) -> DataFrame:
    """First in, first out (K4)."""
    return df.orderBy(order, tie).limit(limit)


def last_per_key(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The n newest rows of each key (W11-W13); rows beyond n drop out before the shuffle."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def upsert_latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last write of each key stays."""
    return last_per_key(df, key, order, 1).drop("rn")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in `gone`."""
    return df.join(gone.select(key), key, "left_anti")


def updated(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """UPDATE .. SET .. WHERE as a projection (M3, M9)."""
    for column, value in values.items():
        df = df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))
    return df


def retry_transition(df: DataFrame, failed: Column, retry: str = "retry_count", most: str = "max_retries", now: str = "updated_at") -> DataFrame:
    """Failed items wait min(2^n, 300) seconds, or fail for good at max_retries (M6); n counts this failure."""
    again = failed & (F.col(retry) + 1 < F.col(most))
    wait = F.least(F.pow(F.lit(2.0), F.col(retry) + 1), F.lit(300.0))
    return df.select(
        "*",
        F.when(again, "pending").when(failed, "failed").otherwise("completed").alias("next_status"),
        F.when(failed, F.col(retry) + 1).otherwise(F.col(retry)).alias("next_retry_count"),
        F.when(again, F.col(now) + wait).alias("next_retry_at"),
    )


def restart_backoff(attempt: Column) -> Column:
    """min(2^min(n, 6), 60) seconds (M7)."""
    return F.least(F.pow(F.lit(2.0), F.least(attempt, F.lit(6))), F.lit(60.0))


def usage_summary(profiles: DataFrame, activity: DataFrame, ok: str, on: Column | None = None) -> DataFrame:
    """Per profile: active days, count, mean time, success rate, last time; profiles without activity stay.

    profiles: id, name, level; activity: profile_id, ts, ok_status, cents. Activity is aggregated before the join, so
    what is joined has one row a profile. Money is summed as whole cents and divided once.
    """
    rows = activity if on is None else activity.filter(on)
    sums = rows.groupBy("profile_id").agg(
        F.countDistinct(F.to_date("ts")).alias("active_days"), F.count("*").alias("n"), F.sum("cents").alias("cents"),
        F.sum(F.when(F.col("status") == ok, 1).otherwise(0)).alias("good"), F.max("ts").alias("last_at"),
    )
    out = profiles.join(sums, profiles["id"] == sums["profile_id"], "left")
    n = F.nullif(F.coalesce("n", F.lit(0)), F.lit(0))
    return out.select(
        "id", "name", "level", F.coalesce("active_days", F.lit(0)).alias("active_days"), F.coalesce("n", F.lit(0)).alias("total"),
        (F.col("cents").cast("double") / n).alias("avg_cents"), ((F.lit(100) * F.col("good")).cast("double") / n).alias("success_rate"), "last_at",
    )


def violations(df: DataFrame, **rules: Column) -> DataFrame:
    """Constraints as expectations: a row for each rule with the number of rows that break it, in one pass."""
    counts = df.agg(*(F.sum(F.when(F.coalesce(ok, F.lit(True)), 0).otherwise(1)).alias(name) for name, ok in rules.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.coalesce(F.col(name), F.lit(0)).alias("broken")) for name in rules))
    return counts.select(F.inline(pairs))


def with_default(df: DataFrame, default: DataFrame) -> DataFrame:
    """`df`, or the default rows where it is empty (C27), without an action on the driver."""
    present = df.limit(1).agg(F.count("*").alias("__n"))
    return df.unionByName(default.join(F.broadcast(present.filter("__n = 0")), F.lit(True), "left_semi"))
