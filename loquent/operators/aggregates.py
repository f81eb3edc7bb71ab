"""Group-by, rollup and rate operators over the activity log. Spark plans them as partial and final aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """100 * part / whole as a double, null for a whole of 0."""
    return (F.lit(100) * part).cast("double") / F.nullif(whole, F.lit(0))


def band(value: Column, *edges: tuple[float, str], rest: str) -> Column:
    """The first label whose lower edge the value reaches."""
    out = None
    for edge, label in edges:
        out = F.when(value >= edge, label) if out is None else out.when(value >= edge, label)
    return out.otherwise(rest)


def daily_rollup(df: DataFrame, key: str, ts: str, ok: Column, failed: Column, amount: Column) -> DataFrame:
    """Counts, successes, failures and sum by key and day, from the log's final state; keys of null are left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key, F.to_date(ts).alias("date")).agg(
        F.count("*").alias("command_count"), F.sum(F.when(ok, 1).otherwise(0)).alias("success_count"), F.sum(F.when(failed, 1).otherwise(0)).alias("failure_count"), F.sum(amount).alias("total"),
    )


def peak(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """The most frequent value of each group, the smallest of several."""
    counts = df.groupBy(*keys, value.alias(name)).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(name, F.struct("n", -F.col(name))).alias(name))


def breakdown(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """A map from value to count for each group, counted before it is gathered."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias(name))


def ordered_concat(df: DataFrame, keys: list[str], order: str, text: str, separator: str, name: str) -> DataFrame:
    """Texts of each group in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p[text]), separator).alias(name))


def running(df: DataFrame, key: str, order: list[str], value: Column, width: int = 100) -> DataFrame:
    """Running sum, maximum and mean, and the mean of the last `width` rows, of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    all_ = w.rowsBetween(Window.unboundedPreceding, 0)
    last = w.rowsBetween(1 - width, 0)
    return df.select("*", F.sum(value).over(all_).alias("running_sum"), F.max(value).over(all_).alias("running_max"), (F.sum(value).over(all_).cast("double") / F.count(value).over(all_)).alias("running_mean"), (F.sum(value).over(last).cast("double") / F.count(value).over(last)).alias("rolling_mean"))
