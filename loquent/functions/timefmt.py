"""Time and number formats as column expressions; seconds are doubles, `as_of` is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column) -> Column:
    """H:MM:SS, cut to whole seconds; from a day on with `1 day, ` before it."""
    s = F.floor(seconds).cast("long")
    days, rest = F.floor(s / 86400), F.pmod(s, F.lit(86400))
    time = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    return F.when(days == 0, time).otherwise(F.concat(days.cast("string"), F.when(F.abs(days) == 1, " day, ").otherwise(" days, "), time))


def timestamp(seconds: Column, hours: bool = False, mark: str = ".") -> Column:
    """[HH:]MM:SS.mmm, milliseconds rounded half to even."""
    ms = F.bround(seconds * 1000).cast("long")
    h, m, s, rest = F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000), F.floor(ms % 60000 / 1000), ms % 1000
    short = F.format_string(f"%02d:%02d{mark}%03d", m, s, rest)
    return F.concat(F.format_string("%02d:", h), short) if hours else F.when(h > 0, F.concat(F.format_string("%02d:", h), short)).otherwise(short)


def relative(ts: Column, as_of: Column) -> Column:
    """Distance in words with a suffix."""
    minutes = F.round(F.abs(F.timestamp_diff("SECOND", ts, as_of)) / 60).cast("long")

    def count(n: Column, unit: str, about: str = "") -> Column:
        return F.concat(F.lit(about), n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))

    words = (
        F.when(F.abs(F.timestamp_diff("SECOND", ts, as_of)) < 30, "less than a minute")
        .when(minutes < 45, count(minutes, "minute"))
        .when(minutes < 90, "about 1 hour")
        .when(minutes < 1440, count(F.round(minutes / 60).cast("long"), "hour", "about "))
        .when(minutes < 2520, "1 day")
        .when(minutes < 43200, count(F.round(minutes / 1440).cast("long"), "day"))
        .when(minutes < 86400, count(F.round(minutes / 43200).cast("long"), "month", "about "))
        .otherwise(count(F.round(minutes / 43200).cast("long"), "month"))
    )
    return F.when(ts > as_of, F.concat(F.lit("in "), words)).otherwise(F.concat(words, F.lit(" ago")))


def duration_ms(ms: Column) -> Column:
    """`250ms`, or hours, minutes and seconds that are not 0 (E5)."""
    s = F.floor(ms / 1000).cast("long")

    def part(n: Column, unit: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s")))

    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.concat_ws(", ", part(F.floor(s / 3600) % 24, "hour"), part(F.floor(s / 60) % 60, "minute"), part(s % 60, "second")))


def uptime(seconds: Column) -> Column:
    """`1d 2h 3m 4s` without parts of 0; `0s` for none."""
    s = F.floor(seconds).cast("long")

    def part(n: Column, unit: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))

    text = F.concat_ws(" ", part(F.floor(s / 86400), "d"), part(F.floor(s / 3600) % 24, "h"), part(F.floor(s / 60) % 60, "m"), part(s % 60, "s"))
    return F.when(text == "", "0s").otherwise(text)


UNITS = ("Bytes", "KB", "MB", "GB", "TB")


def file_size(n: Column, largest: str = "TB") -> Column:
    """`1.5 KB`, two places without trailing zeros (N16); exact powers, no logarithm. `largest` is the last unit to be used."""
    out = F.lit("0 Bytes")
    for k, unit in enumerate(UNITS[: UNITS.index(largest) + 1]):
        number = F.regexp_replace(F.format_string("%.2f", n.cast("double") / float(1024**k)), r"\.?0+$", "")
        out = F.when(n >= 1024**k, F.concat(number, F.lit(f" {unit}"))).otherwise(out)
    return out


def percentage(value: Column, total: Column) -> Column:
    return F.when(total == 0, "0%").otherwise(F.format_string("%.1f%%", value.cast("double") / total * F.lit(100.0).cast("double")))


def confidence(x: Column) -> Column:
    return F.format_string("%.0f%%", x.cast("double") * F.lit(100).cast("double"))


def decibels(level: Column) -> Column:
    return F.when(level == 0, "-∞ dB").otherwise(F.format_string("%.1f dB", F.lit(20).cast("double") * F.log10(level)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rescale(x: Column, in_low: float, in_high: float, out_low: float, out_high: float) -> Column:
    return (x - F.lit(float(in_low))) * F.lit(float(out_high - out_low)) / F.lit(float(in_high - in_low)) + F.lit(float(out_low))
