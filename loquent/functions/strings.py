"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def hotkey(text: Column) -> Column:
    """`ctrl+shift+a` as `Ctrl + Shift + A`."""
    return F.array_join(F.transform(F.split(text, r"\+"), lambda k: F.concat(F.upper(F.substring(F.trim(k), 1, 1)), F.trim(k).substr(F.lit(2), F.length(k) + 1))), " + ")


def first_number(text: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(text, "([0-9]+)", 1), F.lit("")), F.lit("999999999999999999")).cast("long")


def is_punctuation(text: Column) -> Column:
    return F.trim(text).isin(".", "!", "?")


def strip_prefix(text: Column, prefix: Column) -> Column:
    """What follows a prefix that was already validated."""
    return F.when(F.startswith(text, prefix), F.ltrim(text.substr(F.length(prefix) + 1, F.length(text) + 1))).otherwise(text)


def cue_escape(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit("-->"), F.lit("->"))


def highlight(words: Column, at: Column) -> Column:
    """Words joined, the one at `at` (from 0) underlined."""
    return F.array_join(F.transform(words, lambda w, i: F.when(i == at, F.concat(F.lit("<u>"), w, F.lit("</u>"))).otherwise(w)), " ")


def valid_url(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull(), F.lit(False))


def valid_email(text: Column) -> Column:
    return text.rlike("^[^ \t\r\n@]+@[^ \t\r\n@]+[.][^ \t\r\n@]+$")


def spelling(text: Column, words: dict[str, str]) -> Column:
    """Words exchanged by a map that the caller gives."""
    pairs = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(pairs[w], w)), " ")
