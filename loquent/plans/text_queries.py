"""Queries of normalisers, signatures and text sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loquent.functions import normalize as T
from loquent.plans.fold_sql import cues
from loquent.plans.folds_queries import timed
from loquent.plans.intervals_queries import TOKENS
from loquent.plans.registry import Tables, query
from loquent.sources.files import cue


@query("t1_diacritics")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", T.without_diacritics("text").alias("text"))


@query("t2_symbols")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", T.without_symbols("text").alias("text"))


@query("t3_basic_normalizer")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", T.basic(F.col("text")).alias("text"))


@query("t4_graphemes")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", T.graphemes(F.col("text")).alias("text"))


@query("t5_english_contractions")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", T.contractions(F.col("text")).alias("text"))


@query("t6_number_words")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", T.numbers(F.concat(F.lit("twenty one dollars and "), "text")).alias("text"))


@query("t7_english_normalizer")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", T.english(F.col("text")).alias("text"))


@query("t9_compression_ratio")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", T.compression_ratio("text").alias("ratio"))


@query("t15_words_from_pieces", f"WITH {TOKENS} SELECT stream_id, count(*) AS words FROM timed GROUP BY 1")
def _(t: Tables):
    from loquent.operators.intervals import islands
    from loquent.plans.intervals_queries import tokens

    pieces = tokens(t).select("stream_id", "seq", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.concat(F.lit(" "), F.substring("text", 1, 2)).alias("piece")), F.struct(F.lit(1).alias("k"), F.col("text").substr(F.lit(3), F.length("text") + 1).alias("piece")))).alias("p"))
    ordered = pieces.select("stream_id", (F.col("seq") * 2 + F.col("p.k")).alias("at"), "p.piece")
    return islands(ordered, ["stream_id"], "at", F.col("piece").startswith(" ")).groupBy("stream_id").agg(F.countDistinct("island").alias("words"))


@query("t16_sentences", "SELECT conv_id, turn, len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS n FROM conversations")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


def _keyed(key: str, column: str) -> str:
    """HMAC-SHA256 in SQL: the key's two pads around two digests."""
    inner, outer = (bytes(b ^ pad for b in key.encode().ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({column}))))"


@query("t21_signature", f"SELECT event_id, {_keyed('key', 'props')} AS signature FROM events")
def _(t: Tables):
    return t.events.select("event_id", T.signature("key")("props").alias("signature"))


for _kind in ("txt", "vtt", "srt", "tsv", "json"):

    @query(f"b{2 + ('txt', 'vtt', 'srt', 'tsv', 'json').index(_kind)}_{_kind}_cues", cues(_kind))
    def _(t: Tables, kind=_kind):
        w = Window.partitionBy("stream_id").orderBy("start")
        rows = timed(t).groupBy("stream_id", "speaker", F.floor(F.col("seq") / 20).alias("k")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"))
        rows = rows.withColumn("number", F.row_number().over(w))
        return rows.select("stream_id", "number", cue(kind, F.col("number"), F.col("start"), F.col("end"), F.col("text")).alias("cue"))
