"""File sources and sinks: JSON lines with bad lines set apart, log tails, WAV files, subtitles, write-ahead log."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from loquent.functions import timefmt as E


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad lines (A12); blank lines are neither."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return parsed.filter("row._bad is null").select("row.*").drop("_bad"), parsed.filter("row._bad is not null").select("value")


def tail(spark: SparkSession, path: str, n: int = 500) -> DataFrame:
    """The last lines of text files (A16), by file and place in it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return lines.orderBy(F.desc("file"), F.desc("block"), F.desc("id")).limit(n).select("id", "value")


@F.pandas_udf(StructType([StructField("rate", IntegerType()), StructField("samples", ArrayType(FloatType()))]))
def decode_wav(contents: pd.Series) -> pd.DataFrame:
    """Mono samples in [-1, 1) of 16-bit WAV bytes."""
    rates, samples = [], []
    for raw in contents:
        with wave.open(io.BytesIO(raw)) as w:
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
            rates.append(w.getframerate())
            samples.append((x.mean(1) / 32768).astype(np.float32))
    return pd.DataFrame({"rate": rates, "samples": samples})


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", decode_wav("content").alias("audio")).select("path", "audio.rate", "audio.samples")


def cue(kind: str, number: Column, start: Column, end: Column, text: Column) -> Column:
    """One cue as text."""
    text = F.replace(F.trim(text), F.lit("-->"), F.lit("->"))
    if kind == "txt":
        return text
    if kind == "tsv":
        return F.concat_ws("\t", F.bround(start * 1000).cast("long").cast("string"), F.bround(end * 1000).cast("long").cast("string"), F.replace(text, F.lit("\t"), F.lit(" ")))
    if kind == "json":
        return F.to_json(F.struct(number.alias("id"), start.alias("start"), end.alias("end"), text.alias("text")))
    hours, mark = kind == "srt", "," if kind == "srt" else "."
    times = F.concat(E.timestamp(start, hours, mark), F.lit(" --> "), E.timestamp(end, hours, mark))
    return F.concat_ws("\n", *([number.cast("string")] if kind == "srt" else []), times, text, F.lit(""))


HEADERS = {"vtt": "WEBVTT\n", "tsv": "start\tend\ttext"}


def write_subtitles(segments: DataFrame, path: str, kind: str) -> None:
    """One folder for each stream with its cues in order; `all` writes every kind (B7). Streams are dealt to tasks whole,
    as a subtitle file is; a stream's rows are sorted, not gathered."""
    for one in ("txt", "vtt", "srt", "tsv", "json") if kind == "all" else (kind,):
        rows = segments.select("stream_id", F.col("number"), cue(one, F.col("number"), F.col("start"), F.col("end"), F.col("text")).alias("value"))
        if one in HEADERS:
            head = segments.select("stream_id").distinct().select("stream_id", F.lit(-1).cast("long").alias("number"), F.lit(HEADERS[one]).alias("value"))
            rows = rows.unionByName(head.withColumn("number", F.col("number").cast(rows.schema["number"].dataType)))
        rows.repartition("stream_id").sortWithinPartitions("stream_id", "number").select("stream_id", "value").write.mode("overwrite").partitionBy("stream_id").text(f"{path}/{one}")


def read_subtitles(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """stream_id and the lines (`value`) of the files of one kind that `write_subtitles` made (B7). Each task that lists
    folders takes many of them; by default every folder has a task of its own, up to 10,000."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(4 * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.option("basePath", f"{path}/{kind}").text(f"{path}/{kind}")
    finally:
        spark.conf.set(key, before)


def append_log(events: DataFrame, path: str) -> None:
    """Write-ahead append."""
    events.write.mode("append").json(path)


def replay_log(spark: SparkSession, path: str, schema: str, acknowledged: DataFrame, key: str = "event_id") -> DataFrame:
    """Events of the log that were not acknowledged."""
    good, _ = read_json_lines(spark, path, schema)
    return good.join(acknowledged.select(key), key, "left_anti")


def save_settings(settings: DataFrame, path: str) -> None:
    settings.write.mode("overwrite").json(path)


def load_settings(spark: SparkSession, path: str) -> DataFrame:
    """Exported settings read back."""
    return spark.read.schema("key string, value string").json(path)
