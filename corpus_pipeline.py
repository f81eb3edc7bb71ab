"""A training corpus in five stages, each one of the operators in loquent.llm.

Each stage gets the rows that the one before it kept, written as Parquet and read again; its decisions take effect. All
but the last return the columns of documents. A document without text is kept or dropped as the operators define; extra
columns pass through every stage but the last, and the columns a stage adds are named so that they cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquent.llm import decontaminate, neardup, packing, pii, quality
from loquent.llm.columns import free_name
from loquent.llm.queries import PII_KEY, tokenizer
from loquent.llm.scratch import Scratch

# No single SQL statement expresses the learned, hashed and packed stages; tests compare run() with a plain version.
ORACLE_SQL = None

#: Documents are near copies if they share at least so many in a hundred of their shingles.
NEAR_PERCENT = 85

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    name = free_name(docs, "quality_score")
    return quality.score_rows(docs, model, spark, name).filter(F.col(name) >= quality.CUT).drop(name)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = NEAR_PERCENT) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; of rows equal in doc_id and text, one.

    Rows without a doc_id stay, as they can stand for no group.
    """
    name = free_name(docs, "text_hash")
    kept = neardup.near_duplicates(docs.select("doc_id", "text"), spark, percent).filter("kept and doc_id is not null").select("doc_id", F.col("text_digest").alias(name)).distinct()
    rows = docs.filter("doc_id is not null").withColumn(name, F.xxhash64("text")).join(kept, ["doc_id", name], "left_semi").dropDuplicates(["doc_id", name])
    return rows.select(*_names(docs)).unionByName(docs.filter("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    name = free_name(docs, "leaks")
    return decontaminate.find_leaks(docs, _read(spark, sf_dir, "benchmark"), spark, name).filter(F.size(name) == 0).drop(name)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return pii.redact(docs, spark, PII_KEY).select(*_names(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs.select("doc_id", "text"), spark, tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("near-duplicates", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from documents."""
    scratch = Scratch(spark)
    docs, *used = (_read(spark, sf_dir, "documents"),)
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(*used)
        used = [docs]
    return docs
