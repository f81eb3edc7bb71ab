"""One query for each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquent.llm import ann, bpe, decontaminate, dialogue, langid, maxent, merkle, neardup, packing, pii, quality, repeats, tokenfile
from loquent.llm.scratch import Scratch


#: The key of the surrogates; a real run is given a secret one.
PII_KEY = "loquent-example-key"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), spark, 85).drop("text_digest")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out() | F.col("doc_id").isNull()))
    return langid.identify(docs, model, spark).select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.redact(_read(spark, sf_dir, "documents").select("doc_id", "text"), spark, PII_KEY)
    return out.select("doc_id", "text", F.size("entities").alias("n_entities"), F.col("entities.kind").alias("kinds"))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Scratch(spark).path("token-files")
    tokenfile.write(_read(spark, sf_dir, "documents").select("doc_id", "text"), spark, tokenizer(), out)
    return tokenfile.read(spark, out, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents").select("doc_id", "text"), spark, tokenizer())


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_leaks(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"), spark)
    return out.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.array_distinct("leaks.item_id").alias("item_ids"), F.array_max("leaks.similarity").alias("similarity"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(~quality.held_out()))
    return quality.score(docs, model, spark).select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5, spark)


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = maxent.score(docs, docs.filter(~maxent.held_out()), spark)
    return out.select("doc_id", maxent.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove(_read(spark, sf_dir, "documents").select("doc_id", "text"), spark)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fields = _read(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    changed = merkle.digest(*(F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in fields))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, changed)
    rows = merkle.prove(docs, spark, fields, tampered=tampered)
    rows = rows.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), spark, tokenizer(), decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    return dialogue.repair(dialogue.damage(rows), rows, spark)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}
