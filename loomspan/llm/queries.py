"""The ten corpus operators as registered queries over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotrain, decontam, hostrules, jaccard, langid, oracles, packing, secretscan, sharding, substring, urlrep
from .shared import Workspace, spread

SHARDS = 24


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table in ("documents", "pages") else df


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers

    return {
        "json_path": public_tokenizers.path("byte_bpe_50k.json"),
        "rank_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
    }


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_files())


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.shard(read(spark, sf_dir, "documents"), SHARDS)
    return placed.withColumns(
        {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return decontam.digest(found)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(read(spark, sf_dir, "documents")).drop("spans")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = cotrain.fit(docs, read(spark, sf_dir, "labels"))
    return Workspace(spark, "cotrain").table(cotrain.scores(docs, model), "scores")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secretscan.digest(secretscan.with_secrets(docs.select("doc_id", "text"), secretscan.train(secretscan.labelled_samples(docs))))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    workspace = Workspace(spark, "langid")
    predicted = workspace.table(langid.predict(docs, langid.fit(docs.filter(~held_out()))), "predicted")
    return predicted.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "runs")


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.filtered(read(spark, sf_dir, "documents"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return urlrep.judged(pages, urlrep.labelled_outcomes(pages, read(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_sharding": op2_sharding,
        "op3_decontamination": op3_decontamination,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_secret_scan": op7_secret_scan,
        "op8_language_id": op8_language_id,
        "op9_host_rules": op9_host_rules,
        "op10_url_reputation": op10_url_reputation,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
