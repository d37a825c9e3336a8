"""The queries registered for the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaybook.llm import jaccard, licenses, neighbours, oracle, packing, pieces, pii, quality, rules, secrets, toxicity
from quaybook.llm.shared import settle, table


def pack_config(**settings: int) -> packing.PackConfig:
    import public_tokenizers

    return packing.PackConfig(public_tokenizers.path("word_bpe_49k.json"), **settings)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), pack_config())


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("key")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), toxicity.fold(F.col("doc_id"), 3)
    rows = settle(quality.described(docs))
    model = quality.train_on(rows, table(spark, sf_dir, "labels"), fold != 1)
    return quality.score_rows(rows, model).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), toxicity.fold(F.col("doc_id"), 5)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold != 0)
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.join(table(spark, sf_dir, "documents"), jaccard.JoinConfig(width=4, percent=85))
    return found.select("doc_id", "n_shingles", "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_documents(table(spark, sf_dir, "documents"), path, with_ids=False).drop("key", "ids")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    span = lambda m: F.concat_ws(":", m["name"], m["start"].cast("string"), m["end"].cast("string"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.name")), ",").alias("licenses"),
        F.array_join(F.transform("matches", span), ",").alias("spans"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_packing,
        op2_personal_data,
        op3_quality_classifier,
        op4_toxic_segments,
        op5_secret_scan,
        op6_nearest_neighbours,
        op7_ngram_jaccard,
        op8_quality_rules,
        op9_sentencepiece,
        op10_license_scan,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_secret_scan": oracle.SECRET_SCAN, "op7_ngram_jaccard": oracle.NGRAM_JACCARD}
