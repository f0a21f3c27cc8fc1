"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import decontamination, jaccard_join, language_id, license_scan, line_dedup, packing, quality_model, quality_rules, sql, store, substring_dedup, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.clean(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.col("text").alias("kept"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("identifiers", "|").alias("identifiers"), F.array_join("licenses", "|").alias("licenses"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = store.save(packing.tokenized(_table(spark, sf_dir, "documents")), "pieces")
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), packing.vocabulary_path())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality_model.score(docs, quality_model.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", language_id.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents")).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_license_scan,
        op3_packing,
        op4_token_counts,
        op5_substring_dedup,
        op6_quality_model,
        op7_language_id,
        op8_decontamination,
        op9_quality_rules,
        op10_jaccard_join,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": sql.line_dedup_sql(),
    "op2_license_scan": sql.license_scan_sql(),
    "op8_decontamination": sql.decontamination_sql(),
}
