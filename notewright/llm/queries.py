"""Queries over whole tables, one an operator, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .bpe import decode, encode
from .chat import ROTATED_SQL, rotated_dialogues
from .decontaminate import benchmark_hits
from .extraction import ARTICLES_SQL, main_text, own_labelled_pages
from .fm_dedup import repeated_passages
from .hard_negatives import NEGATIVES_SQL, hard_negatives
from .licenses import scan_licenses
from .line_rules import quality_rules
from .merkle import PROOFS_SQL, proofs, without_line_feeds
from .rule_ensemble import quality_scores
from .sharding import interleaved_shards
from .shingle_join import shingle_components
from .suffix_dedup import repeated_bytes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 40


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _spanned() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])


@query
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return interleaved_shards(table(spark, folder, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"))


@query
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = encode(table(spark, folder, "documents").select("doc_id", "text"), path).drop("text")
    return decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", _spanned().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


@query
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_bytes(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", _spanned().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


@query
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(table(spark, folder, "documents")).select(
        "doc_id", "n_words", _spanned().alias("n_removed"), "kept_sha256"
    )


@query
def op10_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_components(table(spark, folder, "documents"))


@query
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files under source and language; every tenth and hundredth is its directory's license file."""
    files = table(spark, folder, "documents").selectExpr(
        "doc_id as file_id", "text",
        """concat_ws('/', source, lang, case when doc_id % 100 = 0 then concat('LICENSE-', doc_id)
          when doc_id % 10 = 0 then concat_ws('/', doc_id div 1000, concat('LICENSE-', doc_id))
          else concat_ws('/', doc_id div 1000, doc_id div 100, concat(doc_id, '.txt')) end) as path""",
    )
    return scan_licenses(files).withColumnRenamed("file_id", "doc_id")


@query
def op6_rule_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    scores = quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scores.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


@query
def op9_chat_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    return rotated_dialogues(table(spark, folder, "conversations"))


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives(table(spark, folder, "embeddings"))


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return proofs(table(spark, folder, "documents"), without_line_feeds(F.col("doc_id"), F.col("text")))


@query
def op13_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"), own_labelled_pages(spark))


ORACLES |= {
    "op2_quality_rules": oracle.QUALITY_RULES,
    "op5_suffix_dedup": oracle.SUFFIX_DEDUP,
    "op7_decontamination": oracle.DECONTAMINATION,
    "op8_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op9_chat_perspectives": ROTATED_SQL,
    "op10_shingle_join": oracle.SHINGLE_JOIN,
    "op11_hard_negatives": NEGATIVES_SQL,
    "op12_merkle_manifest": PROOFS_SQL,
    "op13_html_extraction": ARTICLES_SQL,
}
