"""The corpus pipeline: each stage reads the Parquet that the one before wrote.

Rows of ``documents`` with the columns doc_id, text, lang, source, n_chars go through; every stage works
on what the one before kept, never on the table itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm.bpe import decode, encode
from notewright.llm.decontaminate import benchmark_hits
from notewright.llm.line_rules import quality_rules
from notewright.llm.shared import shared_folder
from notewright.llm.shingle_join import shingle_components
from notewright.llm.suffix_dedup import without_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line and base rules keep, their texts as they are.

    Rows of one doc_id are kept or rejected together; rows without a doc_id are kept.
    """
    rejected = quality_rules(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every component of linked documents.

    Repeated rows of one doc_id become one; rows without a doc_id are kept.
    """
    found = shingle_components(docs)
    other = found.where("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(other, "doc_id", "left_anti").select(*COLUMNS)
    known = left.where("doc_id is not null").dropDuplicates(["doc_id"])
    return known.unionByName(left.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings that start in an earlier document too; n_chars follows."""
    left = without_repeats(docs, ("lang", "source"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word of a benchmark window."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return benchmark_hits(docs, benchmark, COLUMNS).where(F.size("spans") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids of the text, their number, and digests of ids and decoded text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = encode(docs.select("doc_id", "lang", "source", "text"), path).drop("text")
    return decode(encoded, path).select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontaminated),
    ("bpe_encoding", tokens),
]

#: Subword ids have no SQL form; a test holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written to the shared folder and read back."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
