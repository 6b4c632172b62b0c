"""The diagnostic chain: what a search reaches, and of which types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import PROFILE


def annotation_type_audit(annotations: DataFrame) -> DataFrame:
    """Counts by type; the profile type is marked as never read."""
    return annotations.groupBy("type").agg(F.count("*").alias("n")).select(
        "type", "n", F.coalesce(F.col("type") == PROFILE, F.lit(False)).alias("blocked")
    )


def chain_trace(hits: DataFrame, summaries: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per query: hits, sessions behind them, annotations those list and that exist.

    Each stage is counted on ids alone and joined to the hits' queries at the end. Repeated hits go
    before their sessions' annotations are listed.
    """
    reached = hits.select("query_id", "summary_id").distinct().join(
        summaries.select("summary_id", "annotation_ids"), "summary_id", "left"
    )
    listed = reached.select(
        "query_id",
        "summary_id",
        F.col("annotation_ids").isNotNull().alias("found"),
        F.explode_outer("annotation_ids").alias("annotation_id"),
    )
    known = annotations.select("annotation_id", F.lit(True).alias("known"))
    return (
        listed.join(known, "annotation_id", "left")
        .groupBy("query_id")
        .agg(
            F.countDistinct("summary_id").alias("identifiers"),
            F.countDistinct(F.when(F.col("found"), F.col("summary_id"))).alias("summaries"),
            F.countDistinct(F.when(F.col("known"), F.col("annotation_id"))).alias("annotations"),
        )
    )


def session_listing(summaries: DataFrame) -> DataFrame:
    """Day and title of the retrieved sessions."""
    return summaries.select(
        "summary_id", F.substring("created_at", 1, 10).alias("day"), F.col("name").alias("title")
    )
