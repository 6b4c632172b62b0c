"""Rows out of captured search and snapshot payloads.

Malformed parts are skipped, never errors. Each reader is one generator over its own row, so nothing
is shuffled; arrival order is kept in ``*_pos`` columns because later ties depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V


def _elements(df: DataFrame, keys: list[str], payload: str, path: str, pos: str) -> DataFrame:
    """One row per array element. The outer form, here and elsewhere: from the inner one Catalyst
    infers a filter on the array's size, which would parse every payload twice."""
    return df.select(
        *keys, F.posexplode_outer(V.elements_at(V.variant_of(df, payload), path)).alias(pos, "item")
    ).where(F.col(pos).isNotNull())


def semantic_hits(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """``results[]`` of ``{identifier, score?}``; a score that is not a number counts as 0."""
    item = F.col("item")
    return (
        _elements(df, keys, payload, "$.results", "hit_pos")
        .select(
            *keys,
            V.text_at(item, "$.identifier").alias("summary_id"),
            F.coalesce(V.number_at(item, "$.score"), F.lit(0.0)).alias("score"),
            "hit_pos",
        )
        .where("summary_id <> ''")
    )


def keyword_hits(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """``results[]`` of ``{summary: {id}}``; literal hits carry score 0."""
    return (
        _elements(df, keys, payload, "$.results", "hit_pos")
        .select(
            *keys,
            V.text_at(F.col("item"), "$.summary.id").alias("summary_id"),
            F.lit(0.0).alias("score"),
            "hit_pos",
        )
        .where("summary_id <> ''")
    )


def snapshot_items(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """``items[]`` that are objects, as VARIANT."""
    return _elements(df, keys, payload, "$.items", "item_pos").where(V.is_object(F.col("item")))


def summary_fields(items: DataFrame, keys: list[str]) -> DataFrame:
    """Typed summaries of a snapshot: id, optional name, creation time, listed annotation ids."""
    item = F.col("item")
    return items.select(
        *keys,
        V.text_at(item, "$.id").alias("summary_id"),
        V.text_at(item, "$.name").alias("name"),
        V.text_at(item, "$.created.value").alias("created_at"),
        F.coalesce(
            V.keys_at(item, "$.annotations.indices"), F.array().cast("array<string>")
        ).alias("annotation_ids"),
        F.col("item_pos").cast("bigint").alias("snapshot_pos"),
    )


def annotation_fields(items: DataFrame, keys: list[str]) -> DataFrame:
    """Typed annotations of a snapshot."""
    item = F.col("item")
    return items.select(
        *keys,
        V.text_at(item, "$.id").alias("annotation_id"),
        V.text_at(item, "$.type").alias("type"),
        V.text_at(item, "$.text").alias("text"),
        F.col("item_pos").cast("bigint").alias("ann_pos"),
    )


def listed_annotations(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """One row per annotation id a summary lists."""
    return summaries.select(*keys, F.explode("annotation_ids").alias("annotation_id"))
