"""Requests to hits: both searches of every project and topic; and what one search reaches."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import TRACE_LIMIT
from ..operators.requests import query_texts, search_limit
from ..operators.search import keyword_topk, semantic_topk
from ..operators.sessions import union_hits
from ..operators.trace import annotation_type_audit, chain_trace, session_listing

KEYS = ["project_id", "category"]


def search_hits(
    projects: DataFrame, query_vectors: DataFrame, vectors: DataFrame, documents: DataFrame
) -> DataFrame:
    """``(project_id, category, summary_id, score, hit_pos, strategy)``.

    ``projects`` is ``(project_id, project, days)``; the window decides how many results each search
    may give. ``query_vectors`` embeds the semantic texts of ``query_texts`` by whatever model made
    ``vectors``: ``(project_id, category, query_vector)``.
    """
    limits = projects.select("project_id", search_limit(F.col("days")).alias("allowed"))
    meant = query_vectors.join(limits, "project_id")
    said = query_texts(projects).join(limits, "project_id").withColumnRenamed("keyword_text", "query_text")
    return union_hits(
        semantic_topk(vectors, meant, KEYS, F.col("allowed")),
        keyword_topk(documents, said, KEYS, F.col("allowed")),
    )


class Trace(NamedTuple):
    counts: DataFrame
    types: DataFrame
    sessions: DataFrame


def trace_search(queries: DataFrame, vectors: DataFrame, summaries: DataFrame, annotations: DataFrame) -> Trace:
    """The diagnostic chain of ``(query_id, query_vector)``: the few best hits and what stands behind them.

    ``types`` and ``sessions`` cover what the searches reached, not the whole tables.
    """
    hits = semantic_topk(vectors, queries, ["query_id"], TRACE_LIMIT)
    reached = summaries.join(hits.select("summary_id").distinct(), "summary_id", "left_semi")
    listed = reached.select(F.explode("annotation_ids").alias("annotation_id")).distinct()
    found = annotations.join(listed, "annotation_id", "left_semi")
    return Trace(chain_trace(hits, summaries, annotations), annotation_type_audit(found), session_listing(reached))
