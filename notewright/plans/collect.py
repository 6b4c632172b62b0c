"""Hits to entries; its shuffles are on summary, annotation and project ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import sessions as S
from ..operators.requests import project_terms, window_since


def sessions_in_window(
    projects: DataFrame, hits: DataFrame, summaries: DataFrame, now: Column
) -> DataFrame:
    """Found sessions inside each project's window, without their texts.

    The topic is chosen before the window applies. ``scoped`` says whether the title names the
    project; it is worked out here, on small rows, and used once owners are known.
    ``projects`` is ``(project_id, project, aliases, days)``.
    """
    asked = projects.select(
        "project_id",
        window_since(now, F.col("days")).alias("since"),
        S.term_keys(project_terms(F.col("project"), F.col("aliases"))).alias("keys"),
    )
    found = S.fetch_summaries(S.best_category(hits), summaries).join(asked, "project_id")
    title = S.default_title(F.col("name"))
    return S.window_filter(found, F.col("since")).select(
        "project_id",
        "summary_id",
        "category",
        "score",
        title.alias("title"),
        "created_at",
        "annotation_ids",
        "snapshot_pos",
        S.names_project(title, F.col("keys")).alias("scoped"),
    )


OWNER = ["title", "created_at", "category", "score", "scoped"]


def session_bodies(in_window: DataFrame, annotations: DataFrame) -> DataFrame:
    """Readable annotations of sessions in scope.

    Owners come first, among all sessions of the window: a session out of scope may own an
    annotation that one in scope lists too. Only then do texts join.
    """
    owners = S.annotation_owners(in_window, OWNER).select("project_id", "annotation_id", "owner.*")
    return S.fetch_annotations(
        owners.where("scoped").drop("scoped"), S.allowed_annotations(annotations)
    )


def entries_of(in_window: DataFrame, annotations: DataFrame) -> DataFrame:
    bodies = S.best_body(
        session_bodies(in_window, annotations),
        ["project_id", "summary_id", "title", "created_at", "category", "score"],
    )
    return bodies.select(
        "project_id",
        "summary_id",
        S.entry_category(
            F.col("title"), F.col("text"), F.col("category"), F.col("score")
        ).alias("category"),
        "title",
        "created_at",
        "text",
        "entry_pos",
    )


def collect_entries(
    projects: DataFrame,
    hits: DataFrame,
    summaries: DataFrame,
    annotations: DataFrame,
    now: Column,
) -> DataFrame:
    """``(project_id, summary_id, category, title, created_at, text, entry_pos)``."""
    return entries_of(sessions_in_window(projects, hits, summaries, now), annotations)
