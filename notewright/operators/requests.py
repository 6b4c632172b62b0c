"""Requests: which project, which document, how far back, and the searches that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..functions.values import (
    CATEGORIES,
    DEFAULT_SEARCH_LIMIT,
    DEFAULT_WINDOW_DAYS,
    EARLIEST_MILLIS,
    MAX_SEARCH_LIMIT,
    TARGETS,
)


def target_name(requested: Column) -> Column:
    """One of the two accepted documents, in any case, with or without extension; else null."""
    plain = F.regexp_replace(F.lower(trimmed(requested)), r"\.md\z", "")
    chosen = F.lit(None).cast("string")
    for short, name in TARGETS.items():
        chosen = F.when(plain == short, name).otherwise(chosen)
    return chosen


def window_days(requested: Column) -> Column:
    """A positive whole number of days; absent means the default, anything else null.

    A count beyond a BIGINT becomes the largest one: either reaches back further than any date.
    """
    plain = trimmed(requested)
    return F.when(requested.isNull(), F.lit(DEFAULT_WINDOW_DAYS).cast("bigint")).when(
        plain.rlike(r"^[1-9][0-9]*\z"), F.coalesce(plain.try_cast("bigint"), F.lit(2**63 - 1))
    )


def normalise_requests(requests: DataFrame) -> DataFrame:
    """Adds ``target_name`` and ``days``; null marks an unknown target or invalid days."""
    return requests.withColumns(
        {"target_name": target_name(F.col("target")), "days": window_days(F.col("window_days"))}
    )


def search_limit(days: Column) -> Column:
    """Results asked for per topic: grows with the window, between the default and the ceiling."""
    scaled = F.ceil(days / DEFAULT_WINDOW_DAYS) * DEFAULT_SEARCH_LIMIT
    return F.least(
        F.greatest(scaled, F.lit(DEFAULT_SEARCH_LIMIT)), F.lit(MAX_SEARCH_LIMIT)
    ).cast("bigint")


def window_since(now: Column, days: Column) -> Column:
    """``now``, with or without time zone, less whole days of 24 hours; a day-time interval ignores daylight saving.

    Further back than a date can lie the result is null, and no session is inside the window.
    """
    reach = F.floor((F.unix_millis(now.cast("timestamp")) - EARLIEST_MILLIS) / 86_400_000)
    return now - F.when(days <= reach, F.make_dt_interval(days.cast("int")))


def project_terms(project: Column, aliases: Column) -> Column:
    """Names a project goes by: itself and its aliases, trimmed, in lower case, without blanks."""
    names = F.concat(F.array(project), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.filter(F.transform(names, lambda n: F.lower(trimmed(n))), lambda n: n != "")


def query_texts(projects: DataFrame) -> DataFrame:
    """The two search texts of every project and topic; four rows per project from one generator."""
    topics = F.array(
        *[
            F.struct(
                F.lit(name).alias("category"),
                F.concat(F.lit(f"{topic} in the project "), "project").alias("semantic_text"),
                F.concat("project", F.lit(f" {keyword}")).alias("keyword_text"),
            )
            for name, _, topic, keyword in CATEGORIES
        ]
    )
    return projects.select("project_id", F.inline(topics))
