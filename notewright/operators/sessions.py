"""From search hits to session entries: best topic, window, annotations, body, title scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, occurrences, phrase, tokens
from ..functions.values import (
    CATEGORIES,
    CATEGORY_NAMES,
    DESCRIPTION,
    MINIMUM_RUN_ON_LENGTH,
    SUMMARY,
    UNTITLED,
)
from .positions import global_positions

KEYWORDS = {name: keyword for name, _, _, keyword in CATEGORIES}


def category_order(category: Column) -> Column:
    """The place of a topic in the fixed order; unknown topics go last."""
    place = F.array_position(F.array(*map(F.lit, CATEGORY_NAMES)), category).cast("int")
    return F.when(place > 0, place).otherwise(F.lit(len(CATEGORY_NAMES) + 1))


def union_hits(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """Both strategies as one table, each hit tagged with where it came from."""
    return semantic.withColumn("strategy", F.lit("semantic")).unionByName(
        keyword.withColumn("strategy", F.lit("keyword"))
    )


def best_category(hits: DataFrame) -> DataFrame:
    """Per project and summary the topic of its highest score.

    Ties go to the earliest hit: topic order, then meaning before keyword, then result position.
    One aggregate with map-side partials, so a summary with very many hits is reduced before the
    shuffle.
    """
    rank = F.struct(
        "score",
        (-category_order(F.col("category"))).alias("c"),
        F.when(F.col("strategy") == "semantic", 0).otherwise(-1).alias("s"),
        (-F.col("hit_pos")).alias("p"),
    )
    return (
        hits.groupBy("project_id", "summary_id")
        .agg(F.max(F.struct(rank.alias("r"), "category")).alias("best"))
        .select("project_id", "summary_id", "best.category", F.col("best.r.score").alias("score"))
    )


def fetch_summaries(best: DataFrame, summaries: DataFrame) -> DataFrame:
    """The sessions behind the hits."""
    return best.join(summaries, "summary_id")


def window_filter(summaries: DataFrame, since: Column) -> DataFrame:
    """Sessions created at or after ``since``; a missing or unreadable date drops the session.

    A date starts with its year; a bare time of day, which Spark reads as today's, is unreadable.
    """
    dated = F.col("created_at").cast("string").rlike(r"^\s*[+-]?[0-9]{4,6}(?![0-9:])")
    return summaries.where(F.when(dated, F.try_to_timestamp("created_at")) >= since)


def annotation_owners(summaries: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``(project_id, annotation_id, owner)``: of several sessions listing one, the last owns it.

    Only ids and the columns in ``keep`` travel here; texts join later.
    """
    carried = ["summary_id", *(keep or [])]
    listed = summaries.select(
        "project_id", "snapshot_pos", F.struct(*carried).alias("owner"),
        F.explode("annotation_ids").alias("annotation_id"),
    )
    return listed.groupBy("project_id", "annotation_id").agg(
        F.max(F.struct("snapshot_pos", "owner"))["owner"].alias("owner")
    )


def allowed_annotations(annotations: DataFrame) -> DataFrame:
    """Annotations of the two readable types with an id and a text. Profiles are never read."""
    return annotations.where(
        F.col("type").isin(SUMMARY, DESCRIPTION)
        & (F.col("annotation_id") != "")
        & (F.col("text") != "")
    )


def fetch_annotations(owners: DataFrame, annotations: DataFrame) -> DataFrame:
    return owners.join(annotations, "annotation_id")


def best_body(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """One text per session: its last summary, else its first description.

    ``entry_pos`` is the first allowed annotation's position, whichever text wins.
    """
    is_summary = F.col("type") == SUMMARY
    last_summary = F.max(F.when(is_summary, F.struct("ann_pos", "text")))["text"]
    first_description = F.min(
        F.when(F.col("type") == DESCRIPTION, F.struct("ann_pos", "text"))
    )["text"]
    return bodies.groupBy(*keys).agg(
        F.coalesce(last_summary, first_description).alias("text"),
        F.min("ann_pos").alias("entry_pos"),
    )


def default_title(name: Column) -> Column:
    """A missing title gets a fixed label; an empty one stays empty."""
    return F.coalesce(name, F.lit(UNTITLED))


def keyword_category(text: Column, keywords: dict[str, str] | None = None) -> Column:
    """The topic whose keyword occurs most, as a substring; ties by topic order, none gives null."""
    low = F.lower(text)
    counted = F.array_max(
        F.array(
            *[
                F.struct(
                    occurrences(low, keyword).alias("n"),
                    F.lit(-place).alias("o"),
                    F.lit(name).alias("category"),
                )
                for place, (name, keyword) in enumerate((keywords or KEYWORDS).items())
            ]
        )
    )
    return F.when(counted["n"] > 0, counted["category"])


def entry_category(title: Column, text: Column, hit_category: Column, score: Column) -> Column:
    """The hit's topic, unless its score decides nothing: then the topic the text speaks of most."""
    undecided = score.isNull() | (score <= 0)
    spoken = F.when(undecided, keyword_category(F.concat(title, F.lit("\n"), text)))
    return F.coalesce(spoken, hit_category, F.lit(CATEGORY_NAMES[0]))


def term_keys(terms: Column) -> Column:
    """Per project term the word sequence to look for, and its words run on as one."""

    def key(term: Column) -> Column:
        words = tokens(term)
        joined = F.array_join(words, "")
        return F.struct(
            F.concat(F.lit(" "), phrase(words), F.lit(" ")).alias("words"),
            F.when(F.length(joined) >= MINIMUM_RUN_ON_LENGTH, joined).alias("run_on"),
        )

    return F.filter(F.transform(terms, key), lambda k: F.length(k["words"]) > 2)


def names_project(title: Column, keys: Column) -> Column:
    """True when the title names any term: its words in sequence, or words that run on as the term's.

    So ``fern grid`` is found in ``ferngrid`` and the other way round, in whole words only. Which words
    those are is asked only where the title without spaces holds the term without spaces.
    """

    def named(words: Column, padded: Column, whole: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(words))

        def runs_on(term: Column) -> Column:
            def from_word(first: Column) -> Column:
                return F.exists(
                    places, lambda last: F.array_join(F.slice(words, first, F.greatest(last - first + 1, F.lit(0))), "") == term
                )

            return F.contains(whole, term) & F.exists(places, from_word)

        return F.exists(
            keys,
            lambda k: F.contains(padded, k["words"]) | F.coalesce(runs_on(k["run_on"]), F.lit(False)),
        )

    # A title is taken apart once, not once for every term and use.
    def taken_apart(words: Column) -> Column:
        return F.struct(words.alias("words"), F.concat(F.lit(" "), phrase(words), F.lit(" ")).alias("padded"), F.array_join(words, "").alias("whole"))

    return let(let(tokens(title), taken_apart), lambda t: named(t["words"], t["padded"], t["whole"]))


def title_scope(entries: DataFrame, projects: DataFrame) -> DataFrame:
    """Entries whose title names their project. ``projects`` is ``(project_id, terms)``.

    An equi join on the project; the terms of one project are one row, so nothing is paired beyond
    an entry and its own project, and a project with very many entries can be split by AQE.
    """
    keyed = projects.select("project_id", term_keys(F.col("terms")).alias("_keys"))
    return (
        entries.join(keyed, "project_id")
        .where(names_project(F.col("title"), F.col("_keys")))
        .drop("_keys")
    )


def recency_order(entries: DataFrame) -> DataFrame:
    """``(project_id, summary_id, position)``: newest first by the date's text, stable on arrival."""
    slim = entries.select("project_id", "summary_id", "created_at", "entry_pos")
    return global_positions(
        slim,
        ["project_id"],
        [F.col("created_at").desc(), F.col("entry_pos").asc(), F.col("summary_id").asc()],
    ).select("project_id", "summary_id", "position")
