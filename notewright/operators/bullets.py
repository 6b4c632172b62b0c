"""Bullets: found in session texts, filtered, redacted, capped.

The cheap tests on a line's own text run first, then the ones that join, and redaction last on what
is left. All of them run before the cap, so the order among the tests does not change the result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.redaction import mentions_denied, redact
from ..functions.text import (
    LINE_BREAK,
    LINE_ENDS,
    SPACE,
    WORD_END,
    WS,
    evaluated,
    left_trimmed,
    let,
    squash_spaces,
    trimmed,
)
from ..functions.values import (
    IRREGULAR_PAST,
    LINK_SCHEME,
    MAX_BULLET_LENGTH,
    MAX_BULLETS_PER_ENTRY,
    PENDING_OPENINGS,
)
from .vocabulary import anchored, mentions_person

# --- fixed values: the marks of bullets, the forms of links, subjects and placeholders ---------------------------
BULLET_MARKS = ["-", "*"]
BARE_LINK = rf"^\[[^\]]*\]\([^)]*\)[.{WS}]*\z"
PENDING = "(?i)^(?:" + "|".join(PENDING_OPENINGS) + ")" + WORD_END
SUBJECT = rf"(?i)^(?:you|we|the user|user)[{WS}]+"
PLACEHOLDER_FIRST = rf"(?i)^[`{WS}]*\[(?:redacted|local path|phone|email)\]"
PLACEHOLDER_LAST = rf"(?i)\[(?:redacted|local path|phone|email)\][{WS}]*\z"
TITLE_SEPARATOR = rf"(?i){SPACE}+and{SPACE}+"


def bullet_content(line: Column) -> Column:
    """A bullet line's text without emphasis marks, trimmed; null for any other line.

    A bullet is a mark, white space before it or none, white space after it, then text to the end
    that holds no line end of any kind. Byte-level string functions do this several times faster
    than a pattern.
    """

    def after_mark(start: Column) -> Column:
        return F.when(F.substring(start, 1, 1).isin(BULLET_MARKS), F.substring(start, 2, 1 << 30))

    def text(after: Column) -> Column:
        return let(
            left_trimmed(after),
            lambda rest: F.when(
                (F.length(rest) < F.length(after))
                & ~reduce(or_, [F.contains(rest, F.lit(end)) for end in LINE_ENDS]),
                trimmed(F.replace(rest, F.lit("**"), F.lit(""))),
            ),
        )

    return let(let(left_trimmed(line), after_mark), text)


def bullet_lines(entries: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus ``(line_pos, content)`` of every bullet that has content.

    The generator makes the contents themselves: later filters cannot move below it, so a line is
    taken apart once however many tests look at its content.
    """
    contents = F.transform(F.split(text, LINE_BREAK), bullet_content)
    return entries.select(*keep, F.posexplode_outer(contents).alias("line_pos", "content")).where(
        "content <> ''"
    )


def is_bare_link(content: Column) -> Column:
    return content.rlike(BARE_LINK)


def is_pending(content: Column) -> Column:
    """Opens with an imperative: work still to do. Tested before any subject is removed."""
    return content.rlike(PENDING)


def is_past_tense(content: Column) -> Column:
    """The first word, after one leading subject, ends in "ed" or is an irregular past form."""
    word = F.lower(F.regexp_extract(F.regexp_replace(content, SUBJECT, ""), "^([A-Za-z]+)", 1))
    return word.endswith("ed") | word.isin(IRREGULAR_PAST)


def is_placeholder(scrubbed: Column) -> Column:
    """Nothing left, or it opens or ends with a placeholder."""
    return (
        (scrubbed == "") | scrubbed.rlike(PLACEHOLDER_FIRST) | scrubbed.rlike(PLACEHOLDER_LAST)
    )


def truncate_bullet(text: Column) -> Column:
    """Cut at 280 characters, counted as code points."""
    return F.when(
        F.length(text) > MAX_BULLET_LENGTH,
        F.concat(F.substring(text, 1, MAX_BULLET_LENGTH), F.lit("…")),
    ).otherwise(text)


def deny_filter(df: DataFrame, content: str = "content", denied: str = "denied") -> DataFrame:
    """Drops rows whose text, not yet redacted, holds a denied term."""
    return df.where(~mentions_denied(F.col(content), F.col(denied)))


def first_bullets(bullets: DataFrame, ids: list[str]) -> DataFrame:
    """The first six accepted bullets of every entry, in line order."""
    nth = F.row_number().over(Window.partitionBy("project_id", *ids).orderBy("line_pos"))
    return bullets.withColumn("nth", nth).where(F.col("nth") <= MAX_BULLETS_PER_ENTRY)


def accepted_bullets(
    entries: DataFrame,
    keys: DataFrame,
    ids: list[str],
    keep: list[str],
    scheme: str = LINK_SCHEME,
) -> DataFrame:
    """All filters and the redaction: ``(project_id, ids, keep, line_pos, bullet)``, uncapped.

    ``entries`` carries ``text`` and the project's ``denied`` array; ``keys`` are the vocabulary's
    anchor keys.
    """
    scrubbed = evaluated(_telling_lines(entries, keys, ids, keep, scheme), "scrubbed", _scrubbed(scheme))
    return _told(scrubbed, ["project_id", *ids, *keep])


def first_accepted_bullets(
    entries: DataFrame,
    keys: DataFrame,
    ids: list[str],
    keep: list[str],
    scheme: str = LINK_SCHEME,
) -> DataFrame:
    """``first_bullets`` of ``accepted_bullets``, without redacting what an entry's first six leave out.

    Whether a line counts is known once it is redacted, so twice as many lines as can be kept are redacted first, and the others only
    of entries that have not got six from these.
    """
    entry = Window.partitionBy("project_id", *ids)
    is_early = F.col("_place") <= 2 * MAX_BULLETS_PER_ENTRY
    placed = _telling_lines(entries, keys, ids, keep, scheme).withColumn("_place", F.row_number().over(entry.orderBy("line_pos")))
    early = evaluated(placed, "_early", F.when(is_early, _scrubbed(scheme))).withColumn(
        "_found", F.count_if(~is_placeholder(F.col("_early"))).over(entry)
    )
    late = F.when(F.col("_found") < MAX_BULLETS_PER_ENTRY, _scrubbed(scheme))
    scrubbed = evaluated(early, "scrubbed", F.when(is_early, F.col("_early")).otherwise(late))
    return first_bullets(_told(scrubbed, ["project_id", *ids, *keep]), ids)


def _telling_lines(entries: DataFrame, keys: DataFrame, ids: list[str], keep: list[str], scheme: str) -> DataFrame:
    """Bullet lines that pass every test on the line as it was written."""
    content = F.col("content")
    lines = bullet_lines(entries, ["project_id", *ids, *keep, "denied"])
    own = lines.where(
        is_past_tense(content)
        & ~is_pending(content)
        & ~is_bare_link(content)
        & ~mentions_person(content, scheme)
    )
    return anchored(deny_filter(own), keys, [*ids, "line_pos"], "content", scheme)


def _scrubbed(scheme: str) -> Column:
    return squash_spaces(redact("content", "denied", scheme))


def _told(scrubbed: DataFrame, names: list[str]) -> DataFrame:
    return scrubbed.where(~is_placeholder(F.col("scrubbed"))).select(
        *names, "line_pos", truncate_bullet(F.col("scrubbed")).alias("bullet")
    )


def trim_titles(
    entries: DataFrame, keys: DataFrame, ids: list[str], scheme: str = LINK_SCHEME
) -> DataFrame:
    """Redacts titles and keeps, of titles joined by "and", the parts the vocabulary anchors.

    When no part is anchored the title stays whole. ``entries`` carries ``title`` and ``denied`` and
    is read twice.
    """
    title = squash_spaces(redact("_title", "denied", scheme))
    clean = evaluated(entries.withColumnRenamed("title", "_title"), "title", title).drop("_title")
    parts = clean.select(
        "project_id", *ids, F.posexplode_outer(F.split("title", TITLE_SEPARATOR)).alias("part_pos", "part")
    )
    chosen = F.array_sort(F.collect_list(F.struct("part_pos", "part")))
    kept = (
        anchored(parts, keys, [*ids, "part_pos"], "part", scheme)
        .groupBy("project_id", *ids)
        .agg(F.array_join(F.transform(chosen, lambda c: c["part"]), " and ").alias("kept"))
    )
    return (
        clean.join(kept, ["project_id", *ids], "left")
        .withColumn("title", F.when(F.size(F.split("title", TITLE_SEPARATOR)) > 1, F.coalesce("kept", "title")).otherwise(F.col("title")))
        .drop("kept")
    )
