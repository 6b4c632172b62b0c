"""Rendered entries, merging with earlier ones, and the block between its markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.redaction import mentions_denied, redact
from ..functions.text import NOT_EOL, right_trimmed
from ..functions.values import (
    BLOCK_TITLE,
    CATEGORIES,
    LINK_SCHEME,
    MARKER_END,
    MARKER_START,
    MAX_ENTRIES_PER_CATEGORY,
    PROVENANCE,
)
from .sessions import category_order

# --- fixed values: the forms of section and entry headings ----------------------------------------
SECTION_LINE = rf"### ({NOT_EOL}+)"
ENTRY_LINE = rf"\*\*{NOT_EOL}+\*\* — ([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})"

RENDERED = ["project_id", "category", "day", "heading", "bullets", "is_kept", "created_at", "pos"]


def category_of_heading(heading: Column) -> Column:
    """The topic of a section heading; null for any other heading."""
    found = F.lit(None).cast("string")
    for name, title, _, _ in CATEGORIES:
        found = F.when(heading == title, name).otherwise(found)
    return found


def heading_of_category(category: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, title, _, _ in CATEGORIES:
        found = F.when(category == name, title).otherwise(found)
    return found


def section_category(sections: DataFrame) -> DataFrame:
    """Adds ``category`` to ``(…, heading)`` and drops sections with an unknown heading."""
    return sections.withColumn("category", category_of_heading(F.col("heading"))).where(
        "category is not null"
    )


def render_entries(bullets: DataFrame, ids: list[str]) -> DataFrame:
    """One row per entry with at least one bullet, from its at most six bullet rows.

    ``bullets`` carries the entry's ``category``, ``title``, ``created_at`` and ``entry_pos``.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_pos", "bullet")))
    grouped = bullets.groupBy("project_id", *ids).agg(
        F.max(F.struct("category", "title", "created_at", "entry_pos")).alias("e"),
        F.transform(ordered, lambda b: F.concat(F.lit("- "), b["bullet"])).alias("bullets"),
    )
    return grouped.select("project_id", *ids, "e.*", "bullets")


def fresh_entries(rendered: DataFrame) -> DataFrame:
    """Rendered entries in the pool's shape. The day is the date text's first ten characters."""
    day = F.substring("created_at", 1, 10)
    return rendered.select(
        "project_id",
        "category",
        day.alias("day"),
        F.concat(F.lit("**"), "title", F.lit("** — "), day).alias("heading"),
        "bullets",
        F.lit(0).alias("is_kept"),
        "created_at",
        F.col("entry_pos").cast("bigint").alias("pos"),
    )


def entry_body(heading: Column, bullets: Column) -> Column:
    return F.concat(heading, F.lit("\n\n"), F.array_join(bullets, "\n"))


def _first_line(heading: Column) -> Column:
    return F.substring_index(heading, "\n", 1)


def parse_block(notes: DataFrame) -> DataFrame:
    """Entries of the first block in ``(project_id, content)``, in the pool's shape.

    A document is split inside its row, at section lines and then at entry headings, so nothing is
    shuffled. Entries need a known section above them and at least one bullet.
    """
    start = F.instr("content", MARKER_START)
    end = F.instr("content", MARKER_END)
    inside = F.regexp_replace(F.col("content").substr(start, end - start), "\r\n", "\n")
    sections = (
        notes.where((start > 0) & (end > start))
        .select("project_id", inside.alias("inside"))
        .select(
            "project_id",
            F.posexplode_outer(F.split("inside", rf"(?dm)^(?={SECTION_LINE}$)")).alias("section_pos", "section"),
        )
        .withColumn("heading", F.regexp_extract("section", f"^{SECTION_LINE}", 1))
    )
    entries = section_category(sections).select(
        "project_id",
        "category",
        "section_pos",
        F.posexplode_outer(F.split("section", rf"(?dm)^(?={ENTRY_LINE}$)")).alias("entry_pos", "entry"),
    )
    lines = F.split("entry", "\n")
    return (
        entries.where("entry_pos > 0")
        .select(
            "project_id",
            "category",
            F.regexp_extract("entry", f"^{ENTRY_LINE}", 1).alias("day"),
            lines[0].alias("heading"),
            F.filter(lines, lambda line: line.startswith("- ")).alias("bullets"),
            F.lit(1).alias("is_kept"),
            F.lit(None).cast("string").alias("created_at"),
            (F.col("section_pos") * F.lit(1 << 31).cast("bigint") + F.col("entry_pos")).alias("pos"),
        )
        .where(F.size("bullets") > 0)
    )


def refilter_kept(kept: DataFrame, deny: DataFrame, scheme: str = LINK_SCHEME) -> DataFrame:
    """Kept entries under today's deny list: bullets dropped, headings redacted, empty ones gone.

    Bullets are neither redacted nor tested against the vocabulary again.
    """
    listed = kept.join(deny, "project_id", "left")
    clean = F.filter("bullets", lambda b: ~mentions_denied(b, F.col("denied")))
    return (
        listed.withColumn("bullets", clean)
        .where(F.size("bullets") > 0)
        .withColumn("heading", redact("heading", "denied", scheme))
        .select(*RENDERED)
    )


def drop_superseded(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """Kept entries whose heading no fresh entry has, in whatever topic."""
    seen = fresh.select("project_id", _first_line(F.col("heading")).alias("_line"))
    return kept.withColumn("_line", _first_line(F.col("heading"))).join(
        seen, ["project_id", "_line"], "left_anti"
    ).drop("_line")


def union_pool(fresh: DataFrame, kept: DataFrame) -> DataFrame:
    return fresh.select(*RENDERED).unionByName(kept.select(*RENDERED))


def pool_order() -> list[Column]:
    """Newest day first; on one day fresh before kept, each in its own order."""
    return [
        F.col("day").desc(),
        F.col("is_kept").asc(),
        F.col("created_at").desc_nulls_last(),
        F.col("pos").asc(),
    ]


def merge_pool(fresh: DataFrame, kept: DataFrame) -> DataFrame:
    """The pool in its order within each project, as a range-partitioned sort."""
    return union_pool(fresh, kept).orderBy("project_id", *pool_order())


def top_entries(pool: DataFrame) -> DataFrame:
    """The first four per project and topic. Map tasks cut to four before the shuffle."""
    place = F.row_number().over(Window.partitionBy("project_id", "category").orderBy(*pool_order()))
    return pool.withColumn("place", place).where(F.col("place") <= MAX_ENTRIES_PER_CATEGORY)


def compose_block(top: DataFrame, projects: DataFrame) -> DataFrame:
    """``(project_id, block, rendered)`` for every project, also one without entries.

    ``projects`` is ``(project_id, project, days, generated_at)``. At most sixteen entries per
    project are gathered here.
    """
    body = F.concat(entry_body(F.col("heading"), F.col("bullets")), F.lit("\n\n"))
    ordered = F.array_sort(F.collect_list(F.struct("place", body.alias("body"))))
    sections = top.groupBy("project_id", "category").agg(
        F.concat(
            F.lit("### "),
            heading_of_category(F.col("category")),
            F.lit("\n\n"),
            F.array_join(F.transform(ordered, lambda e: e["body"]), ""),
        ).alias("section"),
        F.count("*").alias("entries"),
    )
    whole = F.array_sort(
        F.collect_list(F.struct(category_order(F.col("category")).alias("o"), "section"))
    )
    blocks = sections.groupBy("project_id").agg(
        F.array_join(F.transform(whole, lambda s: s["section"]), "").alias("sections"),
        F.sum("entries").alias("rendered"),
    )
    head = F.concat(
        F.lit(f"{MARKER_START}\n\n## {BLOCK_TITLE}\n\n"),
        F.format_string(PROVENANCE, "project", F.col("days").cast("string"), "generated_at"),
        F.lit("\n\n"),
    )
    return projects.join(blocks, "project_id", "left").select(
        "project_id",
        F.concat(head, F.coalesce("sections", F.lit("")), F.lit(MARKER_END)).alias("block"),
        F.coalesce("rendered", F.lit(0)).cast("bigint").alias("rendered"),
    )


def rendered_count(top: DataFrame) -> DataFrame:
    """Entries in each project's block."""
    return top.groupBy("project_id").agg(F.count("*").alias("rendered"))


def splice(existing: Column, block: Column) -> Column:
    """The document with the block in place; null when its markers leave no clear place.

    Without markers the block is appended after one blank line; between one well-ordered pair it
    replaces what is there; a missing, reversed or repeated marker is a conflict.
    """
    start, end = F.instr(existing, MARKER_START), F.instr(existing, MARKER_END)
    head = right_trimmed(existing)
    appended = F.concat(
        F.when(head == "", F.lit("")).otherwise(F.concat(head, F.lit("\n\n"))), block, F.lit("\n")
    )

    def once(marker: str, at: Column) -> Column:
        return F.instr(existing.substr(at + F.lit(1), F.length(existing)), marker) == 0

    inside = F.concat(
        existing.substr(F.lit(1), start - 1),
        block,
        existing.substr(end + F.lit(len(MARKER_END)), F.length(existing)),
    )
    return F.when((start == 0) & (end == 0), appended).when(
        (start > 0) & (end > start) & once(MARKER_START, start) & once(MARKER_END, end), inside
    )


def splice_block(documents: DataFrame) -> DataFrame:
    """``(project_id, content, block)`` to ``(project_id, status, content)``."""
    merged = splice(F.col("content"), F.col("block"))
    return documents.select("project_id", merged.alias("merged"), "content").select(
        "project_id",
        F.when(F.col("merged").isNull(), "conflict").otherwise("ok").alias("status"),
        F.coalesce("merged", "content").alias("content"),
    )
