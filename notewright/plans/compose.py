"""Entries and earlier notes to each project's block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import LINK_SCHEME
from ..operators import blocks as B
from ..operators.bullets import first_accepted_bullets, trim_titles
from ..operators.vocabulary import anchor_keys
from ..session import durable

#: Counted bytes of deny lists that are broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def with_denied(entries: DataFrame, deny: DataFrame) -> DataFrame:
    """Entries with their project's deny list, where these lists are small without a shuffle.

    A shuffled join leaves the texts in one task a project, and as that also suits all that follows up to the rendered entries,
    the whole text pipeline would run there.
    """
    size = deny.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("project_id", "denied")))), F.lit(0)).alias("bytes")).first()
    return entries.join(F.broadcast(deny) if size["bytes"] <= BROADCAST_BYTES else deny, "project_id", "left")


def render_fresh(
    entries: DataFrame, vocabulary: DataFrame, deny: DataFrame, scheme: str = LINK_SCHEME
) -> DataFrame:
    """Entries with at least one accepted bullet, in the pool's shape.

    Titles are trimmed last, for rendered entries only. Checkpointed are the vocabulary's keys and
    the rendered entries, at most six bullets each: both are read several times, and the text
    pipeline behind the entries should run once.
    """
    keys = durable(anchor_keys(vocabulary))
    listed = with_denied(entries, deny)
    bullets = first_accepted_bullets(
        listed, keys, ["summary_id"], ["category", "title", "created_at", "entry_pos"], scheme
    )
    rendered = durable(B.render_entries(bullets, ["summary_id"]))
    titled = trim_titles(rendered.join(deny, "project_id", "left"), keys, ["summary_id"], scheme)
    return B.fresh_entries(titled)


def merged_top(
    entries: DataFrame,
    notes: DataFrame,
    vocabulary: DataFrame,
    deny: DataFrame,
    scheme: str = LINK_SCHEME,
) -> DataFrame:
    """The entries each block will hold: fresh ones and earlier ones, four per topic."""
    fresh = render_fresh(entries, vocabulary, deny, scheme)
    kept = B.drop_superseded(B.refilter_kept(B.parse_block(notes), deny, scheme), fresh)
    return B.top_entries(B.union_pool(fresh, kept))


def compose(
    entries: DataFrame,
    notes: DataFrame,
    projects: DataFrame,
    vocabulary: DataFrame,
    deny: DataFrame,
    scheme: str = LINK_SCHEME,
) -> DataFrame:
    """``(project_id, block, rendered)``.

    ``deny`` is ``(project_id, denied)``; ``projects`` carries ``project``, ``days`` and
    ``generated_at``.
    """
    return B.compose_block(merged_top(entries, notes, vocabulary, durable(deny), scheme), projects)
