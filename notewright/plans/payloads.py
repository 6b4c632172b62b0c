"""A whole run from captured tool answers: searches, snapshots and annotations, then proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import LINK_SCHEME
from ..operators.sessions import union_hits
from ..sources import payloads as P
from ..sources.messages import decode_tool_results
from .sync import Run, sync

#: Places of one answer's elements lie below this, so that answers keep their order.
PLACES = 1 << 32


def _values(answers: DataFrame, keys: list[str]) -> DataFrame:
    """A failed call's value is null, which the readers skip. A filter on the status would parse each body once more."""
    return decode_tool_results(answers, keys).select(*keys, "value")


def searched_hits(searches: DataFrame) -> DataFrame:
    """Hits of ``(project_id, category, strategy, body)``, the answers of both searches."""
    keys = ["project_id", "category"]

    def of(strategy: str) -> DataFrame:
        return _values(searches.where(F.col("strategy") == strategy), keys)

    return union_hits(P.semantic_hits(of("semantic"), keys, "value"), P.keyword_hits(of("keyword"), keys, "value"))


def answered_summaries(snapshots: DataFrame) -> DataFrame:
    """Sessions of ``(batch_pos, body)``; of a session in several answers the last one's place counts."""
    fields = P.summary_fields(P.snapshot_items(_values(snapshots, ["batch_pos"]), ["batch_pos"], "value"), ["batch_pos"])
    place = (F.col("batch_pos") * PLACES + F.col("snapshot_pos")).alias("snapshot_pos")
    return fields.select("summary_id", "name", "created_at", "annotation_ids", place).where("summary_id is not null")


def answered_annotations(answers: DataFrame) -> DataFrame:
    """Annotations of ``(batch_pos, body)``."""
    fields = P.annotation_fields(P.snapshot_items(_values(answers, ["batch_pos"]), ["batch_pos"], "value"), ["batch_pos"])
    place = (F.col("batch_pos") * PLACES + F.col("ann_pos")).alias("ann_pos")
    return fields.select("annotation_id", "type", "text", place).where("annotation_id is not null")


def run_from_payloads(
    requests: DataFrame,
    searches: DataFrame,
    snapshots: DataFrame,
    annotation_answers: DataFrame,
    vocabulary: DataFrame,
    deny: DataFrame,
    notes: DataFrame,
    now: Column,
    scheme: str = LINK_SCHEME,
) -> Run:
    """``sync`` over what the tools answered."""
    return sync(
        requests, searched_hits(searches), answered_summaries(snapshots), answered_annotations(annotation_answers),
        vocabulary, deny, notes, now, scheme,
    )
