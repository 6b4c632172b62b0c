"""Chat formatting by rotating perspective: each participant in turn is the assistant.

For every participant of a conversation the dialogue is rendered with that speaker as assistant, all
others as users under their names, and only the participant's own turns trained on. System turns are
instructions: nobody's perspective, and the same in all.

A dialogue is given as its turns, one row a turn and perspective. Only the names of its speakers are joined to its turns, stretch by
stretch of ``STRETCH`` turn numbers, so that a conversation of any length spreads over tasks. Built-in functions only.

Marks in texts and names are escaped by a backslash, and so is a backslash; names, which stand inside a mark, have their
line feeds escaped too. No two texts or names look alike afterwards, and none ends a mark or opens one.

Cases: a null role speaks as ``unknown``; a null text is empty; a null turn number lies in the first stretch; a
conversation of system turns alone has no perspective and gives no row; repeated rows give repeated rows;
turns without a conv_id belong to one conversation; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"
UNKNOWN = "unknown"
OPEN, CLOSE, END = "<|", "|>", "<|end|>"


#: Turn numbers of one conversation that are joined to its speakers in one place.
STRETCH = 4096


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit(OPEN), F.lit("<\\|")), F.lit(CLOSE), F.lit("|\\>"))


def escaped_name(name: Column) -> Column:
    return F.replace(F.replace(escaped(name), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def rotated_dialogues(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as conv_id, perspective, turn, role, name, rendered, mask_first,
    mask_past and trained; the mask is a range of characters of ``rendered``, empty where not trained."""
    stretch = F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(0))
    spoken = turns.select(
        "conv_id", stretch.alias("stretch"), "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"), escaped(F.col("text")).alias("said")
    )
    speakers = spoken.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    stretches = spoken.select("conv_id", "stretch").distinct()
    heard = stretches.alias("t").join(speakers.alias("w"), F.col("t.conv_id").eqNullSafe(F.col("w.conv_id"))).select("t.conv_id", "stretch", "perspective")
    same = F.col("s.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("s.stretch") == F.col("p.stretch"))
    both = spoken.alias("s").join(heard.alias("p"), same)
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    name = F.when(role == "user", escaped_name(F.col("speaker")))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" "), name), F.lit("")), F.lit(CLOSE + "\n"))
    first = F.length(head)
    return both.select(
        "s.conv_id", "perspective", "turn", role.alias("role"), name.alias("name"),
        F.concat(head, F.col("said"), F.lit(END + "\n")).alias("rendered"),
        # The end mark is learnt with the turn.
        F.when(own, first).otherwise(0).alias("mask_first"),
        F.when(own, first + F.length("said") + len(END)).otherwise(0).alias("mask_past"),
        own.alias("trained"),
    )


def _escaped_sql(text: str) -> str:
    return f"replace(replace(replace({text}, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), '|>', '|' || chr(92) || '>')"


_NAME_SQL = f"replace(replace({_escaped_sql('speaker')}, chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')"

#: The same in SQL over ``conversations``.
ROTATED_SQL = f"""
WITH spoken AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, {_escaped_sql("coalesce(text, '')")} AS said FROM conversations),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM spoken WHERE speaker <> 'system'),
seen AS (
  SELECT s.conv_id, perspective, turn, speaker, said, speaker = perspective AS trained,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM spoken s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
headed AS (
  SELECT *, CASE WHEN role = 'user' THEN {_NAME_SQL} END AS name,
    '<|' || role || CASE WHEN role = 'user' THEN ' ' || {_NAME_SQL} ELSE '' END || '|>' || chr(10) AS head
  FROM seen)
SELECT conv_id, perspective, turn, role, name, head || said || '<|end|>' || chr(10) AS rendered,
  CAST(CASE WHEN trained THEN length(head) ELSE 0 END AS INTEGER) AS mask_first,
  CAST(CASE WHEN trained THEN length(head) + length(said) + 7 ELSE 0 END AS INTEGER) AS mask_past, trained
FROM headed
"""
