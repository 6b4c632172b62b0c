"""Checked queries: projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions.redaction import redact
from notewright.functions import text as T
from notewright.functions.values import CATEGORIES, UNTITLED
from notewright.operators import bullets as B
from notewright.operators import requests as R
from notewright.operators import sessions as S
from notewright.operators.vocabulary import mentions_person

from . import sql as Q
from .registry import query
from .tables import NOW, Tables, choose

KEYS = ["doc_id", "line_pos"]
BULLETS = f"(SELECT doc_id, CAST(line_pos AS BIGINT) AS line_pos, {Q.content('line')} AS content FROM bullets)"


def contents(t: Tables):
    """Every dressed line's bullet content, none left out but lines that are no bullets."""
    lines = T.evaluated(t.bullets(), "content", B.bullet_content(F.col("line")))
    return lines.where("content <> ''").select(
        "doc_id", F.col("line_pos").cast("bigint").alias("line_pos"), "content"
    )


def _lines_query(name: str, where: str, keep):
    sql = Q.using(["bullets"], f"SELECT * FROM {BULLETS} WHERE content <> '' AND {where}")
    query(name, sql)(lambda t: contents(t).where(keep(F.col("content"))))


@query(
    "window_filter",
    Q.using(
        ["summaries"],
        f"SELECT summary_id, created_at FROM summaries WHERE TRY_CAST(created_at AS TIMESTAMPTZ) >= TIMESTAMPTZ '{NOW}+00' - INTERVAL 14 DAY",
    ),
)
def _(t: Tables):
    since = R.window_since(F.lit(NOW).cast("timestamp"), F.lit(14))
    return S.window_filter(t.summaries(), since).select("summary_id", "created_at")


@query(
    "window_since",
    """SELECT o_orderkey, strftime(o_orderdate - to_hours(24 * (o_orderkey % 400 + 1)), '%Y-%m-%d %H:%M:%S') AS since FROM orders""",
)
def _(t: Tables):
    since = R.window_since(F.col("o_orderdate"), F.col("o_orderkey") % 400 + 1)
    return t.given("orders").select("o_orderkey", F.date_format(since, "yyyy-MM-dd HH:mm:ss").alias("since"))


@query(
    "annotation_type_filter",
    Q.using(
        ["turns", "annotations"],
        """SELECT annotation_id, type, length(text) AS n FROM turns WHERE type <> 'HIERARCHICAL_PROFILE_SUMMARY' AND text <> ''
        UNION ALL SELECT annotation_id, type, length(text) FROM annotations WHERE type IN ('SUMMARY', 'DESCRIPTION') AND text <> ''""",
    ),
)
def _(t: Tables):
    columns = ["annotation_id", "type", "text"]
    both = t.turns().select(*columns).unionByName(t.annotations().select(*columns))
    return S.allowed_annotations(both).select(
        "annotation_id", "type", F.length("text").cast("bigint").alias("n")
    )


@query("bullet_lines", Q.using(["bullets"], f"SELECT * FROM {BULLETS} WHERE content <> ''"))
def _(t: Tables):
    return B.bullet_lines(t.bodies(), ["doc_id"]).withColumn("line_pos", F.col("line_pos").cast("bigint"))


_lines_query("drop_bare_links", f"NOT {Q.bare_link('content')}", lambda c: ~B.is_bare_link(c))
_lines_query("drop_person_refs", f"NOT {Q.person('content')}", lambda c: ~mentions_person(c))
_lines_query("drop_pending_work", f"NOT {Q.pending('content')}", lambda c: ~B.is_pending(c))
_lines_query("keep_past_tense", Q.past("content"), B.is_past_tense)


@query(
    "drop_placeholder_bullets",
    Q.using(
        ["bullets"],
        f"SELECT * FROM (SELECT doc_id, line_pos, {Q.squash(Q.redact('content'))} AS scrubbed FROM {BULLETS} WHERE content <> '') WHERE NOT {Q.placeholder('scrubbed')}",
    ),
)
def _(t: Tables):
    scrubbed = T.squash_spaces(redact("content"))
    return T.evaluated(contents(t), "scrubbed", scrubbed).where(~B.is_placeholder(F.col("scrubbed"))).select(
        *KEYS, "scrubbed"
    )


@query(
    "default_title",
    Q.using(["titles"], f"SELECT doc_id, CASE WHEN name IS NULL THEN {Q.text(UNTITLED)} WHEN doc_id % 4 = 1 THEN '' ELSE name END AS title FROM titles"),
)
def _(t: Tables):
    named = F.when(F.col("name").isNotNull() & (F.col("doc_id") % 4 == 1), "").otherwise(F.col("name"))
    return t.titles().select("doc_id", S.default_title(named).alias("title"))


_TARGETS = [" Agents ", "CLAUDE.md", "claude.MD", "README.md", "", None, "agents.md.md", "CLAUDE.txt"]
_DAYS = [None, " 30 ", "0", "-5", "30abc", "007", "12", "99999999999999999999"]


@query(
    "normalise_requests",
    f"""SELECT o_orderkey,
      CASE o_orderkey % 8 WHEN 0 THEN 'AGENTS.md' WHEN 1 THEN 'CLAUDE.md' WHEN 2 THEN 'CLAUDE.md' END AS target_name,
      CAST(coalesce(CASE (o_orderkey // 8) % 9 WHEN 0 THEN 14 WHEN 1 THEN 30 WHEN 6 THEN 12
        WHEN 7 THEN 9223372036854775807 WHEN 8 THEN nullif(o_orderkey, 0) END, -1) AS BIGINT) AS days FROM orders""",
)
def _(t: Tables):
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    requests = t.given("orders").select(
        "o_orderkey",
        choose(k, [none if v is None else v for v in _TARGETS]).alias("target"),
        choose(F.floor(k / 8), [none if v is None else v for v in _DAYS] + [k.cast("string")]).alias("window_days"),
    )
    return R.normalise_requests(requests).select(
        "o_orderkey", "target_name", F.coalesce("days", F.lit(-1)).alias("days")
    )


@query(
    "query_texts",
    "\nUNION ALL ".join(
        f"SELECT 'c' || c_custkey AS project_id, {Q.text(name)} AS category, {Q.text(topic)} || ' in the project ' || c_name AS semantic_text, "
        f"c_name || {Q.text(' ' + keyword)} AS keyword_text FROM customer"
        for name, _, topic, keyword in CATEGORIES
    ),
)
def _(t: Tables):
    projects = t.given("customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("project_id"), F.col("c_name").alias("project")
    )
    return R.query_texts(projects)
