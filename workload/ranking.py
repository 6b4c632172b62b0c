"""Checked queries: aggregates, rankings, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions.text import tokens
from notewright.operators import blocks as B
from notewright.operators import requests as R
from notewright.operators import sessions as S
from notewright.operators import trace
from notewright.operators.bullets import bullet_lines, first_bullets, is_past_tense
from notewright.operators.positions import global_positions
from notewright.operators.search import keyword_topk, semantic_topk

from . import sql as Q
from .registry import query
from .tables import doc, Tables



@query("best_category", Q.using(["best"], "SELECT * FROM best"))
def _(t: Tables):
    return S.best_category(t.hits())


@query(
    "best_body",
    Q.using(
        ["turns"],
        """SELECT summary_id, CASE WHEN last_summary IS NOT NULL THEN last_summary ELSE first_description END AS text, entry_pos FROM (
          SELECT DISTINCT summary_id,
            first_value(CASE WHEN type = 'SUMMARY' THEN text END) OVER (PARTITION BY summary_id ORDER BY type = 'SUMMARY' DESC, ann_pos DESC) AS last_summary,
            first_value(CASE WHEN type = 'DESCRIPTION' THEN text END) OVER (PARTITION BY summary_id ORDER BY type = 'DESCRIPTION' DESC, ann_pos) AS first_description,
            min(ann_pos) OVER (PARTITION BY summary_id) AS entry_pos
          FROM turns WHERE type IN ('SUMMARY', 'DESCRIPTION') AND text <> '')""",
    ),
)
def _(t: Tables):
    return S.best_body(S.allowed_annotations(t.turns()), ["summary_id"])


@query(
    "annotation_type_audit",
    Q.using(["annotations"], "SELECT type, count(*) AS n, type = 'HIERARCHICAL_PROFILE_SUMMARY' AS blocked FROM annotations GROUP BY type"),
)
def _(t: Tables):
    return trace.annotation_type_audit(t.annotations())


@query(
    "session_listing",
    Q.using(["summaries"], "SELECT summary_id, substr(created_at, 1, 10) AS day, name AS title FROM summaries"),
)
def _(t: Tables):
    return trace.session_listing(t.summaries())


@query("project_vocabulary", Q.using(["vocabulary_terms"], "SELECT DISTINCT project_id, term FROM vocabulary_terms"))
def _(t: Tables):
    return t.whole_vocabulary()


def _pool(t: Tables):
    """Notes entries of all documents, spread over ten projects: every second one counts as fresh."""
    n = F.substring("project_id", 2, 20).cast("bigint")
    return B.parse_block(t.notes()).select(
        (n % 10).cast("string").alias("project_id"),
        "category",
        "day",
        F.concat("heading", F.lit(" "), "project_id").alias("heading"),
        "bullets",
        (n % 2).cast("int").alias("is_kept"),
        F.when(n % 2 == 0, F.concat("day", F.lit("T00:00:00Z"))).alias("created_at"),
        (n * 1000 + F.dense_rank().over(B.Window.partitionBy("project_id").orderBy("pos"))).alias("pos"),
    )


_POOL = """(SELECT CAST(n % 10 AS VARCHAR) AS project_id, category, day, heading || ' ' || p AS heading, bullets, n % 2 AS is_kept,
  CASE WHEN n % 2 = 0 THEN day || 'T00:00:00Z' END AS created_at, n * 1000 + rank AS pos FROM (
  SELECT project_id AS p, CAST(substr(project_id, 2) AS BIGINT) AS n, category, day, heading, bullets,
    row_number() OVER (PARTITION BY project_id ORDER BY heading_pos) AS rank FROM note_entries))"""
_ORDER = "day DESC, is_kept, created_at DESC NULLS LAST, pos"


@query(
    "rendered_count",
    Q.using(["note_entries"], f"SELECT project_id, count(*) AS rendered FROM (SELECT * FROM {_POOL} QUALIFY row_number() OVER (PARTITION BY project_id, category ORDER BY {_ORDER}) <= 4) GROUP BY project_id"),
)
def _(t: Tables):
    return B.rendered_count(B.top_entries(_pool(t)))


@query(
    "top_entries",
    Q.using(["note_entries"], f"SELECT project_id, category, heading, row_number() OVER (PARTITION BY project_id, category ORDER BY {_ORDER}) AS place FROM {_POOL} QUALIFY place <= 4"),
)
def _(t: Tables):
    return B.top_entries(_pool(t)).select("project_id", "category", "heading", F.col("place").cast("bigint").alias("place"))


@query(
    "merge_pool",
    Q.using(["note_entries"], f"SELECT project_id, heading, is_kept, row_number() OVER (PARTITION BY project_id ORDER BY {_ORDER}) AS position FROM {_POOL}"),
)
def _(t: Tables):
    """The merged order made visible as positions."""
    pool = _pool(t)
    merged = B.union_pool(pool.where("is_kept = 0"), pool.where("is_kept = 1"))
    return global_positions(merged, ["project_id"], B.pool_order()).select(
        "project_id", "heading", F.col("is_kept").cast("bigint").alias("is_kept"), "position"
    )


_VECTORS = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


@query(
    "semantic_topk",
    f"""SELECT asked_id, vec_id AS summary_id, round(score, 6) AS score, CAST(hit_pos AS BIGINT) AS hit_pos FROM (
      SELECT q.vec_id AS asked_id, x.vec_id, list_cosine_similarity(x.v, q.v) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(x.v, q.v) DESC, x.vec_id) AS hit_pos
      FROM {_VECTORS} x, {_VECTORS} q WHERE list_cosine_similarity(x.v, q.v) >= 0.1) WHERE hit_pos <= 8""",
)
def _(t: Tables):
    """Every vector asks; the threshold is low enough for the limit to matter."""
    vectors = t.given("embeddings").select(F.col("vec_id").alias("summary_id"), "embedding")
    queries = vectors.select(F.col("summary_id").alias("asked_id"), F.col("embedding").alias("query_vector"))
    hits = semantic_topk(vectors, queries, ["asked_id"], 8, threshold=0.1)
    return hits.select(
        "asked_id", "summary_id", F.round("score", 6).alias("score"), F.col("hit_pos").cast("bigint").alias("hit_pos")
    )


@query(
    "keyword_topk",
    Q.using(
        ["words"],
        f"""SELECT item_id, doc_id AS summary_id, CAST(hit_pos AS BIGINT) AS hit_pos FROM (
          SELECT q.item_id, d.doc_id, row_number() OVER (PARTITION BY q.item_id ORDER BY d.n_chars DESC, d.doc_id) AS hit_pos
          FROM (SELECT doc_id, n_chars, {Q.tokens("text")} AS held FROM documents) d,
               (SELECT item_id, {Q.tokens("text")} AS words FROM benchmark) q
          WHERE list_has_all(d.held, q.words)) WHERE hit_pos <= 8""",
    ),
)
def _(t: Tables):
    """All words of every benchmark passage, searched in all documents; length stands for the date."""
    documents = t.documents().select(doc().alias("summary_id"), "text", F.col("n_chars").alias("created_at"))
    queries = t.given("benchmark").select("item_id", F.col("text").alias("query_text"))
    return keyword_topk(documents, queries, ["item_id"], 8).select(
        "item_id", "summary_id", F.col("hit_pos").cast("bigint").alias("hit_pos")
    )


@query(
    "search_limit",
    """SELECT o_orderkey, CAST(least(100, greatest(8, ceil(o_orderkey / 14.0) * 8)) AS BIGINT) AS search_limit FROM orders""",
)
def _(t: Tables):
    return t.given("orders").select("o_orderkey", R.search_limit(F.col("o_orderkey")).alias("search_limit"))


@query(
    "first_bullets",
    Q.using(["bullets"], f"""SELECT project_id, doc_id, CAST(line_pos AS BIGINT) AS line_pos, content FROM (
      SELECT project_id, doc_id, line_pos, {Q.content("line")} AS content FROM bullets) WHERE content <> ''
      AND {Q.past("content")} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_pos) <= 6"""),
)
def _(t: Tables):
    """All filters first, here the tense, then the cap."""
    bodies = t.bodies().withColumnRenamed("source", "project_id")
    lines = bullet_lines(bodies, ["project_id", "doc_id"])
    return first_bullets(lines.where(is_past_tense(F.col("content"))), ["doc_id"]).select(
        "project_id", "doc_id", F.col("line_pos").cast("bigint").alias("line_pos"), "content"
    )


@query(
    "recency_order",
    Q.using(
        ["summaries"],
        """SELECT project_id, summary_id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC NULLS LAST, entry_pos, summary_id) AS position
        FROM (SELECT d.source AS project_id, s.summary_id, substr(s.created_at, 1, 10) AS created_at, d.n_chars AS entry_pos
          FROM summaries s JOIN documents d ON s.snapshot_pos = d.doc_id)""",
    ),
)
def _(t: Tables):
    """Sessions dated by day, so that many tie and arrival decides."""
    entries = t.summaries().join(t.documents(), F.col("snapshot_pos") == doc()).select(
        F.col("source").alias("project_id"),
        "summary_id",
        F.substring("created_at", 1, 10).alias("created_at"),
        F.col("n_chars").alias("entry_pos"),
    )
    return S.recency_order(entries)


@query(
    "parse_block",
    Q.using(["note_entries"], "SELECT project_id, category, day, heading, array_to_string(bullets, chr(10)) AS bullets FROM note_entries"),
)
def _(t: Tables):
    return B.parse_block(t.notes()).select(
        "project_id", "category", "day", "heading", F.array_join("bullets", "\n").alias("bullets")
    )
