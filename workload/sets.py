"""Checked queries: set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.operators import blocks as B
from notewright.operators import sessions as S
from notewright.operators.changes import change_report
from notewright.operators.vocabulary import union_terms
from notewright.sources.repositories import manifest_names, repo_names

from . import sql as Q
from .registry import query
from .tables import Tables


@query("union_hits", Q.using(["hits"], "SELECT * FROM hits"))
def _(t: Tables):
    """Both strategies taken apart and put together again."""
    hits = t.hits()
    return S.union_hits(
        hits.where("strategy = 'semantic'").drop("strategy"),
        hits.where("strategy = 'keyword'").drop("strategy"),
    )


@query(
    "union_pool",
    Q.using(["note_entries"], "SELECT project_id, heading, 0 AS is_kept FROM note_entries UNION ALL SELECT project_id, heading, 1 FROM note_entries"),
)
def _(t: Tables):
    kept = B.parse_block(t.notes())
    fresh = kept.withColumn("is_kept", F.lit(0))
    return B.union_pool(fresh, kept).select("project_id", "heading", "is_kept")


@query(
    "change_report",
    Q.using(
        ["bodies", "bullets"],
        """SELECT project_id, CASE WHEN d > 0 THEN '+' ELSE '-' END AS op, line, abs(d) AS n FROM (
          SELECT project_id, line, CAST(sum(d) AS BIGINT) AS d FROM (
            SELECT 'n' || doc_id AS project_id, unnest(string_split(text, chr(10))) AS line, -1 AS d FROM documents
            UNION ALL SELECT 'n' || doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))), 1 FROM bodies)
          GROUP BY project_id, line) WHERE d <> 0""",
    ),
)
def _(t: Tables):
    """Every document against its dressed form; undressed lines are in both."""
    name = F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("project_id")
    before = t.documents().select(name, F.col("text").alias("content"))
    after = t.bodies().select(name, F.concat(F.replace("text", F.lit("\r"), F.lit("")), F.lit("\n")).alias("proposed"))
    return change_report(before.join(after, "project_id"))


@query("union_terms", Q.using(["vocabulary_terms"], "SELECT project_id, term, count(*) > 0 AS listed FROM vocabulary_terms GROUP BY ALL"))
def _(t: Tables):
    terms = union_terms(t.terms(), repo_names(t.listing()), manifest_names(t.manifests()))
    return terms.groupBy("project_id", "term").agg((F.count("*") > 0).alias("listed"))
