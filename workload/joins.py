"""Checked queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.operators import blocks as B
from notewright.operators import sessions as S
from notewright.operators.bullets import deny_filter
from notewright.operators.trace import chain_trace
from notewright.operators.vocabulary import anchor_keys, anchored
from notewright.session import durable

from . import sql as Q
from .filters import contents
from .registry import query
from .tables import choose, doc, EVENT_TOPICS, mapped, Tables



@query(
    "fetch_summaries",
    Q.using(["best", "summaries"], "SELECT b.project_id, b.summary_id, b.category, b.score, s.name, s.created_at FROM best b JOIN summaries s USING (summary_id)"),
)
def _(t: Tables):
    return S.fetch_summaries(S.best_category(t.hits()), t.summaries()).select(
        "project_id", "summary_id", "category", "score", "name", "created_at"
    )


@query(
    "fetch_annotations",
    Q.using(
        ["best", "summaries", "annotations"],
        """SELECT o.project_id, o.summary_id, a.annotation_id, a.type, length(a.text) AS n FROM (
          SELECT project_id, summary_id, annotation_id FROM (
            SELECT b.project_id, summary_id, s.snapshot_pos, unnest(s.annotation_ids) AS annotation_id FROM best b JOIN summaries s USING (summary_id))
          QUALIFY row_number() OVER (PARTITION BY project_id, annotation_id ORDER BY snapshot_pos DESC) = 1) o
        JOIN annotations a USING (annotation_id)""",
    ),
)
def _(t: Tables):
    found = S.fetch_summaries(S.best_category(t.hits()), t.summaries())
    owners = S.annotation_owners(found).select("project_id", "annotation_id", "owner.summary_id")
    return S.fetch_annotations(owners, t.annotations()).select(
        "project_id", "summary_id", "annotation_id", "type", F.length("text").cast("bigint").alias("n")
    )


@query(
    "title_scope",
    Q.using(
        ["titles", "terms"],
        "SELECT DISTINCT project_id, doc_id, name AS title FROM titles f JOIN terms t USING (project_id) WHERE name IS NOT NULL AND "
        + "length(array_to_string({w}, '')) > 0 AND (contains({p}, {q}) OR (length(array_to_string({w}, '')) >= 5 AND "
        "list_contains(flatten(list_transform(range(1, length({n}) + 1), lambda i: list_transform(range(i, length({n}) + 1), "
        "lambda j: array_to_string({n}[i:j], '')))), array_to_string({w}, ''))))".format(
            w=Q.tokens("t.term"), p=Q.padded("f.name"), q=Q.padded("t.term"), n=Q.tokens("f.name")
        ),
    ),
)
def _(t: Tables):
    titles = t.titles().select("project_id", "doc_id", F.col("name").alias("title"))
    return S.title_scope(titles, t.terms())


@query(
    "vocab_anchor",
    Q.using(
        ["bullets", "vocabulary"],
        f"SELECT project_id, doc_id, line_pos, content FROM (SELECT project_id, doc_id, CAST(line_pos AS BIGINT) AS line_pos, {Q.content('line')} AS content FROM bullets) b "
        f"WHERE content <> '' AND {Q.anchored('content', 'b.project_id')}",
    ),
)
def _(t: Tables):
    lines = contents(t).join(t.documents().select("doc_id", F.col("source").alias("project_id")), "doc_id")
    keys = durable(anchor_keys(t.vocabulary()))
    return anchored(lines, keys, ["doc_id", "line_pos"], "content")


@query(
    "deny_filter",
    Q.using(
        ["bullets", "deny"],
        f"SELECT b.project_id, doc_id, CAST(line_pos AS BIGINT) AS line_pos, line FROM bullets b LEFT JOIN deny d USING (project_id) WHERE NOT {Q.denied('line', 'd.denied')}",
    ),
)
def _(t: Tables):
    listed = t.bullets().join(t.deny(), "project_id", "left")
    return deny_filter(listed, "line").select(
        "project_id", "doc_id", F.col("line_pos").cast("bigint").alias("line_pos"), "line"
    )


@query(
    "drop_superseded",
    Q.using(
        ["note_entries"],
        """SELECT project_id, category, heading FROM note_entries e WHERE NOT EXISTS (
          SELECT 1 FROM note_entries f WHERE f.project_id = e.project_id AND f.heading = e.heading AND f.category = 'resolved-bugs')""",
    ),
)
def _(t: Tables):
    """Entries of one topic stand for fresh ones; they supersede equal headings of any topic."""
    entries = B.parse_block(t.notes())
    fresh = entries.where("category = 'resolved-bugs'")
    return B.drop_superseded(entries, fresh).select("project_id", "category", "heading")


@query(
    "section_category",
    f"SELECT doc_id, heading, {Q.mapped('heading', Q.TOPICS)} AS category FROM (SELECT doc_id, "
    + Q.choose("doc_id", [Q.text(h) for h in Q.TOPICS] + ["lang", Q.text("conventions and patterns")])
    + f" AS heading FROM documents) WHERE {Q.mapped('heading', Q.TOPICS)} IS NOT NULL",
)
def _(t: Tables):
    heading = choose(doc(), [*Q.TOPICS, F.col("lang"), "conventions and patterns"])
    return B.section_category(t.documents().select("doc_id", heading.alias("heading")))


_WORDS = {"architecture-decisions": "tion", "resolved-bugs": "the", "conventions": "en", "environment-gotchas": "er"}


@query(
    "entry_category",
    Q.using(
        ["best"],
        "SELECT d.doc_id, b.project_id, coalesce(CASE WHEN b.score IS NULL OR b.score <= 0 THEN "
        + Q.keyword_category("d.lang || chr(10) || d.lang || ' ' || CASE d.doc_id % 5 WHEN 0 THEN 'Bug in Setup, debug' WHEN 1 THEN 'conventions' WHEN 2 THEN 'setup' ELSE d.text END", Q.KEYWORDS)
        + " END, b.category, 'architecture-decisions') AS category FROM documents d LEFT JOIN best b ON b.summary_id = 's' || d.doc_id",
    ),
)
def _(t: Tables):
    """Documents with and without hits; a few texts speak of a topic."""
    said = choose(doc(), ["Bug in Setup, debug", "conventions", "setup", F.col("text"), F.col("text")])
    docs = t.documents().select(
        "doc_id", F.concat(F.lit("s"), doc().cast("string")).alias("summary_id"), F.col("lang").alias("title"),
        F.concat("lang", F.lit(" "), said).alias("text"),
    )
    return docs.join(S.best_category(t.hits()), "summary_id", "left").select(
        "doc_id",
        "project_id",
        S.entry_category(F.col("title"), F.col("text"), F.col("category"), F.col("score")).alias("category"),
    )


@query(
    "keyword_category",
    f"SELECT doc_id, {Q.keyword_category('text', _WORDS)} AS category FROM documents UNION ALL "
    f"SELECT doc_id, {Q.keyword_category('text', Q.KEYWORDS)} FROM documents",
)
def _(t: Tables):
    """Stand-in keywords that the texts hold, and the real ones, which they do not."""
    docs = t.documents()
    return docs.select("doc_id", S.keyword_category(F.col("text"), _WORDS).alias("category")).unionByName(
        docs.select("doc_id", S.keyword_category(F.col("text")).alias("category"))
    )


@query(
    "chain_trace",
    Q.using(
        ["summaries", "annotations"],
        """SELECT query_id, count(DISTINCT h.summary_id) AS identifiers, count(DISTINCT s.summary_id) AS summaries, count(DISTINCT a.annotation_id) AS annotations
        FROM (SELECT event_type || '-' || event_id % 10 AS query_id, 's' || (user_id * 7) AS summary_id FROM events) h
        LEFT JOIN (SELECT summary_id, unnest(annotation_ids) AS annotation_id FROM summaries) s ON s.summary_id = h.summary_id
        LEFT JOIN annotations a ON a.annotation_id = s.annotation_id GROUP BY query_id""",
    ),
)
def _(t: Tables):
    hits = t.given("events").select(
        F.concat("event_type", F.lit("-"), (F.col("event_id") % 10).cast("string")).alias("query_id"),
        F.concat(F.lit("s"), (F.col("user_id") * 7).cast("string")).alias("summary_id"),
    )
    return chain_trace(hits, t.summaries(), t.annotations())
