"""Checked queries: payloads, messages, repositories, notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions import variants as V
from notewright.operators.changes import apply_approved
from notewright.sources import messages as M
from notewright.sources import notes as N
from notewright.sources import payloads as P
from notewright.sources import repositories as R

from . import sql as Q
from .registry import query
from .tables import choose, doc, Tables



def _json(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _search_payloads(t: Tables):
    """One semantic payload per event; two in ten are malformed as a whole, parts of all others."""
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    good = _json(
        '{"results":[{"identifier":"s', user, '","score":', F.col("value").cast("string"),
        '},{"identifier":"t', event, '"},{"identifier":7,"score":1},{"identifier":"u', user,
        '","score":"high"},{"identifier":"","score":1},null,5]}',
    )
    payload = choose(F.col("event_id"), [F.lit('{"results":{"a":1}}'), _json(good, " extra")] + [good] * 8)
    return t.given("events").select("event_id", payload.alias("payload"))


@query(
    "ingest_semantic_hits",
    """SELECT event_id, summary_id, score, CAST(hit_pos AS BIGINT) AS hit_pos FROM (
      SELECT event_id, 's' || user_id AS summary_id, value AS score, 0 AS hit_pos FROM events
      UNION ALL SELECT event_id, 't' || event_id, 0.0, 1 FROM events
      UNION ALL SELECT event_id, 'u' || user_id, 0.0, 3 FROM events)
    WHERE event_id % 10 > 1""",
)
def _(t: Tables):
    return P.semantic_hits(_search_payloads(t), ["event_id"]).withColumn(
        "hit_pos", F.col("hit_pos").cast("bigint")
    )


@query(
    "ingest_keyword_hits",
    """SELECT event_id, summary_id, 0.0::DOUBLE AS score, CAST(hit_pos AS BIGINT) AS hit_pos FROM (
      SELECT event_id, 's' || user_id AS summary_id, 1 AS hit_pos FROM events WHERE event_id % 3 > 0
      UNION ALL SELECT event_id, 'k' || event_id, 3 FROM events WHERE event_id % 3 > 0)""",
)
def _(t: Tables):
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    good = _json(
        '{"results":[{"summary":"x"},{"summary":{"id":"s', user, '"},"score":9},{"summary":{"id":3}},',
        '{"summary":{"id":"k', event, '"}},{"id":"z"}]}',
    )
    payloads = t.given("events").select(
        "event_id", choose(F.col("event_id"), [_json("[", good, "]"), good, good]).alias("payload")
    )
    return P.keyword_hits(payloads, ["event_id"]).withColumn(
        "hit_pos", F.col("hit_pos").cast("bigint")
    )


def _snapshots(t: Tables):
    """One snapshot per document, holding its session, two items that are no objects, and odd types."""
    d = doc().cast("string")
    name = choose(doc(), [_json(',"name":"', F.col("lang"), " ", F.col("source"), '"'), F.lit(""), F.lit(',"name":5')])
    created = choose(doc(), [_json(',"created":{"value":"2024-01-', F.lpad((doc() % 28 + 1).cast("string"), 2, "0"), 'T00:00:00Z"}'), F.lit(',"created":"soon"'), F.lit(',"created":{"value":12}'), F.lit("")])
    indices = choose(doc(), [_json(',"annotations":{"indices":{"b', d, '":1,"a', d, '":null}}'), F.lit(',"annotations":{"indices":[]}'), F.lit(',"annotations":7')])
    payload = _json('{"items":[{"id":"s', d, '"', name, created, indices, '},7,"x",{"id":', d, "}]}")
    return t.documents().select("doc_id", payload.alias("payload"))


@query(
    "ingest_snapshot_items",
    """SELECT doc_id, 0::BIGINT AS item_pos, 's' || doc_id AS id FROM documents
    UNION ALL SELECT doc_id, 3, NULL FROM documents""",
)
def _(t: Tables):
    return P.snapshot_items(_snapshots(t), ["doc_id"]).select(
        "doc_id", F.col("item_pos").cast("bigint").alias("item_pos"), V.text_at(F.col("item"), "$.id").alias("id")
    )


@query(
    "summary_created_at",
    """SELECT doc_id, 's' || doc_id AS summary_id,
      CASE WHEN doc_id % 3 = 0 THEN lang || ' ' || source END AS name,
      CASE WHEN doc_id % 4 = 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' END AS created_at
    FROM documents""",
)
def _(t: Tables):
    items = P.snapshot_items(_snapshots(t), ["doc_id"])
    return P.summary_fields(items, ["doc_id"]).where("summary_id is not null").select(
        "doc_id", "summary_id", "name", "created_at"
    )


@query(
    "explode_annotation_ids",
    """SELECT doc_id, 's' || doc_id AS summary_id, unnest(['a' || doc_id, 'b' || doc_id]) AS annotation_id
    FROM documents WHERE doc_id % 3 = 0""",
)
def _(t: Tables):
    fields = P.summary_fields(P.snapshot_items(_snapshots(t), ["doc_id"]), ["doc_id"])
    return P.listed_annotations(fields, ["doc_id", "summary_id"])


def _streams(t: Tables):
    """An event stream per document, its text inside; a few hold nothing that parses."""
    d = doc().cast("string")
    answer = _json('data: {"jsonrpc":"2.0","id":"', d, '","result":{"text":', F.to_json(F.struct("text")), "}}\n\n")
    note = F.lit('data: {"jsonrpc":"2.0","method":"progress"}\n\n')
    raw = choose(
        doc(),
        [
            _json("id: 7\n\ndata: <pause>\n\n", note, answer),
            F.replace(_json(note, answer), F.lit("\n\n"), F.lit("\r\n\r\n")),
            _json('data: {"id":"previous","result":{"page":1}}\n\n', answer),
            _json("retry: 900\n\n", note),
            _json('data: {"id":"previous",\ndata: "error":{"message":"m"}}\n\n', note),
            _json("<html>busy</html> ", F.col("lang")),
        ],
    )
    return t.documents().select("doc_id", raw.alias("raw"), d.alias("wanted"))


@query(
    "decode_sse_messages",
    """SELECT doc_id,
      CASE WHEN doc_id % 6 < 3 THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 6 = 4 THEN 'previous' END AS id,
      CASE WHEN doc_id % 6 < 3 THEN text END AS text,
      CASE WHEN doc_id % 6 = 3 THEN 'progress' END AS method,
      CASE WHEN doc_id % 6 = 4 THEN 'm' END AS error
    FROM documents""",
)
def _(t: Tables):
    message = F.col("message")
    return M.decode_messages(_streams(t), ["doc_id"], request_id="wanted").select(
        "doc_id",
        V.text_at(message, "$.id").alias("id"),
        V.text_at(message, "$.result.text.text").alias("text"),
        V.text_at(message, "$.method").alias("method"),
        V.text_at(message, "$.error.message").alias("error"),
    )


@query(
    "decode_tool_results",
    """SELECT doc_id, CASE WHEN doc_id % 7 < 4 THEN 'ok' ELSE 'call-failed' END AS status,
      CASE doc_id % 7 WHEN 0 THEN text WHEN 1 THEN n_chars || ' chars: ' || text WHEN 3 THEN text END AS text,
      CASE WHEN doc_id % 7 = 2 THEN n_chars ELSE -1 END AS n
    FROM documents""",
)
def _(t: Tables):
    """Bodies as JSON and as streams; texts that are JSON, start like JSON, or are plain."""

    def wrapped(text):
        return _json('{"result":{"content":[{"type":"text","text":', text, "}]}}")

    quoted = F.regexp_extract(F.to_json(F.struct("text")), r"^\{\"text\":(.*)\}\z", 1)
    numbered = F.regexp_replace(quoted, '^"', F.concat(F.lit('"'), F.col("n_chars").cast("string"), F.lit(" chars: ")))
    body = choose(
        doc(),
        [
            wrapped(quoted),
            wrapped(numbered),
            wrapped(_json('"{\\"n\\":', F.col("n_chars").cast("string"), '}"')),
            _json("event: message\ndata: ", wrapped(quoted), "\n\n"),
            F.lit('{"error":{"message":"no"},"result":{"content":[{"text":"x"}]}}'),
            wrapped(F.lit("5")),
            _json("junk ", quoted),
        ],
    )
    value = F.col("value")
    return M.decode_tool_results(t.documents().select("doc_id", body.alias("body")), ["doc_id"]).select(
        "doc_id",
        "status",
        V.text_at(value, "$").alias("text"),
        F.coalesce(V.number_at(value, "$.n").cast("bigint"), F.lit(-1)).alias("n"),
    )


@query(
    "load_deny_terms",
    f"""SELECT project_id, pos, {Q.trim("line")} AS term FROM (
      SELECT source || '-' || doc_id AS project_id, unnest(string_split(text, chr(10))) AS line,
        CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos FROM documents)
    WHERE pos % 3 <> 1 AND {Q.trim("line")} <> ''""",
)
def _(t: Tables):
    """Each document as a deny file: comments, blank ends and both line breaks."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: choose(i, [line, F.concat(F.lit("\t# "), line), F.concat(F.lit(" \u00a0"), line, F.lit("\r"))]),
    )
    raw = t.documents().select(
        F.concat("source", F.lit("-"), doc().cast("string")).alias("project_id"), F.array_join(lines, "\n").alias("raw")
    )
    return R.deny_terms(raw).select("project_id", F.col("pos").cast("bigint").alias("pos"), "term")


@query("repo_name_terms", Q.using(["repo_names"], "SELECT * FROM repo_names"))
def _(t: Tables):
    return R.repo_names(t.listing())


@query("manifest_terms", Q.using(["manifest_names"], "SELECT * FROM manifest_names"))
def _(t: Tables):
    return R.manifest_names(t.manifests())


@query(
    "read_notes",
    Q.using(
        ["notes"],
        """SELECT 'n' || d.doc_id AS project_id,
        CASE WHEN d.doc_id IN (SELECT doc_id FROM labels) THEN n.content ELSE '' END AS content
        FROM documents d JOIN notes n ON n.project_id = 'n' || d.doc_id""",
    ),
)
def _(t: Tables):
    """Only labelled documents have a note."""

    def ids(name: str):
        return t.given(name).select(F.concat(F.lit("n"), doc().cast("string")).alias("project_id"))

    return N.read_notes(ids("documents"), t.notes().join(ids("labels"), "project_id", "left_semi"))


_BLOCK = f"{Q.MARKER_START}\nnew\n{Q.MARKER_END}"


@query(
    "apply_approved",
    Q.using(
        ["notes"],
        f"""SELECT project_id, CASE WHEN merged IS NULL THEN 'conflict' ELSE 'written' END AS status,
          coalesce(merged, content) AS content FROM (
          SELECT project_id, content, CASE WHEN content = base THEN 'proposed ' || base ELSE {Q.splice("content", Q.text(_BLOCK))} END AS merged
          FROM (SELECT n.project_id, n.content AS base, CASE WHEN l.toxic = 1 OR l.doc_id % 4 = 0 THEN n.content || 'Edited.' ELSE n.content END AS content
            FROM notes n JOIN labels l ON n.project_id = 'n' || l.doc_id WHERE l.quality = 1))""",
    ),
)
def _(t: Tables):
    """Approved are documents of good quality; some were edited after the proposal."""
    labels = t.given("labels").withColumn("project_id", F.concat(F.lit("n"), doc().cast("string")))
    notes = t.notes()
    proposals = notes.select(
        "project_id",
        F.col("content").alias("base"),
        F.lit(_BLOCK).alias("block"),
        F.concat(F.lit("proposed "), "content").alias("proposed"),
    )
    edited = (F.col("toxic") == 1) | (doc() % 4 == 0)
    current = notes.join(labels, "project_id").select(
        "project_id",
        F.when(edited, F.concat("content", F.lit("Edited."))).otherwise(F.col("content")).alias("content"),
    )
    return apply_approved(proposals, labels.where("quality = 1"), current)
