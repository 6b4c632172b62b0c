"""Checked queries: text functions, redaction and block texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions import redaction as X
from notewright.functions import text as T
from notewright.functions.values import MARKER_END, MARKER_START
from notewright.operators import blocks as B
from notewright.operators.bullets import first_bullets, trim_titles, truncate_bullet
from notewright.operators.requests import project_terms
from notewright.operators.vocabulary import anchor_keys, term_parts
from notewright.session import durable

from . import sql as Q
from .filters import BULLETS, contents
from .registry import query
from .tables import choose, doc, Tables



@query("fold_text", f"SELECT doc_id, {Q.fold('text')} AS folded FROM documents")
def _(t: Tables):
    return t.documents().select("doc_id", T.fold_text(F.col("text")).alias("folded"))


@query("tokenise", f"SELECT page_id, array_to_string({Q.tokens('html')}, ' ') AS words FROM pages")
def _(t: Tables):
    return t.given("pages").select("page_id", T.phrase(T.tokens(F.col("html"))).alias("words"))


_NAME = Q.choose("(doc_id + k)", ["w1 || '-' || w2", "'@' || w1 || '/' || w2 || '!'", "'  Api ' || w1", "'src'", "'to-do'", "upper(w3)"])


@query(
    "term_parts",
    Q.using(
        ["phrases"],
        f"SELECT doc_id, CAST(k AS INTEGER) AS k, forced, unnest(parts) AS part FROM (SELECT doc_id, k, true AS forced, {Q._parts(_NAME, True)} AS parts FROM phrases "
        f"UNION ALL SELECT doc_id, k, false, {Q._parts(_NAME, False)} FROM phrases)",
    ),
)
def _(t: Tables):
    name = choose(
        doc() + F.col("k"),
        [
            F.concat("w1", F.lit("-"), "w2"),
            F.concat(F.lit("@"), "w1", F.lit("/"), "w2", F.lit("!")),
            F.concat(F.lit("  Api "), "w1"),
            "src",
            "to-do",
            F.upper("w3"),
        ],
    )
    named = t.phrases().select("doc_id", "k", name.alias("name"))
    both = [
        named.select("doc_id", "k", F.lit(forced).alias("forced"), F.explode(term_parts(F.col("name"), forced)).alias("part"))
        for forced in (True, False)
    ]
    return both[0].unionByName(both[1])


@query(
    "strip_extension",
    "SELECT page_id, regexp_replace(string_split(string_split(url, '?')[1], '#')[1] || CASE page_id % 3 WHEN 0 THEN '.MD' WHEN 1 THEN '.d.ts' ELSE '' END, '(?i)\\.[a-z0-9]+$', '') AS name FROM pages",
)
def _(t: Tables):
    plain = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    name = F.concat(plain, choose(F.col("page_id"), [".MD", ".d.ts", ""]))
    return t.given("pages").select("page_id", T.strip_extension(name).alias("name"))


@query("strip_bom", "SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN chr(65279) ELSE '' END || text AS raw FROM documents")
def _(t: Tables):
    mark = choose(doc(), ["", "\ufeff", "\ufeff\ufeff"])
    return t.documents().select("doc_id", T.strip_bom(F.concat(mark, F.col("text"))).alias("raw"))


def _secret_lines(t: Tables):
    return t.secrets().withColumn("line_pos", F.col("line_pos").cast("bigint"))


@query(
    "redact_secrets",
    Q.using(["secrets"], f"SELECT doc_id, CAST(line_pos AS BIGINT) AS line_pos, {Q.redact_secrets('line')} AS line FROM secrets"),
)
def _(t: Tables):
    return _secret_lines(t).select("doc_id", "line_pos", X.redact_secrets("line").alias("line"))


@query(
    "redact_denied",
    Q.using(["bullets", "deny"], f"SELECT doc_id, CAST(line_pos AS BIGINT) AS line_pos, {Q.redact_denied('line', 'd.denied')} AS line FROM bullets LEFT JOIN deny d USING (project_id)"),
)
def _(t: Tables):
    return t.bullets().join(t.deny(), "project_id", "left").select(
        "doc_id", F.col("line_pos").cast("bigint").alias("line_pos"), X.redact_denied("line", "denied").alias("line")
    )


@query(
    "repair_links",
    Q.using(["secrets"], f"SELECT doc_id, CAST(line_pos AS BIGINT) AS line_pos, {Q.repair_links('line')} AS line FROM secrets"),
)
def _(t: Tables):
    return _secret_lines(t).select("doc_id", "line_pos", X.repair_links("line").alias("line"))


@query(
    "redact",
    Q.using(
        ["secrets", "deny"],
        f"SELECT 'd' || doc_id || '-' || line_pos AS id, {Q.redact('line', 'd.denied')} AS text FROM secrets LEFT JOIN deny d USING (project_id) "
        f"UNION ALL SELECT 'p' || page_id, {Q.redact('html')} FROM pages",
    ),
)
def _(t: Tables):
    """Lines with the project's denied terms, and whole pages without any."""
    lines = t.secrets().join(t.deny(), "project_id", "left").select(
        F.concat(F.lit("d"), doc().cast("string"), F.lit("-"), F.col("line_pos").cast("string")).alias("id"),
        X.redact("line", "denied").alias("text"),
    )
    pages = t.given("pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), X.redact("html").alias("text")
    )
    return lines.unionByName(pages)


_SPREAD = "'\t' || replace(replace(text, '. ', '.' || chr(160) || ' '), ', ', ',' || chr(10) || chr(8195)) || chr(65279)"


@query("squash_ws", f"SELECT doc_id, {Q.squash(_SPREAD)} AS text FROM documents")
def _(t: Tables):
    spread = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\u00a0 ")), F.lit(", "), F.lit(",\n\u2003"))
    return t.documents().select(
        "doc_id", T.squash_spaces(F.concat(F.lit("\t"), spread, F.lit("\ufeff"))).alias("text")
    )


@query("truncate_bullet", Q.using(["bullets"], f"SELECT doc_id, line_pos, {Q.cut('content')} AS bullet FROM {BULLETS} WHERE content <> ''"))
def _(t: Tables):
    return contents(t).select("doc_id", "line_pos", truncate_bullet(F.col("content")).alias("bullet"))


_SEPARATOR = Q.text(f"(?i)[{Q.WS}]+and[{Q.WS}]+")


@query(
    "trim_title",
    Q.using(
        ["titles", "vocabulary", "deny"],
        f"""SELECT c.project_id, c.doc_id, coalesce(k.kept, c.title) AS title FROM (
          SELECT project_id, doc_id, {Q.squash(Q.redact("name", "d.denied"))} AS title FROM titles LEFT JOIN deny d USING (project_id) WHERE name IS NOT NULL) c
        LEFT JOIN (SELECT doc_id, string_agg(part, ' and ' ORDER BY part_pos) AS kept FROM (
          SELECT project_id, doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS part_pos, length(parts) AS n FROM (
            SELECT project_id, doc_id, string_split_regex({Q.squash(Q.redact("name", "d.denied"))}, {_SEPARATOR}) AS parts
            FROM titles LEFT JOIN deny d USING (project_id) WHERE name IS NOT NULL)) x
          WHERE n > 1 AND {Q.anchored("part", "x.project_id")} GROUP BY doc_id) k USING (doc_id)""",
    ),
)
def _(t: Tables):
    titles = t.titles().where("name is not null").select("project_id", "doc_id", F.col("name").alias("title"))
    keys = durable(anchor_keys(t.vocabulary()))
    return trim_titles(titles.join(t.deny(), "project_id", "left"), keys, ["doc_id"]).drop("denied")


@query(
    "render_entry",
    Q.using(
        ["bullets"],
        f"""SELECT doc_id, '**' || lang || '** — ' || substr('2024-01-02T00:00:00Z', 1, 10) || chr(10) || chr(10) || body AS body FROM documents JOIN (
          SELECT doc_id, string_agg('- ' || content, chr(10) ORDER BY line_pos) AS body FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_pos) AS nth FROM {BULLETS} WHERE content <> '') WHERE nth <= 6 GROUP BY doc_id) USING (doc_id)""",
    ),
)
def _(t: Tables):
    """The first six bullets of every document under its language as title."""
    entries = t.documents().select(
        "doc_id", F.col("source").alias("project_id"), F.lit("conventions").alias("category"),
        F.col("lang").alias("title"), F.lit("2024-01-02T00:00:00Z").alias("created_at"), doc().alias("entry_pos"),
    )
    lines = contents(t).join(entries, "doc_id").withColumnRenamed("content", "bullet")
    rendered = B.render_entries(first_bullets(lines, ["doc_id"]), ["doc_id"])
    fresh = B.fresh_entries(rendered)
    return fresh.select(F.col("pos").alias("doc_id"), B.entry_body(F.col("heading"), F.col("bullets")).alias("body"))


_NOTE_DENY = "['acme', ' LICENSED ', '']"


@query(
    "refilter_kept",
    Q.using(
        ["note_entries"],
        f"""SELECT project_id, category, heading, array_to_string(bullets, chr(10)) AS bullets FROM (
          SELECT project_id, category, {Q.redact("heading", _NOTE_DENY)} AS heading,
            list_filter(bullets, lambda b: NOT {Q.denied("b", _NOTE_DENY)}) AS bullets FROM note_entries) WHERE length(bullets) > 0""",
    ),
)
def _(t: Tables):
    """Every note under a deny list of its own."""
    terms = F.array(F.lit("acme"), F.lit(" LICENSED "), F.lit(""))
    deny = t.documents().select(F.concat(F.lit("n"), doc().cast("string")).alias("project_id"), terms.alias("denied"))
    return B.refilter_kept(B.parse_block(t.notes()), deny).select(
        "project_id", "category", "heading", F.array_join("bullets", "\n").alias("bullets")
    )


@query(
    "compose_block",
    Q.using(
        ["note_entries"],
        f"""SELECT 'n' || doc_id AS project_id, {Q.text(MARKER_START + chr(10) * 2 + '## Project memory' + chr(10) * 2)}
            || 'Generated from recorded work sessions — project "' || source || '", last ' || n_chars || ' days, on 2024-01-31.' || chr(10) || chr(10)
            || coalesce(body, '') || {Q.text(MARKER_END)} AS block, coalesce(n, 0) AS rendered
        FROM documents LEFT JOIN (SELECT project_id, string_agg(section, '' ORDER BY {Q.TOPIC_ORDER}) AS body, CAST(sum(n) AS BIGINT) AS n FROM (
          SELECT project_id, category, count(*) AS n, '### ' || {Q.mapped("category", Q.HEADINGS)} || chr(10) || chr(10)
            || string_agg(heading || chr(10) || chr(10) || array_to_string(bullets, chr(10)) || chr(10) || chr(10), '' ORDER BY place) AS section
          FROM (SELECT *, row_number() OVER (PARTITION BY project_id, category ORDER BY day DESC, heading_pos) AS place FROM note_entries QUALIFY place <= 4)
          GROUP BY project_id, category) GROUP BY project_id) ON project_id = 'n' || doc_id""",
    ),
)
def _(t: Tables):
    """Every note's own entries composed anew."""
    projects = t.documents().select(
        F.concat(F.lit("n"), doc().cast("string")).alias("project_id"), F.col("source").alias("project"),
        F.col("n_chars").alias("days"), F.lit("2024-01-31").alias("generated_at"),
    )
    return B.compose_block(B.top_entries(B.parse_block(t.notes())), projects)


_BLOCK = f"{MARKER_START}\nNEW\n{MARKER_END}"


@query(
    "splice_block",
    Q.using(["notes"], f"SELECT project_id, CASE WHEN merged IS NULL THEN 'conflict' ELSE 'ok' END AS status, coalesce(merged, content) AS content FROM (SELECT *, {Q.splice('content', Q.text(_BLOCK))} AS merged FROM notes)"),
)
def _(t: Tables):
    return B.splice_block(t.notes().withColumn("block", F.lit(_BLOCK)))


@query("project_terms", Q.using(["terms"], "SELECT project_id, term FROM terms UNION ALL SELECT 'c' || c_custkey, lower(trim(c_name)) FROM customer UNION ALL SELECT 'c' || c_custkey, lower(c_mktsegment) FROM customer"))
def _(t: Tables):
    """Projects of the documents, and customers under their name and segment."""
    customers = t.given("customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("project_id"),
        project_terms(F.concat(F.lit("\t"), "c_name", F.lit(" ")), F.array(F.lit(" "), "c_mktsegment")).alias("terms"),
    )
    both = t.terms().unionByName(customers)
    return both.select("project_id", F.explode("terms").alias("term"))
