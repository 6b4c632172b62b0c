"""The engine's tables in SQL, and SQL renderings of its text rules, for checking.

The renderings use other means than the engine where SQL has them: ``strip_accents`` for folding,
private-use characters instead of look-aheads, window functions instead of aggregates.
"""

from __future__ import annotations

from notewright.functions.text import SPACES, WS
from notewright.functions.values import (
    CATEGORIES,
    DESCRIPTION,
    GENERIC_TERMS,
    IGNORED_NAMES,
    IRREGULAR_PAST,
    LINK_SCHEME,
    MARKER_END,
    MARKER_START,
    PENDING_OPENINGS,
    PLACEHOLDERS,
    PROFILE,
    SUMMARY,
    UNTITLED,
)

from .tables import EVENT_TOPICS, NOW, ROLE_TYPES
from .templates import BULLETS, NOTES, SECRETS, line_sql


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def texts(values: list[str]) -> str:
    return "(" + ", ".join(map(text, values)) + ")"


def choose(key: str, values: list[str | None]) -> str:
    """Values are SQL expressions."""
    cases = " ".join(f"WHEN {i} THEN {v or 'NULL'}" for i, v in enumerate(values))
    return f"(CASE ({key}) % {len(values)} {cases} END)"


def mapped(key: str, values: dict[str, str]) -> str:
    return f"(CASE {key} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in values.items()) + " END)"


def trim(x: str) -> str:
    return f"trim({x}, {text(SPACES)})"


def rtrim(x: str) -> str:
    return f"rtrim({x}, {text(SPACES)})"


def sub(x: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({x}, {text(pattern)}, {text(replacement)}, 'g')"


def like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {text(pattern)})"


def squash(x: str) -> str:
    return trim(sub(x, f"[{WS}]{{2,}}", " "))


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({fold(x)}, '[^a-z0-9]+'), lambda w: w <> '')"


def padded(x: str) -> str:
    return f"(' ' || array_to_string({tokens(x)}, ' ') || ' ')"


# --- redaction ------------------------------------------------------------------------------------

SECRETS_RE2 = [
    (r"(?i)[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b", "[email]"),
    (rf"(?i)file:///[^{WS}]+", "[local path]"),
    (rf"\b[A-Za-z]:[\\/](?:[^\\/\n\"'`)\]]*[\\/])*[^{WS}\"'`)\]]*", "[local path]"),
    (rf"(?:^|[{WS}])/(?:home|Users|mnt|srv)/(?:[^/\n\"'`)\]]*/)*[^{WS}\"'`)\]]*", " [local path]"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", "[jwt]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{16,}", "[github-token]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}", "[slack-token]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[aws-key]"),
    (r"(?i)\b(?:sk|pk|rk)[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{20,}", "[api-key]"),
    (rf"\b[A-Za-z][A-Za-z0-9+.-]*://[^{WS}/@:]+:[^{WS}/@]+@[^{WS}]+", "[url-with-credentials]"),
    (rf"(?i)\[([^\]]+)\]\([{WS}]*{LINK_SCHEME}://[^)]*\)", r"\1"),
    (rf"(?i)\({LINK_SCHEME}://[^){WS}]+\)", ""),
    (rf"(?i){LINK_SCHEME}://[^{WS}]+", ""),
    (r"\+\d[\d \x{A0}().-]{7,}\d", "[phone]"),
    (rf"\(\d{{2,3}}\)[{WS}]?\d{{4,5}}[- ]?\d{{4}}", "[phone]"),
]
LINKS_RE2 = [
    (r"\[`?\[(?:local path|phone|email)\]`?\]\([^)]*\)?", "[redacted]"),
    (rf"\[([^\]]+)\]\([{WS}]*`?\[(?:local path|phone|email)\]`?[^)]*\)?", r"\1"),
    (rf"\[([^\]]+)\]\([^){WS}]*$", r"\1"),
]


def chained(x: str, patterns: list[tuple[str, str]]) -> str:
    for pattern, replacement in patterns:
        x = sub(x, pattern, replacement)
    return x


def redact_secrets(x: str) -> str:
    return chained(x, SECRETS_RE2)


def redact_denied(x: str, terms: str) -> str:
    t = trim("t")
    step = (
        f"CASE WHEN {t} = '' THEN a ELSE "
        f"regexp_replace(a, '(?i)' || regexp_escape({t}), '[redacted]', 'g') END"
    )
    return f"list_reduce(coalesce({terms}, []), lambda a, t: {step}, {x})"


# Private-use characters that stand for an opening and a closing label bracket, and two link joints.
OPEN, CLOSE, JOINT, PAREN = map(chr, (0xE000, 0xE001, 0xE002, 0xE003))


def repair_links(x: str) -> str:
    """Without look-aheads: labels and link joints hide behind private-use characters."""
    x = chained(x, LINKS_RE2)
    x = sub(x, r"\[(" + "|".join(PLACEHOLDERS) + r")\]", rf"{OPEN}\1{CLOSE}")
    x = f"replace({x}, '](', '{JOINT}')"
    x = f"replace({x}, '{CLOSE}(', '{PAREN}')"
    x = sub(x, rf"\[([^\]{CLOSE}{JOINT}{PAREN}]+)[\]{CLOSE}]", r"\1")
    for hidden, shown in ((JOINT, "]("), (PAREN, "]("), (CLOSE, "]"), (OPEN, "[")):
        x = f"replace({x}, '{hidden}', '{shown}')"
    return x


def redact(x: str, terms: str | None = None) -> str:
    x = redact_secrets(x)
    return repair_links(redact_denied(x, terms) if terms else x)


def denied(x: str, terms: str) -> str:
    t = trim("t")
    return (
        f"(length(list_filter(coalesce({terms}, []), "
        f"lambda t: {t} <> '' AND contains(lower({x}), lower({t})))) > 0)"
    )


# --- bullets --------------------------------------------------------------------------------------


def content(line: str) -> str:
    form = rf"^[{WS}]*[-*][{WS}]+([^\n\r\x{{2028}}\x{{2029}}]*)$"
    return trim(f"replace(regexp_extract({line}, {text(form)}, 1), '**', '')")


def bare_link(x: str) -> str:
    return like(x, rf"^\[[^\]]*\]\([^)]*\)[.{WS}]*$")


def pending(x: str) -> str:
    return like(x, r"(?i)^(?:" + "|".join(PENDING_OPENINGS) + r")\b")


def past(x: str) -> str:
    word = f"lower(regexp_extract(regexp_replace({x}, '(?i)^(?:you|we|the user|user)[{WS}]+', ''), '^([A-Za-z]+)', 1))"
    return f"(ends_with({word}, 'ed') OR {word} IN {texts(IRREGULAR_PAST)})"


def person(x: str) -> str:
    return f"contains(lower({x}), '{LINK_SCHEME}://persons/')"


def placeholder(x: str) -> str:
    label = r"\[(?:redacted|local path|phone|email)\]"
    return (
        f"({x} = '' OR " + like(x, rf"(?i)^[`{WS}]*{label}") + " OR " + like(x, rf"(?i){label}[{WS}]*$") + ")"
    )


def cut(x: str) -> str:
    return f"CASE WHEN length({x}) > 280 THEN substr({x}, 1, 280) || '…' ELSE {x} END"


def keyword_count(x: str, keyword: str) -> str:
    return f"(length(string_split(lower({x}), {text(keyword)})) - 1)"


def keyword_category(x: str, keywords: dict[str, str]) -> str:
    """First topic, in order, whose count equals the greatest count above zero."""
    counts = [keyword_count(x, k) for k in keywords.values()]
    top = f"greatest({', '.join(counts)})"
    cases = " ".join(f"WHEN {c} = {top} THEN {text(n)}" for n, c in zip(keywords, counts))
    return f"(CASE WHEN {top} = 0 THEN NULL {cases} END)"


KEYWORDS = {name: keyword for name, _, _, keyword in CATEGORIES}
TOPIC_ORDER = "(CASE category " + " ".join(
    f"WHEN {text(name)} THEN {i}" for i, (name, _, _, _) in enumerate(CATEGORIES)
) + " END)"
HEADINGS = {name: heading for name, heading, _, _ in CATEGORIES}
TOPICS = {heading: name for name, heading, _, _ in CATEGORIES}


def anchored(x: str, project: str, table: str = "vocabulary") -> str:
    """Term by term: the padded token string holds the padded term."""
    return (
        f"(NOT {person(x)} AND EXISTS (SELECT 1 FROM {table} v WHERE v.project_id = {project} "
        f"AND v.needle IS NOT NULL AND contains({padded(x)}, v.needle)))"
    )


def splice(existing: str, block: str) -> str:
    s, e = text(MARKER_START), text(MARKER_END)
    n = "(length(string_split({x}, {m})) - 1)"
    starts, ends = n.format(x=existing, m=s), n.format(x=existing, m=e)
    head = rtrim(existing)
    return (
        f"(CASE WHEN {starts} = 0 AND {ends} = 0 THEN "
        f"(CASE WHEN {head} = '' THEN '' ELSE {head} || chr(10) || chr(10) END) || {block} || chr(10) "
        f"WHEN {starts} = 1 AND {ends} = 1 AND instr({existing}, {e}) > instr({existing}, {s}) THEN "
        f"string_split({existing}, {s})[1] || {block} || string_split({existing}, {e})[2] END)"
    )


# --- tables ---------------------------------------------------------------------------------------


def _dressed(templates: list[str]) -> str:
    line = line_sql(templates, "doc_id", "line", "(i - 1)")
    glue = "CASE doc_id % 2 WHEN 0 THEN chr(10) ELSE chr(13) || chr(10) END"
    return (
        "SELECT doc_id, source, array_to_string(list_transform(string_split(text, chr(10)), "
        f"lambda line, i: {line}), chr(10)) AS joined, {glue} AS glue FROM documents"
    )


def _lines(templates: list[str]) -> str:
    return (
        "SELECT source AS project_id, doc_id, line_pos, "
        + line_sql(templates, "doc_id", "raw", "line_pos")
        + " AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS raw, "
        "generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_pos FROM documents)"
    )


def _parts(x: str, forced: bool) -> str:
    """Terms of one name as a list."""
    folded = trim(fold(x))
    telling = f"length(p) >= 3 AND p NOT IN {texts(GENERIC_TERMS)}"
    whole = "p <> ''" if forced else telling
    return (
        f"list_distinct(list_concat(list_filter([{folded}], lambda p: {whole}), "
        f"list_filter(string_split_regex({folded}, '[^a-z0-9]+'), lambda p: {telling})))"
    )


_ISO = [
    "strftime(to_timestamp(1704067200 + (doc_id * 7919) % 2592000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')"
] * 9 + ["'soon'", None]
_START, _END = text(f"\n{MARKER_START}\n"), text(f"\n{MARKER_END}\n")
_INTRO = text("# Handbook\n\nWritten by hand.\n")

def _repository(rows: str, key: str, prefix: str = "") -> dict[str, tuple[str, list[str]]]:
    """Listings, manifests and the terms they give, from rows of three words each."""
    return {
        f"{prefix}listing": (
            "SELECT source AS project_id, "
            + choose(
                key,
                [
                    "w1 || '/' || w2 || '.ts/' || w3",
                    "'node_modules/' || w1",
                    "'src/' || w1 || '.' || w2 || '.TS'",
                    "'.' || w1 || '/' || w2",
                    "w1 || '/dist'",
                    "w1 || '-' || w2 || '.md'",
                ],
            )
            + " AS path FROM " + rows,
            [rows],
        ),
        f"{prefix}repo_names": (
            "SELECT DISTINCT project_id, regexp_replace(n, '(?i)\\.[a-z0-9]+$', '') AS name FROM ("
            "SELECT project_id, string_split(path, '/')[1] AS n, string_split(path, '/')[1] AS root FROM " + prefix + "listing "
            "UNION ALL SELECT project_id, string_split(path, '/')[2], string_split(path, '/')[1] FROM " + prefix + "listing) "
            f"WHERE n IS NOT NULL AND n NOT IN {texts(IGNORED_NAMES)} AND NOT starts_with(n, '.') "
            f"AND root NOT IN {texts(IGNORED_NAMES)} AND NOT starts_with(root, '.')",
            [f"{prefix}listing"],
        ),
        f"{prefix}manifest_names": (
            "SELECT DISTINCT source AS project_id, unnest("
            + choose(key, ["[w1 || '-' || w2, '@' || w3 || '/' || w1]", "[w2 || '.js', 'index']", "[]", "[w3]"])
            + ") AS name FROM " + rows,
            [rows],
        ),
        f"{prefix}vocabulary_terms": (
            f"SELECT project_id, unnest({_parts('term', True)}) AS term FROM terms UNION ALL "
            f"SELECT project_id, unnest({_parts('name', False)}) FROM {prefix}repo_names UNION ALL "
            f"SELECT project_id, unnest({_parts('name', False)}) FROM {prefix}manifest_names",
            ["terms", f"{prefix}repo_names", f"{prefix}manifest_names"],
        ),
    }


TABLES: dict[str, tuple[str, list[str]]] = {
    "bodies": (f"SELECT doc_id, source, replace(joined, chr(10), glue) AS text FROM ({_dressed(BULLETS)})", []),
    "bullets": (_lines(BULLETS), []),
    "secrets": (_lines(SECRETS), []),
    "words": (
        "SELECT doc_id, source, coalesce(w[1], 'none0') AS w1, coalesce(w[2], 'none1') AS w2, "
        "coalesce(w[3], 'none2') AS w3 FROM (SELECT doc_id, source, "
        f"list_filter({tokens('text')}, lambda w: length(w) >= 5) AS w FROM documents)",
        [],
    ),
    "phrases": (
        "SELECT doc_id, source, k, "
        + ", ".join(f"coalesce(w[3 * k + {i + 1}], 'none{i}') AS w{i + 1}" for i in range(3))
        + " FROM (SELECT doc_id, source, w, unnest(range(0, greatest(1, CAST(ceil(len(w) / 3.0) AS BIGINT)))) AS k FROM "
        f"(SELECT doc_id, source, list_filter({tokens('text')}, lambda w: length(w) >= 5) AS w FROM documents))",
        [],
    ),
    "projects": (
        "SELECT source AS project_id, first_doc, p_name AS project, "
        "[replace(p_name, ' ', '_'), ' ' || p_type, '  ', string_split(p_name, ' ')[1]] AS aliases, "
        + choose("first_doc", [text(v) for v in ["agents", " CLAUDE.md ", "Agents.MD", "README.md", "claude"]])
        + " AS target, "
        + choose("first_doc", [v and text(v) for v in ["14", " 30 ", None, "21", "0", "25", "28"]])
        + " AS window_days FROM (SELECT source, min(doc_id) AS first_doc FROM documents GROUP BY source) "
        "JOIN part ON first_doc = p_partkey",
        [],
    ),
    "terms": (
        f"SELECT project_id, term FROM (SELECT project_id, lower({trim('unnest(list_prepend(project, aliases))')}) AS term "
        "FROM projects) WHERE term <> ''",
        ["projects"],
    ),
    **_repository("phrases", "(doc_id + k)"),
    **_repository("words", "doc_id", "first_"),
    "vocabulary": (
        "SELECT DISTINCT project_id, term, CASE WHEN regexp_full_match(term, '[a-z0-9]+') "
        "OR length(list_filter(string_split_regex(term, '[^a-z0-9]+'), lambda w: w <> '')) > 1 "
        "THEN ' ' || array_to_string(list_filter(string_split_regex(term, '[^a-z0-9]+'), lambda w: w <> ''), ' ') || ' ' "
        "END AS needle FROM first_vocabulary_terms",
        ["first_vocabulary_terms"],
    ),
    "deny": (
        "SELECT source AS project_id, [' LICENSED ', upper(w1), ' ', w2 || ' '] AS denied "
        "FROM words WHERE doc_id IN (SELECT first_doc FROM projects)",
        ["words", "projects"],
    ),
    "titles": (
        "SELECT doc_id, source AS project_id, "
        + choose(
            "doc_id",
            [
                "p_name || ' ' || p_type || ' and ' || w1",
                "upper(replace(p_name, ' ', '-')) || ' Audit ' || p_type",
                "replace(p_name, ' ', '') || '  release AND ' || p_type || ' and ' || w1 || ' dev@mail.example.com'",
                "'x' || replace(p_name, ' ', '') || 's ' || w2",
                None,
            ],
        )
        + " AS name, w1 FROM words JOIN part ON doc_id = p_partkey",
        ["words"],
    ),
    "summaries": (
        "SELECT 's' || doc_id AS summary_id, name, "
        + choose("doc_id", _ISO)
        + " AS created_at, list_concat(['a' || doc_id || '-0', 'a' || doc_id || '-1', 'a' || doc_id || '-2'], "
        "CASE WHEN doc_id % 5 = 0 THEN ['a' || (doc_id - 1) || '-1'] ELSE [] END) AS annotation_ids, "
        "doc_id AS snapshot_pos FROM titles",
        ["titles"],
    ),
    "annotations": (
        f"SELECT 'a' || doc_id || '-0' AS annotation_id, '{DESCRIPTION}' AS type, '- Drew a bug' || chr(10) || text AS text, doc_id * 4 AS ann_pos FROM bodies "
        f"UNION ALL SELECT 'a' || doc_id || '-1', CASE WHEN doc_id % 3 = 2 THEN '{DESCRIPTION}' ELSE '{SUMMARY}' END, "
        "CASE WHEN doc_id % 7 = 6 THEN '' ELSE text END, doc_id * 4 + 1 FROM bodies "
        f"UNION ALL SELECT 'a' || doc_id || '-2', '{PROFILE}', text, doc_id * 4 + 2 FROM bodies",
        ["bodies"],
    ),
    "hits": (
        "SELECT 'src' || CAST((event_id // 7) % 20 AS VARCHAR) AS project_id, 's' || user_id AS summary_id, "
        + mapped("event_type", EVENT_TOPICS)
        + " AS category, CASE WHEN event_id % 3 = 0 THEN 'keyword' ELSE 'semantic' END AS strategy, "
        "CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE CAST(CAST(floor(value) AS BIGINT) % 5 AS DOUBLE) END AS score, "
        "event_id AS hit_pos FROM events",
        [],
    ),
    "best": (
        f"SELECT project_id, summary_id, category, CAST(score AS DOUBLE) AS score FROM hits "
        f"QUALIFY row_number() OVER (PARTITION BY project_id, summary_id ORDER BY score DESC, {TOPIC_ORDER}, "
        "CASE strategy WHEN 'semantic' THEN 0 ELSE 1 END, hit_pos) = 1",
        ["hits"],
    ),
    "turns": (
        "SELECT conv_id AS summary_id, 't' || conv_id || '-' || turn AS annotation_id, "
        + mapped("role", ROLE_TYPES)
        + " AS type, text, turn AS ann_pos FROM conversations",
        [],
    ),
    "asked": (
        "SELECT *, CASE regexp_replace(lower("
        + trim("target")
        + "), '\\.md$', '') WHEN 'agents' THEN 'AGENTS.md' WHEN 'claude' THEN 'CLAUDE.md' END AS target_name, "
        f"CASE WHEN window_days IS NULL THEN 14 WHEN regexp_full_match({trim('window_days')}, '[1-9][0-9]*') "
        f"THEN coalesce(TRY_CAST({trim('window_days')} AS BIGINT), 9223372036854775807) END AS days FROM projects",
        ["projects"],
    ),
    "valid": ("SELECT * FROM asked WHERE days IS NOT NULL AND target_name IS NOT NULL", ["asked"]),
    "found": (
        "SELECT b.project_id, b.summary_id, b.category, b.score, coalesce(s.name, "
        + text(UNTITLED)
        + ") AS title, s.created_at, s.annotation_ids, s.snapshot_pos FROM best b JOIN summaries s USING (summary_id) "
        "JOIN valid p ON p.project_id = b.project_id "
        f"WHERE TRY_CAST(s.created_at AS TIMESTAMPTZ) >= TIMESTAMPTZ '{NOW}+00' - to_hours(24 * p.days)",
        ["best", "summaries", "valid"],
    ),
    "named": (
        "SELECT DISTINCT f.project_id, f.summary_id FROM found f JOIN terms t USING (project_id) WHERE "
        + " length(array_to_string({w}, '')) > 0 AND (contains({p}, {q}) OR (length(array_to_string({w}, '')) >= 5 AND "
        "list_contains(flatten(list_transform(range(1, length({n}) + 1), lambda i: list_transform(range(i, length({n}) + 1), "
        "lambda j: array_to_string({n}[i:j], '')))), array_to_string({w}, ''))))".format(
            w=tokens("t.term"), p=padded("f.title"), q=padded("t.term"), n=tokens("f.title")
        ),
        ["found", "terms"],
    ),
    "owners": (
        "SELECT project_id, annotation_id, summary_id FROM (SELECT project_id, summary_id, snapshot_pos, "
        "unnest(annotation_ids) AS annotation_id FROM found) "
        "QUALIFY row_number() OVER (PARTITION BY project_id, annotation_id ORDER BY snapshot_pos DESC) = 1",
        ["found"],
    ),
    "owned": (
        "SELECT o.project_id, o.summary_id, a.type, a.text, a.ann_pos FROM owners o JOIN annotations a USING (annotation_id) "
        f"WHERE a.type IN ('{SUMMARY}', '{DESCRIPTION}') AND a.text <> ''",
        ["owners", "annotations"],
    ),
    "entries": (
        "SELECT b.project_id, b.summary_id, coalesce(CASE WHEN f.score <= 0 THEN "
        + keyword_category("f.title || chr(10) || b.text", KEYWORDS)
        + f" END, f.category, {text(CATEGORIES[0][0])}) AS category, f.title, f.created_at, b.text, b.entry_pos FROM ("
        f"SELECT project_id, summary_id, coalesce(arg_max(text, ann_pos) FILTER (type = '{SUMMARY}'), "
        f"arg_min(text, ann_pos) FILTER (type = '{DESCRIPTION}')) AS text, min(ann_pos) AS entry_pos "
        "FROM owned GROUP BY ALL) b JOIN found f ON f.project_id = b.project_id AND f.summary_id = b.summary_id "
        "WHERE (b.project_id, b.summary_id) IN (SELECT (project_id, summary_id) FROM named)",
        ["owned", "found", "named"],
    ),
    "entry_lines": (
        f"SELECT *, {content('line')} AS content FROM (SELECT project_id, summary_id, category, title, created_at, entry_pos, "
        "unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, "
        "generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS line_pos FROM entries)",
        ["entries"],
    ),
    "accepted": (
        f"SELECT *, row_number() OVER (PARTITION BY project_id, summary_id ORDER BY line_pos) AS nth FROM ("
        f"SELECT e.*, {squash(redact('content', 'd.denied'))} AS scrubbed FROM entry_lines e LEFT JOIN deny d USING (project_id) "
        f"WHERE content <> '' AND NOT {bare_link('content')} AND NOT {denied('content', 'd.denied')} "
        f"AND {past('content')} AND NOT {pending('content')} AND {anchored('content', 'e.project_id')}) "
        f"WHERE NOT {placeholder('scrubbed')}",
        ["entry_lines", "deny", "vocabulary"],
    ),
    "rendered": (
        f"SELECT project_id, summary_id, category, title, created_at, entry_pos, "
        f"string_agg('- ' || ({cut('scrubbed')}), chr(10) ORDER BY nth) AS bullets "
        "FROM accepted WHERE nth <= 6 GROUP BY ALL",
        ["accepted"],
    ),
    "clean_titles": (
        f"SELECT r.* EXCLUDE (title), {squash(redact('r.title', 'd.denied'))} AS title "
        "FROM rendered r LEFT JOIN deny d USING (project_id)",
        ["rendered", "deny"],
    ),
    "title_parts": (
        "SELECT project_id, summary_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS part_pos, length(parts) AS n FROM ("
        f"SELECT project_id, summary_id, string_split_regex(title, '(?i)[{WS}]+and[{WS}]+') AS parts FROM clean_titles)",
        ["clean_titles"],
    ),
    "fresh": (
        "SELECT c.project_id, c.summary_id, c.category, substr(c.created_at, 1, 10) AS day, "
        "'**' || coalesce(k.kept, c.title) || '** — ' || substr(c.created_at, 1, 10) AS heading, "
        "c.bullets, 0 AS is_kept, c.created_at, c.entry_pos AS pos FROM clean_titles c LEFT JOIN ("
        "SELECT project_id, summary_id, string_agg(part, ' and ' ORDER BY part_pos) AS kept FROM title_parts "
        f"WHERE n > 1 AND {anchored('part', 'title_parts.project_id')} GROUP BY ALL) k "
        "ON k.project_id = c.project_id AND k.summary_id = c.summary_id",
        ["clean_titles", "title_parts", "vocabulary"],
    ),
    "notes": (
        "SELECT 'n' || doc_id AS project_id, "
        + choose(
            "doc_id",
            [
                f"{_INTRO} || {_START} || text || {_END} || 'After.' || chr(10)",
                f"{_INTRO} || chr(10) || ' ' || chr(9) || chr(10)",
                f"{_INTRO} || {_START} || text || {_END}",
                f"{_INTRO} || {_START} || text",
                f"{_START} || text || {_END} || {_START} || text || {_END}",
                f"{_INTRO} || {_END} || text || {_START}",
                "' ' || chr(10) || chr(10)",
            ],
        )
        + f" AS content FROM (SELECT doc_id, replace(joined, chr(10), glue) AS text FROM ({_dressed(NOTES)}))",
        [],
    ),
    "project_notes": (
        "SELECT p.project_id, n.content FROM notes n JOIN projects p ON n.project_id = 'n' || p.first_doc",
        ["notes", "projects"],
    ),
}


def parsed(notes: str) -> str:
    """Kept entries of the notes table: running last section and heading over numbered lines."""
    s, e = text(MARKER_START), text(MARKER_END)
    section = r"^### ([^\n\r\x{2028}\x{2029}]+)$"
    heading = r"^\*\*[^\n\r\x{2028}\x{2029}]+\*\* — ([0-9]{4}-[0-9]{2}-[0-9]{2})$"
    inside = f"replace(substr(content, instr(content, {s}), instr(content, {e}) - instr(content, {s})), chr(13) || chr(10), chr(10))"
    return f"""
    SELECT project_id, {mapped("section", TOPICS)} AS category, day, heading, bullets, heading_pos FROM (
      SELECT project_id, any_value(section) AS section, any_value(regexp_extract(heading, {text(heading)}, 1)) AS day,
             any_value(heading) AS heading, heading_pos,
             list(line ORDER BY pos) FILTER (starts_with(line, '- ') AND pos > heading_pos) AS bullets
      FROM (
        SELECT project_id, pos, line,
               last_value(CASE WHEN {like("line", section)} THEN regexp_extract(line, {text(section)}, 1) END IGNORE NULLS) OVER w AS section,
               last_value(CASE WHEN {like("line", section)} THEN pos END IGNORE NULLS) OVER w AS section_pos,
               last_value(CASE WHEN {like("line", heading)} THEN line END IGNORE NULLS) OVER w AS heading,
               last_value(CASE WHEN {like("line", heading)} THEN pos END IGNORE NULLS) OVER w AS heading_pos
        FROM (SELECT project_id, unnest(string_split({inside}, chr(10))) AS line,
                     generate_subscripts(string_split({inside}, chr(10)), 1) AS pos
              FROM {notes} WHERE instr(content, {s}) > 0 AND instr(content, {e}) > instr(content, {s}))
        WINDOW w AS (PARTITION BY project_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
      WHERE heading_pos > section_pos GROUP BY project_id, heading_pos)
    WHERE length(bullets) > 0 AND {mapped("section", TOPICS)} IS NOT NULL"""


TABLES["kept"] = (parsed("project_notes"), ["project_notes"])
TABLES["note_entries"] = (parsed("notes"), ["notes"])
TABLES["refiltered"] = (
    f"SELECT k.project_id, k.category, k.day, {redact('k.heading', 'd.denied')} AS heading, "
    f"list_filter(k.bullets, lambda b: NOT {denied('b', 'd.denied')}) AS bullets, k.heading_pos "
    "FROM kept k LEFT JOIN deny d USING (project_id)",
    ["kept", "deny"],
)
TABLES["pool"] = (
    "SELECT project_id, category, day, heading, bullets, is_kept, created_at, pos FROM fresh UNION ALL "
    "SELECT project_id, category, day, heading, array_to_string(bullets, chr(10)), 1, NULL, heading_pos FROM refiltered r "
    "WHERE length(bullets) > 0 AND (project_id, heading) NOT IN (SELECT (project_id, heading) FROM fresh)",
    ["fresh", "refiltered"],
)
TABLES["top"] = (
    "SELECT *, row_number() OVER (PARTITION BY project_id, category ORDER BY day DESC, is_kept, created_at DESC NULLS LAST, pos) AS place "
    "FROM pool QUALIFY place <= 4",
    ["pool"],
)
TABLES["sections"] = (
    "SELECT project_id, category, '### ' || "
    + mapped("category", HEADINGS)
    + " || chr(10) || chr(10) || string_agg(heading || chr(10) || chr(10) || bullets || chr(10) || chr(10), '' ORDER BY place) AS section, "
    "count(*) AS n FROM top GROUP BY project_id, category",
    ["top"],
)
TABLES["blocks"] = (
    f"SELECT p.project_id, {text(MARKER_START + chr(10) * 2 + '## Project memory' + chr(10) * 2)} || "
    "'Generated from recorded work sessions — project \"' || p.project || '\", last ' || p.days || "
    f"' days, on {NOW[:10]}.' || chr(10) || chr(10) || coalesce(s.body, '') || {text(MARKER_END)} AS block, "
    "coalesce(s.n, 0) AS rendered FROM valid p LEFT JOIN (SELECT project_id, "
    f"string_agg(section, '' ORDER BY {TOPIC_ORDER}) AS body, CAST(sum(n) AS BIGINT) AS n FROM sections GROUP BY project_id) s USING (project_id)",
    ["valid", "sections"],
)
TABLES["proposals"] = (
    f"SELECT b.*, coalesce(n.content, '') AS content, {splice('coalesce(n.content, chr(32)[2:])', 'b.block')} AS proposed "
    "FROM blocks b LEFT JOIN project_notes n USING (project_id)",
    ["blocks", "project_notes"],
)


def using(names: list[str], select: str, instead: dict[str, tuple[str, list[str]]] | None = None) -> str:
    """``select`` with the named tables, and those they need, in front of it; ``instead`` stands in for some."""
    tables = TABLES | (instead or {})
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for needed in tables[name][1]:
            visit(needed)
        order.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({tables[name][0]})" for name in order)
    return f"WITH {ctes}\n{select}" if order else select
