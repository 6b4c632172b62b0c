"""The same results in DuckDB's SQL, over ``documents`` and ``benchmark`` with distinct doc_ids."""

#: The words of the contracts.
BLANK_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def word_list(text: str, pattern: str = BLANK_WORD) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{pattern}')"


QUALITY_RULES = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, source, {word_list("text")} AS ws FROM documents),
line AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM w),
filled AS (SELECT *, array_to_string({word_list(lowered("raw"))}, ' ') AS norm FROM line WHERE regexp_matches(raw, '{BLANK_WORD}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM filled GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM w GROUP BY source),
common AS (SELECT f.source, norm FROM filled f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
  GROUP BY f.source, norm, h.n HAVING count(DISTINCT f.text) > 10 AND count(DISTINCT f.text) > 0.05 * h.n),
gone AS (SELECT doc_id, count(*) AS n, sum(len(string_split(f.norm, ' '))) AS words FROM filled f JOIN common c
  ON f.norm = c.norm AND f.source IS NOT DISTINCT FROM c.source GROUP BY doc_id),
stats AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  CAST(coalesce(g.n, 0) AS BIGINT) AS removed_lines, CAST(coalesce(g.words, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN repeated r USING (doc_id) LEFT JOIN gone g USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  n_words - removed_words < 20 OR n_words - removed_words < 0.3 * n_words AS depleted FROM stats)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM judged
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
later AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM later),
spans AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE before IS DISTINCT FROM p - 1) AS spans, list(p) AS ps
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id),
byte AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d SEMI JOIN spans USING (doc_id))),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY i) AS h FROM byte b ANTI JOIN gone g ON b.doc_id = g.doc_id AND b.i = g.p GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(s.n, 0) AS n_removed, coalesce(s.spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN s.n IS NULL THEN d.h ELSE coalesce(k.h, '') END)) AS kept_sha256
FROM d LEFT JOIN spans s USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

DECONTAMINATION = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {word_list(lowered("text"), PLAIN_WORD)} AS ws FROM benchmark),
pattern AS (SELECT DISTINCT item, len(run) AS size, array_to_string(run, ' ') AS s FROM (
  SELECT item, ws[i:i + least(10, len(ws)) - 1] AS run FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM item WHERE len(ws) > 0))),
w AS (SELECT doc_id, {word_list(lowered("text"), PLAIN_WORD)} AS ws FROM documents),
win AS (SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS s FROM (
  SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (SELECT DISTINCT size FROM pattern))),
hit AS (SELECT doc_id, i, win.size, item FROM win JOIN pattern USING (size, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {word_list("text")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM twice),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS left_text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(left_text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN removed r USING (doc_id)
"""

SHINGLE_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {word_list(lowered("text"))} AS ws FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (
  SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 85 * (x.n + y.n - inter)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""
