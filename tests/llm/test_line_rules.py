"""Statistics and verdicts against plain Python."""

import random
import re
from collections import Counter, defaultdict

from notewright.llm.line_rules import quality_rules, without_common_lines

SCHEMA = "doc_id long, text string, source string, n_words int, line string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def normal_lines(text):
    return Counter(n for x in (text or "").split("\n") if (n := " ".join(WORD.findall(lower(x)))))


def expected(rows, min_docs, max_share):
    texts = defaultdict(set)
    for _, text, host, *_ in rows:
        texts[host].add(text or "")
    held = Counter((host, line) for host, ts in texts.items() for t in ts for line in normal_lines(t))
    common = {k for k, n in held.items() if n > min_docs and n > max_share * len(texts[k[0]])}
    out = []
    for doc_id, text, host, *_ in rows:
        n, *rest, rep = statistics(text)
        gone = [len(line.split(" ")) for line in normal_lines(text).elements() if (host, line) in common]
        failed = n < 20 or 100 * rep > 30 * n
        depleted = n - sum(gone) < 20 or n - sum(gone) < 0.3 * n
        out.append((doc_id, n, *rest, rep, len(gone), sum(gone), failed, depleted, not failed and not depleted))
    return Counter(out)


def test_matches_plain_python(spark):
    rng = random.Random(5)
    vocabulary = ["Éa", "b", "c#", "<d>", "e f", "g", "H", "naïve", "|"]
    common = " ".join(rng.choices(vocabulary, k=14))
    rows = []
    for i in range(150):
        body = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        if i % 2:
            body.insert(0, common.upper() if i % 4 == 1 else common.replace(" ", " \t"))
        if i % 9 == 0:
            body += body
        rows.append((i, "\n".join(body), rng.choice(["a", "a", "a", "b", None]), 1, "x"))
    rows += [(200, None, None, 1, ""), (201, "", "a", 1, ""), (None, "\n\n \x0b\n", "b", 1, ""), (202, "w " * 40000 + "end\n", "a", 1, "")]
    rows += [(7, rows[7][1], rows[7][2], 1, "x")] * 3 + [(300 + i, rows[8][1], "b", 1, "x") for i in range(30)]
    df = quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(5), min_docs=4, max_share=0.1)
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words removed_lines removed_words base_failed depleted kept"
    found = df.select(*names.split()).collect()
    assert Counter(map(tuple, found)) == expected(rows, 4, 0.1)
    assert any(r["removed_lines"] for r in found) and any(r["depleted"] and not r["base_failed"] for r in found)


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_without_common_lines(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choices(["Éa", "b", "c#", "d", "e", "<f>", "g"], k=n))
    common, rows = text(9), []
    for i in range(60):
        body = [text(rng.randint(15, 30)), "", text(30)]
        if i % 3:
            body.insert(i % 4, common.upper() if i % 2 else common.replace(" ", " \t"))
        rows.append((i, "\n".join(body), "ab"[i % 5 == 0], i, "x"))
    rows += [(100, None, "a", 1, None), (101, "", None, 1, ""), (102, common + "\n" + common, "a", 1, "")]
    # The same id with another text, no id, and the line where it is not common.
    rows += [(1, "short", "a", 7, "y"), (None, rows[1][1], "a", 8, "z"), (103, common + "\n" + text(40) + "\n", "c", 1, "")]
    texts = defaultdict(set)
    for _, t, host, *_ in rows:
        texts[host].add(t or "")
    held = Counter((host, line) for host, ts in texts.items() for t in ts for line in normal_lines(t))
    gone = {k for k, n in held.items() if n > 5 and n > 0.1 * len(texts[k[0]])}
    left = lambda t, host: t and "\n".join(x for x in t.split("\n") if not any((host, k) in gone for k in normal_lines(x)))
    found = without_common_lines(spark.createDataFrame(rows, SCHEMA).repartition(3), min_docs=5, max_share=0.1).collect()
    assert sorted(((r[0], left(r[1], r[2]), *r[2:]) for r in rows), key=repr) == sorted((tuple(r)[:5] for r in found), key=repr)
    assert {(r.doc_id, r.n_words): r.kept for r in found}[(1, 7)] is False and sum(r.kept for r in found) > 50
    assert sum(r[1] != left(r[1], r[2]) for r in rows) > 30 and left(rows[-1][1], "c") == rows[-1][1]
