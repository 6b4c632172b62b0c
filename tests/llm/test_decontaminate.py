"""Spans and items against a plain search for every window."""

import random
import re

import pytest

from notewright.llm import decontaminate
from notewright.llm.decontaminate import benchmark_hits

DOCS, ITEMS = "doc_id long, text string, spans int, item_id string", "item_id long, text string, doc_id int"


def tokens(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def expected(docs, items):
    windows = {}
    for item_id, text, *_ in items:
        words = tokens(text)
        size = min(10, len(words))
        for i in range(len(words) - size + 1) if size else []:
            windows.setdefault(tuple(words[i : i + size]), set()).add("" if item_id is None else str(item_id))
    out = []
    for doc_id, text, *_ in docs:
        words, hit, names = tokens(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if found := windows.get(tuple(words[i : i + size])):
                    hit |= set(range(i, i + size))
                    names |= found
        out.append((doc_id, len(words), sorted(hit), sorted(names)))
    return sorted(out, key=repr)


def actual(df):
    rows = df.collect()
    for r in rows:
        assert all(a.past < b.first for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.doc_id, r.n_words, [k for s in r.spans for k in range(s.first, s.past)], list(r["items"])) for r in rows), key=repr)


@pytest.mark.parametrize("block", [4 << 20, 400])
def test_matches_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(7)
    vocabulary = ["the", "Of", "wé", "x1", "and", "42", "là", "a"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 11, 40]))), 1) for i in range(30) if i % 7]
    items = [x for x in items if len(tokens(x[1])) != 1] + [(50, "Zebra!", 1), (None, "q w e r", 1), (3, items[5][1], 1), (9, None, 1)]
    items += [(70, "a a a a a a a a a a a a", 2)] * 2
    docs = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = (rng.choice(items)[1] or "").upper().split(" ")
        docs.append((i, ", ".join(words), 1, "x"))
    docs += [(None, None, 1, ""), (400, "", 1, ""), (401, "a " * 3000 + "zebra", 1, ""), (5, docs[5][1], 2, ""), (402, "ZEBRA", 1, "")]
    df = benchmark_hits(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS))
    assert actual(df) == expected(docs, items)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "a b", 1)], ITEMS)
    docs = spark.createDataFrame([(1, "a b c", 1, "")], DOCS)
    assert actual(benchmark_hits(docs, none)) == [(1, 3, [], [])]
    assert benchmark_hits(docs.limit(0), some).collect() == []
