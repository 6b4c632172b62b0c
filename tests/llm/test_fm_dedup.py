"""Removed words against a plain count of all windows, and the index against direct search."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from notewright.llm import passages
from notewright.llm.fm_dedup import FmIndex, repeated_passages, repeated_windows
from notewright.llm.texts import Spans, Texts, words

SCHEMA = "doc_id long, text string, pack int, spans string"


def plain(rows, size=35):
    data = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    count = Counter(tuple(w[k : k + size]) for _, w in data for k in range(len(w) - size + 1))
    out = []
    for i, w in data:
        gone = {k + j for k in range(len(w) - size + 1) if count[tuple(w[k : k + size])] > 1 for j in range(size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,pack,hot", [(1, 2 << 20, 7), (2, 2000, 7), (3, 2000, 2), (4, 500, 1)])
def test_matches_all_windows(spark, monkeypatch, seed, pack, hot):
    monkeypatch.setattr(passages, "PACK_BYTES", pack)
    monkeypatch.setattr(passages, "HOT_LEVEL", hot)
    rng = random.Random(seed)
    vocabulary = ["é", "b", "Cc", "dd,", "the"] if seed % 2 else [f"w{i}" for i in range(60)]
    blanks = [" ", "  ", "\t", "\n", " \x0b"]
    spaced = lambda words: "".join(w + rng.choice(blanks) for w in words)
    shared = [rng.choices(vocabulary, k=rng.randint(25, 90)) for _ in range(10)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(shared) if rng.random() < 0.5 else rng.choices(vocabulary, k=rng.randint(0, 60))
        rows.append((i, spaced(parts), 1, "x"))
    rows += [(500, None, 1, ""), (501, "", 1, ""), (502, "same " * 900, 1, ""), (503, " \n", 1, ""), (None, rows[4][1], 1, "")]
    rows += [(504, "q " * 34, 1, ""), (505, "r " * 35, 1, ""), (506, "s " * 36, 1, "")] + [rows[7]] * 2
    expected = plain(rows)
    df = repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    got = sorted(((r.doc_id, r.n_words, sum(s.past - s.first for s in r.spans), r.kept_sha256) for r in df), key=repr)
    assert got == expected
    assert sum(r[2] for r in expected) > 500


def test_empty_table(spark):
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_matching_statistics():
    rng = np.random.default_rng(4)
    for letters in (1, 2, 5, 40):
        text = rng.integers(1, letters + 1, 120)
        weights = rng.integers(1, 3, 120)
        ends = np.arange(11, 120)
        got = FmIndex(text, weights).matching(text, ends, 12, 3)
        for end, length in zip(ends, got):
            best = 0
            for size in range(1, 13):
                piece = text[end - size + 1 : end + 1]
                if sum(weights[i] for i in range(121 - size) if (text[i : i + size] == piece).all()) < 3:
                    break
                best = size
            assert best == length


def test_word_hashes_tell_contents_and_build_no_table(monkeypatch):
    texts = ["one two one", "", "éé two", "a" * 5000 + " one ab ba"]
    data = "".join(texts).encode()
    found = words(Texts(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])))
    contents = [w for t in texts for w in t.split()]
    monkeypatch.setattr(Spans, "encoded", lambda self: pytest.fail("a table of words"))
    hashes = passages.Scheme(window=35, seed=20, by_word=True).values(found).tolist()
    assert len(hashes) == len(contents)
    assert len(set(zip(contents, hashes))) == len(set(contents)) == len(set(hashes))


def test_a_string_that_repeats_whole_takes_one_search(monkeypatch):
    searched = []
    whole = FmIndex.matching
    monkeypatch.setattr(FmIndex, "matching", lambda self, text, ends, *rest: searched.append(len(ends)) or whole(self, text, ends, *rest))
    data = " ".join(f"w{i}" for i in range(90)).encode() + b" "
    found = words(Texts(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
    assert repeated_windows(found, np.array([1]), np.array([2])).tolist() == [1] * 56
    assert sum(searched) == 1
    assert repeated_windows(found, np.array([1]), np.array([1])).tolist() == [0] * 56
