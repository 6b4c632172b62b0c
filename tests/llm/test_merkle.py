"""Manifest and proofs against a single-process tree, with blocks small enough for several levels of them."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx long, digest string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def climb(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    steps = []
    for level in levels[:-1]:
        first = i // 3 * 3
        steps.append((level[first:i], level[i + 1 : first + 3]))
        i //= 3
    return steps


def fold(digest, steps):
    for left, right in steps:
        digest = sha(*left, digest, *right)
    return digest


def tampered(row):
    i, *rest, text = row[:5]
    if i is not None and text is not None and zlib.crc32(str(i).encode()) % 2 == 0:
        text = text.replace("\n", "")
    return (i, *rest, text)


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([m[2] for m in sorted(groups[s], key=lambda m: m[:3])]) for s in order}
    top = climb([trees[s][-1][0] for s in order])
    out = Counter()
    for place, s in enumerate(order):
        for i, (*_, own, row) in enumerate(sorted(groups[s], key=lambda m: m[:3])):
            steps = path(trees[s], i) + path(top, place)
            proof = sha(*[d for left, right in steps for d in (*left, *right)])
            folded = fold(leaf(tampered(row)), steps)
            out[(row[0], own, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0])] += 1
    return out


def actual(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = merkle.proofs(docs, merkle.without_line_feeds(F.col("doc_id"), F.col("text")))
    return Counter(tuple(r) for r in found.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in {"HEIGHT": 2, "BLOCK": 9, "ASKERS": 2}.items():
        monkeypatch.setattr(merkle, name, value)


def rows_of(n):
    extra = ("clash", 5, "clash")
    rows = [(i, f"s{i % 40}" if i % 3 else "hot", "en", i, f"line {i}\nend é" * (i % 4), *extra) for i in range(n)]
    rows += [(None, None, None, None, None, None, None, None), (None, "hot", None, 1, "a\n", *extra)]
    rows += [(7, "hot", "en", 1, "same\n", *extra)] * 2 + [(7, "hot", "de", 1, "other", *extra), (1 << 40, "", "", 0, "", *extra)]
    return rows


def test_blocks_of_several_levels(spark, small_blocks):
    rows = rows_of(400)
    assert actual(spark, rows) == expected(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_small_trees(spark, small_blocks, n):
    rows = [(i, "only", None, None, "x\ny", None, None, None) for i in range(n)]
    found = actual(spark, rows)
    assert found == expected(rows)
    assert {r[-1] for r in found} <= {True, False}


def test_empty_table(spark):
    assert actual(spark, []) == Counter()


def test_long_text_and_full_blocks(spark):
    rows = [(1, "s", None, None, "é\n" * 500_000, None, None, None), *rows_of(30)]
    assert actual(spark, rows) == expected(rows)


def test_union_is_minimal():
    sizes = merkle.sizes_of(20)
    assert merkle.missing(np.array([0, 1, 2]), sizes) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert merkle.missing(np.array([0, 5]), sizes) == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (2, 1), (2, 2)]
    assert merkle.missing(np.arange(20), sizes) == []
    assert merkle.missing(np.array([0]), merkle.sizes_of(1)) == []
