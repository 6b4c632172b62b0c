"""Components against all pairs of shingle sets."""

import random
import re

import numpy as np
import pytest

from notewright.llm import passages, shingle_join
from notewright.llm.components import components
from notewright.llm.shingle_join import _digest, overlaps, prefix_length, shingle_components, shingle_sets
from notewright.llm.texts import Texts

SCHEMA = "doc_id long, text string, kind long, pack string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}


def plain(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    parent[top(i)] = top(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if sets[i] and doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((r[0], len(s), least.get(top(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "dé", "e"] if seed % 2 else [f"W{i}" for i in range(200)]
    rows = []
    for _ in range(18):
        base = rng.choices(vocabulary, k=rng.choice([3, 4, 6, 30, 80, 150]))
        for _ in range(rng.choice([1, 2, 9, 20])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(copy) + 1)
                copy[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            rows.append((len(rows) * 3 % 997, rng.choice([" ", "\n", "  "]).join(copy).swapcase(), 1, "x"))
    rows += [(2000, None, 1, ""), (2001, "", 1, ""), (2002, " \t", 1, ""), (2003, "one", 1, ""), (2004, "ONE", 1, ""), (2005, "one two", 1, "")]
    rows += [(None, rows[4][1], 1, ""), (None, "only null here now", 1, ""), (2006, "long " * 30000, 1, ""), (2007, "Long " * 9, 1, "")]
    return rows + [rows[9]] * 2


@pytest.mark.parametrize("seed,pack,block", [(1, 2 << 20, 512), (2, 1500, 512), (3, 700, 3), (4, 1500, 2)])
def test_matches_all_pairs(spark, monkeypatch, seed, pack, block):
    monkeypatch.setattr(passages, "PACK_BYTES", pack)
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rows = corpus(seed)
    found = shingle_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    expected = plain(rows)
    assert sorted(map(tuple, found), key=repr) == expected
    assert any(r[0] != r[2] for r in expected)


@pytest.mark.parametrize("first", [0, 1])
def test_members_of_one_group_link_on_their_own(spark, monkeypatch, first):
    """A and A' are one group and link, A' and B link, A and B don't; whichever of A and A' is the first."""
    for seed in range(20000):
        rng = random.Random(seed)
        a = [f"w{rng.randrange(10**6):06d}" for _ in range(103)]
        fresh = [f"v{rng.randrange(10**6):06d}" for _ in range(16)]
        near = a[:-8] + fresh[:8]
        texts = [" ".join(t) for t in (a, near, fresh[8:] + near[8:])]
        sets = shingle_sets(Texts.of([t.encode() for t in texts]))
        heads = [set(s[: prefix_length(len(s))].tolist()) for s in sets]
        kinds = [_digest(s, 1) for s in sets]
        if heads[0] == heads[1] and heads[1] & heads[2] and kinds[first] < kinds[1 - first]:
            break
    assert heads[0] == heads[1] and heads[1] & heads[2] and kinds[first] < kinds[1 - first]
    # Four packs of all three texts: every shingle has one level, and the prefixes are the smallest hashes.
    monkeypatch.setattr(passages, "PACK_BYTES", sum(map(len, texts)))
    rows = [(3 * k + i + 1, texts[i], 1, "") for k in range(4) for i in range(3)]
    found = shingle_components(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert sorted(map(tuple, found), key=repr) == plain(rows)
    assert {r.component_id for r in found} == {1}


def test_empty_table(spark):
    assert shingle_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 90, 40)).astype(np.uint64) for _ in range(20)]
    got = overlaps(sets)
    for i in range(20):
        for j in range(20):
            if i != j:
                assert got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 200)]
    mixed = {i: (i * 0x9E3779B97F4A7C15 + 12345) % (1 << 61) for pair in chain for i in pair}
    edges = [(mixed[a], mixed[b]) for a, b in chain]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    roots = {i: found[m] for i, m in mixed.items()}
    assert len({roots[i] for i in range(41)}) == 1 and len({roots[i] for i in range(100, 140)}) == 1
    assert roots[200] == roots[300] and len(set(roots.values())) == 3
