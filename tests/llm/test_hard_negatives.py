"""Hard negatives against a comparison of every anchor with every row, with cells and packs small enough to split."""

import math
from collections import Counter

import numpy as np
import pytest

from notewright.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, rank int, score double, own string"


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def expected(rows):
    items = []
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        e = whole(v)
        if sum(x * x for x in e) <= H.LONGEST:
            items.append((i, (label + 1) % 10 if i % 7 == 0 else label, e))
    width = max((len(e) for *_, e in items), default=0)
    items = [(i, label, tuple(e + [0] * (width - len(e)))) for i, label, e in items]
    anchors = {}
    for i, label, e in items:
        if i % 100 == 0:
            packed = np.array(e, np.int32).tobytes()
            anchors[i] = min(anchors.get(i, (label, packed, e)), (label, packed, e))
    out = Counter()
    for a, (label, _, e) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(e, f)), i, same == label) for i, same, f in items if i != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            below = [(n, i) for n, i, same in scored if not same and 80 * -s <= 100 * -n <= 100 * -s][:5]
            for rank, (n, i) in enumerate(below, 1):
                out[(a, p, rank, i, -s, -n)] += 1
    return out


def actual(spark, rows):
    found = H.hard_negatives(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, found.collect()))


@pytest.fixture
def small(monkeypatch):
    for name, value in {"SAMPLE": 300, "FANOUT": 4, "SPLIT": 16, "CELL_ROWS": 60, "PACK_ROWS": 32, "GROUP": 3, "PACKS": 2}.items():
        monkeypatch.setattr(H, name, value)


def clustered(n, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 6))
    return [(k, (centres[k % 12] + r.normal(size=6) / 8).astype(np.float32).tolist(), int(k % 5), 1, 1, 1.0, "x") for k in range(n)]


def test_clusters_ties_and_one_common_vector(spark, small):
    rows = clustered(900, 1)
    rows += [(1000 + k, rows[5][1], k % 3, None, None, None, None) for k in range(500)]  # equal vectors
    rows += [(k + 2000, [0.0] * 6, 1, 1, 1, 1.0, "") for k in range(30)]
    assert actual(spark, rows) == expected(rows)


def test_odd_rows(spark, small):
    rows = clustered(250, 2)
    extra = (1, 1, 1.0, "x")
    rows += [(None, [1.0] * 6, 1, *extra), (300, None, 1, *extra), (301, [1.0] * 6, None, *extra), (302, [1.0, None], 1, *extra)]
    rows += [(303, [float("nan")] * 6, 1, *extra), (400, [float("inf")] * 6, 1, *extra), (500, [], 2, *extra), (501, [0.5], 2, *extra)]
    rows += [(600, [3e38] * 6, 1, *extra), (700, [2e6] * 6, 1, *extra), (701, [2e6] * 6, 1, *extra), (702, [1.9e6] * 6, 2, *extra)]
    rows += [rows[100], (100, rows[7][1], 3, *extra), (800, rows[3][1], 77, *extra), rows[4], rows[4]]
    assert actual(spark, rows) == expected(rows)


def test_few_rows_and_none(spark):
    assert actual(spark, []) == Counter()
    one = [(0, [1.0, 2.0], 1, 1, 1, 1.0, "x")]
    assert actual(spark, one) == Counter()
    rows = one + [(1, [1.0, 2.0], 2, 1, 1, 1.0, ""), (2, [1.0, 1.9], 3, 1, 1, 1.0, "")]
    assert actual(spark, rows) == expected(rows) and expected(rows)


def test_ranges_rule_out_cells_and_no_result(monkeypatch):
    for name, value in {"FANOUT": 4, "SPLIT": 16, "CELL_ROWS": 60}.items():
        monkeypatch.setattr(H, name, value)
    rows = np.array([whole(r[1]) for r in clustered(1200, 3)], np.int32)
    tree = H.Tree(rows[::4], len(rows))
    cells = tree.cells_of(rows)
    lengths = np.sqrt((rows.astype(float) ** 2).sum(1))
    ranges = []
    for cell, way in tree.paths().items():
        own = rows[cells == cell]
        for node, child in way:
            if len(own):
                away = H.distances(own, tree.nodes[node].points)
                ranges.append((node, -1, child, lengths[cells == cell].min(), lengths[cells == cell].max()))
                ranges += [(node, p, child, away[:, p].min(), away[:, p].max()) for p in range(away.shape[1])]
    merged = {}
    for *key, low, high in ranges:
        was = merged.get(tuple(key), (low, high))
        merged[tuple(key)] = (min(was[0], low), max(was[1], high))
    tree.measure([(*k, *v) for k, v in merged.items()])
    anchors = rows[::100]
    scores = H.products(anchors, rows)
    best = -np.sort(-scores, axis=1)
    lows, highs = best[:, [20]], best[:, [5]]
    reached = tree.reached(anchors, lows, highs)
    for a in range(len(anchors)):
        inside = (scores[a] >= lows[a]) & (scores[a] <= highs[a])
        assert reached[a, cells[inside]].all()
    assert tree.cells > 8 and reached.mean() < 0.5


def test_products_are_exact_beyond_doubles():
    a = np.array([[2**30 - 1, -3, 7]], np.int32)
    assert H.products(a, a)[0, 0] == (2**30 - 1) ** 2 + 58
