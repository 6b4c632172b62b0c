import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notewright.operators import search as S
from notewright.operators import vectors as V


def cosines(vectors, asked, limits, threshold=0.35):
    wanted = {}
    for i, query in enumerate(asked):
        scores = vectors @ query / np.linalg.norm(vectors, axis=1) / np.linalg.norm(query)
        best = sorted((-round(s, 9), f"s{j:03}") for j, s in enumerate(scores) if s >= threshold)[: limits[i]]
        wanted |= {(f"q{i}", k + 1): (name, -score) for k, (score, name) in enumerate(best)}
    return wanted


def searched(spark, vectors, asked, limits, odd=()):
    have = spark.createDataFrame(
        [(f"s{i:03}", v.tolist()) for i, v in enumerate(vectors)] + list(odd), "summary_id string, embedding array<double>"
    ).repartition(5)
    rows = [(f"q{i}", v.tolist(), limits[i]) for i, v in enumerate(asked)] + [("none", None, 3), ("short", [1.0], 3), ("zero", [0.0] * 6, 3)]
    return have, spark.createDataFrame(rows, "q string, query_vector array<double>, n int")


def found(have, want):
    return {(r.q, r.hit_pos): (r.summary_id, round(r.score, 9)) for r in S.semantic_topk(have, want, ["q"], F.col("n")).collect()}


@pytest.mark.parametrize("budget", [1 << 24, 100])
def test_vectors_match_brute_force(spark, monkeypatch, budget):
    monkeypatch.setattr(S, "QUERY_BYTES", budget)
    rng = np.random.default_rng(7)
    vectors, asked, limits = rng.normal(size=(80, 6)), rng.normal(size=(7, 6)), [1, 2, 3, 4, 5, 100, 100]
    odd = [("zero", [0.0] * 6), ("null", None), ("nan", [float("nan")] * 6), ("inf", [float("inf")] * 6), ("long", [1.0] * 7), ("void", [])]
    assert found(*searched(spark, vectors, asked, limits, odd)) == cosines(vectors, asked, limits)


@pytest.mark.parametrize("budget", [1 << 24, 200])
def test_near_vectors_are_found_without_most_comparisons(spark, monkeypatch, budget):
    monkeypatch.setattr(S, "QUERY_BYTES", budget)
    monkeypatch.setattr(V, "BLOCK_ROWS", 8)
    monkeypatch.setattr(V, "HELD", 20)
    monkeypatch.setattr(S, "SAMPLE", 60)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(10, 6))
    vectors = np.repeat(centres, 60, 0) + rng.normal(size=(600, 6)) / 20
    vectors[100:160] = vectors[100]  # ties go by id
    asked, limits = centres + rng.normal(size=(10, 6)) / 20, [3, 70, 8, 8, 8, 8, 8, 8, 1, 0]
    have, want = searched(spark, vectors, asked, limits)
    assert found(have, want) == cosines(vectors, asked, limits)
    assert S.pruned_share(have, want, ["q"], F.col("n")) > 0.5


@pytest.mark.parametrize("names", [int, lambda k: f"s{k:03}"])
def test_candidates_are_cut_only_when_as_many_have_come_again(monkeypatch, names):
    """What all queries keep is more than is held before a cut; each cut must still wait for new candidates."""
    monkeypatch.setattr(V, "HELD", 50)
    monkeypatch.setattr(V, "BLOCK_ROWS", 8)
    cuts, cut = [], V.Best.cut
    monkeypatch.setattr(V.Best, "cut", lambda self: cuts.append(sum(map(len, self.queries))) or cut(self))
    rng = np.random.default_rng(9)
    rows, asked = rng.normal(size=(800, 6)), rng.normal(size=(40, 6))
    rows[200:260] = rows[200]
    table = pa.table({"q": range(40), "_limit": [8] * 40, "query_vector": asked.tolist()})
    stored = pa.table({"summary_id": [names(k) for k in range(800)], "embedding": rows.tolist()})
    own = V.asked_of(table, ["q"], stored.slice(0, 10), 0.1)
    run = V.scan(type("Shared", (), {"value": own}))
    out = pa.Table.from_batches(run(iter(stored.to_batches(max_chunksize=100)))).to_pylist()
    assert len(cuts) < 20 and max(cuts) < 3 * 40 * 8
    scores = rows @ asked.T / np.linalg.norm(rows, axis=1)[:, None] / np.linalg.norm(asked, axis=1)
    for q in range(40):
        best = sorted((-round(s, 9), names(k)) for k, s in enumerate(scores[:, q]) if s >= 0.1)[:8]
        assert sorted((-round(r["score"], 9), r["summary_id"]) for r in out if r["q"] == q and r["score"] is not None) == best


def test_no_vectors_or_no_queries(spark):
    have, want = searched(spark, np.zeros((0, 6)), np.ones((1, 6)), [3])
    assert found(have, want) == {}
    have, _ = searched(spark, np.ones((2, 6)), np.ones((1, 6)), [3])
    assert found(have, want.limit(0)) == {}


@pytest.mark.parametrize("lists, budget", [(4, 100), (1, 100), (2, 3)])
def test_words_match_brute_force(spark, monkeypatch, lists, budget):
    monkeypatch.setattr(S, "LISTS", lists)
    monkeypatch.setattr(S, "SET_WORDS", budget)
    rng = random.Random(3)
    words = ["the"] * 6 + [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choices(words, k=6)) for _ in range(60)] + ["", None, "the w1 w2 w3 w4 w5 w6 w7"]
    asked = ["the w1", "W2, w3!", "the", "absent the", "", "w4 w4", "w1 the", None, "w1 w2 w3 w4 w5 w6 w7", "the w2 w5"]
    dates = [f"2024-01-{i % 9 + 1:02}" if i % 10 else None for i in range(len(texts))]
    rows = [(f"s{i:02}", t, d) for i, (t, d) in enumerate(zip(texts, dates))]
    docs = spark.createDataFrame(rows + rows[:20], "summary_id string, text string, created_at string")
    limits = [5, 5, 40, 5, 5, 5, 2, 5, 5, 0]
    want = spark.createDataFrame([(q, t, limits[q]) for q, t in enumerate(asked)], "q int, query_text string, n int")
    out = {(r.q, r.hit_pos): r.summary_id for r in S.keyword_topk(docs, want, ["q"], F.col("n")).collect()}
    wanted = {}
    for q, text in enumerate(asked):
        needed = set((text or "").lower().replace(",", " ").replace("!", " ").split())
        found = [i for i, t in enumerate(texts) if needed and needed <= set((t or "").split())]
        found.sort(key=lambda i: f"s{i:02}")
        found.sort(key=lambda i: dates[i] or "", reverse=True)
        wanted |= {(q, n + 1): f"s{i:02}" for n, i in enumerate(found[: limits[q]])}
    assert out == wanted


def test_no_row_per_session_word_and_query(spark):
    """One word of all sessions and very many queries: posting lists meet sets, sessions come last and limited."""
    docs = spark.range(2000).selectExpr("concat('s', id) as summary_id", "concat('common w', id % 50) as text", "cast(id as string) as created_at")
    want = spark.range(300).selectExpr("id as q", "concat('common w', id % 60) as query_text")
    out = S.keyword_topk(docs, want, ["q"], 3)
    assert out.count() == 50 * 5 * 3
    assert out.groupBy("q").count().where("count > 3").isEmpty()
