"""Held-out accuracy, the compiled expression against the rules, and awkward inputs."""

import random
import zlib

import numpy as np

from notewright.llm.rule_ensemble import STATISTICS, compiled, fitted, held_out, holds, quality_scores, statistics
from notewright.llm.texts import Texts

DOCS, LABELS = "doc_id long, text string, score double, held_out int", "doc_id long, quality int, text string"


def corpus(n=600):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(20, 80))]
        junk = i % 4 == 0
        if junk:
            words = [w.upper() + "!!" for w in words] if i % 8 else words[:3] * 20
        docs.append((i, " ".join(words), 0.0, 1))
        labels.append((i, int(not junk), "x"))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    docs += [(None, None, 0.0, 1), (9000, "", 0.0, 1), (9001, "w " * 60000, 0.0, 1), (3, docs[3][1], 0.0, 1)]
    rows = quality_scores(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels + labels[:5], LABELS)).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    truth = {i: q for i, q, _ in labels}
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum((r.score >= 0.7) == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_labels_change_nothing(spark):
    docs, labels = corpus(300)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, x) for i, q, x in labels]
    df = spark.createDataFrame(docs, DOCS)
    one, two = (quality_scores(df, spark.createDataFrame(rows, LABELS)).orderBy("doc_id").collect() for rows in (labels, flipped))
    assert one == two


def test_compiled_rules_score_as_the_rules(spark):
    docs, labels = corpus(300)
    data = [t.encode() for _, t, *_ in docs]
    x = statistics(Texts(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])].astype(np.int64)))
    b, rules = fitted(x, np.array([q for _, q, _ in labels], float))
    assert 0 < len(rules) < 100
    wanted = 1 / (1 + np.exp(-(b + sum(w * holds(r, x) for w, r in rules))))
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["i", *STATISTICS])
    got = [r.s for r in df.select("i", compiled(b, rules).alias("s")).orderBy("i").collect()]
    assert np.allclose(got, wanted)


def test_few_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", 0.0, 1)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert quality_scores(docs, none).first().score == 0.5
    assert quality_scores(docs.limit(0), none).collect() == []
    ones = spark.createDataFrame([(1, 1, "x"), (4, None, "x")], LABELS)
    assert 0.5 < quality_scores(docs, ones).first().score < 1
