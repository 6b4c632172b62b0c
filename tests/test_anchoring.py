import pytest

from notewright.operators import vocabulary as V


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def local(spark, monkeypatch):
    """What is kept becomes a local table, so that plans show what runs after it."""
    monkeypatch.setattr(V, "durable", lambda df: spark.createDataFrame(df.collect(), df.schema))


def keys_of(spark, n):
    terms = [("p", f"w{k}" if k % 3 else f"w{k} x{k}") for k in range(n)] + [(None, "stray")]
    keys = V.anchor_keys(spark.createDataFrame(terms, "project_id string, term string"))
    return spark.createDataFrame(keys.collect(), keys.schema)


TEXTS = [("p", 1, "a w1 b"), ("p", 2, "w3 b x3"), ("p", 3, "b w3 x3"), ("p", 4, "none"), ("q", 5, "w1"), (None, 6, "stray"), ("p", 7, "")]


def test_the_filter_is_not_written_out_in_the_plan(spark):
    df = spark.createDataFrame(TEXTS, "project_id string, i int, text string")
    few, many = (V.anchored(df, keys_of(spark, n), ["i"], "text") for n in (30, 3000))
    assert {r.i for r in many.collect()} == {r.i for r in few.collect()} == {1, 3}
    assert len(plan_of(many)) < len(plan_of(few)) + 1000


@pytest.mark.parametrize("bits", [64, 1 << 18])
@pytest.mark.parametrize("limit", [600, 0])
def test_texts_do_not_meet_a_large_vocabulary_in_a_shuffle(spark, monkeypatch, local, bits, limit):
    """Whether the filter holds back nothing or nearly all that is no term, and what it lets through is broadcast or not."""
    monkeypatch.setattr(V, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(V, "LEAST_BITS", bits)
    monkeypatch.setattr(V, "MOST_BITS", bits)
    df = spark.createDataFrame(TEXTS * 2, "project_id string, i int, text string")
    out = V.anchored(df, keys_of(spark, 300), ["i"], "text")
    if limit:
        assert plan_of(out).count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r) for r in out.collect()) == [("p", 1, "a w1 b"), ("p", 3, "b w3 x3")]
