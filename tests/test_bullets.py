import pytest
from pyspark.sql import functions as F

from notewright.operators import bullets as B
from notewright.operators import vocabulary as V
from notewright.plans import compose

VOCABULARY = ["harbour", "basalt", "by-law", "turbine", "yew!", "long tidal gate"]


@pytest.fixture(scope="module")
def keys(spark):
    rows = [("p", term) for term in VOCABULARY] + [("q", "other")]
    return V.anchor_keys(spark.createDataFrame(rows, "project_id string, term string"))


BULLETS = [
    ("Oiled each turbine", True), ("Picked Basalt over brick", True), ("Read that by-law twice", True),
    ("Stood by a law", False), ("Cut a yew", False), ("One Long-Tidal, GATE shut", True), ("long tidal", False),
    ("Met [Q](session://persons/8) near a turbine", False), ("SESSION://PERSONS/8 turbine", False), ("turbines", False),
    ("other", False), ("", False), ("H\u00e1rbour", True),
]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_anchors_by_broadcast_and_by_shuffle(spark, keys, monkeypatch, limit):
    monkeypatch.setattr(V, "BROADCAST_BYTES", limit)
    df = spark.createDataFrame([("p", i, text) for i, (text, _) in enumerate(BULLETS)], "project_id string, i int, text string")
    out = V.anchored(df, keys, ["i"], "text").collect()
    assert sorted(r.text for r in out) == sorted(text for text, wanted in BULLETS if wanted)
    assert {tuple(r) for r in out} <= {("p", i, text) for i, (text, _) in enumerate(BULLETS)}


def test_anchoring_takes_one_exchange_and_a_filter_of_any_size(spark, monkeypatch):
    terms = [("p" if k % 2 else "q", f"w{k}" if k % 3 else f"w{k} x{k} y") for k in range(300)]
    keys = V.anchor_keys(spark.createDataFrame(terms, "project_id string, term string"))
    texts = [("p" if i % 2 else "q", i, f"a w{i} x{i} y b" if i % 5 else f"w{i} x{i}", [i]) for i in range(320)]
    df = spark.createDataFrame(texts, "project_id string, i int, text string, more array<int>")

    def held(p, text):
        return any(q == p and f" {term} " in f" {text} " for q, term in terms)

    wanted = sorted(i for p, i, text, _ in texts if held(p, text))
    for least, most in ((1 << 10, 1 << 18), (128, 128)):
        monkeypatch.setattr(V, "LEAST_BITS", least)
        monkeypatch.setattr(V, "MOST_BITS", most)
        out = V.anchored(df, keys, ["i"], "text")
        assert sorted(r.i for r in out.collect()) == wanted and all(r.more == [r.i] for r in out.collect())
    plan = V.anchored(df, spark.createDataFrame(keys.collect(), keys.schema), ["i"], "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_words_without_a_hit_do_not_reach_the_sort(spark, monkeypatch, limit):
    """Of a line whose every word passes the filter one row and its hits are sorted, however long it is."""
    monkeypatch.setattr(V, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(V, "LEAST_BITS", 128)
    monkeypatch.setattr(V, "MOST_BITS", 128)
    terms = [("p", f"t{k}") for k in range(1000)] + [("p", "u1 u2"), ("p", "u2 u3 u4")]
    keys = V.anchor_keys(spark.createDataFrame(terms, "project_id string, term string"))
    filler = " ".join(f"u{j}x" for j in range(100))
    texts = [("p", i, f"{filler} t{i} u2 u3 u4" if i % 2 else f"{filler} u1 u3") for i in range(20)]
    # The same id again, and one without any word.
    df = spark.createDataFrame(texts + texts[:4] + [("p", 90, "--"), ("p", 91, None), (None, 92, "t1")], "project_id string, i int, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = V.anchored(df, keys, ["i"], "text")
        assert sorted((r.i, r.text) for r in out.collect()) == [(i, text) for _, i, text in texts if i % 2]
        node = out._jdf.queryExecution().executedPlan()
        while node.nodeName() != "SortAggregate" or "partial" not in node.toString().split("\n")[0]:
            node = node.children().apply(0)
        node = node.children().apply(0)
        while node.metrics().get("numOutputRows").isEmpty():
            node = node.children().apply(0)
        assert node.metrics().apply("numOutputRows").value() <= 25 + 2 * 12
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_vocabulary_terms(spark):
    terms = spark.createDataFrame([("p", ["agents", "my app", " "])], "project_id string, terms array<string>")
    names = spark.createDataFrame([("p", "src"), ("p", "Widget-Store"), ("p", "ab"), ("p", "x-yz-caf\u00e9!")], "project_id string, name string")
    none = names.where("false")
    out = {r.term for r in V.project_vocabulary(terms, names, none).collect()}
    assert out == {"agents", "my app", "widget-store", "widget", "x-yz-cafe!", "cafe"}


def test_bullet_content(column):
    lines = [
        "- a", "* a", "  -\t**a** b ", "-a", "a - b", "- ", "-", "\u00a0- a", "- a\rb", "- a\u2028b", "--  a", "- - a", "-\r a",
        "- **", "", None,
    ]
    out = column(lines, lambda n: B.bullet_content(F.col(n)))
    assert out == ["a", "a", "a b", None, None, "", None, "a", None, None, None, "- a", "a", "", None, None]


@pytest.mark.parametrize(
    "use, yes, no",
    [
        (B.is_past_tense, ["Fixed x", "You merged", "the user Ran it", "need x", "WE built"], ["`Fixed`", "Fixing", "you the user ran", "9 fixed", "", "user"]),
        (B.is_pending, ["Resolve it", "follow up.", "add-on", "FIX"], ["Added", "resolved", "you add", "adding", "run\u00e9"[:2]]),
        (B.is_bare_link, ["[a](b)", "[a](b). ", "[](x)..\u00a0"], ["see [a](b)", "[a](b) x", "[a]"]),
        (B.is_placeholder, ["", "[email] x", " `[Phone] x", "x [local path] ", "x [redacted]"], ["[jwt] x", "x [email] y", "[aws-key]"]),
    ],
)
def test_line_tests(column, use, yes, no):
    assert column(yes + no, lambda n: use(F.col(n))) == [True] * len(yes) + [False] * len(no)


def test_truncates_after_280(column):
    texts = ["x" * 280, "x" * 281, "\U0001f600" * 281]
    assert column(texts, lambda n: B.truncate_bullet(F.col(n))) == ["x" * 280, "x" * 280 + "\u2026", "\U0001f600" * 280 + "\u2026"]


def test_filters_come_before_the_cap(spark, keys):
    lines = ["- Paint harbour", "- Hummed nothing"] * 3
    lines += [f"- Swept harbour {i}" for i in range(4)] + ["- Swept harbour with Odile", "- Swept harbour in K:\\q\\r.py"]
    lines += [f"- Swept harbour {i}" for i in range(4, 9)]
    entries = spark.createDataFrame([("p", "s", "\r\n".join(lines), ["odile"])], "project_id string, summary_id string, text string, denied array<string>")
    kept = B.first_bullets(B.accepted_bullets(entries, keys, ["summary_id"], []), ["summary_id"])
    assert [r.bullet for r in kept.orderBy("line_pos").collect()] == [f"Swept harbour {i}" for i in range(6)]


def test_only_lines_that_may_be_kept_are_redacted(spark, keys, monkeypatch):
    """Late lines are redacted where the early ones give too few, and nowhere else."""
    hidden = "- Swept harbour with Odile"
    texts = {
        "enough": [f"- Swept harbour {i}" for i in range(14)] + ["- Swept harbour never"],
        "late": [hidden] * 8 + [f"- Swept harbour {i}" for i in range(9)],
        "few": [hidden] * 14 + ["- Swept harbour 1"],
    }
    rows = [("p", name, "\n".join(lines), ["odile"]) for name, lines in texts.items()]
    entries = spark.createDataFrame(rows, "project_id string, summary_id string, text string, denied array<string>")
    entries = entries.withColumn("text", F.regexp_replace("text", "Odile", "O"))

    def redact(text, terms, scheme):
        seen = F.when(F.col(text).endswith("with O"), "[redacted]").otherwise(F.col(text))
        return F.when(F.col(text).endswith("never"), F.raise_error(F.lit("redacted too much")).cast("string")).otherwise(seen)

    monkeypatch.setattr(B, "redact", redact)
    kept = B.first_accepted_bullets(entries, keys, ["summary_id"], [])
    got = {name: [r.bullet for r in kept.where(F.col("summary_id") == name).orderBy("line_pos").collect()] for name in texts}
    six = [f"Swept harbour {i}" for i in range(6)]
    assert got == {"enough": six, "late": six, "few": ["Swept harbour 1"]}


def test_deny_lists_join_without_a_shuffle_of_texts(spark):
    entries = spark.createDataFrame([("p", "a"), ("q", "b")], "project_id string, text string")
    deny = spark.createDataFrame([("p", ["x"])], "project_id string, denied array<string>")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = compose.with_denied(entries, deny)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert sorted(map(tuple, joined.collect())) == [("p", "a", ["x"]), ("q", "b", None)]


@pytest.mark.parametrize(
    "title, wanted",
    [
        ("Harbour Dredging and Lunch Plans", "Harbour Dredging"), ("Harbour and Turbine AND rest", "Harbour and Turbine"),
        ("Walks and Talks", "Walks and Talks"), ("Harbour  by OrlandCo and rest", "Harbour by [redacted]"), ("Windy harbour", "Windy harbour"),
        ("Wrote k@l.io", "Wrote [email]"),
    ],
)
def test_trims_titles(spark, keys, title, wanted):
    entries = spark.createDataFrame([("p", "s", title, ["orlandco"], 7)], "project_id string, summary_id string, title string, denied array<string>, n int")
    row = B.trim_titles(entries, keys, ["summary_id"]).first()
    assert (row.title, row.n) == (wanted, 7)
