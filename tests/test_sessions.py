import pytest
from pyspark.sql import functions as F

from notewright.operators import requests as R
from notewright.operators import sessions as S
from notewright.operators.positions import global_positions
from notewright.plans.collect import collect_entries

HIT = "project_id string, summary_id string, category string, strategy string, score double, hit_pos int"
A, B, C, E = "architecture-decisions", "resolved-bugs", "conventions", "environment-gotchas"


def test_best_category_breaks_ties_by_arrival(spark):
    hits = [
        ("p", "s1", B, "semantic", 2.0, 0), ("p", "s1", A, "semantic", 2.0, 5), ("p", "s1", A, "keyword", 2.0, 1),
        ("p", "s2", C, "keyword", 0.0, 0), ("p", "s2", C, "semantic", 0.0, 9), ("p", "s2", E, "semantic", -1.0, 0),
        ("q", "s1", E, "semantic", 9.0, 0),
    ]
    out = S.best_category(spark.createDataFrame(hits, HIT)).collect()
    assert sorted(map(tuple, out)) == [("p", "s1", A, 2.0), ("p", "s2", C, 0.0), ("q", "s1", E, 9.0)]


def test_best_body(spark):
    rows = [
        ("a", "DESCRIPTION", "d1", 1), ("a", "SUMMARY", "s2", 2), ("a", "SUMMARY", "s3", 3), ("a", "DESCRIPTION", "d4", 4),
        ("b", "DESCRIPTION", "d5", 5), ("b", "DESCRIPTION", "d6", 6), ("c", "HIERARCHICAL_PROFILE_SUMMARY", "x", 7),
        ("d", "SUMMARY", "", 8), ("", "SUMMARY", "no id", 9),
    ]
    df = spark.createDataFrame([(r[0] and f"t{i}", *r) for i, r in enumerate(rows)], "annotation_id string, summary_id string, type string, text string, ann_pos int")
    out = S.best_body(S.allowed_annotations(df), ["summary_id"]).collect()
    assert sorted(map(tuple, out)) == [("a", "s3", 1), ("b", "d5", 5)]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("One bug hid a second bug behind our setup", B), ("Drew the architecture", A), ("Night SETUP run", E),
        ("ladybug", B), ("setup, bug", B), ("Watered plants", None), ("", None),
    ],
)
def test_keyword_category(column, text, wanted):
    assert column([text], lambda n: S.keyword_category(F.col(n))) == [wanted]


@pytest.mark.parametrize(
    "title, terms, wanted",
    [
        ("Sorted Paper-Kite invoices", ["paper-kite"], True), ("Tapestry upload", ["tap"], False),
        ("tap-room ledger", ["tap"], True), ("Zo\u00eb Harbour Survey", ["zoe_harbour"], True),
        ("FernGrid Planting", ["fern grid"], True), ("Fern Grid Planting", ["ferngrid"], True), ("Fernando arrives", ["ferna"], False),
        ("Old Tapwaterworks", ["tapwa"], False), ("K l m", ["kl"], False), ("K l m", ["k l"], True),
        ("myFernGrid", ["fern grid"], False), ("some words", ["", "?;"], False), ("we go on", ["z", "go on"], True),
        ("k lmno", ["klm no"], True), ("k lmnop", ["klm no"], False),
    ],
)
def test_title_scope(spark, title, terms, wanted):
    entries = spark.createDataFrame([("p", title), ("q", title)], "project_id string, title string")
    projects = spark.createDataFrame([("p", terms)], "project_id string, terms array<string>")
    assert [r.project_id for r in S.title_scope(entries, projects).collect()] == (["p"] if wanted else [])


def test_requests(column, spark):
    asked = ["CLAUDE.md", "claude", " agents ", "AGENTS.MD", "README.md", "CLAUDE.txt", "", None]
    assert column(asked, lambda n: R.target_name(F.col(n))) == ["CLAUDE.md", "CLAUDE.md", "AGENTS.md", "AGENTS.md"] + [None] * 4
    days = ["30", " 14 ", None, "0", "-5", "30abc", "", "05", "1\n"]
    assert column(days, lambda n: R.window_days(F.col(n))) == [30, 14, 14, None, None, None, None, None, 1]
    assert column([14, 7, 90, 365, 10000], lambda n: R.search_limit(F.col(n)), "int") == [8, 8, 56, 100, 100]
    since = spark.range(1).select(R.window_since(F.lit("2024-03-31 12:00:00").cast("timestamp"), F.lit(2)).cast("string"))
    assert since.first()[0] == "2024-03-29 12:00:00"
    without_zone = R.window_since(F.lit("2024-03-31 12:00:00").cast("timestamp_ntz"), F.lit(2)).cast("string")
    assert spark.range(1).select(without_zone).first()[0] == since.first()[0]
    far = R.window_since(F.lit("2024-03-31 12:00:00").cast("timestamp"), F.lit(99999999999))
    assert spark.range(1).select(far).first()[0] is None
    terms = R.project_terms(F.lit(" My App\u00a0"), F.array(F.lit(" "), F.lit("MA")))
    assert spark.range(1).select(terms).first()[0] == ["my app", "ma"]


def test_positions_of_one_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("g"), (F.col("id") * 37 % 101).alias("v"), "id"
    ).repartition(7)
    out = global_positions(df, ["g"], [F.col("v").desc(), F.col("id").asc()])
    rows = [tuple(r) for r in out.select("g", "v", "id", "position").collect()]
    wanted = []
    for group in ("cold", "hot"):
        mine = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2]))
        wanted += [(g, v, i, n + 1) for n, (g, v, i, _) in enumerate(mine)]
    assert sorted(rows) == sorted(wanted) and len(rows) == 5000


def test_collect_keeps_owner_order_and_windows(spark):
    """A session out of scope owns a shared annotation; dates on the edge stay; topics follow texts."""
    projects = spark.createDataFrame([("p", "owl", ["owl sql"], 2)], "project_id string, project string, aliases array<string>, days bigint")
    hits = spark.createDataFrame(
        [("p", "s1", B, "semantic", 1.0, 0), ("p", "s2", C, "keyword", 0.0, 0), ("p", "s3", C, "keyword", 0.0, 1),
         ("p", "s4", A, "semantic", 3.0, 0), ("p", "s5", A, "semantic", 3.0, 1), ("p", "gone", A, "semantic", 3.0, 2)],
        HIT,
    )
    summaries = spark.createDataFrame(
        [("s1", "OwlSQL day", "2024-01-03T00:00:00Z", ["a1", "shared"], 1),
         ("s2", "Other work", "2024-01-04T00:00:00Z", ["shared"], 2),
         ("s3", "Owl setup", "2024-01-04T01:00:00Z", ["a3"], 3),
         ("s4", "Owl early", "2024-01-02T23:59:59Z", ["a4"], 4),
         ("s5", None, "soon", ["a5"], 5)],
        "summary_id string, name string, created_at string, annotation_ids array<string>, snapshot_pos bigint",
    )
    annotations = spark.createDataFrame(
        [("a1", "DESCRIPTION", "body one", 10), ("shared", "SUMMARY", "stolen", 11), ("a3", "SUMMARY", "a bug, a bug", 12),
         ("a4", "SUMMARY", "late", 13), ("a5", "SUMMARY", "undated", 14)],
        "annotation_id string, type string, text string, ann_pos bigint",
    )
    out = collect_entries(projects, hits, summaries, annotations, F.lit("2024-01-05 00:00:00").cast("timestamp"))
    assert sorted((r.summary_id, r.category, r.title, r.text, r.entry_pos) for r in out.collect()) == [
        ("s1", B, "OwlSQL day", "body one", 10), ("s3", B, "Owl setup", "a bug, a bug", 12)
    ]
    order = S.recency_order(out).collect()
    assert sorted((r.position, r.summary_id) for r in order) == [(1, "s3"), (2, "s1")]


def test_bare_times_are_no_dates(spark):
    dates = ["12:30:00", "2024-01-05", " 2024-01-05T10:00:00Z", "2024", "soon", None, "1999-01-01"]
    df = spark.createDataFrame([(d,) for d in dates], "created_at string")
    kept = S.window_filter(df, F.lit("2000-01-01").cast("timestamp")).collect()
    assert [r.created_at for r in kept] == ["2024-01-05", " 2024-01-05T10:00:00Z", "2024"]
