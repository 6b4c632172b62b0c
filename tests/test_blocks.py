import pytest
from pyspark.sql import functions as F

from notewright.functions.values import MARKER_END as END
from notewright.functions.values import MARKER_START as START
from notewright.operators import blocks as B
from notewright.operators.changes import apply_approved, approval_outcomes, change_report, outcome_report
from notewright.plans.compose import compose

TERMS = ["harbour", "basalt", "slate", "turbine"]
TEXT = "### Materials\n- Picked basalt before slate\n- Signed an OrlandCo order for one turbine"
ENTRY = "project_id string, summary_id string, category string, title string, created_at string, text string, entry_pos bigint"


@pytest.fixture(scope="module")
def block(spark):
    """Compose one project's block from (title, date[, text]) entries."""

    def run(entries, previous="", denied=(), category="architecture-decisions"):
        rows = [("p", f"s{i}", category, e[0], e[1], e[2] if len(e) > 2 else TEXT, i) for i, e in enumerate(entries)]
        out = compose(
            spark.createDataFrame(rows, ENTRY),
            spark.createDataFrame([("p", previous)], "project_id string, content string"),
            spark.createDataFrame([("p", "harbour", 14, "2026-08-02")], "project_id string, project string, days bigint, generated_at string"),
            spark.createDataFrame([("p", t) for t in TERMS], "project_id string, term string"),
            spark.createDataFrame([("p", list(denied))], "project_id string, denied array<string>"),
        )
        return out.first()

    return run


def test_composes_and_merges(block):
    old = block([(f"Day {n}", f"2026-06-0{n}T10:00:00Z") for n in (1, 2, 3, 4)]).block
    assert old.startswith(f"{START}\n\n## Project memory\n\n") and old.endswith(f"\n\n{END}")
    assert '"harbour", last 14 days, on 2026-08-02.' in old and "OrlandCo" in old

    fresh = [("Latest", "2026-08-01T10:00:00Z"), ("Day 4", "2026-06-04T23:00:00Z"), ("Essay", "2026-08-09", "Only prose")]
    new = block(fresh, old, ["orlandco"])
    headings = [line for line in new.block.split("\n") if line.startswith("**")]
    assert headings == [f"**{t}** — {d}" for t, d in (
        ("Latest", "2026-08-01"), ("Day 4", "2026-06-04"), ("Day 3", "2026-06-03"), ("Day 2", "2026-06-02"))]
    assert new.rendered == 4 and "OrlandCo" not in new.block


def test_kept_entries_lose_denied_text(block):
    old = block([("Harbour and OrlandCo turbine", "2026-07-01"), ("Gone", "2026-07-02", "- Signed OrlandCo harbour")]).block
    new = block([("Fresh", "2026-08-01")], old, ["orlandco"]).block
    assert "**Harbour and [redacted] turbine** — 2026-07-01" in new and "Gone" not in new and "orlandco" not in new.lower()


def test_same_block_again_changes_nothing(block, spark):
    entries = [("One", "2026-07-01"), ("Two", "2026-07-01"), ("Three", "2026-07-03")]
    first = block(entries).block
    assert block(entries, first).block == first
    assert block([("x", "2026-01-01", "none")]).block.count("### ") == 0


def splice(spark, existing):
    docs = spark.createDataFrame([("p", existing, f"{START}\nNEW\n{END}")], "project_id string, content string, block string")
    row = B.splice_block(docs).first()
    return row.content if row.status == "ok" else None


def test_splices(spark):
    new = f"{START}\nNEW\n{END}"
    assert splice(spark, "# T\n\nMine.\n \n") == f"# T\n\nMine.\n\n{new}\n"
    assert splice(spark, " \n\t") == f"{new}\n"
    assert splice(spark, f"a\n{START}\nOLD\n{END}\nb\n") == f"a\n{new}\nb\n"
    assert splice(spark, splice(spark, "# T\n")) == f"# T\n\n{new}\n"
    for broken in (f"a {START} b", f"a {END}", f"{END} {START}", f"{START}{END}{START}{END}", f"{START}{END}{END}", f"{START}{START}{END}"):
        assert splice(spark, broken) is None


def test_parses_the_first_block_only(spark):
    content = "\r\n".join([
        "**out** — 2026-01-01", "- no", START, "**early** — 2026-01-01", "- no section yet",
        "### Conventions and patterns", "- loose", "**A ** b** — 2026-01-02", "", "- one", " - two", "- three",
        "**no bullets** — 2026-01-03", "### Odd", "**B** — 2026-01-04", "- x", "### Resolved bugs and root causes",
        "**C** — 2026-01-05 ", "**D** — 2026-01-06", "- y", END, "**late** — 2026-01-01", "- z", START, END,
    ])
    docs = spark.createDataFrame([("p", content), ("q", f"{END}{START}"), ("r", "")], "project_id string, content string")
    rows = B.parse_block(docs).orderBy("pos").collect()
    assert [(r.project_id, r.category, r.day, r.heading, r.bullets) for r in rows] == [
        ("p", "conventions", "2026-01-02", "**A ** b** — 2026-01-02", ["- one", "- three"]),
        ("p", "resolved-bugs", "2026-01-06", "**D** — 2026-01-06", ["- y"]),
    ]


def test_changes(spark):
    docs = spark.createDataFrame([("p", "a\nb\nb\nc\n", "a\nb\nd\n"), ("q", "", "x"), ("r", "same\n", "same")], "project_id string, content string, proposed string")
    assert sorted(map(tuple, change_report(docs).collect())) == [
        ("p", "+", "d", 1), ("p", "-", "b", 1), ("p", "-", "c", 1), ("q", "+", "x", 1)
    ]


def test_applies_only_what_was_approved(spark):
    new = f"{START}\nNEW\n{END}"
    proposals = spark.createDataFrame([(k, "base", new, f"base\n\n{new}\n") for k in "abcd"], "project_id string, base string, block string, proposed string")
    approvals = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "project_id string")
    current = spark.createDataFrame([("a", "base"), ("b", "edited"), ("c", END), ("d", "base")], "project_id string, content string")
    assert sorted(map(tuple, apply_approved(proposals, approvals, current).collect())) == [
        ("a", "written", f"base\n\n{new}\n"), ("b", "written", f"edited\n\n{new}\n"), ("c", "conflict", END)
    ]


def test_outcomes_in_order(spark):
    good = dict(days=14, target_name="AGENTS.md", hits=1, in_window=1, annotation_ids=1, entries=1, content="a", block="### x", proposed="b")
    cases = [
        ({"days": None, "target_name": None}, "invalid-days"), ({"target_name": None}, "unknown-target"),
        ({"hits": None}, "no-memories-in-window"), ({"annotation_ids": None}, "no-memories-in-window"),
        ({"entries": None, "block": "x"}, "no-project-match"), ({"block": "x"}, "every-bullet-filtered"),
        ({"proposed": None}, "managed-block-conflict"), ({"proposed": "a"}, "up-to-date"), ({}, "changed"),
    ]
    schema = "project_id int, days bigint, target_name string, hits bigint, in_window bigint, annotation_ids bigint, entries bigint, content string, block string, proposed string"
    rows = [(i, *{**good, **change}.values()) for i, (change, _) in enumerate(cases)]
    out = outcome_report(spark.createDataFrame(rows, schema)).orderBy("project_id").collect()
    assert [r.status for r in out] == [wanted for _, wanted in cases]


def test_top_entries_order(spark):
    rows = [("p", "conventions", d, h, ["- x"], k, c, p) for d, h, k, c, p in [
        ("2026-01-02", "kept", 1, None, 0), ("2026-01-02", "fresh late", 0, "2026-01-02T09", 5), ("2026-01-02", "fresh b", 0, "2026-01-02T01", 2),
        ("2026-01-02", "fresh a", 0, "2026-01-02T01", 1), ("2026-01-01", "old", 0, "2026-01-01", 0)]]
    pool = spark.createDataFrame(rows, "project_id string, category string, day string, heading string, bullets array<string>, is_kept int, created_at string, pos bigint")
    assert [r.heading for r in B.top_entries(pool).orderBy("place").collect()] == ["fresh late", "fresh a", "fresh b", "kept"]
    assert [r.heading for r in B.merge_pool(pool.where("is_kept = 0"), pool.where("is_kept = 1")).collect()][-1] == "old"
    assert B.rendered_count(B.top_entries(pool)).first()["rendered"] == 4


def test_outcomes_after_approval(spark):
    outcomes = [("a", "changed"), ("b", "changed"), ("c", "changed"), ("d", "up-to-date")]
    applied = [("a", "written", "x"), ("c", "conflict", "y")]
    out = approval_outcomes(
        spark.createDataFrame(outcomes, "project_id string, status string"),
        spark.createDataFrame(applied, "project_id string, status string, content string"),
    )
    assert {r.project_id: r.status for r in out.collect()} == {
        "a": "written", "b": "cancelled", "c": "managed-block-conflict", "d": "up-to-date",
    }


def test_approval_of_one_target(spark):
    schema = "project_id string, target string, base string, block string, proposed string"
    proposals = spark.createDataFrame([("a", t, "", "B", f"new {t}") for t in ("X", "Y")], schema)
    approvals = spark.createDataFrame([("a", "Y")], "project_id string, target string")
    current = spark.createDataFrame([], "project_id string, target string, content string")
    assert [tuple(r) for r in apply_approved(proposals, approvals, current).collect()] == [("a", "Y", "written", "new Y")]
