import json

import pytest
from pyspark.sql import functions as F

from notewright.functions import variants as V
from notewright.plans import payloads
from notewright.sources import messages as M
from notewright.sources import notes as N
from notewright.sources import payloads as P
from notewright.sources import repositories as R


def test_unclosed_json_is_known_without_the_parser(spark, monkeypatch):
    """What can't be a JSON value for its last character never reaches the parser; what can be one does, white space or not."""
    seen = []
    parse = F.try_parse_json
    monkeypatch.setattr(V.F, "try_parse_json", lambda text: seen.append(1) or F.coalesce(parse(text), F.raise_error(F.lit("parsed")).cast("variant")))
    broken = spark.createDataFrame([('{"name":"a"} trailing',), ('[1, 2',), (' {"a":1]',)], "raw string")
    assert [r.m for r in broken.select(V.strict_json(F.col("raw")).isNull().alias("m")).collect()] == [True] * 3
    whole = spark.createDataFrame([(' {"a":1}\n',), ("[1]\t",), ('"x"',), ("5 ",)], "raw string")
    assert [r.m for r in whole.select(F.to_json(V.strict_json(F.col("raw"))).alias("m")).collect()] == ['{"a":1}', "[1]", '"x"', "5"]
    assert seen


def test_a_manifest_is_parsed_once(spark):
    manifests = spark.createDataFrame([("p", "{}")], "project_id string, raw string").repartition(2)
    plan = R.manifest_names(manifests)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson") + plan.count("parse_json") == 1


def test_strict_json_refuses_trailing_text(column):
    texts = ["44 boats", "12", '{"a":1}', '{"a":1} x', "1] x", "1,2", "", "  ", "null", '"t"', "[1,2]"]
    out = column(texts, lambda n: F.to_json(V.strict_json(F.col(n))))
    assert out == [None, "12", '{"a":1}', None, None, None, None, None, "null", '"t"', "[1,2]"]


def test_payload_readers_skip_malformed_parts(spark):
    payload = {
        "results": [{"identifier": "a", "score": 2}, {"identifier": ""}, {"identifier": 3}, None, {"identifier": "b", "score": "x"}]
    }
    df = spark.createDataFrame([("p", json.dumps(payload)), ("q", "{}"), ("r", "[1]"), ("s", "x")], "k string, payload string")
    assert [tuple(r) for r in P.semantic_hits(df, ["k"]).collect()] == [("p", "a", 2.0, 0), ("p", "b", 0.0, 4)]

    keyword = {"results": [{"summary": {"id": "z"}}, {"summary": 3}, {"id": "y"}]}
    df = spark.createDataFrame([("p", json.dumps(keyword))], "k string, payload string")
    assert [tuple(r) for r in P.keyword_hits(df, ["k"]).collect()] == [("p", "z", 0.0, 0)]


def test_snapshots(spark):
    items = [
        {"id": "s", "created": {"value": "2024"}, "annotations": {"indices": {"b": 1, "a": None}}},
        5,
        {"id": "t", "name": 7, "created": {"value": 3}, "annotations": {"indices": [1]}},
    ]
    df = spark.createDataFrame([("p", json.dumps({"items": items}))], "k string, payload string")
    rows = P.summary_fields(P.snapshot_items(df, ["k"]), ["k"]).collect()
    assert [(r.summary_id, r.name, r.created_at, sorted(r.annotation_ids), r.snapshot_pos) for r in rows] == [
        ("s", None, "2024", ["a", "b"], 0),
        ("t", None, None, [], 2),
    ]
    notes = json.dumps({"items": [{"id": "a", "type": "SUMMARY", "text": "x"}, {"id": 1}]})
    df = spark.createDataFrame([("p", notes)], "k string, payload string")
    rows = P.annotation_fields(P.snapshot_items(df, ["k"]), ["k"]).collect()
    assert [(r.annotation_id, r.type, r.text) for r in rows] == [("a", "SUMMARY", "x"), (None, None, None)]


def test_event_streams(spark):
    answer = '{"id":"k7","result":{"rows":2}}'
    bodies = [
        (f"retry: 5\ndata: {answer}\n\n", None, "k7"),
        (f"id: 1\n\ndata: <wait>\n\ndata:{answer}\n\n", None, "k7"),
        (": keep open\n\n", None, None),
        ("<html/>", None, None),
        (f'data: {{"step":3}}\r\n\r\ndata: {answer}\r\n\r\n', None, "k7"),
        (f'data: {{"id":"early","result":[]}}\n\ndata: {answer}\n\n', "k7", "k7"),
        (f'data: {{"id":"early","result":[]}}\n\ndata: {answer}\n\n', "k8", "early"),
        ('data: {"id":7,"result":{}}\n\n', "7", None),
        ('data: {"id":"split",\ndata: "error":null}\n\n', None, "split"),
    ]
    df = spark.createDataFrame([(i, r, w) for i, (r, w, _) in enumerate(bodies)], "i int, raw string, wanted string")
    out = M.decode_messages(df, ["i"], request_id="wanted").orderBy("i")
    assert [r[0] for r in out.select(V.text_at(F.col("message"), "$.id")).collect()] == [b[2] for b in bodies]


def test_tool_results(spark):
    def body(text):
        return json.dumps({"result": {"content": [{"text": text}]}})

    bodies = [body('{"items":[]}'), body("31 rows"), "data: " + body("7") + "\n\n", '{"error":{}}', "[]", body(5), "junk"]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    out = M.decode_tool_results(df, ["i"]).orderBy("i").select("status", F.to_json("value")).collect()
    assert [tuple(r) for r in out] == [
        ("ok", '{"items":[]}'), ("ok", '"31 rows"'), ("ok", "7"),
        ("call-failed", None), ("call-failed", None), ("call-failed", None), ("call-failed", None),
    ]


def test_repository_files(spark, tmp_path):
    shop = tmp_path / "my shop"
    (shop / "src" / "models").mkdir(parents=True)
    (shop / "dist").mkdir()
    (shop / "deny.txt").write_text("# people\n Wim Kok \r\n\nOrland\n", encoding="utf8")
    (shop / "src" / "models" / "x.ts").write_text("x")
    (shop / "src" / ".hidden").write_text("x")
    (shop / "dist" / "bundle.js").write_text("x")
    terms = R.deny_terms(R.read_whole_files(spark, str(tmp_path / "*" / "deny.txt")))
    assert [tuple(r) for r in terms.orderBy("pos").collect()] == [("my shop", "Wim Kok", 1), ("my shop", "Orland", 3)]
    assert R.deny_lists(terms).first()["denied"] == ["Wim Kok", "Orland"]
    listing = R.read_listing(spark, str(tmp_path))
    assert {r["name"] for r in R.repo_names(listing).collect()} == {"deny", "src", "models"}


def test_manifests(spark):
    rows = [
        ("a", '\ufeff{"name":"w-f","dependencies":{"knex":"1"},"devDependencies":{"ava":"2"}}'),
        ("b", '{"name":5,"dependencies":["x"]}'),
        ("c", "not json"),
        ("d", "[]"),
    ]
    out = R.manifest_names(spark.createDataFrame(rows, "project_id string, raw string")).collect()
    assert sorted(map(tuple, out)) == [("a", "ava"), ("a", "knex"), ("a", "w-f")]


def test_notes_round_trip(spark, tmp_path):
    projects = spark.createDataFrame([("a",), ("b",)], "project_id string")
    notes = spark.createDataFrame([("a", "x")], "project_id string, content string")
    assert {tuple(r) for r in N.read_notes(projects, notes).collect()} == {("a", "x"), ("b", "")}
    asked = spark.createDataFrame([("a", "CLAUDE.md"), ("b", "AGENTS.md")], "project_id string, target_name string")
    both = spark.createDataFrame([("a", "AGENTS.md", "x"), ("a", "CLAUDE.md", "y")], "project_id string, target string, content string")
    assert [tuple(r) for r in N.notes_of_target(asked, both).collect()] == [("a", "y")]


def test_only_written_documents_change(spark, tmp_path):
    schema, out = "project_id string, target string, status string, content string", str(tmp_path / "out")
    first = [("a", "AGENTS.md", "written", "1"), ("a", "CLAUDE.md", "written", "2"), ("b/c d", "AGENTS.md", "written", "3\n")]
    N.write_notes(spark.createDataFrame(first, schema), out)
    second = [("a", "CLAUDE.md", "written", "new"), ("b/c d", "AGENTS.md", "conflict", "lost")]
    N.write_notes(spark.createDataFrame(second, schema), out)
    stored = {(r.project_id, r.target): r.content for r in N.stored_notes(spark, out).collect()}
    assert stored == {("a", "AGENTS.md"): "1", ("a", "CLAUDE.md"): "new", ("b/c d", "AGENTS.md"): "3\n"}


@pytest.mark.parametrize("targets", [("CLAUDE.md", "2024-01-01"), ("1", "01")])
def test_names_that_look_like_numbers_or_dates_come_back_as_written(spark, tmp_path, targets):
    out = str(tmp_path / "out")
    rows = [(p, t, "written", f"{p} in {t}") for p in ("007", "7", "1e3", "2024-02-30", "true") for t in targets]
    N.write_notes(spark.createDataFrame(rows, "project_id string, target string, status string, content string"), out)
    again = [("007", targets[1], "written", "new")]
    N.write_notes(spark.createDataFrame(again, "project_id string, target string, status string, content string"), out)
    wanted = {(p, t): c for p, t, _, c in rows} | {("007", targets[1]): "new"}
    found = N.stored_notes(spark, out).collect()
    assert {(r.project_id, r.target): r.content for r in found} == wanted and len(found) == len(wanted)


def test_listing_of_plain_paths_and_uris(spark, tmp_path):
    root = tmp_path / "repos"
    for name in ("shop/src/a.py", "shop/repos/shop/b.py", "mill/c.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    wanted = {("shop", "src/a.py"), ("shop", "repos/shop/b.py"), ("mill", "c.py")}
    for start in (str(root), f"{root}/", f"file://{root}", f"file:{root}/"):
        assert {tuple(r) for r in R.read_listing(spark, start).collect()} == wanted


def test_last_of_repeated_keys_counts(spark):
    for setting in ("true", "false"):
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", setting)
        hits = '{"results":[],"results":[{"identifier":"x","score":1,"score":2,"identifier":"y"}]}'
        df = spark.createDataFrame([("p", hits)], "k string, payload string")
        assert [tuple(r) for r in P.semantic_hits(df, ["k"]).collect()] == [("p", "y", 2.0, 0)]
        rows = [("a", '{"name":"first","name":"last","dependencies":{"x":1,"x":2}}')]
        out = R.manifest_names(spark.createDataFrame(rows, "project_id string, raw string")).collect()
        assert sorted(map(tuple, out)) == [("a", "last"), ("a", "x")]


def test_failed_answers_give_nothing_and_no_filter_parses_bodies(spark):
    said = '{"result":{"content":[{"text":"{\\"items\\":[{\\"id\\":\\"a\\",\\"type\\":\\"t\\",\\"text\\":\\"x\\"},7]}"}]}}'
    bodies = [said, '{"error":{"code":1},"result":{"content":[{"text":"{\\"items\\":[{\\"id\\":\\"b\\"}]}"}]}}', "nonsense", "", None, '{"result":{"content":[{"text":"plain"}]}}']
    out = payloads.answered_annotations(spark.createDataFrame(list(enumerate(bodies)), "batch_pos long, body string"))
    assert [tuple(r) for r in out.collect()] == [("a", "t", "x", 0)]
    node, filters = out._jdf.queryExecution().optimizedPlan(), []
    while node.children().size():
        if node.nodeName() == "Filter":
            filters.append(node.toString().split("\n")[0])
        node = node.children().head()
    assert filters and not any("parseJson" in f or "body" in f for f in filters)
