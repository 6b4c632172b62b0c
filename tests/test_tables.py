"""Tables that are made of the projects' first documents alone."""

import pytest
from pyspark.sql import functions as F

from workload.tables import Tables


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    texts = [(d, "a b c " * (40 * (d % 3)) + f"orchard{d} meadows turbine\nsecond {d}", f"src{d % 2}") for d in range(9)]
    texts += [(2, "short again", "src0"), (None, "orphan words standing", "src0"), (7, None, None)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    parts = [(d, f"fern grid {d}", "STEEL") for d in range(9)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(f"{folder}/part.parquet")
    return Tables(spark, folder)


def rows(df):
    return sorted(map(str, df.collect()))


def test_project_notes_and_deny_lists_are_made_of_first_documents_only(tables):
    first = tables.projects().select(F.col("project_id").alias("p"), F.concat(F.lit("n"), F.col("first_doc").cast("string")).alias("project_id"))
    assert rows(tables.project_notes()) == rows(tables.notes().join(first, "project_id").select(F.col("p").alias("project_id"), "content"))
    of_all = tables.words().join(tables.projects().select("first_doc"), F.col("doc_id") == F.col("first_doc"))
    terms = {(r.source, r.w1.upper()) for r in of_all.collect()}
    assert {(r.project_id, r.term) for r in tables.deny_rows().where("pos = 1").collect()} == terms
    for made in (tables.project_notes(), tables.deny_rows()):
        assert "LeftSemi" in made._jdf.queryExecution().optimizedPlan().toString()


def test_first_words_come_from_whole_texts_where_the_start_has_too_few(tables):
    got = {(r.doc_id, r.w1, r.w2, r.w3) for r in tables.words().where("doc_id in (0, 1, 5)").collect()}
    assert got == {(0, "orchard0", "meadows", "turbine"), (1, "orchard1", "meadows", "turbine"), (5, "orchard5", "meadows", "turbine")}
