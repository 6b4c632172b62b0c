"""Headline timings. Prints one JSON line.

The engine's tables are written once from the given ones, as a real run would find them; the time of
that is reported apart. Every query is then run three times and its median taken.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.redaction import redact
from notewright.functions.text import evaluated, squash_spaces, tokens
from notewright.operators import bullets as B
from notewright.operators import sessions as S
from notewright.operators.requests import normalise_requests
from notewright.operators.search import keyword_topk, semantic_topk
from notewright.operators.vocabulary import anchor_keys, anchored
from notewright.plans.collect import collect_entries
from notewright.plans.compose import compose
from notewright.plans.sync import sync
from notewright.session import local_session
from workload.tables import NOW, Tables

ENGINE_TABLES = [
    "projects", "terms", "hits", "summaries", "annotations", "turns", "vocabulary", "deny",
    "project_notes", "bullets", "secrets", "titles", "documents", "embeddings", "benchmark",
]


def prepare(spark: SparkSession, folder: str, out: str) -> dict[str, DataFrame]:
    tables = Tables(spark, folder)
    for name in ENGINE_TABLES:
        source = getattr(tables, name)() if hasattr(tables, name) else tables.given(name)
        source.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{out}/{name}")
    return {name: spark.read.parquet(f"{out}/{name}") for name in ENGINE_TABLES}


def headline(t: dict[str, DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    now = F.lit(NOW).cast("timestamp")
    valid = normalise_requests(t["projects"]).where("days is not null and target_name is not null")

    def bullets() -> DataFrame:
        lines = evaluated(t["bullets"], "content", B.bullet_content(F.col("line")))
        content = F.col("content")
        return lines.where(
            (content != "") & B.is_past_tense(content) & ~B.is_pending(content) & ~B.is_bare_link(content)
        )

    def vectors() -> DataFrame:
        rows = t["embeddings"].select(F.col("vec_id").alias("summary_id"), "embedding", "label")
        asked = rows.groupBy("label").agg(F.min_by("embedding", "summary_id").alias("query_vector"))
        return semantic_topk(rows, asked, ["label"], 8, threshold=0.1)

    def words() -> DataFrame:
        docs = t["documents"].select(
            F.col("doc_id").alias("summary_id"), "text", F.col("n_chars").alias("created_at")
        )
        first_words = F.array_join(F.slice(tokens(F.col("text")), 1, 2), " ")
        asked = t["benchmark"].select("item_id", first_words.alias("query_text"))
        return keyword_topk(docs, asked, ["item_id"], 8)

    def collected() -> DataFrame:
        return collect_entries(valid, t["hits"], t["summaries"], t["annotations"], now)

    def composed() -> DataFrame:
        projects = valid.withColumn("generated_at", F.lit(NOW[:10]))
        return compose(collected(), t["project_notes"], projects, t["vocabulary"], t["deny"])

    def synced() -> DataFrame:
        return sync(
            t["projects"], t["hits"], t["summaries"], t["annotations"], t["vocabulary"], t["deny"],
            t["project_notes"], now,
        ).outcomes

    return {
        "best_category": lambda: S.best_category(t["hits"]),
        "best_body": lambda: S.best_body(S.allowed_annotations(t["turns"]), ["summary_id"]),
        "redact_lines": lambda: t["secrets"].select("doc_id", squash_spaces(redact("line"))),
        "bullet_filters": bullets,
        "vocab_anchor": lambda: anchored(
            bullets().drop("line"), anchor_keys(t["vocabulary"]), ["doc_id", "line_pos"], "content"
        ),
        "title_scope": lambda: S.title_scope(
            t["titles"].select("project_id", "doc_id", F.col("name").alias("title")), t["terms"]
        ),
        "semantic_topk": vectors,
        "keyword_topk": words,
        "collect": collected,
        "compose": composed,
        "sync": synced,
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cpus)
    start = time.time()
    tables = prepare(spark, folder, tempfile.mkdtemp(prefix="notewright-bench-"))
    prepared = time.time() - start
    seconds = {}
    for name, build in headline(tables).items():
        runs = []
        for _ in range(3):
            start = time.time()
            build().write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        seconds[name] = round(statistics.median(runs), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm median of 3",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
                "prepare_sec": round(prepared, 3),
            }
        )
    )


if __name__ == "__main__":
    main()
