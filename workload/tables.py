"""The engine's tables, derived by Spark from the given ones; all grow with them.

Sessions are documents, their bodies the documents' own lines dressed as bullets; projects are
document sources; hits are events. ``workload.sql`` states the same mapping in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.text import let, tokens
from notewright.functions.values import DESCRIPTION, MARKER_END, MARKER_START, PROFILE, SUMMARY
from notewright.operators.requests import project_terms
from notewright.operators.vocabulary import project_vocabulary
from notewright.sources.repositories import deny_lists, manifest_names, repo_names

from .templates import BULLETS, NOTES, SECRETS, line_column

NOW = "2024-01-31 00:00:00"
#: Characters of a text that are looked at for its first words, one after another while they hold too few.
STARTS = (100, 400)
ROLE_TYPES = {"assistant": SUMMARY, "user": DESCRIPTION, "system": PROFILE}
EVENT_TOPICS = {
    "view": "architecture-decisions",
    "signup": "resolved-bugs",
    "error": "conventions",
    "click": "environment-gotchas",
    "purchase": "architecture-decisions",
}


def doc() -> Column:
    return F.col("doc_id")


def choose(key: Column, values: list) -> Column:
    """``values[key mod n]``; a value is a column, a text or None."""
    picked = F.lit(None)
    for i, value in enumerate(values):
        value = value if isinstance(value, Column) else F.lit(value)
        picked = F.when(F.pmod(key, F.lit(len(values))) == i, value).otherwise(picked)
    return picked


def mapped(key: Column, values: dict[str, str]) -> Column:
    picked = F.lit(None).cast("string")
    for name, value in values.items():
        picked = F.when(key == name, value).otherwise(picked)
    return picked


def shared(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """One DataFrame per table and session folder, so that equal scans and exchanges are reused."""

    @wraps(build)
    def once(self: Tables) -> DataFrame:
        if build.__name__ not in self.built:
            self.built[build.__name__] = build(self)
        return self.built[build.__name__]

    return once


class Tables:
    """Lazy tables over one folder of the given parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.built: dict[str, DataFrame] = {}

    def given(self, name: str) -> DataFrame:
        if name not in self.built:
            self.built[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.built[name]

    def documents(self) -> DataFrame:
        return self.given("documents")

    def dressed(self, templates: list[str], keep: list[str] | None = None, documents: DataFrame | None = None) -> DataFrame:
        """``(doc_id, keep, text)``: every line of every document through its template."""
        lines = F.transform(
            F.split("text", "\n"),
            lambda line, i: line_column(templates, F.col("doc_id"), line, i),
        )
        glue = choose(F.col("doc_id"), ["\n", "\r\n"])
        return (documents or self.documents()).select(
            "doc_id", *(keep or []), F.array_join(lines, "\n").alias("joined"), glue.alias("glue")
        ).select(
            "doc_id", *(keep or []), F.replace("joined", F.lit("\n"), F.col("glue")).alias("text")
        )

    @shared
    def bodies(self) -> DataFrame:
        return self.dressed(BULLETS, ["source"])

    def bullets(self, templates: list[str] = BULLETS) -> DataFrame:
        """``(project_id, doc_id, line_pos, line)``: the dressed lines one by one."""
        return self.documents().select(
            F.col("source").alias("project_id"),
            "doc_id",
            F.posexplode_outer(F.split("text", "\n")).alias("line_pos", "raw"),
        ).select(
            "project_id",
            "doc_id",
            "line_pos",
            line_column(templates, F.col("doc_id"), F.col("raw"), F.col("line_pos")).alias("line"),
        )

    @shared
    def secrets(self) -> DataFrame:
        return self.bullets(SECRETS)

    def first_documents(self) -> DataFrame:
        """The projects' first documents, whole rows. What is made of them alone starts here, not from all texts."""
        first = self.projects().select(F.col("first_doc").alias("doc_id")).distinct()
        return self.documents().join(F.broadcast(first), "doc_id", "left_semi")

    @shared
    def words(self) -> DataFrame:
        """``(doc_id, source, w1, w2, w3)``: each document's first words of five letters or more."""
        return self.words_of(self.documents())

    def words_of(self, documents: DataFrame) -> DataFrame:
        def long(words: Column) -> Column:
            return F.filter(words, lambda w: F.length(w) >= 5)

        def enough_else(more: Column) -> Callable[[Column], Column]:
            return lambda w: F.when(F.size(w) >= 3, w).otherwise(more)

        # The start of a text mostly holds them; its last word may be cut there and does not count.
        found = long(tokens(F.col("text")))
        for start in reversed(STARTS):
            found = let(long(tokens(F.col("text"), start)), enough_else(found))
        return (
            documents
            .select("doc_id", "source", found.alias("w"))
            .select(
                "doc_id",
                "source",
                *[F.coalesce(F.get("w", F.lit(i)), F.lit(f"none{i}")).alias(f"w{i + 1}") for i in range(3)],
            )
        )

    @shared
    def phrases(self) -> DataFrame:
        """``(doc_id, source, k, w1, w2, w3)``: all words of five letters or more of each text, three at a time."""
        long = F.filter(tokens(F.col("text")), lambda w: F.length(w) >= 5)
        last = F.greatest(F.ceil(F.size("w") / 3) - 1, F.lit(0)).cast("int")
        three = F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.struct(*[
                F.coalesce(F.get("w", k * 3 + i), F.lit(f"none{i}")).alias(f"w{i + 1}") for i in range(3)
            ]),
        )
        listed = self.documents().select("doc_id", "source", F.explode_outer(F.array(long)).alias("w"))
        return listed.select("doc_id", "source", F.posexplode_outer(three).alias("k", "p")).select("doc_id", "source", "k", "p.*")

    # --- projects and what their repositories hold ------------------------------------------------

    @shared
    def projects(self) -> DataFrame:
        """One per document source, named after the part of its first document."""
        first = self.documents().groupBy(F.col("source").alias("project_id")).agg(
            F.min("doc_id").alias("first_doc")
        )
        part = self.given("part").select("p_partkey", "p_name", "p_type")
        n = F.col("first_doc")
        return first.join(part, F.col("first_doc") == F.col("p_partkey")).select(
            "project_id",
            "first_doc",
            F.col("p_name").alias("project"),
            F.array(
                F.replace("p_name", F.lit(" "), F.lit("_")),
                F.concat(F.lit(" "), "p_type"),
                F.lit("  "),
                F.substring_index("p_name", " ", 1),
            ).alias("aliases"),
            choose(n, ["agents", " CLAUDE.md ", "Agents.MD", "README.md", "claude"]).alias("target"),
            choose(n, ["14", " 30 ", F.lit(None).cast("string"), "21", "0", "25", "28"]).alias("window_days"),
        )

    @shared
    def terms(self) -> DataFrame:
        return self.projects().select(
            "project_id", project_terms(F.col("project"), F.col("aliases")).alias("terms")
        )

    def _listing(self, rows: DataFrame, key: Column) -> DataFrame:
        path = choose(
            key,
            [
                F.concat("w1", F.lit("/"), "w2", F.lit(".ts/"), "w3"),
                F.concat(F.lit("node_modules/"), "w1"),
                F.concat(F.lit("src/"), "w1", F.lit("."), "w2", F.lit(".TS")),
                F.concat(F.lit("."), "w1", F.lit("/"), "w2"),
                F.concat("w1", F.lit("/dist")),
                F.concat("w1", F.lit("-"), "w2", F.lit(".md")),
            ],
        )
        return rows.select(F.col("source").alias("project_id"), path.alias("path"))

    def _manifests(self, rows: DataFrame, key: Column) -> DataFrame:
        raw = choose(
            key,
            [
                F.concat(F.lit('\ufeff{"name":"'), "w1", F.lit("-"), "w2", F.lit('","dependencies":{"@'), "w3", F.lit("/"), "w1", F.lit('":"1"}}')),
                F.concat(F.lit('{"name":5,"devDependencies":{"'), "w2", F.lit('.js":"1","index":"2"}}')),
                F.concat(F.lit('{"name":"'), "w3", F.lit('"} trailing')),
                F.concat(F.lit('{"name":"'), "w3", F.lit('","dependencies":["'), "w1", F.lit('"]}')),
            ],
        )
        return rows.select(F.col("source").alias("project_id"), raw.alias("raw"))

    @shared
    def listing(self) -> DataFrame:
        """``(project_id, path)``: a listed file for every three words of a document."""
        return self._listing(self.phrases(), F.col("doc_id") + F.col("k"))

    @shared
    def manifests(self) -> DataFrame:
        """``(project_id, raw)``: a manifest for every three words of a document; some are broken."""
        return self._manifests(self.phrases(), F.col("doc_id") + F.col("k"))

    @shared
    def vocabulary(self) -> DataFrame:
        """What runs anchor on: the terms that each document's first words give.

        A vocabulary of all words would anchor every line, and the filter under test none.
        """
        names, manifests = self._listing(self.words(), doc()), self._manifests(self.words(), doc())
        return project_vocabulary(self.terms(), repo_names(names), manifest_names(manifests))

    @shared
    def whole_vocabulary(self) -> DataFrame:
        """The terms that all words of all documents give."""
        return project_vocabulary(self.terms(), repo_names(self.listing()), manifest_names(self.manifests()))

    @shared
    def deny_rows(self) -> DataFrame:
        """``(project_id, term, pos)``: a licence word and two of the first document's words."""
        first = self.words_of(self.first_documents()).join(
            self.projects().select("first_doc"), F.col("doc_id") == F.col("first_doc")
        )
        return first.select(
            F.col("source").alias("project_id"),
            F.posexplode(
                F.array(F.lit(" LICENSED "), F.upper("w1"), F.lit(" "), F.concat("w2", F.lit(" ")))
            ).alias("pos", "term"),
        )

    @shared
    def deny(self) -> DataFrame:
        return deny_lists(self.deny_rows())

    # --- sessions, hits and annotations -----------------------------------------------------------

    @shared
    def titles(self) -> DataFrame:
        """``(doc_id, project_id, name, w1)``: every document's session title."""
        part = self.given("part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_type")
        run_on = F.replace("p_name", F.lit(" "), F.lit(""))
        name = choose(
            F.col("doc_id"),
            [
                F.concat("p_name", F.lit(" "), "p_type", F.lit(" and "), "w1"),
                F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit(" Audit "), "p_type"),
                F.concat(run_on, F.lit("  release AND "), "p_type", F.lit(" and "), "w1", F.lit(" dev@mail.example.com")),
                F.concat(F.lit("x"), run_on, F.lit("s "), "w2"),
                F.lit(None).cast("string"),
            ],
        )
        return self.words().join(part, "doc_id").select(
            "doc_id", F.col("source").alias("project_id"), name.alias("name"), "w1"
        )

    @shared
    def summaries(self) -> DataFrame:
        """One session per document; some dates are missing or unreadable."""
        d = F.col("doc_id")
        second = F.timestamp_seconds(F.lit(1704067200) + F.pmod(d * 7919, F.lit(2592000)))
        iso = F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        own = [F.concat(F.lit("a"), d.cast("string"), F.lit(f"-{k}")) for k in range(3)]
        borrowed = F.concat(F.lit("a"), (d - 1).cast("string"), F.lit("-1"))
        return self.titles().select(
            F.concat(F.lit("s"), d.cast("string")).alias("summary_id"),
            "name",
            choose(d, [iso] * 9 + [F.lit("soon"), F.lit(None).cast("string")]).alias("created_at"),
            F.when(F.pmod(d, F.lit(5)) == 0, F.array(*own, borrowed)).otherwise(F.array(*own)).alias("annotation_ids"),
            d.alias("snapshot_pos"),
        )

    @shared
    def annotations(self) -> DataFrame:
        """Three per document: a description, mostly a summary, and a profile that is never read."""
        d = F.col("doc_id")
        dressed = self.dressed(BULLETS)
        summary_type = choose(d, [SUMMARY, SUMMARY, DESCRIPTION])
        summary_text = choose(d, [F.col("text")] * 6 + [F.lit("")])
        listed = [
            (DESCRIPTION, F.concat(F.lit("- Drew a bug\n"), "text")),
            (summary_type, summary_text),
            (PROFILE, F.col("text")),
        ]
        rows = F.array(
            *[
                F.struct(
                    F.lit(k).alias("k"),
                    (kind if isinstance(kind, Column) else F.lit(kind)).alias("type"),
                    text.alias("text"),
                )
                for k, (kind, text) in enumerate(listed)
            ]
        )
        return dressed.select("doc_id", F.inline(rows)).select(
            F.concat(F.lit("a"), d.cast("string"), F.lit("-"), F.col("k").cast("string")).alias("annotation_id"),
            "type",
            "text",
            (d * 4 + F.col("k")).alias("ann_pos"),
        )

    @shared
    def hits(self) -> DataFrame:
        """Events as hits; scores tie and reach zero."""
        e = F.col("event_id")
        keyword = F.pmod(e, F.lit(3)) == 0
        return self.given("events").select(
            F.concat(F.lit("src"), F.pmod(F.floor(e / 7), F.lit(20)).cast("string")).alias("project_id"),
            F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("summary_id"),
            mapped(F.col("event_type"), EVENT_TOPICS).alias("category"),
            F.when(keyword, "keyword").otherwise("semantic").alias("strategy"),
            F.when(keyword, 0.0).otherwise(F.pmod(F.floor("value"), F.lit(5)).cast("double")).alias("score"),
            e.alias("hit_pos"),
        )

    @shared
    def turns(self) -> DataFrame:
        """Conversation turns as annotations of their conversation."""
        return self.given("conversations").select(
            F.col("conv_id").alias("summary_id"),
            F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("annotation_id"),
            mapped(F.col("role"), ROLE_TYPES).alias("type"),
            "text",
            F.col("turn").alias("ann_pos"),
        )

    # --- notes ------------------------------------------------------------------------------------

    @shared
    def notes(self) -> DataFrame:
        """``(project_id, content)``, one per document: text around a block, or broken markers."""
        return self.notes_of(self.documents())

    def notes_of(self, documents: DataFrame) -> DataFrame:
        d = F.col("doc_id")
        start, end = F.lit(f"\n{MARKER_START}\n"), F.lit(f"\n{MARKER_END}\n")
        body, intro = F.col("text"), F.lit("# Handbook\n\nWritten by hand.\n")
        content = choose(
            d,
            [
                F.concat(intro, start, body, end, F.lit("After.\n")),
                F.concat(intro, F.lit("\n \t\n")),
                F.concat(intro, start, body, end),
                F.concat(intro, start, body),
                F.concat(start, body, end, start, body, end),
                F.concat(intro, end, body, start),
                F.lit(" \n\n"),
            ],
        )
        return self.dressed(NOTES, documents=documents).select(
            F.concat(F.lit("n"), d.cast("string")).alias("project_id"), content.alias("content")
        )

    @shared
    def project_notes(self) -> DataFrame:
        """Each project's document is its first document's note."""
        first = self.projects().select(
            F.col("project_id").alias("p"), F.concat(F.lit("n"), F.col("first_doc").cast("string")).alias("project_id")
        )
        return self.notes_of(self.first_documents()).join(first, "project_id").select(F.col("p").alias("project_id"), "content")
