"""Searches behind the hit tables.

Only the call contract is given (text, limit, threshold, scored ids out); the scoring is ours: exact
cosine for the search by meaning, all words present and newest first for the literal one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.text import evaluated, phrase, tokens
from ..functions.values import SIMILARITY_THRESHOLD
from ..session import durable
from .postings import posting_lists
from .vectors import asked_of, scan

#: Query vectors that go past the stored ones at a time, and stored ones that pivots are chosen from.
QUERY_BYTES = 16 * 1024 * 1024
SAMPLE = 512
#: Blocks of the inverted index for each shuffle partition, and words of a set that are met by their posting lists.
BLOCKS = 2
LISTS = 4
#: Words that are looked up in a set of the plan.
SET_WORDS = 2_048


def _scans(
    vectors: DataFrame, queries: DataFrame, keys: list[str], limit: Column, threshold: float
) -> Iterator[tuple[DataFrame, int]]:
    """Per set of queries what the tasks found, with rows that count pairs, and the number of sets."""
    stored = vectors.select("summary_id", "embedding").where("embedding is not null")
    asked = queries.select(*keys, limit.cast("bigint").alias("_limit"), "query_vector").where("query_vector is not null")
    size = asked.agg(F.coalesce(F.sum(F.size("query_vector")), F.lit(0))).first()[0]
    sets = max(1, ceil(size * 8 / QUERY_BYTES))
    if sets > 1:
        # Hashed by the vector as well, so that no key puts more than its share into one set.
        asked = durable(asked.withColumn("_set", F.pmod(F.xxhash64(*keys, "query_vector"), F.lit(sets))))
        stored = durable(stored)
    sample = stored.orderBy(F.xxhash64("summary_id", "embedding")).limit(SAMPLE).toArrow()
    fields = [queries.schema[k] for k in keys]
    schema = StructType([
        *fields, StructField("_limit", LongType()), StructField("summary_id", vectors.schema["summary_id"].dataType),
        StructField("score", DoubleType()), StructField("pairs", LongType()), StructField("compared", LongType()),
    ])
    for k in range(sets):
        table = (asked.where(F.col("_set") == k) if sets > 1 else asked).toArrow()
        shared = vectors.sparkSession.sparkContext.broadcast(asked_of(table, keys, sample, threshold))
        yield stored.mapInArrow(scan(shared), schema), sets


def semantic_topk(
    vectors: DataFrame,
    queries: DataFrame,
    keys: list[str],
    limit: Column | int,
    threshold: float = SIMILARITY_THRESHOLD,
) -> DataFrame:
    """``(keys, summary_id, score, hit_pos)``: per query the best ``limit`` vectors by cosine, exactly.

    ``vectors`` is ``(summary_id, embedding)``; ``queries`` is keys plus ``query_vector``. A limit
    that is a column belongs to ``queries``. Vectors stay where they were read and are never shuffled: sets of queries of at most
    ``QUERY_BYTES`` on average go past them, by one broadcast a set, and what leaves a task is its best of every query. A set's result is kept before the next one
    starts, so one broadcast lives at a time. Pivots, and first bounds of the queries, come from at most ``SAMPLE`` vectors;
    they save comparisons and decide nothing. Equal scores go by summary_id. A vector that is null, zero, not finite or of another length
    than the query's is no hit.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    ceiling = queries.agg(F.coalesce(F.max(limit), F.lit(0))).first()[0]
    found: DataFrame | None = None
    for scanned, sets in _scans(vectors, queries, keys, limit, threshold):
        order = [F.col("score").desc(), F.col("summary_id")]
        best = _best(scanned.where("score is not null"), keys, order, ["summary_id", "score"], ceiling)
        best = durable(best) if sets > 1 else best
        found = best if found is None else found.unionByName(best)
    return found


def pruned_share(
    vectors: DataFrame, queries: DataFrame, keys: list[str], limit: Column | int, threshold: float = SIMILARITY_THRESHOLD
) -> float:
    """The share of all pairs of vector and query that ``semantic_topk`` does not compare."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    counts = [
        scanned.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("compared"), F.lit(0))).first()
        for scanned, _ in _scans(vectors, queries, keys, limit, threshold)
    ]
    return 1 - sum(c[1] for c in counts) / max(1, sum(c[0] for c in counts))


def _held(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(summary_id, created_at, held)``: which of the wanted words a session's text holds.

    Up to ``SET_WORDS`` of them are a set that each word of a text is looked up in, in the row; beyond that a
    session's words are shuffled to them.
    """
    words = [r.word for r in wanted.limit(SET_WORDS + 1).collect()]
    told = documents.select("summary_id", "created_at", tokens(F.col("text")).alias("words"))
    if len(words) <= SET_WORDS:
        # Words are ASCII letters and digits. One literal, as plans with thousands of them are slow to build.
        known = F.split(F.lit(" ".join(words)), " ")
        return evaluated(told, "held", F.array_intersect("words", known)).drop("words").where(F.size("held") > 0)
    spoken = told.select("summary_id", "created_at", F.explode_outer(F.array_distinct("words")).alias("word"))
    return spoken.join(wanted, "word", "left_semi").groupBy("summary_id", "created_at").agg(F.collect_set("word").alias("held"))


def _postings(documents: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inverted index of the wanted words, and the sessions it numbers.

    Sessions are dealt to blocks by hash and numbered within their block, newest first, so a posting list is a
    rising list of small numbers that starts with the newest: ``(block, word, numbers)``. The sessions
    are ``(block, number, summary_id, created_at, held)`` with the wanted words they hold. One exchange by block makes both.
    """
    blocks = BLOCKS * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    newest = Window.partitionBy("block").orderBy(F.col("created_at").desc(), "summary_id")
    sessions = durable(
        _held(documents, wanted).withColumn("block", F.pmod(F.xxhash64("summary_id"), F.lit(blocks)).cast("int"))
        .withColumn("number", F.dense_rank().over(newest))
        .groupBy("block", "number", "summary_id", "created_at")
        .agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))
    )
    lists = sessions.select("block", "number", "held").mapInArrow(posting_lists, "block int, word string, numbers array<int>")
    return durable(lists), sessions


def keyword_topk(
    documents: DataFrame, queries: DataFrame, keys: list[str], limit: Column | int
) -> DataFrame:
    """``(keys, summary_id, score, hit_pos)``: documents holding every word, newest first.

    ``documents`` is ``(summary_id, text, created_at)``; ``queries`` is keys plus ``query_text``.
    Texts are read once, for the words some query asks for. Queries of the same words are answered once. A set of words
    starts from the posting lists of its rarest word and meets those of the next rarest ones block by block, so rows are sets
    and blocks, never sessions, until the words are found together; of a set settled by then only as many sessions of a block go on as it may give.
    A set of more than ``LISTS`` words has the others looked up among the words of the sessions that are left.
    Rows of one session and date are one; a query without words finds nothing.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    words = F.array_sort(F.array_distinct(tokens(F.col("query_text"))))
    asked = evaluated(queries.select(*keys, limit.alias("_limit"), "query_text"), "words", words).where(F.size("words") > 0)
    asked = asked.select(*keys, "_limit", "words", phrase(F.col("words")).alias("_set"))
    ceiling, longest = asked.agg(F.coalesce(F.max("_limit"), F.lit(0)), F.coalesce(F.max(F.size("words")), F.lit(0))).first()
    sets = asked.groupBy("_set", "words").agg(F.max("_limit").alias("_limit"))
    lists, sessions = _postings(documents, sets.select(F.explode("words").alias("word")).distinct())
    counted = lists.groupBy("word").agg(F.sum(F.size("numbers")).alias("n"))
    rare = (
        sets.select("_set", "_limit", F.explode("words").alias("word")).join(counted, "word", "left")
        .groupBy("_set", "_limit").agg(
            F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("by_n")
        ).where(F.col("by_n")[0]["n"] > 0)
        .select("_set", "_limit", F.transform("by_n", lambda w: w["word"]).alias("words"))
    )
    found = rare.withColumn("word", F.col("words")[0]).join(lists, "word").drop("word")
    for k in range(1, min(LISTS, longest)):
        more = lists.select(F.col("block").alias("_block"), F.col("word").alias("_word"), F.col("numbers").alias("_more"))
        own = found.withColumn("_own", F.get("words", F.lit(k)))
        joined = own.join(more, (F.col("block") == F.col("_block")) & (F.col("_own") == F.col("_word")), "left")
        both = F.when(F.col("_own").isNull(), F.col("numbers")).otherwise(F.array_intersect("numbers", "_more"))
        found = joined.withColumn("numbers", both).drop("_own", "_block", "_word", "_more").where(F.size("numbers") > 0)
    settled = F.size("words") <= LISTS
    newest = F.slice("numbers", F.lit(1), F.greatest(F.col("_limit"), F.lit(0)).cast("int"))
    rest = F.slice("words", LISTS + 1, F.greatest(F.size("words"), F.lit(1)))
    hits = found.select(
        "_set", "_limit", "block", F.when(~settled, rest).alias("rest"),
        F.explode(F.when(settled, newest).otherwise(F.col("numbers"))).alias("number"),
    ).join(sessions, ["block", "number"]).where(F.col("rest").isNull() | (F.size(F.array_except("rest", "held")) == 0))
    best = _best(
        hits.withColumn("score", F.lit(0.0)),
        ["_set"],
        [F.col("created_at").desc(), F.col("summary_id")],
        ["summary_id", "score"],
        ceiling,
    )
    return asked.join(best, "_set").where(F.col("hit_pos") <= F.col("_limit")).select(*keys, "summary_id", "score", "hit_pos")


def _best(
    hits: DataFrame, keys: list[str], order: list[Column], out: list[str], ceiling: int
) -> DataFrame:
    """Rows ranked within their keys and cut at each row's own limit.

    The ceiling, the largest limit of all queries, beside the own limit lets Spark keep only that many rows per key in every
    map task, before anything is shuffled.
    """
    ranked = hits.withColumn("hit_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(
        (F.col("hit_pos") <= ceiling) & (F.col("hit_pos") <= F.col("_limit"))
    ).select(*keys, *out, "hit_pos")
