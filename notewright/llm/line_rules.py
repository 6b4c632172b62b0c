"""Quality rules: document statistics and lines that many documents of one host share.

Lines are normalised (A-Z lower-cased, blanks squeezed) and hashed. A line that more than
``min_docs`` distinct texts of a host hold, and more than ``max_share`` of that host's distinct texts,
is boilerplate there and is removed: ``without_common_lines`` gives the texts without them, ``quality_rules``
the numbers and verdicts. A document left with fewer than ``min_words`` words, or with less
than ``min_left`` of its words, is depleted and rejected. Exact copies count once, so a large group of
copies does not make its own lines boilerplate.

One pass reads the texts and keeps numbers and line hashes only. Line counts are combined before the
shuffle; what a task receives of one line is a row for each map task at most.

Cases: a null or empty text has no words and fails the base rules; a null host is a host of its own;
repeated rows are judged alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .shared import kept
from .texts import BLANKS, LOWER, Spans, Texts, covered, lines, mixed, pieces, span_sums, windows, words

#: Characters counted as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
REPEAT_WINDOW = 8

STATS = (
    "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, lines array<struct<line: long, times: long, words: long>>"
)


def _first_seen(owners: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether a (owner, value) pair is the first of its kind in order."""
    first = np.zeros(len(values), bool)
    if len(values):
        order = np.lexsort((np.arange(len(values)), values, owners))
        o, v = owners[order], values[order]
        first[order] = np.r_[True, (o[1:] != o[:-1]) | (v[1:] != v[:-1])]
    return first


def repeated_words(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Words of each text in windows that occur twice or more in it."""
    starts, runs = windows(hashes, firsts, REPEAT_WINDOW)
    owner = np.searchsorted(firsts, starts, "right").astype(np.uint64)
    keys = mixed(runs + mixed(owner))
    order = np.argsort(keys)
    equal = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    return span_sums(covered(starts[twice], REPEAT_WINDOW, len(hashes)), firsts)


def line_hashes(texts: Texts, found: Spans, all_lines: Spans) -> tuple[np.ndarray, np.ndarray]:
    """Of each line a hash of its normal form, and its words."""
    lowered = words(Texts(LOWER[texts.data], texts.offsets)).hashes()
    # A line's hash: the sum over its words, each mixed with its place in the line.
    line_first = np.searchsorted(found.starts, all_lines.starts)
    line_words = np.searchsorted(found.starts, all_lines.ends) - line_first
    place = np.arange(len(found)) - np.repeat(line_first, line_words) if len(found) else np.zeros(0, np.int64)
    terms = mixed(lowered + mixed(place.astype(np.uint64)))
    sums = np.r_[np.uint64(0), np.cumsum(terms, dtype=np.uint64)]
    return mixed(sums[line_first + line_words] - sums[line_first]), line_words


def text_statistics(texts: Texts) -> dict[str, np.ndarray]:
    """The base statistics of each text, and its distinct normalised lines with their words."""
    found = words(texts)
    inside = ~BLANKS[texts.data]
    letters = inside & ((texts.data & 0xC0) != 0x80)
    all_lines = lines(texts)
    total = np.zeros(len(inside) + 1, np.int64)
    np.cumsum(inside, out=total[1:])
    filled = total[all_lines.ends] > total[all_lines.starts]
    owners = all_lines.owners()
    codes = all_lines.encoded()[0]
    dup = np.zeros(len(all_lines), bool)
    dup[filled] = ~_first_seen(owners[filled], codes[filled])
    by_text = np.r_[0, np.cumsum(dup)]
    line_hash, line_words = line_hashes(texts, found, all_lines)
    return {
        "n_words": found.counts,
        "word_chars": texts.per_text(letters),
        "n_symbols": texts.per_text(SYMBOLS[texts.data]),
        "n_dup_lines": by_text[all_lines.firsts[1:]] - by_text[all_lines.firsts[:-1]],
        "n_repeat_words": repeated_words(found.hashes(), found.firsts),
        "line_owner": owners[filled],
        "line": line_hash[filled].view(np.int64),
        "line_words": line_words[filled],
    }


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in pieces(batch):
            found = text_statistics(texts)
            owner, line, count = (found[k] for k in ("line_owner", "line", "line_words"))
            order = np.lexsort((line, owner))
            owner, line, count = owner[order], line[order], count[order]
            new = np.r_[True, (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])][: len(owner)]
            heads = np.flatnonzero(new)
            times = np.diff(np.r_[heads, len(owner)])
            sizes = np.add.reduceat(count, heads) if len(heads) else count
            offsets = np.searchsorted(owner[heads], np.arange(len(texts) + 1))
            entries = pa.StructArray.from_arrays(
                [pa.array(x.astype(np.int64)) for x in (line[heads], times, sizes)], ["line", "times", "words"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("host"), part.column("text_hash"),
                    *(pa.array(found[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), entries),
                ],
                ["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
            )


def base_failed():
    """The rules on a document alone: too short, or too much of it repeated."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _host_and_hash() -> list[Column]:
    return [
        F.coalesce(F.concat(F.lit("h"), F.col("source")), F.lit("")).alias("host"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"),
    ]


def _judged(docs: DataFrame, min_docs: int, max_share: float, min_words: int, min_left: float) -> tuple[DataFrame, DataFrame]:
    """Statistics and verdict of every row, with host and text_hash; and of each host and text its common lines."""
    rows = docs.select(F.col("doc_id").cast("long"), *_host_and_hash(), "text")
    stats = kept(rows.mapInArrow(_statistics, STATS))
    held = (
        stats.where("size(lines) > 0").select("host", "text_hash", F.explode("lines").alias("entry"))
        .select("host", "text_hash", "entry.*").distinct()
    )
    hosts = stats.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("n_texts"))
    common = (
        held.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
        .join(hosts, "host").where(F.col("n_docs") > max_share * F.col("n_texts")).select("host", "line")
    )
    gone = held.join(common, ["host", "line"])
    removed = kept(gone.groupBy("host", "text_hash").agg(F.sum("times").alias("removed_lines"), F.sum("words").alias("removed_words")))
    left = F.col("n_words") - F.col("removed_words")
    none = F.lit(0).cast("long")
    verdicts = (
        stats.drop("lines").join(removed, ["host", "text_hash"], "left")
        .withColumn("removed_lines", F.coalesce("removed_lines", none))
        .withColumn("removed_words", F.coalesce("removed_words", none))
        .withColumn("base_failed", base_failed())
        .withColumn("depleted", (left < min_words) | (left < min_left * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )
    return verdicts, gone.select("host", "text_hash", "line")


def quality_rules(
    docs: DataFrame, min_docs: int = 10, max_share: float = 0.05, min_words: int = 20, min_left: float = 0.3
) -> DataFrame:
    """Statistics and verdict of every row: removed_lines, removed_words, depleted, base_failed, kept.

    ``docs`` has doc_id, text and source, which is the host.
    """
    return _judged(docs, min_docs, max_share, min_words, min_left)[0].drop("text_hash", "host")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose hashes are in ``gone``; other columns as they are."""
    for batch in batches:
        for part, texts in pieces(batch):
            out = part.column("text").to_pylist()
            gone = part.column("gone").to_pylist()
            found, all_lines = words(texts), lines(texts)
            hashes, counts = line_hashes(texts, found, all_lines)
            for i in np.flatnonzero([bool(g) for g in gone]).tolist():
                own = slice(all_lines.firsts[i], all_lines.firsts[i + 1])
                left = (counts[own] == 0) | ~np.isin(hashes[own].view(np.int64), np.array(gone[i], np.int64))
                out[i] = "\n".join(x for x, stays in zip(out[i].split("\n"), left.tolist()) if stays)
            names = [n for n in part.schema.names if n != "gone"]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else part.column(n) for n in names], names)


def without_common_lines(
    docs: DataFrame, min_docs: int = 10, max_share: float = 0.05, min_words: int = 20, min_left: float = 0.3
) -> DataFrame:
    """The rows of ``docs`` with all their columns, texts without the common lines, and the row's verdict ``kept``.

    Line feeds of removed lines go with them; blank lines stay. The texts are read again and joined to their own
    common lines and verdicts by host and text.
    """
    verdicts, gone = _judged(docs, min_docs, max_share, min_words, min_left)
    key = ["host", "text_hash"]
    found = kept(
        verdicts.select(*key, "kept").distinct()
        .join(gone.groupBy(*key).agg(F.collect_set("line").alias("gone")), key, "left")
    )
    schema = StructType([*docs.schema.fields, StructField("kept", BooleanType())])
    return docs.select("*", *_host_and_hash()).join(found, key).select(*docs.columns, "kept", "gone").mapInArrow(_without, schema)
