"""Shards whose mixture of sources is the corpus's: proportional stratified interleaving.

Rows are shuffled by a seed within their source; row ``r`` of ``n`` gets the fractional rank
``(r + u) / n``, with ``u`` between 0 and 1 fixed for the source; all rows sorted by it interleave the sources in proportion, and the sorted row is
cut into equal runs, one a shard.

Neither rank comes from a window over a whole source or the whole corpus. Both are ranks within
buckets of the sort key plus the counted sizes of the buckets before.

Cases: a null source is a source of its own; null or empty texts weigh only the fixed part; rows that
agree in id and text sort as one and are then told apart by nothing, so either may get either place;
an empty table gives an empty result; further columns are left out, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_OVERHEAD = 16
#: Least expected rows of one bucket of a sort key.
BUCKET_ROWS = 4096
UNIT = 1 << 32


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long")


def seeded(seed: str, *parts: Column) -> Column:
    """A hex string that orders rows at random but always alike."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def bucket_ranks(df: DataFrame, group: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``, the 0-based rank by ``bucket`` and then ``order`` within ``group``.

    ``bucket`` must follow the order and split it finely. What one task sorts is a bucket; the sizes
    summed in order are one row a group and bucket.
    """
    keys = [*group, bucket]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    own = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return own.join(offsets, keys).withColumn(name, F.col("_rank") + F.col("_before")).drop("_rank", "_before")


def interleaved_shards(docs: DataFrame, shards: int, seed: str = "shard") -> DataFrame:
    """doc_id, size, text_crc32, source, shard and slot of every row; shards differ by one row at most."""
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("source"),
        text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("_key", seeded(seed, F.col("doc_id"), F.col("text_crc32")))
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    total = max(1, counts.agg(F.sum("n")).first()[0] or 0)
    # As many buckets as rows in one, so that neither a bucket nor the list of buckets grows large.
    per_bucket = max(BUCKET_ROWS, math.isqrt(total))
    lead = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_bucket", F.shiftright(lead * -(-total // per_bucket), 32))
    tie = [F.col(c) for c in ("_key", "doc_id", "text_crc32")]
    ranked = bucket_ranks(rows, ["source"], "_bucket", tie, "r").drop("_bucket")
    # (r + u) / n in units of 1/1024 row of the whole; u in [0, 1) is fixed by the source, so that
    # many sources of a single row spread over the whole instead of meeting in its middle.
    u = F.conv(F.substring(seeded(seed, F.col("source")), 1, 8), 16, 10).cast("long")
    part = F.expr(f"((cast(r as decimal(38,0)) * {UNIT}L + u) * {total}L * 1024L) div (cast(n as decimal(38,0)) * {UNIT}L)")
    placed = (
        ranked.join(counts, "source").withColumn("u", u).withColumn("_part", part)
        .withColumn("_run", F.expr(f"_part div {1024 * per_bucket}L")).drop("n", "u", "r")
    )
    whole = bucket_ranks(placed, [], "_run", [F.col("_part"), F.col("source"), *tie], "g")
    # Shard k holds the places g with g * shards div total = k, from ceil(k * total / shards) on.
    return whole.withColumn("shard", F.expr(f"cast(g * {shards}L div {total}L as int)")).select(
        "doc_id", "size", "text_crc32", "source", "shard",
        F.expr(f"g - (shard * {total}L + {shards - 1}L) div {shards}L").alias("slot"),
    )
