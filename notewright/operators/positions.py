"""Row positions within groups of any size, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def global_positions(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Adds ``position`` (1 is first) within ``keys`` by ``order``, which must break all ties.

    Rows are range-partitioned by keys and order, so a hot group spreads over many partitions.
    Positions inside a partition come from its sorted order; each group's partitions are counted and
    their offsets added. The offsets hold at most one row per group and partition. The sorted rows
    are checkpointed because their partition numbers must not change between the two uses.
    """
    marked = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    marked = durable(marked)
    parts = marked.groupBy(*keys, "_part").agg(
        F.min("_row").alias("_first"), F.count("*").alias("_size")
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    return (
        marked.join(offsets.drop("_size"), [*keys, "_part"])
        .withColumn("position", F.col("_row") - F.col("_first") + F.col("_before") + 1)
        .drop("_part", "_row", "_first", "_before")
    )
