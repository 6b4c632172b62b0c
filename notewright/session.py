"""Session settings, and the one place where lineage is cut."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(name: str, cpus: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.files.openCostInBytes", "64k")
        # Text work costs far more per byte than the default sizing of shuffle reads assumes.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable(df: DataFrame) -> DataFrame:
    """The rows of ``df``, made once and kept for the uses that follow.

    They go to the cluster's shared folder, ``spark.checkpoint.dir``, where that is set, so that the
    loss of executors costs nothing; otherwise they stay with the executors and lost parts are made
    again.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            return df.persist(StorageLevel.MEMORY_AND_DISK)
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
