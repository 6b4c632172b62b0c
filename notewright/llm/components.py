"""Connected components of an edge table, by contraction.

Every round each node hooks onto its smallest neighbour if that is smaller, the edges are rewritten to
where the hooks lead in two steps, and loops and repeats go. Nodes must be hashes: in a random order a
fixed share of the nodes with edges vanishes a round, so rounds grow with the logarithm of the nodes. A
node's neighbours are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (``a``, ``b``); root is one node of the component."""
    edges = kept(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        one = kept(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")))
        two = one.toDF("root", "far")
        hook = kept(one.join(two, "root").select("node", F.col("far").alias("root")))
        levels.append(hook)
        moved = (
            edges.join(hook.toDF("a", "ra"), "a").join(hook.toDF("b", "rb"), "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        edges = kept(moved)
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = levels[-1]
    for level in reversed(levels[:-1]):
        later = found.toDF("root", "last")
        found = kept(level.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")))
    return found
