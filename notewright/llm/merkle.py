"""Merkle manifest of a dataset, and the proof of every row by an octopus multiproof.

Every row is a leaf. Leaves of one source ascend by doc_id; three consecutive nodes at a time become their
hash until one is left, the source's subroot. Subroots ordered by source likewise give the root.

Leaves are cut into blocks of ``BLOCK`` places of one source, a power of three, so that a block holds whole
subtrees. Blocks become one node each, those nodes again blocks, until a source is one node; sources are
leaves of one more tree, cut into blocks in the same way. A proof is not built node by node: a block works
out the minimal union of coordinates (tree, level, index) that its leaves' proofs need and that it can't
derive from the leaves it holds, gets these nodes once, derives the interiors that its leaves share, and
expands every single proof in place.

What is shuffled are digests, never texts. A source of any size is many blocks; a block is bounded. The
nodes that blocks ask for grow with the number of blocks, and near a root many blocks ask for one node: such
nodes are replicated over salts, as many as their level makes necessary. The nodes between a source's
subroot and the root are asked for once a source, and handed to its blocks.

Cases: a null in any column is ``-`` in the leaf; null sources and null doc_ids come first; leaves of one
source and doc_id follow their digests, so repeated rows take neighbouring places and it makes no
difference which takes which; a lone leaf is its subroot, a lone subroot the root; the proof of a row
without siblings is the hash of nothing; an empty table has no rows and no root; a text of any length is
hashed where it is read; further columns, whatever their names, are neither hashed nor carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

FANOUT = 3
#: Levels of a block, and the places of one.
HEIGHT = 7
BLOCK = FANOUT**HEIGHT
#: So many blocks may ask for one copy of a node.
ASKERS = 4096
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the subroots; a source's own is named "s" and the source, or nothing for the null source.
TOP = "top"

#: A node, and how many nodes its level has.
NODES = "tree string, level int, idx long, size long, digest binary"
STEPS = "array<struct<left array<binary>, right array<binary>>>"
PROOFS = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(fields[name]) for name in FIELDS]), 256))


def hashed(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def sizes_of(leaves: int) -> list[int]:
    """The number of nodes of every level, the root's last."""
    sizes = [leaves]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FANOUT))
    return sizes


def missing(held: np.ndarray, sizes: list[int]) -> list[tuple[int, int]]:
    """The least set of (level, index) that, beside the leaves ``held``, gives the root and all their proofs."""
    out = []
    for level, size in enumerate(sizes[:-1]):
        parents = np.unique(held // FANOUT)
        family = (parents[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        wanted = np.setdiff1d(family[family < size], held, assume_unique=False)
        out += [(level, int(i)) for i in wanted]
        held = parents
    return out


def interiors(leaves: dict[int, bytes], fetched: dict[tuple[int, int], bytes], sizes: list[int]) -> list[dict[int, bytes]]:
    """Every node above the leaves, by level: what the leaves derive beside what was fetched."""
    levels = [dict(leaves)]
    for level, size in enumerate(sizes[:-1]):
        own = levels[-1]
        own.update({i: d for (at, i), d in fetched.items() if at == level})
        above = {}
        for parent in {i // FANOUT for i in own}:
            children = range(parent * FANOUT, min(parent * FANOUT + FANOUT, size))
            if all(c in own for c in children):
                above[parent] = hashed([own[c] for c in children])
        levels.append(above)
    return levels


def path(levels: list[dict[int, bytes]], sizes: list[int], idx: int) -> list[tuple[list[bytes], list[bytes]]]:
    """For each level the siblings to the left and to the right."""
    out = []
    for level, size in enumerate(sizes[:-1]):
        first = idx // FANOUT * FANOUT
        own = levels[level]
        out.append((
            [own[i] for i in range(first, idx)],
            [own[i] for i in range(idx + 1, min(first + FANOUT, size))],
        ))
        idx //= FANOUT
    return out


def folded(digest: bytes, steps: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    for left, right in steps:
        digest = hashed([*left, digest, *right])
    return digest


def in_block() -> Column:
    return F.expr(f"idx div {BLOCK}L").alias("block")


def numbered(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Adds ``idx``, the 0-based place within ``keys`` by ``order``, and ``size``, the rows of the group.

    Rows are sorted by range over all tasks, so a large group is many ranges; the counts of the ranges
    are one row a group and range. Sorted rows are kept, as they are read twice.
    """
    sort = [F.col(k) for k in keys] + order
    marked = kept(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort)
        .withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    )
    group = [*keys, "_part"]
    counts = marked.groupBy(*group).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("size")
    )
    placed = marked.join(offsets, group).withColumn("idx", F.col("_row") - F.col("_first") + F.col("_before"))
    return placed.drop("_part", "_row", "_first", "_before", "_n")


def _climb(base: int, inner: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The nodes that follow from one block of nodes of level ``base``: the block's own, with ``inner``
        also those below it; a tree that ends here ends with its root."""
        tree, sizes = rows["tree"].iloc[0], sizes_of(int(rows["size"].iloc[0]))[: HEIGHT + 1]
        levels = interiors(dict(zip(rows["idx"].tolist(), rows["digest"].tolist())), {}, sizes)
        out = [
            (tree, base + k, i, size, digest)
            for k, (level, size) in enumerate(zip(levels, sizes)) for i, digest in level.items()
            if (k and (inner or k == HEIGHT or size == 1)) or not base and (inner or size == 1)
        ]
        return pd.DataFrame(out, columns=["tree", "level", "idx", "size", "digest"])

    return run


def nodes_above(leaves: DataFrame, largest: int, inner: bool) -> DataFrame:
    """Nodes of all levels from the blocks of ``leaves`` (tree, idx, size, digest) up, with roots, and with ``inner``
    all others too. A pass a level of blocks, as many as the largest tree needs."""
    found, rows = [], leaves.select("tree", "idx", "size", "digest")
    while True:
        base = HEIGHT * len(found)
        # What lies inside the lowest blocks is derived where a proof needs it.
        found.append(kept(rows.groupBy("tree", in_block()).applyInPandas(_climb(base, inner or base > 0), NODES)))
        largest = -(-largest // BLOCK)
        if largest <= 1:
            break
        rows = found[-1].where(F.col("level") == base + HEIGHT).drop("level")
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def _wanted(rows: pd.DataFrame) -> pd.DataFrame:
    """What the proofs of one block of leaves need beyond the block."""
    tree, block = rows["tree"].iloc[0], int(rows["idx"].iloc[0]) // BLOCK
    asked = missing(np.unique(rows["idx"].to_numpy()), sizes_of(int(rows["size"].iloc[0])))
    return pd.DataFrame([(tree, block, level, i) for level, i in asked], columns=["tree", "block", "level", "idx"])


def copies(level: Column) -> Column:
    """Into how many copies a node goes so that one is asked for by ``ASKERS`` blocks at most."""
    below = F.pow(F.lit(float(FANOUT)), F.greatest(level + 1 - HEIGHT, F.lit(0)))
    return F.greatest(F.ceil(below / ASKERS), F.lit(1)).cast("long")


def unions(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per block of ``leaves`` (tree, idx, size) the missing nodes, gathered in one row of bounded size."""
    wanted = (
        leaves.select("tree", "idx", "size").groupBy("tree", in_block())
        .applyInPandas(_wanted, "tree string, block long, level int, idx long")
        .withColumn("salt", F.pmod("block", copies(F.col("level"))))
    )
    spread = nodes.drop("size").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), copies(F.col("level")) - 1)))
    return wanted.join(spread, ["tree", "level", "idx", "salt"]).groupBy("tree", "block").agg(
        F.collect_list(F.struct("level", "idx", "digest")).alias("nodes")
    )


def _expanded(rows: pd.DataFrame, union: pd.DataFrame) -> Iterator[tuple]:
    """Every row of one block, its path within its tree, and the root of that."""
    sizes, places = sizes_of(int(rows["size"].iloc[0])), rows["idx"].to_numpy()
    cell = union["nodes"].iloc[0] if len(union) else None
    got = {} if cell is None else {(int(n["level"]), int(n["idx"])): n["digest"] for n in cell}
    if set(got) != set(missing(np.unique(places), sizes)):
        raise ValueError("the nodes fetched are not those that the proofs need")
    levels = interiors(dict(zip(places.tolist(), rows["digest"].tolist())), got, sizes)
    for row in rows.itertuples(index=False):
        yield row, path(levels, sizes, row.idx), levels[-1][0]


def _tops(key, rows: pd.DataFrame, union: pd.DataFrame) -> pd.DataFrame:
    """Per source the siblings from its subroot up to the root."""
    out = [
        (row.source, row.digest, root, [{"left": left, "right": right} for left, right in steps])
        for row, steps, root in _expanded(rows, union)
    ]
    return pd.DataFrame(out, columns=["source", "subroot", "root", "steps"])


def _proofs(key, rows: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
    """Per leaf its proof, and the root that the offered leaf folds to."""
    root = head["root"].iloc[0]
    upper = [(list(s["left"]), list(s["right"])) for s in head["steps"].iloc[0]]
    top = b"".join(d for left, right in upper for d in [*left, *right]).hex()
    out = []
    for row, own, subroot in _expanded(rows, head):
        siblings = b"".join(d for left, right in own for d in [*left, *right]).hex()
        offered = row.digest if row.offered is None else row.offered
        fold = folded(folded(offered, own), upper)
        proof = hashlib.sha256((siblings + top).encode()).hexdigest()
        doc_id = None if pd.isna(row.doc_id) else int(row.doc_id)
        out.append((doc_id, row.digest.hex(), subroot.hex(), root.hex(), proof, fold.hex(), fold == root))
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})


def leaves_of(docs: DataFrame, offered: Column | None = None) -> DataFrame:
    """tree, doc_id, digest, and the digest of the row with ``offered`` as its text where that differs."""
    own = {name: F.col(name) for name in FIELDS}
    other = F.lit(None).cast("binary")
    if offered is not None:
        other = F.when(F.coalesce(offered != F.col("text"), F.lit(False)), leaf_digest(own | {"text": offered}))
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long"), leaf_digest(own).alias("digest"), other.alias("offered"))


def manifest(docs: DataFrame, offered: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The leaves (tree, idx, size, doc_id, digest, offered); the nodes above (tree, level, idx, size, digest); and
    of every tree of a source subroot, root and steps, the siblings to the left and right up to the root."""
    placed = numbered(kept(leaves_of(docs, offered)), ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()])
    leaves = kept(placed)
    nodes = nodes_above(leaves, _largest(leaves), False)
    subroots = nodes.where("size = 1").select(F.col("tree").alias("source"), "digest")
    tops = kept(numbered(subroots, [], [F.col("source")]).withColumn("tree", F.lit(TOP)))
    union = unions(tops, nodes_above(tops, _largest(tops), True))
    paths = tops.groupBy("tree", in_block()).cogroup(union.groupBy("tree", "block")).applyInPandas(
        _tops, f"source string, subroot binary, root binary, steps {STEPS}"
    )
    return leaves, nodes, kept(paths)


def _largest(leaves: DataFrame) -> int:
    return leaves.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]


def proofs(docs: DataFrame, offered: Column | None = None) -> DataFrame:
    """Per row doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``offered`` is the text that is to be verified against the manifest, the row's own by default.
    """
    leaves, nodes, paths = manifest(docs, offered)
    # A source's path goes to its blocks; that of a source of very many blocks in several copies.
    crowd = F.expr(f"idx div {BLOCK * ASKERS}L").alias("crowd")
    upper = leaves.where(f"idx % {BLOCK * ASKERS}L = 0").select(F.col("tree").alias("source"), crowd).join(paths, "source")
    blocks = leaves.where(f"idx % {BLOCK}L = 0").select(F.col("tree").alias("source"), crowd, "tree", in_block())
    heads = blocks.join(upper, ["source", "crowd"]).join(unions(leaves, nodes), ["tree", "block"], "left")
    heads = heads.toDF(*heads.columns)
    return leaves.groupBy("tree", in_block()).cogroup(heads.groupBy("tree", "block")).applyInPandas(_proofs, PROOFS)


def without_line_feeds(doc_id: Column, text: Column) -> Column:
    """The tampering of the check: texts of every second doc_id, by its checksum, lose their line feeds."""
    picked = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(F.coalesce(picked, F.lit(False)), F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


#: The same in SQL over ``documents`` with distinct doc_ids. crc32 is worked out byte by byte and bit by bit.
PROOFS_SQL = """
WITH RECURSIVE checked AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda k: CAST(k AS BIGINT))),
      lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295::BIGINT) AS crc FROM documents),
leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) AS offered
  FROM (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS seen,
    concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head FROM checked)),
own AS (
  SELECT source, 0 AS level, idx, leaf AS digest, count(*) OVER (PARTITION BY source) AS size FROM leaves
  UNION ALL
  SELECT source, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(size) + 2) // 3
  FROM own WHERE size > 1 GROUP BY source, level, idx // 3),
subroots AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS sources FROM own WHERE size = 1),
top AS (
  SELECT 0 AS level, place AS idx, digest, sources AS size FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(size) + 2) // 3
  FROM top WHERE size > 1 GROUP BY level, idx // 3),
pow AS (SELECT level, CAST(pow(3, level) AS BIGINT) AS p FROM (SELECT unnest(range(20)) AS level)),
steps AS (
  SELECT l.doc_id, p.level AS step, coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx < l.idx // p.p), '') AS before,
    coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx > l.idx // p.p), '') AS after
  FROM leaves l JOIN pow p ON true JOIN own n ON n.source IS NOT DISTINCT FROM l.source AND n.level = p.level AND n.idx // 3 = l.idx // p.p // 3 AND n.size > 1
  GROUP BY l.doc_id, l.idx, p.level
  UNION ALL
  SELECT l.doc_id, 100 + p.level, coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx < s.place // p.p), ''),
    coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx > s.place // p.p), '')
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN pow p ON true
    JOIN top n ON n.level = p.level AND n.idx // 3 = s.place // p.p // 3 AND n.size > 1
  GROUP BY l.doc_id, s.place, p.level),
paths AS (SELECT doc_id, list(before ORDER BY step) AS lefts, list(after ORDER BY step) AS rights, string_agg(before || after, '' ORDER BY step) AS siblings FROM steps GROUP BY doc_id),
found AS (
  SELECT l.doc_id, leaf, s.digest AS subroot, (SELECT digest FROM top WHERE size = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce(list_prepend(offered, list_transform(range(len(coalesce(lefts, []))), lambda i: lefts[i + 1] || '|' || rights[i + 1])),
      lambda d, step: sha256(string_split(step, '|')[1] || d || string_split(step, '|')[2])) AS folded_root
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source LEFT JOIN paths USING (doc_id))
SELECT *, folded_root = root AS verified FROM found
"""
