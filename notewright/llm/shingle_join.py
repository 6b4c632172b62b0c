"""N-gram Jaccard join: components of documents that share 85 in 100 of their word shingles.

Grouped prefix join. Shingles have one global order, rare before common; two sets that link share one
of the first ``n - ceil(0.85 n) + 1`` shingles of each. Documents with one shingle set are one kind; kinds
with equal prefix and size are one group. Groups that share a prefix shingle and whose sizes allow a link
are chained; of chained groups all members that share a shingle of their own prefixes are candidates and
verified on their whole sets.

How it is spread: documents travel in packs. How many packs hold a shingle is counted for all of them, to
the power of two, as ``passages`` does; shingles of a level are ordered by hash, and those that occur once
anywhere, level 0, meet nobody and are dropped from prefixes. Groups chained by candidates form a cluster; every kind's set goes once to its cluster, where pairs are verified in memory and a
spanning forest of the links is given back. A cluster of more than ``BLOCK`` kinds is split into blocks
and every pair of blocks is its own task unit, so no task holds a cluster of any size. Roots come from
contraction (``components``).

Cases: null and empty texts and texts without words have an empty set and link with nothing, not even
each other; with fewer words than a shingle the whole sequence is one; equal sets link; a null doc_id is
never a component's smallest unless all are null; an empty table gives an empty result; further columns
are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .passages import (
    SEEDS, Scheme, Tags, bucket_counts, judged, pack_texts, packed, rolled, rows_of, states_of, tag_rows, tagged,
)
from .shared import kept, released
from .texts import Texts, mixed, words

SHINGLE = 4
SCHEME = Scheme(window=SHINGLE, seed=SHINGLE, by_word=True, lower=True)
PERCENT = 85
BLOCK = 512
#: Blocks of a cluster at most; larger clusters have larger blocks, up to LARGE_BLOCK, and then more blocks.
BLOCKS = 16
LARGE_BLOCK = 1 << 15
#: Columns of the table of common shingles handled at once.
COLUMNS = 4096
#: Sizes that can link lie in one class or in two neighbouring ones.
CLASS_WIDTH = math.log(100 / PERCENT) * 1.000001

PROFILE = "pack string, place int, doc_id long, n_shingles long, kind long, prefix long, shared array<long>"
SETS = "pack string, place int, cluster long, unit long, kind long, side int, n int, shingles binary"
LINKS = "a long, b long"


def shingle_sets(texts: Texts) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    found = words(texts)
    hashes = found.hashes()
    (runs,) = rolled(hashes, SHINGLE)
    runs = mixed(runs)
    out = []
    for a, b in zip(found.firsts[:-1].tolist(), found.firsts[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mixed(rolled(hashes[a:b], b - a)[0] + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def _digest(values: np.ndarray, salt: int) -> int:
    return int(mixed(np.array([np.sum(mixed(values + np.uint64(salt)), dtype=np.uint64) + np.uint64(len(values))]))[0].view(np.int64))


class Profile:
    """Of one pack: per text its set and kind; and the first text of each kind."""

    def __init__(self, row: dict):
        self.sets = shingle_sets(pack_texts(row))
        self.kinds = [_digest(s, 1) if len(s) else None for s in self.sets]
        first: dict[int, int] = {}
        for i, kind in enumerate(self.kinds):
            if kind is not None:
                first.setdefault(kind, i)
        self.new = list(first.values())
        self.ends = np.r_[0, np.cumsum([len(self.sets[i]) for i in self.new])].astype(np.int64)
        self.all = np.concatenate([self.sets[i] for i in self.new]) if self.new else np.zeros(0, np.uint64)

    def tags(self, buckets: int) -> Tags:
        return tagged(self.all, buckets)


def _send_shingles(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield tag_rows(row["pack"], Profile(row).tags(buckets), buckets)

    return run


def _profiles(buckets: int):
    """Per text its kind; for the first of each kind in a pack also the prefix and the shared shingles in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            profile = Profile(row)
            level = states_of(profile.tags(buckets), row["states"], buckets)
            n = len(profile.sets)
            prefix: list = [None] * n
            shared: list = [None] * n
            for i, a, b in zip(profile.new, profile.ends[:-1], profile.ends[1:]):
                order = np.argsort(level[a:b], kind="stable")[: prefix_length(int(b - a))]
                head = profile.sets[i][order]
                prefix[i] = _digest(head, 2 + int(b - a))
                shared[i] = head[level[a:b][order] > 0].view(np.int64)
            ids, known = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["known"], np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["pack"]] * n, pa.string()), pa.array(range(n), pa.int32()),
                    pa.array([i if k else None for i, k in zip(ids.tolist(), known)], pa.int64()),
                    pa.array([len(s) for s in profile.sets], pa.int64()), pa.array(profile.kinds, pa.int64()),
                    pa.array(prefix, pa.int64()), pa.array(shared, pa.list_(pa.int64())),
                ],
                ["pack", "place", "doc_id", "n_shingles", "kind", "prefix", "shared"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets that clusters ask of a pack, one row for each unit of the cluster that needs it."""
    for row in rows_of(batches):
        texts, out = pack_texts(row), []
        wanted = row["wanted"]
        part = Texts.of([texts.text(w["place"]) for w in wanted])
        for want, shingles in zip(wanted, shingle_sets(part)):
            data, block, blocks = shingles.tobytes(), want["block"], want["blocks"]
            for other in range(blocks):
                low, high = min(block, other), max(block, other)
                out.append((
                    row["pack"], want["place"], want["cluster"], low * blocks + high, want["kind"],
                    int(block == high), len(shingles), data,
                ))
            if len(out) > 500:
                yield _set_batch(out)
                out = []
        yield _set_batch(out)


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["pack", "place", "cluster", "unit", "kind", "side", "n", "shingles"]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, by products of blocks of the table of shingles held twice or more."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    distinct, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.cumsum(times > 1) - 1
    held = times[code] > 1
    owner, code = owner[held], common[code[held]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((n, n), np.float32)
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [first, first + COLUMNS])
        table = np.zeros((n, COLUMNS), np.float32)
        table[owner[a:b], code[a:b] - first] = 1
        out += table @ table.T
    return out.astype(np.int64)


def _heads(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The prefixes of the sets, as codes, in the order of how many of the sets hold a shingle."""
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    ends = np.r_[0, np.cumsum([len(s) for s in sets])]
    return [np.sort(rank[code[a:b]])[: prefix_length(int(b - a))] for a, b in zip(ends[:-1], ends[1:])]


def _sharing(heads: list[np.ndarray]) -> np.ndarray:
    """Which pairs of the heads have a code in common."""
    n = len(heads)
    owner = np.repeat(np.arange(n), [len(h) for h in heads])
    code = np.concatenate(heads)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
    first, times = cuts[:-1], np.diff(cuts)
    out = np.zeros((n, n), bool)
    for k in np.flatnonzero((times > 1) & (8 * times <= n)):
        own = owner[first[k] : first[k] + times[k]]
        out[np.ix_(own, own)] = True
    # Codes that many hold, by a product.
    wide = np.flatnonzero((times > 1) & (8 * times > n))
    for k in range(0, len(wide), COLUMNS):
        table = np.zeros((n, min(COLUMNS, len(wide) - k)), np.float32)
        for column, w in enumerate(wide[k : k + COLUMNS]):
            table[owner[first[w] : first[w] + times[w]], column] = 1
        out |= table @ table.T > 0
    return out


def linked_pairs(sides: np.ndarray, crossing: bool, sets: list[np.ndarray]) -> np.ndarray:
    """Index pairs of the kinds that link; only pairs of both sides where the unit is of two blocks."""
    sizes = np.array([len(s) for s in sets], np.int64)
    # Pairs that share a prefix shingle, by an order of the unit's own: rare here before common here. The
    # members of a group differ in this order's prefixes, so each has its own.
    pairs = np.triu(_sharing(_heads(sets)), 1)
    # ... and whose sizes allow a link.
    pairs &= 100 * np.minimum(sizes[:, None], sizes) >= PERCENT * np.maximum(sizes[:, None], sizes)
    if crossing:
        pairs &= sides[:, None] != sides
    a, b = np.nonzero(pairs)
    if not len(a):
        return np.zeros((0, 2), np.int64)
    if len(a) <= len(sets):
        inter = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)])
    else:
        used, place = np.unique(np.r_[a, b], return_inverse=True)
        inter = overlaps([sets[i] for i in used])[place[: len(a)], place[len(a) :]]
    good = 100 * inter >= PERCENT * (sizes[a] + sizes[b] - inter)
    return np.stack([a[good], b[good]], 1)


def _verify_unit(rows: list[dict]) -> list[tuple[int, int]]:
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
    sides = np.array([r["side"] for r in rows])
    # A unit of a block with itself has the numbers of one block twice, and side 1 throughout.
    pairs = linked_pairs(sides, bool((sides == 0).any()), sets)
    parent = list(range(len(rows)))
    forest = []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x != y:
            parent[y] = x
            forest.append((rows[a]["kind"], rows[b]["kind"]))
    return forest


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units come one after the other, as the partition is sorted by them."""
    unit, rows, out = None, [], []
    for row in rows_of(batches):
        key = (row["cluster"], row["unit"])
        if key != unit:
            out += _verify_unit(rows) if len(rows) > 1 else []
            unit, rows = key, []
        rows.append(row)
        if len(out) > 10_000:
            yield _link_batch(out)
            out = []
    out += _verify_unit(rows) if len(rows) > 1 else []
    yield _link_batch(out)


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def shingle_components(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    packs = packed(docs, SCHEME)
    buckets, _ = bucket_counts(packs, SCHEME)
    states = judged(packs.mapInArrow(released(_send_shingles(buckets)), SEEDS), buckets)
    profile = kept(packs.join(states, "pack", "left").mapInArrow(released(_profiles(buckets)), PROFILE))
    kinds = kept(
        profile.where("kind is not null").groupBy("kind")
        .agg(F.min("doc_id").alias("least"), F.min(F.struct("pack", "place")).alias("home"), F.min("prefix").alias("prefix"))
    )

    # Groups that share a prefix shingle and a class of size.
    held = (
        profile.where("size(shared) > 0").select("prefix", "n_shingles", F.explode("shared").alias("shingle")).distinct()
        .withColumn("class", F.explode(F.expr(
            f"transform(sequence(0, 1), k -> cast(floor(ln(n_shingles) / {CLASS_WIDTH!r}) as int) + k)"
        ))).select("prefix", "shingle", "class")
    )
    stars = held.groupBy("shingle", "class").agg(F.min("prefix").alias("a"), F.max("prefix").alias("z")).where("a < z")
    edges = held.join(stars, ["shingle", "class"]).select("a", F.col("prefix").alias("b"))
    chained = components(edges).toDF("prefix", "root")

    # Clusters of two kinds or more, cut into blocks.
    clustered = kinds.join(chained, "prefix", "left").withColumn("cluster", F.coalesce("root", "prefix")).drop("root")
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("members")).where("members > 1")
    block_size = f"greatest({BLOCK}, least({LARGE_BLOCK}, cast(ceil(members / {BLOCKS}) as int)))"
    wanted = (
        clustered.join(sizes, "cluster").withColumn("blocks", F.expr(f"cast(ceil(members / {block_size}) as int)"))
        .select(
            F.col("home.pack").alias("pack"),
            F.struct(F.col("home.place").alias("place"), "cluster", "kind", "blocks",
                     F.expr("cast(pmod(xxhash64(kind), blocks) as int)").alias("block")).alias("want"),
        ).groupBy("pack").agg(F.collect_list("want").alias("wanted"))
    )
    sets = packs.join(wanted, "pack").mapInArrow(released(_sets), SETS)
    links = sets.repartition(buckets, "cluster", "unit").sortWithinPartitions("cluster", "unit", "kind").mapInArrow(released(_verify), LINKS)
    roots = components(links).toDF("kind", "root")

    reached = kinds.join(roots, "kind", "left").select("kind", F.coalesce("root", "kind").alias("root"), "least")
    smallest = reached.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = kept(reached.join(smallest, "root").select("kind", "component_id"))
    return profile.select("doc_id", "n_shingles", "kind").join(ids, "kind", "left").select(
        "doc_id", "n_shingles", F.when(F.col("kind").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
