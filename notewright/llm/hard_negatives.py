"""Hard negatives of anchors from embeddings, searched in a GNAT-style tree of split points.

A node of the tree has up to ``FANOUT`` split points; a vector goes to the child whose point is nearest, which
cuts space by hyperplanes into many cells at once. For every split point and every child the node stores the
least and greatest distance from the point to the vectors of the child, and for every child the least and
greatest length of its vectors. A search is a window of scores; with the lengths of a child it becomes an
annulus of distances around the anchor, and a child is passed over when, by the triangle inequality, its range
from any split point does not meet the annulus. Leaves are compared exactly, so the result is that of a full
comparison whatever the ranges leave over.

Split points come from a bounded sample, at most ``SAMPLE`` rows by hash of vec_id; the tree has at most as many cells, however
many vectors there are. Every row is indexed and every range covers all rows. The same sample gives each window
a first bound: the fifth best of the sample in it cannot beat the fifth best of all.

How the work is spread: vectors are sorted once by cell and hash, so that a cell of any size, one of equal
vectors too, is cut over tasks, and kept in packs of at most ``PACK_ROWS`` of one cell. Anchors travel in groups
of at most ``GROUP``, one row a group and cell that it has to look at, one more for every ``PACKS`` packs of a
large cell. What comes out of a task is the best five of each window, not scores. The anchors are a stated
hundredth of the rows, so the comparisons that no range rules out grow with the square of the rows, as the
contract's search does.

Cases: rows with a null vec_id, label or vector, a null or non-finite component take no part, nor do vectors whose
squared length in units of 1/256 is above 2**60, as their products may not fit a long; shorter vectors count as
filled with zeros; an anchor without positives, or a positive without negatives, gives no row; equal scores go by
vec_id; of several rows with one vec_id all are candidates, one never a positive of another, and the least by label and
components is the anchor; an empty table gives an empty result; further columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

ANCHORS = 100
POSITIVES = NEGATIVES = BEST = 5
UNIT = 256.0
SAMPLE = 4096
FANOUT = 16
#: Vectors in a cell, as far as the sample allows, and the least of the sample in a node that is split.
CELL_ROWS = 4096
SPLIT = 4 * FANOUT
PACK_ROWS = 2048
GROUP = 512
PACKS = 64
#: Squared length of a vector that takes part; scores and their fourfold fit a long.
LONGEST = float(1 << 60)
#: Relative slack of distances, which are not integers.
SLACK = 1e-6
NONE = -(1 << 61)

CLEAN = "vec_id long, label int, own binary"
PACKED = "cell int, pack long, size int, ids binary, labels binary, vectors binary"
RANGES = "node int, point int, child int, low double, high double"
GROUPS = "cell int, salt int, id long, size int, ids binary, labels binary, vectors binary, places binary, lows binary, highs binary, marks binary"
FOUND = "anchor_id long, place int, mark long, vec_id long, score long"


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


@dataclass
class Vectors:
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray  # integers, one vector a row

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at: np.ndarray) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.rows[at])

    def packed(self) -> tuple[int, bytes, bytes, bytes]:
        return len(self), self.ids.tobytes(), self.labels.tobytes(), self.rows.tobytes()


def unpacked(row: dict) -> Vectors:
    rows = np.frombuffer(row["vectors"], np.int32)
    return Vectors(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), rows.reshape(row["size"], -1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while all sums are whole numbers there, else in integers."""
    longest = [float(np.sqrt((x.astype(float) ** 2).sum(1).max(initial=0))) for x in (a, b)]
    if longest[0] * longest[1] < 2.0**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(float), b.astype(float)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


@dataclass
class Node:
    points: np.ndarray
    children: list[int]  # a node's number, or -1 - the number of a cell
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))  # point, child
    high: np.ndarray = field(default_factory=lambda: np.zeros(0))
    shortest: np.ndarray = field(default_factory=lambda: np.zeros(0))  # child
    longest: np.ndarray = field(default_factory=lambda: np.zeros(0))


def spread_points(rows: np.ndarray) -> np.ndarray:
    """Up to FANOUT distinct rows, each the farthest from those before."""
    chosen = [0]
    far = distances(rows, rows[:1])[:, 0]
    while len(chosen) < FANOUT and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


class Tree:
    """Node 0 is the root; a tree of one cell has no nodes."""

    def __init__(self, sample: np.ndarray, rows: int) -> None:
        self.nodes: list[Node] = []
        self.cells = 0
        self._grow(sample, rows)

    def _cell(self) -> int:
        self.cells += 1
        return -self.cells

    def _grow(self, sample: np.ndarray, rows: float) -> int:
        points = spread_points(sample) if rows > CELL_ROWS and len(sample) >= SPLIT else sample[:0]
        if len(points) < 2:
            return self._cell()
        node = Node(points, [])
        self.nodes.append(node)
        number = len(self.nodes) - 1
        nearest = distances(sample, points).argmin(1)
        for child in range(len(points)):
            own = sample[nearest == child]
            node.children.append(self._grow(own, rows * len(own) / len(sample)))
        return number

    def cells_of(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        todo = [(0 if self.nodes else -1, np.arange(len(rows)))]
        while todo:
            number, at = todo.pop()
            if number < 0:
                out[at] = -1 - number
            elif len(at):
                node = self.nodes[number]
                nearest = distances(rows[at], node.points).argmin(1)
                todo += [(child, at[nearest == k]) for k, child in enumerate(node.children)]
        return out

    def paths(self) -> dict[int, list[tuple[int, int]]]:
        """For every cell the (node, child) on the way to it."""
        out, todo = {}, [(0 if self.nodes else -1, [])]
        while todo:
            number, way = todo.pop()
            if number < 0:
                out[-1 - number] = way
            else:
                todo += [(child, [*way, (number, k)]) for k, child in enumerate(self.nodes[number].children)]
        return out

    def measure(self, ranges: list[tuple]) -> None:
        """Take over the ranges of all rows; point -1 stands for the origin. A child without rows meets nothing."""
        for node in self.nodes:
            shape = (len(node.points), len(node.children))
            node.low, node.high = np.full(shape, np.inf), np.full(shape, -np.inf)
            node.shortest, node.longest = np.full(shape[1], np.inf), np.full(shape[1], -np.inf)
        for number, point, child, low, high in ranges:
            node = self.nodes[number]
            if point < 0:
                node.shortest[child], node.longest[child] = low, high
            else:
                node.low[point, child], node.high[point, child] = low, high

    def reached(self, anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """Which cells may hold a vector whose score with an anchor lies in one of the anchor's windows."""
        out = np.zeros((len(anchors), self.cells), bool)
        if not self.nodes:
            return out | (lows <= highs).any(1)[:, None]
        own = np.sqrt((anchors.astype(float) ** 2).sum(1))
        todo = [(0, np.flatnonzero((lows <= highs).any(1)))]
        while todo:
            number, at = todo.pop()
            if not len(at):
                continue
            node = self.nodes[number]
            away = distances(anchors[at], node.points)  # anchor, point
            length, low, high = own[at][:, None], lows[at].astype(float), highs[at].astype(float)
            for k, child in enumerate(node.children):
                if node.longest[k] < 0:
                    continue
                slack = SLACK * (length + node.longest[k] + 1)
                near = np.sqrt(np.maximum(length**2 + node.shortest[k] ** 2 - 2 * high, 0)) - slack  # anchor, window
                far = np.sqrt(np.maximum(length**2 + node.longest[k] ** 2 - 2 * low, 0)) + slack
                inner = np.maximum(away[:, None, :] - far[:, :, None], near[:, :, None] - away[:, None, :])
                outer = away[:, None, :] + far[:, :, None]
                meets = ((inner <= node.high[:, k] + slack[:, :, None]) & (outer >= node.low[:, k] - slack[:, :, None])).all(2)
                rest = at[(meets & (low <= high)).any(1)]
                if child < 0:
                    out[rest, -1 - child] = True
                else:
                    todo.append((child, rest))
        return out


def _clean(width: int):
    """Vectors of ``width`` whole numbers; those that take no part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten()
            values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            whole = np.floor(UNIT * np.where(np.isfinite(values), values, 0))
            bad = np.bincount(owner, ~np.isfinite(values), minlength=len(sizes)) > 0
            bad |= np.bincount(owner, whole * whole, minlength=len(sizes)) > LONGEST
            good = ~bad[owner]
            matrix = np.zeros((len(sizes), width), np.int32)
            matrix[owner[good], (np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[good]] = whole[good]
            matrix = matrix[~bad]
            edges = np.arange(len(matrix) + 1, dtype=np.int32) * (4 * width)
            rows = pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(edges), pa.py_buffer(matrix)])
            at = pa.array(np.flatnonzero(~bad))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), rows], names=["vec_id", "label", "own"]
            )

    return run


def vectors_of(batch: pa.RecordBatch, width: int) -> Vectors:
    rows = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.int32).reshape(batch.num_rows, width)
    return Vectors(batch.column("vec_id").to_numpy().astype(np.int64), batch.column("label").to_numpy().astype(np.int64), rows)


def _with_cells(tree: Tree, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = tree.cells_of(vectors_of(batch, width).rows)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), *batch.columns], names=["cell", *batch.schema.names])

    return run


def _packs(width: int):
    """Packs of one cell from rows sorted by cell; what a batch ends with goes on in the next."""

    def pack(rows: list[tuple[int, Vectors]]) -> pa.RecordBatch:
        out = []
        for cell, v in rows:
            v = v.take(np.argsort(v.ids, kind="stable"))
            # Any number will do that spreads a cell's packs and is the same when a task runs again.
            out.append((cell, int(v.ids[0]), *v.packed()))
        return batch_of(out, PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = -1, []
        for batch in batches:
            v, cells = vectors_of(batch, width), batch.column("cell").to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(cells)) + 1, len(cells)] if len(cells) else np.zeros(0, int)
            for a, b in zip(edges[:-1], edges[1:]):
                if held and (cells[a] != cell):
                    yield pack([(cell, joined(held))])
                    held = []
                cell = int(cells[a])
                held.append(v.take(np.arange(a, b)))
                while sum(map(len, held)) >= PACK_ROWS:
                    all_ = joined(held)
                    yield pack([(cell, all_.take(np.arange(PACK_ROWS)))])
                    held = [all_.take(np.arange(PACK_ROWS, len(all_)))] if len(all_) > PACK_ROWS else []
        if held:
            yield pack([(cell, joined(held))])

    return run


def joined(parts: list[Vectors]) -> Vectors:
    return Vectors(*[np.concatenate([getattr(p, name) for p in parts]) for name in ("ids", "labels", "rows")])


def _ranges(tree: Tree):
    """Ranges of the vectors of one task: (node, point, child, least, greatest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], tuple[float, float]] = {}
        paths = tree.paths()
        for batch in batches:
            for row in batch.to_pylist():
                rows = unpacked(row).rows
                length = np.sqrt((rows.astype(float) ** 2).sum(1, keepdims=True))
                for number, child in paths[row["cell"]]:
                    away = np.concatenate([length, distances(rows, tree.nodes[number].points)], 1)
                    for point, (low, high) in enumerate(zip(away.min(0).tolist(), away.max(0).tolist()), -1):
                        was = found.get((number, point, child), (low, high))
                        found[number, point, child] = min(was[0], low), max(was[1], high)
        yield batch_of([(*k, *v) for k, v in found.items()], RANGES)

    return run


def best_of(place: np.ndarray, scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Indices of the best ``count`` of every place: higher scores, then smaller ids."""
    order = np.lexsort((ids, -scores, place))
    sorted_ = place[order]
    first = np.r_[True, sorted_[1:] != sorted_[:-1]] if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[rank < count]


#: Whether (anchor labels, candidate labels) may pair: equal for positives, not for negatives.
Pairing = Callable[[np.ndarray, np.ndarray], np.ndarray]
SAME: Pairing = np.equal
OTHER: Pairing = np.not_equal


def fifth_best(scores: np.ndarray, allowed: np.ndarray, count: int) -> np.ndarray:
    """Per row the least of the best ``count`` allowed scores, or NONE where there are fewer."""
    if scores.shape[1] < count:
        return np.full(len(scores), NONE)
    return -np.partition(-np.where(allowed, scores, NONE), count - 1, axis=1)[:, count - 1]


def _groups(tree: Tree, salts: dict[int, int], sample: Vectors, pairing: Pairing, count: int, width: int):
    """One row a cell that a group of anchors has to look at, with the windows narrowed by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, GROUP):
                part = batch.slice(first, GROUP)
                own = vectors_of(part, width)
                windows = part.column("windows").to_pylist()
                n, most = len(own), max((len(w) for w in windows), default=0)
                lows, highs, marks = np.full((n, most), 1), np.zeros((n, most), np.int64), np.zeros((n, most), np.int64)
                for a, ws in enumerate(windows):
                    for k, w in enumerate(ws):
                        lows[a, k], highs[a, k], marks[a, k] = w["low"], w["high"], w["mark"]
                scores = products(own.rows, sample.rows)
                may = pairing(own.labels[:, None], sample.labels) & (own.ids[:, None] != sample.ids)
                for k in range(most):
                    inside = may & (scores >= lows[:, k, None]) & (scores <= highs[:, k, None])
                    lows[:, k] = np.maximum(lows[:, k], fifth_best(scores, inside, count))
                cells = tree.reached(own.rows, lows, highs)
                out = []
                for cell in np.flatnonzero(cells.any(0)).tolist():
                    if cell not in salts:
                        continue
                    at = np.flatnonzero(cells[:, cell])
                    rest = (*own.take(at).packed(), at.astype(np.int32).tobytes(), *[x[at].astype(np.int64).tobytes() for x in (lows, highs, marks)])
                    out += [(cell, salt, int(own.ids[0]), *rest) for salt in range(salts[cell])]
                yield batch_of(out, GROUPS)

    return run


def _compared(pairing: Pairing, count: int):
    """The best ``count`` of every window from the packs and groups of anchors that meet in a task."""

    def batch_of(held: dict) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held.values())]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                pack = unpacked(row)
                own = unpacked({"ids": row["a_ids"], "labels": row["a_labels"], "vectors": row["a_vectors"], "size": row["a_size"]})
                lows, highs, marks = (np.frombuffer(row[c], np.int64).reshape(len(own), -1) for c in ("lows", "highs", "marks"))
                scores = products(own.rows, pack.rows)
                may = pairing(own.labels[:, None], pack.labels) & (own.ids[:, None] != pack.ids)
                for w in range(lows.shape[1]):
                    a, b = np.nonzero(may & (scores >= lows[:, w, None]) & (scores <= highs[:, w, None]))
                    if not len(a):
                        continue
                    new = (own.ids[a], np.full(len(a), w), marks[a, w], pack.ids[b], scores[a, b])
                    key = (row["id"], w)
                    both = [np.concatenate(c) for c in zip(held[key], new)] if key in held else list(new)
                    best = best_of(both[0], both[4], both[3], count)
                    held[key] = tuple(c[best] for c in both)
            if sum(len(h[0]) for h in held.values()) > 200_000:
                yield batch_of(held)
                held = {}
        if held:
            yield batch_of(held)

    return run


@dataclass
class Index:
    packs: DataFrame
    tree: Tree
    sample: Vectors
    width: int

    def salts(self) -> dict[int, int]:
        """Parts into which a cell's packs are dealt; one row a cell, and cells are bounded by the sample."""
        return {r["cell"]: -(-r["n"] // PACKS) for r in self.packs.groupBy("cell").agg(F.count("*").alias("n")).collect()}

    def search(self, anchors: DataFrame, pairing: Pairing, count: int) -> DataFrame:
        """anchor_id, place, mark, vec_id, score, rank of the best ``count`` of every window of ``anchors``
        (vec_id, label, own, windows: low, high, mark)."""
        salts = self.salts()
        asked = anchors.mapInArrow(_groups(self.tree, salts, self.sample, pairing, count, self.width), GROUPS)
        for name in ("ids", "labels", "vectors", "size"):
            asked = asked.withColumnRenamed(name, f"a_{name}")
        parts = F.element_at(F.create_map(*[F.lit(x) for pair in (salts or {0: 1}).items() for x in pair]), F.col("cell"))
        dealt = self.packs.withColumn("salt", F.pmod(F.xxhash64("pack", "size"), parts).cast("int"))
        found = dealt.join(asked, ["cell", "salt"]).drop("salt", "pack", "places").mapInArrow(_compared(pairing, count), FOUND)
        order = Window.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def indexed(vectors: DataFrame, width: int, rows: int) -> Index:
    """The index of ``vectors`` (vec_id, label, own), which have ``width`` components each."""
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "own").limit(SAMPLE).collect()
    flat = np.frombuffer(b"".join(r["own"] for r in chosen), np.int32).reshape(len(chosen), width)
    sample = Vectors(*[np.array([r[c] for r in chosen], np.int64) for c in ("vec_id", "label")], flat)
    tree = Tree(flat, rows)
    placed = vectors.mapInArrow(_with_cells(tree, width), f"cell int, {CLEAN}").withColumn("_at", F.xxhash64("vec_id"))
    packs = kept(
        placed.repartitionByRange("cell", "_at").sortWithinPartitions("cell", "_at").drop("_at").mapInArrow(_packs(width), PACKED)
    )
    ranges = packs.mapInArrow(_ranges(tree), RANGES).groupBy("node", "point", "child").agg(F.min("low"), F.max("high"))
    tree.measure([tuple(r) for r in ranges.collect()])
    return Index(packs, tree, sample, width)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``embeddings`` (vec_id, embedding, label)."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null").select("vec_id", label.alias("label"), "embedding")
    size = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    width = max(size[1] or 0, 1)
    vectors = rows.mapInArrow(_clean(width), CLEAN)
    index = indexed(vectors, width, size[0])
    anchors = kept(
        vectors.where(F.col("vec_id") % ANCHORS == 0).groupBy("vec_id").agg(F.min(F.struct("label", "own")).alias("least"))
        .select("vec_id", "least.label", "least.own")
    )

    def window(low, high, mark):
        return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), mark.cast("long").alias("mark"))

    every = F.array(window(F.lit(NONE), F.lit(1 << 61), F.lit(0)))
    positives = kept(
        index.search(anchors.withColumn("windows", every), SAME, POSITIVES)
        .select("anchor_id", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    )
    # 80 * positive <= 100 * negative <= 100 * positive; the mark names the positive.
    least = F.expr("cast(ceil(cast(4 as decimal(20,0)) * positive_score / 5) as long)")
    windows = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", window(least, F.col("positive_score"), F.col("positive_id")).alias("w")))).alias("all")
    ).select("vec_id", F.transform("all", lambda x: x["w"]).alias("windows"))
    negatives = index.search(anchors.join(windows, "vec_id").select("vec_id", "label", "own", "windows"), OTHER, NEGATIVES)
    # Windows of one anchor are in the order of its positives.
    at = positives.select("anchor_id", (F.col("rank") - 1).alias("place"), "positive_id", "positive_score")
    return negatives.join(at, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


#: The same in SQL over ``embeddings`` with distinct vec_ids: every anchor against every row.
NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negative AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positive p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5
"""
