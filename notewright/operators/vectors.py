"""Comparing vectors in blocks: matrix products, and bounds on angles that make most of them needless.

Runs inside tasks on Arrow batches. A batch is cut into blocks of vectors that lie near one pivot; a block
knows its least and greatest angle to every pivot. By the triangle inequality of angles no vector of the
block is nearer to a query than the gap between the query's angle and that range, so a block is compared
only with queries whose bound its best possible cosine reaches. The bound of a query is the threshold, then the score of its
last place as far as found. Matrix products only pick candidates, with some slack; a score that is given out
is summed up component by component, so it does not depend on blocks, and equal vectors score the same.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle

# Functions that run in tasks travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 256
PIVOTS = 16
#: Products of a block with many queries at a time, and candidates held before they are cut to the best.
QUERIES_AT_ONCE = 4096
HELD = 200_000
SLACK = 1e-9


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of list its rows' indices and their matrix; only rows with a direction."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    here = np.flatnonzero(~np.asarray(column.is_null()))
    lists = column.take(pa.array(here))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == size)
        rows = flat[starts[own][:, None] + np.arange(size)]
        norms = lengths(rows)
        usable = np.isfinite(norms) & (norms > 0)
        yield here[own[usable]], rows[usable]


def in_order(products: np.ndarray) -> np.ndarray:
    """Sums of rows from left to right; numpy's own sum pairs up differently by size."""
    return np.add.accumulate(products, axis=1)[:, -1]


def lengths(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(in_order(rows * rows))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / lengths(rows)[:, None]


def angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1, 1))


def pivots_of(sample: np.ndarray) -> np.ndarray:
    """Unit vectors of the sample, each the farthest from those before."""
    units = unit(sample)
    chosen = [0]
    far = angles(units, units[:1])[:, 0]
    while len(chosen) < min(PIVOTS, len(units)) and far.max() > 1e-6:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, angles(units, units[chosen[-1:]])[:, 0])
    return units[chosen]


@dataclass
class Asked:
    """Queries: their key columns, limits, vectors by length, and the bounds that are known beforehand."""

    keys: pa.Table
    limits: np.ndarray
    vectors: dict[int, tuple[np.ndarray, np.ndarray]]  # length: (query numbers, matrix)
    pivots: dict[int, np.ndarray]
    bounds: np.ndarray
    threshold: float


def asked_of(table: pa.Table, keys: list[str], sample: pa.Table, threshold: float) -> Asked:
    vectors = {rows.shape[1]: (at, rows) for at, rows in matrices(table["query_vector"])}
    limits = np.array(table["_limit"].fill_null(0).to_pylist(), np.int64)
    bounds = np.full(len(limits), threshold, float)
    pivots = {}
    for _, rows in matrices(sample["embedding"]):
        size = rows.shape[1]
        if not len(rows) or size not in vectors:
            continue
        pivots[size] = pivots_of(rows)
        at, queries = vectors[size]
        for first in range(0, len(at), QUERIES_AT_ONCE):
            part = at[first : first + QUERIES_AT_ONCE]
            scores = unit(queries[first : first + QUERIES_AT_ONCE]) @ unit(rows).T
            most = min(max(int(limits[part].max(initial=1)), 1), scores.shape[1])
            scores = -np.sort(np.partition(-scores, most - 1, axis=1)[:, :most], axis=1)
            known = (limits[part] > 0) & (limits[part] <= scores.shape[1])
            last = scores[np.arange(len(part)), np.clip(limits[part] - 1, 0, scores.shape[1] - 1)] - SLACK
            bounds[part] = np.where(known, np.maximum(bounds[part], last), bounds[part])
    return Asked(table.select([*keys, "_limit"]), limits, vectors, pivots, bounds, threshold)


@dataclass
class Best:
    """The best of every query so far, cut to its limit now and then.

    A cut takes as long as what is held, and what it leaves may be more than ``HELD`` by itself: the next one waits until as much
    has come again, so that all cuts together cost no more than a few passes over the candidates.
    """

    asked: Asked
    bounds: np.ndarray
    queries: list[np.ndarray] = field(default_factory=list)
    scores: list[np.ndarray] = field(default_factory=list)
    places: list[np.ndarray] = field(default_factory=list)
    names: list = field(default_factory=list)
    fresh: int = 0
    left: int = 0

    def named(self, ids: list) -> int:
        """Take in the ids of vectors; the place of the first one."""
        self.names.extend(ids)
        return len(self.names) - len(ids)

    def add(self, queries: np.ndarray, scores: np.ndarray, places: np.ndarray) -> None:
        self.queries.append(queries)
        self.scores.append(scores)
        self.places.append(places)
        self.fresh += len(queries)

    def full(self) -> bool:
        return self.fresh > max(HELD, self.left)

    def cut(self) -> tuple[np.ndarray, np.ndarray, list]:
        queries = np.concatenate([np.zeros(0, np.int64), *self.queries])
        scores = np.concatenate([np.zeros(0), *self.scores])
        known, at = np.unique(np.concatenate([np.zeros(0, np.int64), *self.places]), return_inverse=True)
        ids = [self.names[k] for k in known.tolist()]
        place = {i: k for k, i in enumerate(sorted(set(ids), key=lambda i: (i is not None, i)))}
        order = np.lexsort((np.array([place[i] for i in ids], np.int64)[at], -scores, queries))
        first = np.searchsorted(queries[order], queries[order])
        rank = np.arange(len(order)) - first
        limit = self.asked.limits[queries[order]]
        kept = order[rank < limit]
        last = order[rank == limit - 1]
        self.bounds[queries[last]] = np.maximum(self.bounds[queries[last]], scores[last] - SLACK)
        self.queries, self.scores, self.places, self.names = [queries[kept]], [scores[kept]], [at[kept]], ids
        self.fresh, self.left = 0, len(kept)
        return queries[kept], scores[kept], [ids[k] for k in at[kept].tolist()]


def compare(best: Best, ids: list, rows: np.ndarray) -> tuple[int, int]:
    """Take over what the vectors give; how many pairs there are, and how many were compared."""
    asked, size = best.asked, rows.shape[1]
    if size not in asked.vectors or not len(rows):
        return 0, 0
    at, queries = asked.vectors[size]
    norms, query_norms = lengths(rows), lengths(queries)
    units, query_units = rows / norms[:, None], queries / query_norms[:, None]
    # Single precision is enough to pick candidates: the slack is above all that rounding can lose in a product of unit vectors.
    light, query_light, slack = units.astype(np.float32), query_units.astype(np.float32), SLACK + (size + 4) * 2.0**-23
    order, gaps, named = np.arange(len(rows)), None, None
    if size in asked.pivots:
        away, query_away = angles(units, asked.pivots[size]), angles(query_units, asked.pivots[size])
        near = away.argmin(1)
        order = np.lexsort((away[np.arange(len(away)), near], near))
        gaps = (away, query_away)
    compared = 0
    for first in range(0, len(order), BLOCK_ROWS):
        block = order[first : first + BLOCK_ROWS]
        open_ = np.ones(len(at), bool)
        if gaps:
            low, high = gaps[0][block].min(0), gaps[0][block].max(0)
            gap = np.maximum(np.maximum(low - gaps[1], gaps[1] - high), 0).max(1)
            open_ = np.cos(np.minimum(gap, np.pi)) + 1e-6 >= best.bounds[at]
        for some in np.array_split(np.flatnonzero(open_), max(1, -(-int(open_.sum()) // QUERIES_AT_ONCE))):
            compared += len(some) * len(block)
            reached = light[block] @ query_light[some].T >= (best.bounds[at[some]] - slack).astype(np.float32)
            x, q = np.divmod(np.flatnonzero(reached), max(1, len(some)))
            if not len(x):
                continue
            x, q = block[x], some[q]
            scores = np.concatenate([
                in_order(rows[x[k : k + HELD]] * queries[q[k : k + HELD]]) / (norms[x[k : k + HELD]] * query_norms[q[k : k + HELD]])
                for k in range(0, len(x), HELD)
            ])
            enough = scores >= asked.threshold
            named = best.named(ids) if named is None else named
            best.add(at[q[enough]], scores[enough], named + x[enough])
            if best.full():
                # Only ids of what is kept stay with it.
                best.cut()
                named = None
    return len(rows) * len(at), compared


def scan(asked: Broadcast):
    """Batches of (summary_id, embedding) to the best of the task, and one row that counts pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Asked = asked.value
        best = Best(own, own.bounds.copy())
        pairs = compared = 0
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at, rows in matrices(batch.column(1)):
                more = compare(best, batch.column(0).take(pa.array(at)).to_pylist(), rows)
                pairs, compared = pairs + more[0], compared + more[1]
        if kind is None:
            return
        queries, scores, ids = best.cut()
        n = len(queries)
        keys = own.keys.take(pa.array(np.r_[queries, [0]] if len(own.limits) else []))
        if not len(own.limits):
            return
        columns = [c.combine_chunks() for c in keys.columns]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        columns += [
            pa.array([*ids, None], kind), pa.array([*scores.tolist(), None], pa.float64()),
            pa.array([0] * n + [pairs], pa.int64()), pa.array([0] * n + [compared], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[*own.keys.schema.names, "summary_id", "score", "pairs", "compared"])

    return run
