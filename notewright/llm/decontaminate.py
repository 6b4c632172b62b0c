"""Benchmark decontamination: documents' words inside occurrences of benchmark windows.

Wu-Manber search over words. Patterns are the windows of ``WINDOW`` consecutive item words, and the
whole of an item that is shorter; patterns of one length are searched together. A shift table over
blocks of words says how far a position can move on because no pattern ends there; where it can't,
the block's bucket holds the patterns that end in that block, and comparing all words confirms.

Many positions of one piece of texts are moved on at once: each text, and each ``STRETCH`` words of a
long one, has its own. Documents are read in place and not shuffled. Patterns are sent to tasks in
blocks of items of about ``BLOCK_BYTES``; each block is a further step over the same rows, so a large
benchmark costs passes and no memory.

Cases: a null or empty text has no words; an item without words has no window; a null item id is the
empty string; equal items count once an id; repeated documents give repeated rows; an empty benchmark
hits nothing; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import LOWER, MARKS, Spans, Texts, covered, pieces, span_sums, words

WINDOW = 10
BLOCK_BYTES = 4 << 20
STRETCH = 256
PIECE = 2 << 20
#: Pairs of a position and a pattern compared at once.
COMPARED = 1 << 18

#: Columns added, with their kinds.
FOUND = {"n_words": "long", "spans": "array<struct<first: int, past: int>>", "items": "array<string>"}


def lowered_words(texts: Texts) -> Spans:
    return words(Texts(LOWER[texts.data], texts.offsets), MARKS)


class Patterns:
    """The windows of one length over coded words, with their shift table and buckets."""

    def __init__(self, codes: np.ndarray, items: np.ndarray):
        self.codes, inverse = np.unique(codes, axis=0, return_inverse=True)
        n, self.length = self.codes.shape
        self.block = min(3, max(1, self.length // 2))
        self.mask = (1 << max(8, int(4 * n * self.length).bit_length())) - 1
        reach = self.length - self.block + 1
        self.shift = np.full(self.mask + 1, reach, np.int16)
        for end in range(self.block, self.length + 1):
            at = self.hashed(*(self.codes[:, end - self.block + k] for k in range(self.block)))
            np.minimum.at(self.shift, at, self.length - end)
        suffix = self.hashed(*(self.codes[:, self.length - self.block + k] for k in range(self.block)))
        self.by_suffix = np.argsort(suffix, kind="stable")
        self.bucket = np.searchsorted(suffix[self.by_suffix], np.arange(self.mask + 2))
        order = np.argsort(inverse.reshape(-1), kind="stable")
        self.items = items[order]
        self.item_first = np.searchsorted(inverse.reshape(-1)[order], np.arange(n + 1))

    def hashed(self, *block: np.ndarray) -> np.ndarray:
        h = np.zeros(len(block[0]), np.uint64)
        for word in block:
            h = (h + word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) & np.uint64(self.mask)).astype(np.int64)

    def search(self, text: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all occurrences within texts, and the pattern of each."""
        counts = np.diff(firsts) - self.length + 1
        places = -(-np.maximum(counts, 0) // STRETCH)
        lead = firsts[:-1] + self.length - 1
        step = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
        at = np.repeat(lead, places) + step * STRETCH
        past = np.minimum(at + STRETCH, np.repeat(firsts[1:], places))
        starts, which = [], []
        while len(at):
            h = self.hashed(*(text[at - self.block + 1 + k] for k in range(self.block)))
            shift = self.shift[h]
            stop = shift == 0
            if stop.any():
                for s, p in self.compared(text, at[stop] - self.length + 1, h[stop]):
                    starts.append(s)
                    which.append(p)
            at = at + np.maximum(shift, 1)
            go = at < past
            at, past = at[go], past[go]
        none = np.zeros(0, np.int64)
        return (np.concatenate(starts), np.concatenate(which)) if starts else (none, none)

    def compared(self, text: np.ndarray, starts: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = self.bucket[h + 1] - self.bucket[h]
        ends = np.cumsum(sizes)
        first = 0
        while first < len(starts):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + COMPARED, "right")))
            own = sizes[first:last]
            pair = np.repeat(np.arange(first, last), own)
            rank = np.arange(len(pair)) - np.repeat(np.cumsum(own) - own, own)
            pattern = self.by_suffix[self.bucket[h[pair]] + rank]
            at = starts[pair]
            for k in range(self.length):
                same = self.codes[pattern, k] == text[at + k]
                at, pattern = at[same], pattern[same]
            yield at, pattern
            first = last


class Benchmark:
    """The patterns of one block of items."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        found = lowered_words(Texts.of([text.encode() for _, text in items]))
        codes, contents = found.encoded()
        self.vocabulary = {word: k + 1 for k, word in enumerate(contents)}
        rows: dict[int, list] = {}
        for k, (name, _) in enumerate(items):
            own = codes[found.firsts[k] : found.firsts[k + 1]] + 1
            if len(own):
                size = min(WINDOW, len(own))
                runs = np.lib.stride_tricks.sliding_window_view(own, size)
                rows.setdefault(size, []).append((runs, np.full(len(runs), number[name])))
        self.classes = [
            Patterns(np.concatenate([r for r, _ in held]).astype(np.int32), np.concatenate([i for _, i in held]))
            for _, held in sorted(rows.items())
        ]

    def hits(self, texts: Texts) -> tuple[Spans, np.ndarray, list[list[str]]]:
        """The texts' words, which of them are hit, and each text's items."""
        found = lowered_words(texts)
        codes, contents = found.encoded()
        known = np.fromiter((self.vocabulary.get(w, 0) for w in contents), np.int32, len(contents))
        text = known[codes] if len(codes) else np.zeros(0, np.int32)
        hit = np.zeros(len(found), bool)
        pairs = []
        for patterns in self.classes:
            starts, which = patterns.search(text, found.firsts)
            hit |= covered(starts, patterns.length, len(found))
            sizes = patterns.item_first[which + 1] - patterns.item_first[which]
            owner = np.repeat(np.searchsorted(found.firsts, starts, "right") - 1, sizes)
            at = np.repeat(patterns.item_first[which] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            pairs.append(owner * len(self.names) + patterns.items[at])
        items: list[list[str]] = [[] for _ in range(len(texts))]
        for pair in np.unique(np.concatenate(pairs)).tolist() if pairs else []:
            items[pair // len(self.names)].append(self.names[pair % len(self.names)])
        return found, hit, items


def _search(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = None
        for batch in batches:
            benchmark = benchmark or Benchmark(sent.value)
            for part, texts in pieces(batch, limit=PIECE):
                found, hit, items = benchmark.hits(texts)
                before = part.column("spans")
                for i, spans in enumerate(before.to_pylist() if before.null_count < len(before) else []):
                    for s in spans or []:
                        hit[found.firsts[i] + s["first"] : found.firsts[i] + s["past"]] = True
                earlier = part.column("items")
                if earlier.null_count < len(earlier):
                    items = [sorted({*own, *(old or [])}) for own, old in zip(items, earlier.to_pylist())]
                edge = np.r_[False, hit, False]
                opens, closes = edge[1:] & ~edge[:-1], edge[:-1] & ~edge[1:]
                opens[found.firsts[1:-1]] |= (edge[1:] & edge[:-1])[found.firsts[1:-1]]
                closes[found.firsts[1:-1]] |= (edge[1:] & edge[:-1])[found.firsts[1:-1]]
                first, past = np.flatnonzero(opens), np.flatnonzero(closes)
                owner = np.searchsorted(found.firsts, first, "right") - 1
                entries = pa.StructArray.from_arrays(
                    [pa.array((x - found.firsts[owner]).astype(np.int32)) for x in (first, past)], ["first", "past"]
                )
                ends = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
                kept = [c for c in part.schema.names if c not in FOUND]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in kept), pa.array(found.counts.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), entries), pa.array(items, pa.list_(pa.string())),
                    ],
                    [*kept, *FOUND],
                )

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row the ``carried`` columns, n_words, the word ``spans`` that windows cover, and their ``items``.

    Spans are maximal, ``first`` to before ``past``, counted in words from 0; items are sorted strings.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    rows = docs.select(
        *carried, *(["text"] if "text" not in carried else []), *(F.lit(None).cast(kind).alias(c) for c, kind in FOUND.items())
    )
    schema = rows.schema
    block = F.pmod(F.xxhash64("name", "text"), F.lit(blocks))
    for k in range(blocks):
        part = [(r.name, r.text) for r in items.where(block == k).select("name", "text").distinct().toLocalIterator()]
        rows = rows.mapInArrow(_search(spark.sparkContext.broadcast(part)), schema)
    return rows.select(*carried, *FOUND)
