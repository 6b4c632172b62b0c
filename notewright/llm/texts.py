"""Texts of an Arrow batch as byte arrays: words, lines and windows without a Python loop per word.

A batch is cut into pieces of bounded size, so that what a task holds depends neither on the number
of rows in a batch nor on the partition; a single text is never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 1 << 20

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII other than letters and digits.
MARKS = np.zeros(256, bool)
MARKS[:128] = [not chr(c).isalnum() for c in range(128)]
#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Texts:
    """``data[offsets[i]:offsets[i + 1]]`` is text ``i`` in UTF-8; a null text is empty."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, contents: list[bytes]) -> Texts:
        ends = np.r_[0, np.cumsum([len(c) for c in contents])].astype(np.int64)
        return cls(np.frombuffer(b"".join(contents), np.uint8), ends)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many of a text's bytes are marked."""
        return span_sums(marks, self.offsets)


def span_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, dtype=np.int64, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def texts_of(column: pa.Array) -> Texts:
    if pa.types.is_large_string(column.type) or pa.types.is_string_view(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batch in row ranges of at most ``limit`` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + limit, "right")))
        part = batch.slice(first, last - first)
        yield part, texts_of(part.column(column))
        first = last


@dataclass
class Spans:
    """Byte ranges within Texts; ``firsts[i]:firsts[i + 1]`` are those of text ``i``."""

    texts: Texts
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.counts)

    def encoded(self) -> tuple[np.ndarray, list[bytes]]:
        """A code for each span, and the distinct contents by code."""
        if not len(self):
            return np.zeros(0, np.int64), []
        edges = np.empty(2 * len(self) + 1, np.int32)
        edges[0:-1:2], edges[1:-1:2], edges[-1] = self.starts, self.ends, self.ends[-1]
        data = np.ascontiguousarray(self.texts.data)
        both = pa.Array.from_buffers(pa.binary(), 2 * len(self), [None, pa.py_buffer(edges), pa.py_buffer(data)])
        coded = both.dictionary_encode()
        used, codes = np.unique(coded.indices.to_numpy()[::2], return_inverse=True)
        return codes, coded.dictionary.take(pa.array(used)).to_pylist()

    def hashes(self, change: Callable[[bytes], bytes] | None = None) -> np.ndarray:
        """A 64-bit hash of each span's content, the same in every process."""
        codes, contents = self.encoded()
        if change:
            contents = map(change, contents)
        known = np.fromiter(map(xxhash.xxh3_64_intdigest, contents), np.uint64)
        return known[codes] if len(codes) else known


def words(texts: Texts, separators: np.ndarray = BLANKS) -> Spans:
    """Maximal runs of bytes that are no separators, within each text."""
    inside = np.zeros(len(texts.data) + 2, bool)
    inside[1:-1] = ~separators[texts.data]
    # A text's first byte may start a word although the byte before, of another text, is no separator.
    edges = texts.offsets
    opens = inside[1:] & ~inside[:-1]
    opens[edges] |= inside[1:][edges]
    opens[-1] = False
    closes = inside[:-1] & ~inside[1:]
    closes[edges] |= inside[:-1][edges]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    return Spans(texts, starts, ends, np.searchsorted(starts, edges))


def lines(texts: Texts) -> Spans:
    """The pieces of each text between line feeds; an empty text has none."""
    breaks = np.flatnonzero(texts.data == 10)
    edges = texts.offsets
    filled = edges[:-1][np.diff(edges) > 0]
    starts = np.sort(np.concatenate([filled, breaks + 1]))
    ends = np.sort(np.concatenate([edges[1:][np.diff(edges) > 0], breaks]))
    # A line feed at the end of a text opens an empty last line, which sorts before the next text's first.
    return Spans(texts, starts, ends, np.concatenate([[0], np.cumsum(texts.per_text(texts.data == 10) + (np.diff(edges) > 0))]))


def windows(hashes: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which ``size`` consecutive values of one text start, and a hash of each run."""
    if len(hashes) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    held = len(hashes) - size + 1
    runs = np.zeros(held, np.uint64)
    for k in range(size):
        runs *= np.uint64(0x9E3779B97F4A7C15)
        runs += hashes[k : k + held]
    whole = np.ones(held, bool)
    for back in range(1, size):  # a run must not reach over the first position of a text
        at = firsts[1:-1] - back
        whole[at[(at >= 0) & (at < held)]] = False
    starts = np.flatnonzero(whole)
    return starts, mixed(runs[starts])


def covered(starts: np.ndarray, size: int | np.ndarray, total: int) -> np.ndarray:
    """Which of ``total`` positions lie in a run of ``size`` that begins at one of ``starts``."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change[:-1]) > 0
