"""Substring dedup: words covered by a window of ``WINDOW`` words that starts anywhere else too.

Every shard holds an FM-index of its strings: the last column of the sorted rotations in a wavelet tree,
whose levels are bit vectors with counts at fixed steps, and the running weight of the suffixes, as a
string may stand for many copies. For each end of a window, backward search goes left while the matched
words weigh two or more; its length is the matching statistic there. A window is reported where that
reaches ``WINDOW``. Many ends are searched side by side.

``passages`` deals the strings: equal windows have an equal seed and meet in one shard.

Cases: null and empty texts have no words; a window repeated within one text counts; repeated rows remove
each other's words; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .passages import Scheme, shared_windows
from .suffix_dedup import difference_cover_order
from .texts import Spans, Texts, covered

WINDOW = 35
SCHEME = Scheme(window=WINDOW, seed=20, by_word=True)
#: Ends searched side by side.
SEARCHED = 1 << 18
#: Searches from one string's ends that go on beyond a window.
LONG_SEARCHES = 4

RESULT = "doc_id long, n_words long, spans array<struct<first: int, past: int>>, kept_sha256 string"


class BitVector:
    """Bits in bytes, with the number of ones before every eighth byte."""

    STEP = 8

    def __init__(self, bits: np.ndarray):
        self.bytes = np.r_[np.packbits(bits, bitorder="little"), np.zeros(self.STEP + 1, np.uint8)]
        self.bytes = self.bytes[: len(self.bytes) // self.STEP * self.STEP]
        self.words = self.bytes.view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = np.zeros(len(self.words) + 1, np.uint32)
        np.cumsum(counts, out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low).astype(np.int64)


class WaveletTree:
    """How often a letter occurs among the first letters of a sequence; a level for each bit of letters."""

    def __init__(self, letters: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            own = (letters >> bit) & 1
            self.levels.append((bit, BitVector(own), int(len(own) - own.sum())))
            letters = np.concatenate([letters[own == 0], letters[own == 1]])
        # In the last order equal letters stand together: where each one's begin.
        heads = np.flatnonzero(np.r_[True, letters[1:] != letters[:-1]])
        self.begins = np.zeros(1 << bits, np.int64)
        self.begins[letters[heads]] = heads

    def rank(self, letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, vector, zeros in self.levels:
            ones = vector.ones(at)
            at = np.where((letter >> bit) & 1, zeros + ones, at - ones)
        return at - self.begins[letter]


class FmIndex:
    """Of a text of letters from 1 on, with a weight for each place; letter 0 is kept for the end."""

    def __init__(self, text: np.ndarray, weights: np.ndarray):
        n = len(text)
        order = np.r_[np.int64(n), difference_cover_order(text)]
        last = np.r_[text, 0][order - 1]
        top = int(text.max(initial=0))
        self.tree = WaveletTree(last, max(1, top.bit_length()))
        self.begins = np.r_[0, np.cumsum(np.bincount(last, minlength=top + 1))]
        self.weight = np.zeros(n + 2, np.int64)
        np.cumsum(np.r_[weights, 0][order], out=self.weight[1:])

    def matching(self, text: np.ndarray, ends: np.ndarray, limit: int | np.ndarray, least: int) -> np.ndarray:
        """How many letters up to and with each end, ``limit`` at most, match places of weight ``least`` or more."""
        length = np.zeros(len(ends), np.int64)
        most = np.broadcast_to(limit, ends.shape)
        live = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.weight) - 1)
        for step in range(most.max(initial=0)):
            letter = text[ends[live] - step]
            low = self.begins[letter] + self.tree.rank(letter, low)
            high = self.begins[letter] + self.tree.rank(letter, high)
            go = self.weight[high] - self.weight[low] >= least
            length[live[go]] = step + 1
            go &= most[live] > step + 1
            live, low, high = live[go], low[go], high[go]
            if not len(live):
                break
        return length


def repeated_windows(units: Spans, _: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each window of the strings in order: 1 where it occurs twice or more."""
    codes, _contents = units.encoded()
    firsts, sizes = units.firsts, units.counts
    # Letter 1 stands between strings; weights are those of the string a place is in.
    of = np.repeat(np.arange(len(sizes)), sizes)
    text = np.ones(len(codes) + len(sizes), np.int64)
    places = np.arange(len(codes)) + of
    text[places] = codes + 2
    weights = np.repeat(count, sizes + 1)
    index = FmIndex(text, weights)
    windows = sizes - WINDOW + 1
    begins = firsts[:-1] + np.arange(len(sizes))

    def matched(ends: np.ndarray, limit: np.ndarray) -> np.ndarray:
        parts = [index.matching(text, ends[k : k + SEARCHED], limit[k : k + SEARCHED], 2) for k in range(0, len(ends), SEARCHED)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    # A match of any length holds all windows inside it, so a search from a string's end goes on to its start, and the next one
    # from the end of the first window to the left that the match does not hold.
    heads = np.cumsum(windows) - windows
    out = np.zeros(windows.sum() + 1, np.int64)  # steps: 1 where windows that occur twice begin, -1 behind them
    left = windows.copy()  # windows of each string that are not known yet, its first ones
    live = np.flatnonzero(left)
    for _round in range(LONG_SEARCHES):
        length = matched(begins[live] + left[live] + WINDOW - 2, left[live] + WINDOW - 1)
        held = np.maximum(length - WINDOW + 1, 0)
        np.add.at(out, heads[live] + left[live] - held, 1)
        np.add.at(out, heads[live] + left[live], -1)
        left[live] -= np.maximum(held, 1)
        live = live[left[live] > 0]
    found = np.cumsum(out[:-1])
    # What is still left has few matches: every window by itself.
    own = left[live]
    step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    ends = np.repeat(begins[live], own) + step + WINDOW - 1
    found[np.repeat(heads[live], own) + step] = matched(ends, np.full(len(ends), WINDOW)) >= WINDOW
    return found


def _removed(texts: Texts, units: Spans, ids: list, start: np.ndarray, doc: np.ndarray, answer: np.ndarray, _: dict) -> pa.RecordBatch:
    gone = covered(start[answer > 0], WINDOW, len(units))
    spans, digests = [], []
    for i in range(len(texts)):
        a, b = units.firsts[i], units.firsts[i + 1]
        own = gone[a:b]
        edge = np.flatnonzero(np.diff(np.r_[False, own, False]))
        spans.append([{"first": f, "past": p} for f, p in edge.reshape(-1, 2).tolist()])
        if not len(edge):
            rest = texts.text(i)[:-1]
        else:  # words and the space after each
            rest = texts.data[texts.offsets[i] : texts.offsets[i + 1]][np.repeat(~own, units.ends[a:b] - units.starts[a:b] + 1)].tobytes()[:-1]
        digests.append(hashlib.sha256(rest).hexdigest())
    kind = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(units.counts.astype(np.int64)), pa.array(spans, kind), pa.array(digests)],
        ["doc_id", "n_words", "spans", "kept_sha256"],
    )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_words, the word ``spans`` to remove (maximal, in order) and kept_sha256."""
    return shared_windows(docs, SCHEME, repeated_windows, _removed, RESULT)
