"""Suffix-array dedup: bytes covered by a ``WINDOW``-byte string that starts in an earlier document too.

Suffixes are sorted by difference cover: those at two of every three places are named by their sorted
triples, the names are sorted by recursion where they repeat, the remaining third is sorted by its first
letter and the rank that follows, and both are merged. Adjacent suffixes with equal prefixes of
``WINDOW`` bytes then form the groups of equal strings, and the smallest doc_id of each is found.

The sort is spread over the cluster by ``passages``: strings that can be equal have an equal seed and are
dealt to one shard, every shard sorts the suffixes of its distinct strings, and a string that is in many
documents is sorted once. Windows whose seed occurs once anywhere can't repeat and are not sorted.

Cases: null and empty texts have no bytes; a null doc_id counts as larger than any other; rows of equal
doc_id are not earlier than each other; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .passages import Scheme, shared_windows
from .texts import Spans, Texts, covered

WINDOW = 50
SCHEME = Scheme(window=WINDOW, seed=24, by_word=False)
#: Positions of which adjacent prefixes are compared at once.
COMPARED = 1 << 16

RESULT = "doc_id long, n_bytes long, spans array<struct<first: int, past: int>>, kept_sha256 string"


def _width(largest: int) -> int:
    return max(1, int(largest).bit_length())


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of keys, and the keys in it.

    A key and its place share one number, as plain numbers are sorted many times faster than places by their keys.
    """
    low = np.uint64(_width(len(key)))
    packed = (key << low) | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    return (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int32), packed >> low


def _names(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The stable order of keys, the rank of every key among the distinct ones, from 0, and how many there are."""
    order, rising = _sorted(key)
    rank = np.zeros(len(key), np.int32)
    np.cumsum(rising[1:] != rising[:-1], dtype=np.int32, out=rank[1:])
    out = np.empty(len(key), np.int32)
    out[order] = rank
    return order, out, int(rank[-1]) + 1


def _keys(columns: list[np.ndarray], room: int) -> np.ndarray:
    """One number of at most ``room`` bits per row that orders rows as their columns do, first column first."""
    key, bits = None, 0
    for column in columns:
        own = _width(column.max(initial=0))
        if key is None:
            key, bits = column.astype(np.uint64), own
            continue
        if bits + own > room:
            _, names, distinct = _names(key)
            key, bits = names.astype(np.uint64), _width(distinct)
        key, bits = (key << np.uint64(own)) | column.astype(np.uint64), bits + own
    return key


def difference_cover_order(text: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffix array of numbers of 1 and more, or of ``wanted`` places alone; a suffix that ends sorts before what it is a prefix of."""
    order = _order([text], wanted)
    return order if wanted is None or len(text) >= 3 else order[wanted[order]]


def _order(held: list[np.ndarray], wanted: np.ndarray | None = None) -> np.ndarray:
    """``held`` has the text alone and gives it up, so that no level of the recursion keeps another's."""
    text = held.pop()
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int32)
    t = np.zeros(n + 4, np.int32)  # a shard is far below 2^31 letters
    t[:n] = text
    del text
    # Sampled places, those of remainder 1 before those of remainder 2; one more place at the end keeps
    # the triples of the first part apart from the second's.
    ones, twos, rests = len(range(1, n + (n % 3 == 1), 3)), len(range(2, n, 3)), len(range(0, n, 3))

    def thirds(of: np.ndarray, *places: tuple[int, int]) -> np.ndarray:
        return np.concatenate([of[first::3][:count] for first, count in places])

    order, rank_of, distinct = _names(_keys([thirds(t, (1 + k, ones), (2 + k, twos)) for k in range(3)], 64 - _width(ones + twos)))
    if distinct < ones + twos:
        lower = [rank_of + 1]
        del rank_of, order
        order = _order(lower)
        rank_of = np.empty(ones + twos, np.int32)
        rank_of[order] = np.arange(ones + twos, dtype=np.int32)
    rank = np.zeros(n + 4, np.int32)
    rank[1::3][:ones] = rank_of[:ones] + 1
    rank[2::3][:twos] = rank_of[ones:] + 1
    del rank_of
    # The remaining suffixes, by first letter and the rank behind it.
    rest = _sorted(_keys([t[::3][:rests], rank[1::3][:rests]], 64 - _width(rests)))[0]
    if wanted is not None:
        rest = rest[wanted[::3][rest]]
        order = order[thirds(np.r_[wanted, False, False], (1, ones), (2, twos))[order]]
    elif n % 3 == 1:
        order = order[order != ones - 1]
    own = order < ones
    first, second = order[own], order[~own] - ones
    place = 3 * order + np.where(own, 1, 2 - 3 * ones)
    del order, own
    # Merge: how many sampled suffixes of either remainder each of them follows.
    both = _keys([thirds(t, (1, ones), (0, rests)), thirds(rank, (2, ones), (1, rests))], 64)
    behind = np.searchsorted(both[:ones][first], both[ones:][rest])
    both = _keys([thirds(t, (2, twos), (0, rests)), thirds(t, (3, twos), (1, rests)), thirds(rank, (4, twos), (2, rests))], 64)
    behind += np.searchsorted(both[:twos][second], both[twos:][rest])
    del both
    behind += np.arange(len(rest))
    out = np.empty(len(place) + len(rest), np.int32)
    left = np.ones(len(out), bool)
    left[behind] = False
    out[behind] = 3 * rest
    out[left] = place
    return out


def earliest_owners(units: Spans, owner: np.ndarray, _: np.ndarray) -> np.ndarray:
    """For each window of the strings in order: the smallest owner of an equal window."""
    texts = units.texts
    lengths = np.diff(texts.offsets)
    # A separator after each string, so that no window reaches into the next.
    begins = texts.offsets[:-1] + np.arange(len(lengths))
    data = np.ones(len(texts.data) + len(lengths), np.int16)
    inside = np.ones(len(data), bool)
    inside[begins + lengths] = False
    data[inside] = texts.data
    data[inside] += 2
    del inside
    windows = lengths - WINDOW + 1
    total = int(windows.sum())
    index = np.full(len(data), -1, np.int32)  # of the window that starts at a place
    index[np.arange(total) + np.repeat(begins - np.cumsum(windows) + windows, windows)] = np.arange(total, dtype=np.int32)
    order = difference_cover_order(data, index >= 0)
    same = np.zeros(len(order), bool)
    letters = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    for k in range(1, len(order), COMPARED):
        prefixes = letters[order[k - 1 : k + COMPARED]]
        same[k : k + COMPARED] = (prefixes[1:] == prefixes[:-1]).all(axis=1)
    place = index[order]
    del order, index
    heads = np.flatnonzero(~same)
    found = np.repeat(owner, windows)[place]
    least = np.minimum.reduceat(found, heads) if len(heads) else found
    out = np.empty(total, np.int64)
    out[place] = np.repeat(least, np.diff(np.r_[heads, len(place)]))
    return out


def _gone(texts: Texts, ids: list, start: np.ndarray, doc: np.ndarray, owner: np.ndarray) -> np.ndarray:
    own = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
    return covered(start[owner < own[doc]], WINDOW, len(texts.data))


def _removed(texts: Texts, units: Spans, ids: list, start: np.ndarray, doc: np.ndarray, owner: np.ndarray, _: dict) -> pa.RecordBatch:
    gone = _gone(texts, ids, start, doc, owner)
    # A span opens after a byte that stays or at a text's first byte, and ends likewise.
    edge = np.ones(len(gone) + 1, bool)
    np.not_equal(gone[1:], gone[:-1], out=edge[1:-1])
    edge[texts.offsets] = True
    opens = np.flatnonzero(edge[:-1] & gone)
    ends = np.flatnonzero(edge[1:] & gone) + 1
    edges = np.searchsorted(opens, texts.offsets)
    begins = np.repeat(texts.offsets[:-1], np.diff(edges))
    kept = texts.data[~gone]
    stays = texts.offsets - np.r_[0, np.cumsum(gone)][texts.offsets]
    digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(stays[:-1].tolist(), stays[1:].tolist())]
    spans = pa.ListArray.from_arrays(
        pa.array(edges, pa.int32()),
        pa.StructArray.from_arrays([pa.array(opens - begins, pa.int32()), pa.array(ends - begins, pa.int32())], ["first", "past"]),
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(np.diff(texts.offsets)), spans, pa.array(digests, pa.string())],
        ["doc_id", "n_bytes", "spans", "kept_sha256"],
    )


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_bytes, the byte ``spans`` to remove (maximal, in order) and kept_sha256."""
    return shared_windows(docs, SCHEME, earliest_owners, _removed, RESULT)


def _left(texts: Texts, units: Spans, ids: list, start: np.ndarray, doc: np.ndarray, owner: np.ndarray, rest: dict) -> pa.RecordBatch:
    gone = _gone(texts, ids, start, doc, owner)
    left = [
        texts.data[a:b][~gone[a:b]].tobytes().decode(errors="ignore")
        for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist())
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), *rest.values(), pa.array(left, pa.string())], ["doc_id", *rest, "text"]
    )


def without_repeats(docs: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """doc_id, the ``carried`` columns and the text that is left of every row.

    A character of which only some bytes are removed is removed whole, so that the text is valid.
    """
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    schema = f"doc_id long, {kinds + ', ' if kinds else ''}text string"
    return shared_windows(docs, SCHEME, earliest_owners, _left, schema, carried)
