"""Removed bytes against a plain table of all windows, and suffix arrays against sorted suffixes."""

import hashlib
import random

import numpy as np
import pytest

from notewright.llm import passages
from notewright.llm.suffix_dedup import SCHEME, difference_cover_order, repeated_bytes
from notewright.llm.texts import Texts

SCHEMA = "doc_id long, text string, pack int, spans string"


def plain(rows, size=50):
    first = {}
    key = lambda i: float("inf") if i is None else i
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in data:
        for k in range(len(b) - size + 1):
            w = b[k : k + size]
            first[w] = min(first.get(w, float("inf")), key(i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < key(i):
                gone[k : k + size] = b"\1" * size
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    rows = df.collect()
    return sorted(((r.doc_id, r.n_bytes, sum(s.past - s.first for s in r.spans), len(r.spans), r.kept_sha256) for r in rows), key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    letters = "ab é\n" if seed % 2 else "abcdefgh ij"
    shared = ["".join(rng.choices(letters, k=rng.randint(30, 200))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choices(letters, k=rng.randint(0, 80))))
        rows.append((i, "".join(parts), 1, "x"))
    rows += [(n + i, rows[i][1][: -rng.randint(1, 9)] + "tail", 2, "") for i in range(20)]
    rows += [(500, None, 1, ""), (501, "", 1, ""), (502, "a" * 5000, 1, ""), (503, "b" + "a" * 300, 1, ""), (None, "z" + rows[3][1], 1, "")]
    rows += [(None, rows[3][1], 1, ""), (504, "x" * 49, 1, ""), (505, "x" * 49, 1, ""), (506, "y" * 50, 1, ""), (507, "y" * 50, 1, "")]
    return rows + [rows[7]] * 2


@pytest.mark.parametrize("seed,pack,hot", [(1, 2 << 20, 7), (2, 900, 7), (3, 900, 2), (4, 300, 1)])
def test_matches_all_windows(spark, monkeypatch, seed, pack, hot):
    monkeypatch.setattr(passages, "PACK_BYTES", pack)
    monkeypatch.setattr(passages, "HOT_LEVEL", hot)
    rows = corpus(seed)
    df = repeated_bytes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    expected = plain(rows)
    assert found(df) == expected
    assert sum(r[2] for r in expected) > 1000


def test_empty_table(spark):
    assert repeated_bytes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 8, 50, 333]:
        for letters in (1, 2, 30):
            t = rng.integers(1, letters + 1, n)
            assert difference_cover_order(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_suffix_arrays_of_wanted_places():
    rng = np.random.default_rng(2)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 8, 50, 333]:
        for letters in (1, 2, 30):
            t, wanted = rng.integers(1, letters + 1, n), rng.random(n) < 0.3
            whole = sorted(range(n), key=lambda i: t[i:].tolist())
            assert difference_cover_order(t, wanted).tolist() == [i for i in whole if wanted[i]]


def test_a_pack_of_bytes_is_as_large_as_one_of_words(spark):
    """Every pack sends a row to every shard, so smaller ones cost rows that grow with the square of the input."""
    rows = [(i, chr(97 + i % 26) * 50_000, 1, "") for i in range(36)]
    assert passages.packed(spark.createDataFrame(rows, SCHEMA).coalesce(1), SCHEME).count() == 1


def test_blocks_change_no_anchor(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 3000).astype(np.uint8)
    data[1000:1080] = data[2500:2580]
    whole = passages.anchors(data, 24, 50)
    monkeypatch.setattr(passages, "BLOCK", 100)
    least, hashes, seeds = passages.anchors(data, 24, 50)
    assert all((a == b).all() for a, b in zip(whole, (least, hashes, seeds)))
    order = seeds >> np.uint64(32)
    assert all(least[i] == i + np.argmin(order[i : i + 27]) for i in range(len(least)))
    assert (hashes[1000:1031] == hashes[2500:2531]).all() and len(np.unique(hashes)) == len(hashes) - 31


def test_runs_are_those_of_each_window():
    """Texts shorter than a window, empty ones and ends of texts included."""
    rng = np.random.default_rng(4)
    contents = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 49, 50, 0, 0, 3, 51, 400, 49, 1, 120, 0)]
    runs = passages.Runs(SCHEME, Texts.of(contents))
    starts = np.repeat(runs.first, runs.count) + np.concatenate([np.arange(c) for c in runs.count])
    offsets = np.cumsum([0] + [len(c) for c in contents])
    assert starts.tolist() == [offsets[i] + k for i, c in enumerate(contents) for k in range(len(c) - 49)]
    assert passages.Runs(SCHEME, Texts.of([b"", b"a" * 49])).first.tolist() == []
    assert passages.Runs(SCHEME, Texts.of([b"a" * 49, b"b" * 49])).first.tolist() == []
