"""Shards against a single-process computation, and their law, on small and awkward tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

from notewright.llm.sharding import interleaved_shards

SCHEMA = "doc_id long, text string, source string, size long, shard int"


def expected(rows, shards, seed="shard"):
    key = lambda i, c: hashlib.md5(f"{seed}:{'' if i is None else i}:{c}".encode()).hexdigest()
    groups = defaultdict(list)
    for doc_id, text, source, *_ in rows:
        crc = zlib.crc32((text or "").encode())
        groups["" if source is None else "s" + source].append((key(doc_id, crc), doc_id, crc, len((text or "").encode()) + 16))
    total, placed = len(rows), []
    for source, members in groups.items():
        u = int(hashlib.md5(f"{seed}:{source}".encode()).hexdigest()[:8], 16)
        for r, (k, *rest) in enumerate(sorted(members, key=lambda m: (m[0], m[1] is not None, m[1] or 0))):
            part = ((r << 32) + u) * total * 1024 // (len(members) << 32)
            placed.append(((part, source, k), rest))
    out = []
    for g, (_, (doc_id, crc, size)) in enumerate(sorted(placed, key=lambda p: p[0])):
        shard = g * shards // total
        out.append((doc_id, size, crc, shard, g - -(-shard * total // shards)))
    return Counter(out)


def actual(df):
    return Counter(tuple(r[c] for c in ("doc_id", "size", "text_crc32", "shard", "slot")) for r in df.collect())


def test_matches_single_process(spark):
    rows = [(i, f"text {i % 7} é" * (i % 5), None if i % 11 == 0 else f"s{min(i % 9, 3)}", 7, 9) for i in range(500)]
    rows += [(None, None, None, None, None), (3, "same", "s1", 1, 1), (3, "same", "s1", 1, 1)]
    df = interleaved_shards(spark.createDataFrame(rows, SCHEMA), 8)
    assert actual(df) == expected(rows, 8)
    sizes = Counter(r["shard"] for r in df.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8


def test_each_shard_has_the_mixture(spark):
    rows = [(i, str(i), "a" if i % 3 else f"b{i % 2}", 0, 0) for i in range(1200)]
    shards = defaultdict(Counter)
    for r in interleaved_shards(spark.createDataFrame(rows, SCHEMA), 10).collect():
        shards[r["shard"]][r["source"]] += 1
    assert {c["sa"] for c in shards.values()} <= {79, 80, 81}
    assert all(abs(c["sb0"] - 20) <= 1 and abs(c["sb1"] - 20) <= 1 for c in shards.values())


def test_single_row_sources_spread_and_empty_table(spark):
    rows = [(i, str(i), f"only{i}", 0, 0) for i in range(64)]
    assert actual(interleaved_shards(spark.createDataFrame(rows, SCHEMA), 4)) == expected(rows, 4)
    assert interleaved_shards(spark.createDataFrame([], SCHEMA), 4).collect() == []
