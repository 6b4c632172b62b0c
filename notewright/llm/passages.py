"""Finding the passages that documents may share, and bringing the parts that may be equal together.

The units of a text are its bytes or its words. Two equal windows of ``window`` units have the same
smallest seed (a run of ``seed`` units, ordered by hash) at the same place. So each text is cut into
runs of consecutive windows with one smallest seed, and only runs whose seed occurs twice or more can
hold a window that does. Those runs, with all their units, are dealt to shards by seed; a shard's index
answers for each window; the answers go back and are laid over the texts.

Documents travel as packs of about ``PACK_BYTES``, compressed, as every pack sends a row to every shard. What a pack sends is unique within the
pack, so a seed, run or copy that a third of all documents hold costs one entry a pack. A seed of a level
above ``HOT_LEVEL`` may have any number of different surroundings; its windows are sent one by one and
dealt by their own content instead, so that one seed never fills one shard.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, shared_folder
from .texts import LOWER, Spans, Texts, mixed, pieces, words

PACK_BYTES = 2 << 20
#: Text for the seeds of one bucket, and for the strings of one shard, on average.
BUCKET_BYTES = 8 << 20
SHARD_BYTES = 8 << 20
#: Windows of bytes are many times more than those of words, so shards of bytes are smaller.
FEWER = 4
#: A shard's strings are indexed in this many parts, each of which stays near the processor.
PARTS = 4
#: Units that are hashed at once, for the same reason.
BLOCK = 1 << 15
#: A hash that occurs once is of level 0, one that n packs hold of as many as n has binary digits.
HOT_LEVEL = 14

PACK = "pack string, size long, doc_ids binary, known binary, ends binary, data binary, rest binary"
SEEDS = "bucket int, pack string, kinds long, tags binary, twice binary"
STATES = "pack string, bucket int, states binary"
STRINGS = "shard int, pack string, kinds long, numbers binary, size long, data binary"
ANSWERS = "pack string, shard int, size long, answers binary"


def squeezed(data: bytes | np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(np.ascontiguousarray(data).data if isinstance(data, np.ndarray) else data, asbytes=True)


def opened(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data, size, asbytes=True), np.uint8)


@dataclass(frozen=True)
class Scheme:
    """``by_word``: windows of words, else of bytes."""

    window: int
    seed: int
    by_word: bool
    lower: bool = False

    def canonical(self, texts: Texts) -> Texts:
        """The same units, A-Z lowered where that is asked for; words get one space after each."""
        if self.lower:
            texts = Texts(LOWER[texts.data], texts.offsets)
        if not self.by_word:
            return texts
        found = words(texts)
        sizes = found.ends - found.starts + 1
        ends = np.r_[0, np.cumsum(sizes)]
        data = np.full(ends[-1], 32, np.uint8)
        inside = np.ones(len(data), bool)
        inside[ends[1:] - 1] = False
        at = np.arange(len(data)) + np.repeat(found.starts - ends[:-1], sizes)
        data[inside] = texts.data[at[inside]]
        return Texts(data, ends[found.firsts])

    def units(self, texts: Texts) -> Spans:
        if self.by_word:
            return words(texts)
        at = np.arange(len(texts.data) + 1, dtype=np.int32)
        return Spans(texts, at[:-1], at[1:], texts.offsets)

    def values(self, found: Spans) -> np.ndarray:
        return _word_hashes(found) if self.by_word else BYTES[found.texts.data]


#: A random number for each byte.
BYTES = mixed(np.arange(1, 257))


def _word_hashes(found: Spans) -> np.ndarray:
    """A 64-bit hash of each word: the sum of a random number for each byte at its place, mixed again.

    Unlike ``Spans.hashes`` it builds no table of the distinct words, which takes most of a pack's time.
    """
    if not len(found):
        return np.zeros(0, np.uint64)
    sizes = found.ends - found.starts
    begins = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(begins, sizes)
    letters = found.texts.data[place + np.repeat(found.starts, sizes)]
    return mixed(np.add.reduceat(mixed((place << 8) + letters + 1), begins))


def rolled(values: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size a hash of that many consecutive values, from sums over powers of two of them.

    Values must be random; the hashes are sums of them with odd factors and so as random.
    """
    out: list = [None] * len(sizes)
    done = [0] * len(sizes)
    power, width = values, 1
    while width <= max(sizes):
        for k, size in enumerate(sizes):
            if size & width:
                if out[k] is None:
                    out[k] = power
                else:
                    n = max(0, min(len(out[k]), len(power) - done[k]))
                    out[k] = out[k][:n] * np.uint64(0x9E3779B97F4A7C15 ^ (width << 1)) + power[done[k] : done[k] + n]
                done[k] += width
        factor = np.uint64(0xD1B54A32D192ED03 ^ (width << 7))
        power = power[:-width] * factor + power[width:] if len(power) > width else power[:0]
        width *= 2
    return [o[: max(0, len(values) - size + 1)] for o, size in zip(out, sizes)]


_FACTOR = 0xD1B54A32D192ED03


def _powers(factor: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(2 * BLOCK, factor, np.uint64)])


_RISING, _FALLING = _powers(_FACTOR), _powers(pow(_FACTOR, -1, 1 << 64))


def anchors(values: np.ndarray, seed: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window the place of its smallest seed and a hash of its units, and for each place a hash of the seed there.

    A hash is a difference of running sums of the units' numbers times powers of an odd factor, brought back to power 0. The sum
    starts anew in each block of ``BLOCK`` windows, which changes no hash. ``window`` is ``BLOCK`` at most; bytes are looked up here.
    """
    held = len(values) - window + 1
    least, hashes, seeds = np.empty(held, np.int32), np.empty(held, np.uint64), np.empty(len(values) - seed + 1, np.uint64)
    for first in range(0, held, BLOCK):
        own = values[first : first + BLOCK + window - 1]
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((BYTES[own] if own.dtype == np.uint8 else own) * _RISING[: len(own)], out=total[1:])
        here = (total[seed:] - total[:-seed]) * _FALLING[: len(own) - seed + 1]
        seeds[first : first + len(here)] = here
        whole = len(own) - window + 1
        hashes[first : first + whole] = (total[window:] - total[:-window]) * _FALLING[:whole]
        keys = (here & np.uint64(0xFFFFFFFF00000000)) | np.arange(first, first + len(here), dtype=np.uint64)
        least[first : first + whole] = sliding_least(keys, window - seed + 1) & np.uint64(0xFFFFFFFF)
    return least, hashes, seeds


def sliding_least(keys: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while 2 * width <= size:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    return np.minimum(keys[: len(keys) - (size - width)], keys[size - width :]) if size > width else keys


Tags = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def tagged(hashes: np.ndarray, buckets: int) -> Tags:
    """Distinct hashes as (bucket, 32-bit tag) in order; whether each occurs twice; each hash's place in it.

    Bucket and tag together stand for the hash; two hashes that agree in both only cost needless work.
    """
    keys = ((hashes >> np.uint64(40)) % np.uint64(buckets) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
    distinct, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    return (distinct >> np.uint64(32)).astype(np.int64), distinct.astype(np.uint32), times > 1, place


def squeezed_order(tags: np.ndarray) -> bytes:
    """Rising 32-bit numbers: their steps, all lowest bytes first, which compresses the rest."""
    steps = np.diff(tags, prepend=np.uint32(0)).astype("<u4")
    return squeezed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T))


def opened_order(data: bytes, count: int) -> np.ndarray:
    steps = np.ascontiguousarray(opened(data, 4 * count).reshape(4, -1).T).view("<u4").reshape(-1)
    return np.cumsum(steps, dtype=np.uint64)


class Runs:
    """The runs of windows of one pack: first window, number of windows, seed; and hashes of windows."""

    def __init__(self, scheme: Scheme, texts: Texts):
        self.scheme, self.texts = scheme, texts
        self.units = scheme.units(texts)
        n, firsts = len(self.units), self.units.firsts
        empty = np.zeros(0, np.int64)
        self.first, self.count, self.seed, self.hashes = empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
        if n < scheme.window:
            return
        least, hashes, seeds = anchors(scheme.values(self.units) if scheme.by_word else texts.data, scheme.seed, scheme.window)
        # A run also ends where its text's windows do; windows that reach into the next text are left out.
        new = np.empty(len(least) + 1, bool)
        new[0] = True
        np.not_equal(least[1:], least[:-1], out=new[1:-1])
        new[np.minimum(firsts, len(least))] = True
        new[np.clip(firsts[1:] - scheme.window + 1, firsts[:-1], len(least))] = True
        head = np.flatnonzero(new[:-1])
        count = np.diff(np.r_[head, len(least)])
        whole = head + scheme.window <= firsts[np.searchsorted(firsts, head, "right")]
        self.first, self.count = head[whole], count[whole]
        self.seed = mixed(seeds[least[self.first]])
        self.hashes = hashes

    def tags(self, buckets: int) -> Tags:
        return tagged(self.seed, buckets)

    def strings(self, state: np.ndarray, shards: int) -> "Strings":
        """The distinct strings to ask about, given the level of each run's seed."""
        runs, hot = np.flatnonzero((state > 0) & (state <= HOT_LEVEL)), np.flatnonzero(state > HOT_LEVEL)
        sizes = self.count[hot]
        single = np.repeat(self.first[hot] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        first = np.concatenate([self.first[runs], single])
        count = np.concatenate([self.count[runs], np.ones(len(single), np.int64)])
        # The first and the last window of a string cover all of it.
        head, tail = self.hashes[first], self.hashes[first + count - 1]
        dealt = np.concatenate([mixed(self.seed[runs] + np.uint64(1)), mixed(self.hashes[single])])
        part = (dealt % np.uint64(shards * PARTS)).astype(np.int64)
        order = np.lexsort((count, tail, head, part))
        same = np.zeros(len(order), bool)
        if len(order) > 1:
            a, b = order[1:], order[:-1]
            same[1:] = (head[a] == head[b]) & (tail[a] == tail[b]) & (count[a] == count[b]) & (part[a] == part[b])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(~same) - 1
        return Strings(self, first, count, part, place, order[~same])


class Strings:
    """Occurrences ``first``, ``count`` with their ``place`` among the distinct strings ``kinds``.

    Part ``PARTS * shard + k`` is the shard's part ``k``; distinct strings come by part.
    """

    def __init__(self, runs: Runs, first, count, part, place, kinds):
        self.runs, self.first, self.count, self.part, self.place, self.kinds = runs, first, count, part, place, kinds

    def by_shard(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The shard, its distinct strings, and how many are in each of its parts."""
        parts = self.part[self.kinds]
        for shard in np.unique(parts // PARTS).tolist():
            edges = np.searchsorted(parts, np.arange(shard * PARTS, (shard + 1) * PARTS + 1))
            yield shard, np.arange(edges[0], edges[-1]), np.diff(edges)

    def texts(self) -> np.ndarray:
        """The text that each occurrence is in."""
        return np.searchsorted(self.runs.units.firsts, self.first, "right") - 1

    def contents(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths in bytes, and the bytes, of some distinct strings."""
        units, size = self.runs.units, self.runs.scheme.window
        at = self.kinds[of]
        start, end = units.starts[self.first[at]], units.ends[self.first[at] + self.count[at] + size - 2]
        lengths = end - start
        begins = np.cumsum(lengths) - lengths
        return lengths, self.runs.texts.data[np.arange(lengths.sum()) + np.repeat(start - begins, lengths)]


def packed(docs: DataFrame, scheme: Scheme, carried: tuple[str, ...] = ()) -> DataFrame:
    """The packs of all rows, written once to the shared folder so that they stay what they are.

    Columns ``carried`` travel along in ``rest``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, limit=PACK_BYTES):
                texts = scheme.canonical(texts)
                ids = part.column("doc_id")
                row = (
                    os.urandom(12).hex(), len(texts.data), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
                    ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
                    texts.offsets.astype(np.int64).tobytes(), squeezed(texts.data), _as_stream(part.select(list(carried))),
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v]) for v in row], ["pack", "size", "doc_ids", "known", "ends", "data", "rest"]
                )

    folder = f"{shared_folder(docs.sparkSession)}/packs-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long"), "text", *carried)
    rows.mapInArrow(run, PACK).write.option("compression", "none").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _as_stream(batch: pa.RecordBatch) -> bytes:
    if not batch.num_columns:
        return b""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def carried_columns(rest: bytes) -> dict[str, pa.Array]:
    if not rest:
        return {}
    found = pa.ipc.open_stream(rest).read_all().combine_chunks()
    return {name: found.column(name).combine_chunks() for name in found.column_names}


def pack_texts(row: dict) -> Texts:
    return Texts(opened(row["data"], row["size"]), np.frombuffer(row["ends"], np.int64))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names)], [n for n, _ in names])


def tag_rows(pack: str, tags: Tags, buckets: int) -> pa.RecordBatch:
    """A row a bucket: the tags of the distinct hashes, and for each whether it occurs twice."""
    bucket, tag, twice, _ = tags
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(edges)).tolist():
        own = slice(edges[b], edges[b + 1])
        out.append((b, pack, own.stop - own.start, squeezed_order(tag[own]), np.packbits(twice[own]).tobytes()))
    return batch_of(out, SEEDS)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = list(rows_of(batches))
    if not rows:
        return
    sizes = np.array([r["kinds"] for r in rows])
    keys = np.concatenate([opened_order(r.pop("tags"), r["kinds"]) | np.uint64(r["bucket"] << 32) for r in rows])
    distinct, place, packs = np.unique(keys, return_inverse=True, return_counts=True)
    level = np.where(packs > 1, np.frexp(packs.astype(float))[1], 0).astype(np.uint8)
    twice = np.concatenate([np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=r["kinds"]) for r in rows])
    own = place[twice == 1]
    level[own] = np.maximum(level[own], 1)
    level = level[place]
    ends = np.r_[0, np.cumsum(sizes)]
    for k in range(0, len(rows), 500):
        part = range(k, min(k + 500, len(rows)))
        yield batch_of([(rows[i]["pack"], rows[i]["bucket"], squeezed(level[ends[i] : ends[i + 1]])) for i in part], STATES)


def states_of(tags: Tags, states: list[dict], buckets: int) -> np.ndarray:
    """The level of every hash, 0 where it occurs once anywhere."""
    bucket, _, _, place = tags
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    state = np.zeros(len(bucket), np.uint8)
    for s in states or []:
        own = slice(edges[s["bucket"]], edges[s["bucket"] + 1])
        state[own] = opened(s["states"], own.stop - own.start)
    return state[place]


def judged(tags: DataFrame, buckets: int) -> DataFrame:
    """Per pack the states of its hashes, from the rows of ``tag_rows`` of all packs."""
    return kept(
        tags.repartition(buckets, "bucket").mapInArrow(_judge, STATES)
        .groupBy("pack").agg(F.collect_list(F.struct("bucket", "states")).alias("states"))
    )


def bucket_counts(packs: DataFrame, scheme: Scheme) -> tuple[int, int]:
    """How many buckets of seeds and how many shards of strings."""
    total = packs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    least = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tuple(max(least, -(-total // size)) for size in (BUCKET_BYTES, SHARD_BYTES // (1 if scheme.by_word else FEWER)))


def _send_seeds(scheme: Scheme, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield tag_rows(row["pack"], Runs(scheme, pack_texts(row)).tags(buckets), buckets)

    return run


def _send_strings(scheme: Scheme, buckets: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            texts = pack_texts(row)
            runs = Runs(scheme, texts)
            strings = runs.strings(states_of(runs.tags(buckets), row["states"], buckets), shards)
            ids = np.frombuffer(row["doc_ids"], np.int64).copy()
            ids[np.frombuffer(row["known"], np.uint8) == 0] = np.iinfo(np.int64).max
            doc = strings.texts()
            owner = np.full(len(strings.kinds), np.iinfo(np.int64).max)
            np.minimum.at(owner, strings.place, ids[doc])
            times = np.bincount(strings.place, minlength=len(strings.kinds))
            out = []
            for shard, of, parts in strings.by_shard():
                lengths, data = strings.contents(of)
                numbers = np.concatenate([owner[of], times[of], lengths, parts]).astype(np.int64)
                out.append((shard, row["pack"], len(of), squeezed(numbers), len(data), squeezed(data)))
            yield batch_of(out, STRINGS)

    return run


#: Asked of an index: the distinct strings' units, the smallest owner and the count of each, and gives
#: an answer of one number for each window in order.
Answer = Callable[[Spans, np.ndarray, np.ndarray], np.ndarray]


def _answered(scheme: Scheme, answer: Answer, numbers: list[np.ndarray], contents: list[np.ndarray]) -> list[np.ndarray]:
    """The answers to what each pack sent to one part: the strings' owners, counts and lengths, and their bytes."""
    owners, times, lengths = np.concatenate(numbers, axis=1)
    # What several packs hold is one string of the index.
    data = np.concatenate(contents)
    ends = np.r_[0, np.cumsum(lengths)]
    arrays = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    code = arrays.indices.to_numpy().astype(np.int64)
    distinct = arrays.dictionary
    owner = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(owner, code, owners)
    count = np.bincount(code, weights=times, minlength=len(distinct)).astype(np.int64)
    offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    units = scheme.units(Texts(np.frombuffer(distinct.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]))
    found = answer(units, owner, count)
    windows = np.r_[0, np.cumsum(units.counts - scheme.window + 1)]
    out, first = [], 0
    for own in numbers:
        codes = code[first : first + own.shape[1]]
        first += own.shape[1]
        sizes = windows[codes + 1] - windows[codes]
        at = np.arange(sizes.sum()) + np.repeat(windows[codes] - np.cumsum(sizes) + sizes, sizes)
        out.append(found[at].astype(np.int64))
    return out


def _answer(scheme: Scheme, answer: Answer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(rows_of(batches))
        if not rows:
            return
        numbers, contents, edges = [], [], []
        for r in rows:
            own = opened(r.pop("numbers"), 8 * (3 * r["kinds"] + PARTS)).view(np.int64)
            numbers.append(own[:-PARTS].reshape(3, -1))
            contents.append(opened(r.pop("data"), r["size"]))
            strings = np.r_[0, np.cumsum(own[-PARTS:])]
            edges.append((strings, np.r_[0, np.cumsum(numbers[-1][2])][strings]))
        answers = [[] for _ in rows]
        for k in range(PARTS):
            asking = [i for i, (strings, _) in enumerate(edges) if strings[k + 1] > strings[k]]
            if not asking:
                continue
            got = _answered(
                scheme, answer, [numbers[i][:, edges[i][0][k] : edges[i][0][k + 1]] for i in asking],
                [contents[i][edges[i][1][k] : edges[i][1][k + 1]] for i in asking],
            )
            for i, own in zip(asking, got):
                answers[i].append(own)
        del numbers, contents
        out = []
        for r, parts in zip(rows, answers):
            found = np.concatenate(parts)
            parts.clear()
            out.append((r["pack"], r["shard"], len(found) * 8, squeezed(found)))
            if len(out) == 200:
                yield batch_of(out, ANSWERS)
                out = []
        yield batch_of(out, ANSWERS)

    return run


#: Gives the result of a pack from its texts, units, ids (None: unknown), for each asked window its first
#: unit, the index of its text and the answer; and from the carried columns.
Finish = Callable[[Texts, Spans, list, np.ndarray, np.ndarray, np.ndarray, dict[str, pa.Array]], pa.RecordBatch]


def _finish(scheme: Scheme, buckets: int, shards: int, finish: Finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            texts = pack_texts(row)
            runs = Runs(scheme, texts)
            strings = runs.strings(states_of(runs.tags(buckets), row["states"], buckets), shards)
            answers = {a["shard"]: a for a in row["answers"] or []}
            sizes = strings.count[strings.kinds]
            begins = np.r_[0, np.cumsum(sizes)]
            answer = np.zeros(begins[-1], np.int64)
            for shard, of, _ in strings.by_shard():
                a = answers[shard]
                answer[begins[of[0]] : begins[of[-1] + 1]] = opened(a["answers"], a["size"]).view(np.int64)
            own = sizes[strings.place]
            step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            start = np.repeat(strings.first, own) + step
            got = answer[np.repeat(begins[strings.place], own) + step]
            doc = np.repeat(strings.texts(), own)
            ids, known = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["known"], np.uint8)
            yield finish(texts, runs.units, [i if k else None for i, k in zip(ids.tolist(), known)], start, doc, got, carried_columns(row["rest"]))

    return run


def shared_windows(
    docs: DataFrame, scheme: Scheme, answer: Answer, finish: Finish, schema: str, carried: tuple[str, ...] = ()
) -> DataFrame:
    """What ``finish`` makes of every pack once ``answer`` has been asked about its possibly shared windows."""
    packs = packed(docs, scheme, carried)
    buckets, shards = bucket_counts(packs, scheme)
    asked = packs.join(judged(packs.mapInArrow(_send_seeds(scheme, buckets), SEEDS), buckets), "pack", "left")
    strings = asked.mapInArrow(_send_strings(scheme, buckets, shards), STRINGS)
    answers = (
        strings.repartition(shards, "shard").mapInArrow(_answer(scheme, answer), ANSWERS)
        .groupBy("pack").agg(F.collect_list(F.struct("shard", "size", "answers")).alias("answers"))
    )
    return asked.join(answers, "pack", "left").mapInArrow(_finish(scheme, buckets, shards, finish), schema)
