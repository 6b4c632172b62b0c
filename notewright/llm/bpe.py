"""BPE encoding and decoding with the vocabulary file of a public tokenizer.

A text is split at special tokens, normalised (NFC, lower case) and cut into words by the file's
pattern; a word's UTF-8 bytes are the first parts, the last one marked as the word's end.

Parts are merged in a contiguous rank array: the boundaries of a word's parts in one list, the ranks
of adjacent parts in another. The smallest rank is looked for, its boundary deleted and the ranks on
both sides refreshed, until no pair has a rank. The new words of a piece that have ``TABLE_PARTS`` parts
or fewer go through this together: a table has a row for each word of so many parts, a merge takes one
part from every row, and rows join a table as it becomes as narrow as they are. The scan is quadratic in
a word's parts, so words of more than ``SCAN_PARTS`` parts keep their ranks in a heap beside linked
boundaries; the merges, and so the ids, are the same.

Texts go through row by row, so nothing is shuffled. A task holds the vocabulary, which is sent once
as a broadcast of the file (refused above ``MAX_FILE_BYTES``), one piece of texts, and a table of
recent words that is emptied when full. As no word of the pattern ``CHUNKED`` holds white space, what
stands between white space is looked up in that table as a whole, and cut into words only if it is new.

Which characters are letters follows the ``regex`` package; code points that Unicode assigned after its
version 16 can be cut otherwise than by the library, which does not know them.

Cases: a null or empty text encodes to no ids and decodes to the empty text; characters that no part
covers cannot occur, as every byte is a part; repeated rows give repeated results; an empty table
gives an empty one; other columns are kept as they are, but ``ids`` or ``decoded`` is replaced.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import released

TABLE_PARTS = 24
SCAN_PARTS = 48
KNOWN_WORDS = 300_000
KNOWN_IDS = 8 * KNOWN_WORDS
#: Words longer than this are not remembered.
KNOWN_CHARS = 64
MAX_FILE_BYTES = 64 << 20
#: Texts encoded at once, in characters.
PIECE_CHARS = 1 << 20
NO_RANK = 1 << 60

#: The pattern of which every character but white space is in a word, and no word depends on what is around it.
CHUNKED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What ``str.split`` takes for white space though Unicode does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPACES = regex.compile(r"\p{White_Space}+")

#: Capital letters that Unicode added after the database of Python 3.13, and their lower case.
NEWER_CASE = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
    0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
_NEWER = regex.compile("[" + "".join(map(chr, NEWER_CASE)) + "]")


def byte_letters() -> list[str]:
    """The printable letter for each byte: itself where printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, content: bytes):
        file = json.loads(content)
        model = file["model"]
        if model["type"] != "BPE" or file["decoder"] is not None or file["post_processor"] is not None:
            raise ValueError("not a plain BPE vocabulary")
        self.end = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        # The same ranks by numbers: pairs in order, the rank of each and what it becomes.
        self.size = max(self.ids.values()) + 1
        keys = np.array([self.ids[a] * self.size + self.ids[b] for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pairs = np.r_[keys[order], np.iinfo(np.int64).max]
        self.pair_ranks = np.r_[np.fromiter(self.ranks.values(), np.int64)[order], NO_RANK]
        self.pair_ids = np.r_[np.array([self.ids[a + b] for a, b in self.ranks], np.int64)[order], 0]
        splits = [p for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        # White space in the pattern is Unicode's; the file's replacement of it by spaces changes no word.
        pattern = splits[0]["pattern"]["Regex"]
        self.chunked = pattern == CHUNKED
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}") + (r"|\n" if self.chunked else ""))
        longest = sorted(self.special, key=len, reverse=True)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.letters = byte_letters()
        self.inner = np.array([self.ids[c] for c in self.letters], np.int64)
        self.final = np.array([self.ids[c + self.end] for c in self.letters], np.int64)
        #: Entries of chunks, of words, and of special tokens by id.
        self.known: dict[str | int, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.long: set[str] = set()
        self.flat = array("i")
        self.begins = array("q", [0])
        if self.chunked:
            self.known["\n"] = self._add(np.zeros(0, np.int32), np.zeros(1, np.int64))[0]

    def merged(self, parts: list[str]) -> list[str]:
        return self._scanned(parts) if len(parts) <= SCAN_PARTS else self._queued(parts)

    def _scanned(self, parts: list[str]) -> list[str]:
        rank_of, size = self.ranks.get, len(parts)
        text = "".join(parts)
        bounds = [0]
        for p in parts:
            bounds.append(bounds[-1] + len(p))
        ranks = [rank_of((parts[i], parts[i + 1]), NO_RANK) for i in range(size - 1)]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            del bounds[i + 1], ranks[i]
            mid = text[bounds[i] : bounds[i + 1]]
            if i < len(ranks):
                ranks[i] = rank_of((mid, text[bounds[i + 1] : bounds[i + 2]]), NO_RANK)
            if i:
                ranks[i - 1] = rank_of((text[bounds[i - 1] : bounds[i]], mid), NO_RANK)
        return [text[a:b] for a, b in zip(bounds, bounds[1:])]

    def _queued(self, parts: list[str]) -> list[str]:
        rank_of, size = self.ranks.get, len(parts)
        parts = list(parts)
        left, right = list(range(-1, size - 1)), list(range(1, size + 1))
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(size - 1) if (r := rank_of((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = right[i]
            if parts[i] != a or j == size or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            right[i] = right[j]
            if right[j] < size:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < size and (r := rank_of((parts[x], parts[y]))) is not None:
                    heapq.heappush(queue, (r, x, parts[x], parts[y]))
        return [p for p in parts if p]

    def word_ids(self, word: str) -> list[int]:
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += self.end
        return [self.ids[p] for p in self.merged(parts)]

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs, and their places in the order of all."""
        keys = left * self.size + right
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], NO_RANK), at

    def _tabled(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of short words one after the other, and how many each has."""
        sizes = np.array([len(w) for w in raw], np.int64)
        data, begins = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes
        widest = int(sizes.max(initial=1))
        numbers, ids, ranks = (np.zeros(shape, np.int64) for shape in (0, (0, widest), (0, widest - 1)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for width in range(widest, 0, -1):
            own = np.flatnonzero(sizes == width)
            fresh = self.inner[data[begins[own, None] + np.arange(width)]]
            fresh[:, -1] = self.final[data[begins[own] + width - 1]]
            numbers = np.r_[numbers, own]
            ids = np.concatenate([ids, fresh])
            ranks = np.concatenate([ranks, self._found(fresh[:, :-1], fresh[:, 1:])[0]])
            merging = (ranks < NO_RANK).any(axis=1)
            done.append((numbers[~merging], ids[~merging]))
            numbers, ids, ranks = numbers[merging], ids[merging], ranks[merging]
            if not len(numbers):
                ids, ranks = ids.reshape(0, width - 1), ranks.reshape(0, max(0, width - 2))
                continue
            row, i = np.arange(len(numbers)), ranks.argmin(axis=1)
            merged = self.pair_ids[self._found(ids[row, i], ids[row, i + 1])[1]]
            rest = np.ones(ids.shape, bool)
            rest[row, i + 1] = False
            left = np.ones(ranks.shape, bool)
            left[row, i] = False
            ids, ranks = ids[rest].reshape(len(row), width - 1), ranks[left].reshape(len(row), width - 2)
            ids[row, i] = merged
            to = i < width - 2
            ranks[row[to], i[to]] = self._found(merged[to], ids[row[to], i[to] + 1])[0]
            to = i > 0
            ranks[row[to], i[to] - 1] = self._found(ids[row[to], i[to] - 1], merged[to])[0]
        counts = np.zeros(len(raw), np.int64)
        for own, table in done:
            counts[own] = table.shape[1]
        flat, first = np.zeros(counts.sum(), np.int32), np.cumsum(counts) - counts
        for own, table in done:
            flat[first[own, None] + np.arange(table.shape[1])] = table
        return flat, counts

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> range:
        """New entries of so many ids each."""
        first = len(self.begins) - 1
        self.begins.frombytes((len(self.flat) + np.cumsum(counts, dtype=np.int64)).tobytes())
        self.flat.frombytes(ids.astype(np.int32).tobytes())
        return range(first, first + len(counts))

    def _ids(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries one after the other, and where each one's begin."""
        begins = np.frombuffer(self.begins, np.int64)
        sizes = begins[entry + 1] - begins[entry]
        ends = np.r_[0, np.cumsum(sizes)]
        at = np.arange(ends[-1]) + np.repeat(begins[entry] - ends[:-1], sizes)
        return np.frombuffer(self.flat, np.int32)[at] if len(at) else np.zeros(0, np.int32), ends

    def _learn(self, new: set[str | int]) -> None:
        """Makes the entries of new chunks and of the new words in them; ``long`` are those to forget after the piece."""
        known = self.known
        special = [c for c in new if isinstance(c, int)]
        known.update(zip(special, self._add(np.array(special, np.int32), np.ones(len(special), np.int64))))
        chunks = [c for c in new if isinstance(c, str)]
        # No chunk has a line feed in it, which stands for the end of one.
        words = self.words.findall("\n".join([*chunks, ""])) if self.chunked else chunks
        fresh = list(set(words).difference(known))
        raw = [w.encode() for w in fresh]
        for w, r in zip(fresh, raw):
            if len(r) > TABLE_PARTS:
                known[w] = self._add(ids := np.array(self.word_ids(w)), np.array([len(ids)]))[0]
        short = [r for r in raw if len(r) <= TABLE_PARTS]
        known.update(zip([w for w, r in zip(fresh, raw) if len(r) <= TABLE_PARTS], self._add(*self._tabled(short))))
        self.long = {w for w in chain(fresh, chunks) if len(w) > KNOWN_CHARS}
        if not self.chunked:
            return
        entry = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        breaks = np.flatnonzero(entry == known["\n"])
        ids, ends = self._ids(entry)
        sizes = np.diff(ends[np.r_[0, breaks + 1]])
        several = np.diff(np.r_[-1, breaks]) > 2
        known.update(zip(compress(chunks, several), self._add(ids[np.repeat(several, sizes)], sizes[several])))

    def _plain(self, text: str) -> list[str]:
        # A final sigma is lower-cased like any other.
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if not text.isascii() and _NEWER.search(text):
            text = text.translate(NEWER_CASE)
        if not self.chunked:
            return self.words.findall(text)
        if any(s in text for s in SEPARATORS):
            return [c for c in _SPACES.split(text) if c]
        return text.split()

    def chunks(self, text: str) -> list[str | int]:
        """What lies between white space, in order, and the ids of special tokens."""
        if self.cuts is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[str | int] = []
        for k, piece in enumerate(self.cuts.split(text)):
            out += [self.special[piece]] if k % 2 else self._plain(piece)
        return out

    def encoded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's begin."""
        if len(self.begins) > KNOWN_WORDS or len(self.flat) > KNOWN_IDS:
            self._forget()
        chunks = [self.chunks(t) if t else [] for t in texts]
        every = list(chain.from_iterable(chunks))
        firsts = np.r_[0, np.cumsum([len(c) for c in chunks])].astype(np.int64)
        del chunks
        new = set(every).difference(self.known)
        if new:
            self._learn(new)
        ids, ends = self._ids(np.fromiter(map(self.known.__getitem__, every), np.int64, len(every)))
        for word in self.long:
            del self.known[word]
        self.long.clear()
        return ids, ends[firsts]


def token_texts(content: bytes) -> pa.Array:
    """The text of every id; null where the vocabulary file has none."""
    file = json.loads(content)
    tokens = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
    return pa.array([tokens.get(i) for i in range(max(tokens, default=-1) + 1)], pa.string())


def decoded_texts(tokens: pa.Array, ids: pa.ListArray) -> pa.Array:
    """The library's plain form without a decoder: token texts joined by spaces; null ids give the empty text."""
    if ids.null_count:
        ids = pc.fill_null(ids, pa.scalar([], ids.type))
    offsets = ids.offsets.to_numpy()
    texts = tokens.take(ids.values.slice(offsets[0], offsets[-1] - offsets[0]))
    if texts.null_count:
        raise KeyError("an id that the vocabulary does not have")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), texts), " ")


def _vocabulary(docs: DataFrame, path: str):
    with open(path, "rb") as file:
        content = file.read(MAX_FILE_BYTES + 1)
    if len(content) > MAX_FILE_BYTES:
        raise ValueError("the vocabulary file is too large to send to every executor")
    return docs.sparkSession.sparkContext.broadcast(content)


def _cut(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), values], [*names, name])


def _schema(docs: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in docs.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """``docs`` with ``ids``, an array of ints, for the whole text of every row."""
    sent = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or WordBpe(sent.value)
            sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            for part in _cut(batch, sizes, PIECE_CHARS):
                ids, ends = bpe.encoded(part.column(column).to_pylist())
                yield _with(part, "ids", pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)))

    return docs.mapInArrow(released(run), _schema(docs, "ids", T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of each row's ``ids``; null ids decode to the empty text."""
    sent = _vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            tokens = token_texts(sent.value) if tokens is None else tokens
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
            for part in _cut(batch, sizes, PIECE_CHARS):
                yield _with(part, "decoded", decoded_texts(tokens, part.column("ids")))

    return encoded.mapInArrow(released(run), _schema(encoded, "decoded", T.StringType()))
