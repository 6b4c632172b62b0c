"""Ids and decoded texts against the tokenizers library."""

import random
import unicodedata

import public_tokenizers
from tokenizers import Tokenizer

from notewright.llm.bpe import KNOWN_CHARS, SCAN_PARTS, WordBpe, decode, encode

PATH = public_tokenizers.path("word_bpe_49k.json")
CASES = [
    None, "", "  \n", "Hello World's  don't 'sx ", "a<|endoftext|>B <|startoftext|><|endoftext|", "ΣΑΣ ΟΔΟΣ",
    "İstanbul ǅ ß", "a\x1cb\x1d\x85c d​e­f", "é Å", "x" * 3000 + " " + "ab" * 500 + "!?" * 400,
    "１２３ 4567 ½ ²", "😀😀 \U0001f1e6", "'re'VE 'LL", "힣 한국어 中文", "a\x00b", "ſ K Å ǆ", "Ɤ\U00010d50 \U00016ea0",
    "long text " * 20000,
]


def test_whole_texts_as_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    pool = [chr(c) for c in [*range(0x20, 0x600), *range(0x1E00, 0x2100), *range(0x3040, 0x3100)]]
    pool = [c for c in pool if unicodedata.category(c) != "Cn"]
    texts = CASES + ["".join(rng.choices(pool, k=60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("doc_id", "decoded")
    df = df.selectExpr("decoded as id", "text", "'x' as ids").repartition(3)
    rows = decode(encode(df, PATH), PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["text"] == texts[r["id"]]
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_both_ways_of_merging_agree():
    bpe = WordBpe(open(PATH, "rb").read())
    rng = random.Random(3)
    for size in [1, 2, 5, SCAN_PARTS, 90, 300] * 20:
        parts = rng.choices("abthein", k=size - 1) + ["e</w>"]
        assert bpe._scanned(parts) == bpe._queued(parts)


def test_words_are_cut_and_merged_once_a_table():
    bpe = WordBpe(open(PATH, "rb").read())
    found = []
    bpe.words = type("Counted", (), {"findall": lambda self, text, own=bpe.words: found.append(text) or own.findall(text)})()
    long = "ab1" * KNOWN_CHARS
    texts = ["It's done, done\x1c!\n" + long, None, "done, it's <|endoftext|> done,", "<|ENDOFTEXT|> " + "q" * (KNOWN_CHARS + 1)]
    ids, ends = bpe.encoded(texts)
    library = Tokenizer.from_file(PATH)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and ends.tolist() == [0, *(sum(map(len, want[: k + 1])) for k in range(4))]
    assert len(found) == 1 and found[0].split("\n").count("done,") == 1
    assert not any(isinstance(w, str) and len(w) > KNOWN_CHARS for w in bpe.known)
    assert bpe.encoded(["done, it's done,"] * 50)[0].tolist() == library.encode("done, it's done,").ids * 50
    assert len(found) == 1


def test_words_merged_in_tables_are_as_those_merged_alone():
    bpe = WordBpe(open(PATH, "rb").read())
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdethein'ö力!", k=rng.randint(1, 8))) for _ in range(500)] + ["a", "the"]
    ids, counts = bpe._tabled([w.encode() for w in words])
    assert ids.tolist() == [i for w in words for i in bpe.word_ids(w)]
    assert counts.tolist() == [len(bpe.word_ids(w)) for w in words]
    assert [a.tolist() for a in bpe._tabled([])] == [[], []]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert decode(encode(df, PATH), PATH).collect() == []
