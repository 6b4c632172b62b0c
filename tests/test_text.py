import unicodedata

import pytest

from pyspark.sql import functions as F

from notewright.functions import text as T


def col(use):
    return lambda name: use(F.col(name))


def test_trims_every_kind_of_white_space(column):
    assert column([" \t\u00a0a b\ufeff\r\n", "\u2003\u3000", "x"], col(T.trimmed)) == ["a b", "", "x"]


def test_squashes_runs_but_keeps_single_spaces(column):
    assert column(["a  b\tc \u00a0d", "a\nb", " x "], col(T.squash_spaces)) == ["a b\tc d", "a\nb", "x"]


def test_folds_accents_like_canonical_decomposition(column):
    letters = ["".join(map(chr, range(a, a + 64))) for a in range(0xA0, 0x530, 64)]

    def plain(text):
        return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not 0x300 <= ord(c) < 0x370)

    assert column(letters + ["\u0130stanbul"], col(T.fold_text)) == [plain(x) for x in letters] + ["istanbul"]


def test_tokens(column):
    texts = ["Marc\u00f4_Agenda-2!", "\u65e5\u672c \U0001f600", "", None]
    assert column(texts, col(T.tokens)) == [["marco", "agenda", "2"], [], [], None]


def test_token_runs(column):
    def run(n):
        return lambda name: T.token_runs(F.split(name, " "), F.lit(n))

    assert column(["a b c"], run(2)) == [["a b", "b c"]]
    assert column(["a b c"], run(4)) == [[]]


def test_small_rules(column):
    assert column(["a.test.TS", ".git", "x.", "a.b c"], col(T.strip_extension)) == ["a.test", "", "x.", "a.b c"]
    assert column(["\ufeffa\ufeff", "\ufeff\ufeffb"], col(T.strip_bom)) == ["a\ufeff", "\ufeffb"]
    assert column(["bug debug BUG"], lambda n: T.occurrences(F.lower(n), "bug")) == [3]


@pytest.mark.parametrize("start", [1, 3, 5, 9, 400])
def test_words_that_end_within_the_start_of_a_text(column, start):
    texts = ["", "ab", "abc def ghi", "café cafés İzmir", "́x", "  ", "abcd́́ e", "a\U0001f600bé c", "ΣΣ abΣ", None]
    whole, early = column(texts, T.tokens, "string"), column(texts, lambda c: T.tokens(c, start))
    for text, words, some in zip(texts, whole, early):
        if text is None:
            assert some is None
        else:
            assert some == words[: len(some)] and (len(text) > start or some == words)
            assert len(text) <= start or not some or len("".join(some)) < start
