"""Text rules shared by every operator: Unicode-wide trimming, accent folding, tokens and runs.

The rules follow ECMAScript's idea of white space and word edges, which differs from Java's, so
white space is always spelled out as a class and word edges as look-arounds on ASCII word characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: what counts as white space, and what ends a line besides it -------------------
_SPACE_POINTS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680]
_SPACE_POINTS += [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
_WIDE = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

SPACES = "".join(map(chr, _SPACE_POINTS))
WS = rf"\t\n\x0B\f\r {_WIDE}"  # for use inside [...]
# Java tests a class member by member for every character. Here the first, cheap half rejects
# ordinary letters, so a scan over a long text does not walk the whole list each time.
SPACE = rf"[\s\x{{A0}}-\x{{FFFF}}&&[\s{_WIDE}]]"
LINE_ENDS = ["\r", chr(0x2028), chr(0x2029)]
NOT_EOL = r"[^\n\r\x{2028}\x{2029}]"
WORD_START = "(?<![A-Za-z0-9_])"
WORD_END = "(?![A-Za-z0-9_])"
LINE_BREAK = "\r?\n"
SEPARATORS = "[^a-z0-9]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def left_trimmed(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def right_trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def squash_spaces(text: Column) -> Column:
    """Runs of two or more white-space characters become one space; the ends are trimmed."""
    return trimmed(F.regexp_replace(text, f"{SPACE}{SPACE}+", " "))


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, r"^\x{FEFF}", "")


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.[a-z0-9]+\z", "")


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Characters whose canonical decomposition, less its combining marks, is one other character.

    Characters that keep several characters after decomposition are left as they are: none of them
    yields an ASCII letter or digit, so tokens do not depend on them.
    """
    marks = {chr(c) for c in range(0x300, 0x370)}
    source, target = [], []
    for point in range(0x80, 0x10000):
        char = chr(point)
        if 0xD800 <= point <= 0xDFFF or char in marks:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFD", char) if c not in marks)
        if len(plain) == 1 and plain != char:
            source.append(char)
            target.append(plain)
    return "".join(source) + "".join(sorted(marks)), "".join(target)


def fold_text(text: Column) -> Column:
    """Lower case without accents. ASCII rows, found by byte length, skip the character map."""
    low = F.lower(text)
    source, target = _fold_table()
    return F.when(F.length(text) == F.octet_length(text), low).otherwise(
        F.translate(low, source, target)
    )


def split_words(folded: Column) -> Column:
    return F.array_remove(F.split(folded, SEPARATORS), "")


def tokens(text: Column, start: int | None = None) -> Column:
    """The words of a text; with ``start`` those that surely end within its first ``start`` characters."""
    if start is None:
        return split_words(fold_text(text))
    words = F.split(fold_text(F.substring(text, 1, start)), SEPARATORS)
    whole = F.length(text) <= start
    return F.array_remove(F.when(whole, words).otherwise(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))), "")


def phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def token_runs(words: Column, size: Column) -> Column:
    """Every contiguous run of ``size`` words, joined by single spaces."""
    last = F.size(words) - size
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last), lambda i: phrase(F.slice(words, i + F.lit(1), size))
        ),
    ).otherwise(F.array().cast("array<string>"))


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping count of a literal."""
    return (
        (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)
    ).cast("bigint")


def evaluated(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once per row.

    Catalyst moves filters below projections by copying the projected expression into each of them,
    which repeats a redaction chain for every test of its result. It does not move them below a
    generator, and a one-element outer ``explode`` is the cheapest one.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
