"""Strict JSON on Spark's VARIANT type.

``try_parse_json`` reads the first value and ignores what follows it, so ``12 sessions`` would parse
as ``12``. The text is therefore parsed as the first element of an array whose second element is a
known guard; trailing text breaks the array or hides the guard. Of a key that an object repeats the
last value counts: Spark has a setting for that, which is turned on here, as results must not depend on
what a session was started with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

_GUARD = "␞end-of-value␞"


def guarded(text: Column) -> Column:
    """The text and the guard behind it, parsed; ``first_of`` takes the text's own value out.

    A text that does not close the bracket it opens with is no JSON value, and is known without the parser's exception, which costs
    far more than parsing.
    """
    SparkSession.active().conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    bare = F.btrim(text, F.lit(" \t\n\r"))
    closed = F.when(bare.startswith("{"), bare.endswith("}")).when(bare.startswith("["), bare.endswith("]")).otherwise(F.lit(True))
    return F.when(closed, F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_GUARD}"]'))))


def first_of(pair: Column) -> Column:
    whole = F.try_variant_get(pair, "$[1]", "string") == _GUARD
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))


def strict_json(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value, else null."""
    return first_of(guarded(text))


def variant_of(df: DataFrame, column: str) -> Column:
    """A payload column as VARIANT, parsed only when it is stored as text."""
    if isinstance(df.schema[column].dataType, VariantType):
        return F.col(column)
    return strict_json(F.col(column))


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("OBJECT"), F.lit(False))


def is_record(value: Column) -> Column:
    """Objects and arrays."""
    return F.coalesce(kind(value).rlike("^(OBJECT|ARRAY)"), F.lit(False))


def text_at(value: Column, path: str) -> Column:
    """The string at a path; null where it is missing or another type (5 is not '5')."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(kind(found) == "STRING", F.try_variant_get(value, path, "string"))


def number_at(value: Column, path: str) -> Column:
    found = F.try_variant_get(value, path, "variant")
    return F.when(
        kind(found).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"),
        F.try_variant_get(value, path, "double"),
    )


def elements_at(value: Column, path: str) -> Column:
    """The array at a path, else null."""
    return F.try_variant_get(value, path, "array<variant>")


def keys_at(value: Column, path: str) -> Column:
    """Keys of the object at a path, else null."""
    return F.map_keys(F.try_variant_get(value, path, "map<string,variant>"))
