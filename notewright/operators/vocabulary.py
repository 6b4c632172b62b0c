"""A project's vocabulary, and the test whether a text touches it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEPARATORS, evaluated, fold_text, phrase, split_words, tokens, trimmed
from ..functions.values import GENERIC_TERMS, LINK_SCHEME, MINIMUM_TERM_LENGTH
from ..session import durable

#: Counted bytes of rows that are broadcast; as a hash table keys take over three times as much, also in the driver.
BROADCAST_BYTES = 16 * 1024 * 1024
#: Bits of the filter over keys: sixteen for each at least, within these.
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 26


def _telling(term: Column) -> Column:
    return (F.length(term) >= MINIMUM_TERM_LENGTH) & ~term.isin(GENERIC_TERMS)


def term_parts(raw: Column, forced: bool = False) -> Column:
    """The folded name as a whole and its separate words, less short and generic ones.

    A forced name is kept whole whatever it is.
    """
    folded = trimmed(fold_text(raw))
    whole_counts = F.length(folded) > 0 if forced else _telling(folded)
    whole = F.when(whole_counts, F.array(folded)).otherwise(F.array().cast("array<string>"))
    return F.array_union(whole, F.filter(F.split(folded, SEPARATORS), _telling))


def union_terms(project_terms: DataFrame, names: DataFrame, manifests: DataFrame) -> DataFrame:
    """``(project_id, term)`` of all three sources, duplicates included.

    ``project_terms`` is ``(project_id, terms)``; the others are ``(project_id, name)``.
    """
    own = project_terms.select("project_id", F.explode("terms").alias("name")).select(
        "project_id", F.explode_outer(term_parts(F.col("name"), forced=True)).alias("term")
    )
    listed = names.unionByName(manifests).select(
        "project_id", F.explode_outer(term_parts(F.col("name"))).alias("term")
    )
    return own.unionByName(listed).where("term is not null")


def project_vocabulary(
    project_terms: DataFrame, names: DataFrame, manifests: DataFrame
) -> DataFrame:
    """Distinct ``(project_id, term)``."""
    return union_terms(project_terms, names, manifests).distinct()


def anchor_keys(vocabulary: DataFrame) -> DataFrame:
    """``(project_id, run, first, words)``: what must stand in a text for a term to be there.

    A plain word is its own run; a term of several words is their sequence. A single word with
    separators around it can only match through its bare form, which is a term of its own.
    """
    words = split_words(F.col("term"))
    plain = F.col("term").rlike(r"^[a-z0-9]+\z")
    return (
        vocabulary.where(plain | (F.size(words) > 1))
        .select("project_id", phrase(words).alias("run"), words[0].alias("first"), F.size(words).alias("words"))
        .distinct()
    )


def mentions_person(text: Column, scheme: str = LINK_SCHEME) -> Column:
    """A link to an identified person, in any case."""
    return F.contains(F.lower(text), F.lit(f"{scheme.lower()}://persons/"))


def _hash(text: Column, whole: bool) -> Column:
    """One hash of a term's first word, or of a whole run, and its project."""
    return F.xxhash64("project_id", text, F.lit(whole))


def _word(hashed: Column, words: int) -> Column:
    """The place of a hash's word in the filter; ``words`` is a power of two."""
    return hashed.bitwiseAND(F.lit(words - 1)).cast("int")


def _bits(hashed: Column) -> Column:
    """The four bits of a hash within its word; they lie above those that choose the word."""
    fours = [F.shiftright(hashed, 24 + 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(4)]
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("bigint"), n) for n in fours])


def key_filter(keys: DataFrame, words: int) -> DataFrame:
    """One row ``known``: a Bloom filter of ``words`` words over the runs, and the first words, of terms and their projects.

    As a subquery's value it goes to the tasks without being written out in the plan, of which the driver keeps many copies as text.
    """
    hashed = keys.select(F.explode(F.array(_hash(F.col("first"), False), _hash(F.col("run"), True))).alias("h"))
    held = hashed.select(_word(F.col("h"), words).alias("word"), _bits(F.col("h")).alias("bits"))
    none = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    filled = held.unionByName(none).repartitionByRange("word").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return filled.agg(F.transform(in_order, lambda w: w["bits"]).alias("known"))


def _may_be(hashed: Column, known: Column, words: int) -> Column:
    """False where no term has the hash."""
    return F.get(known, _word(hashed, words)).bitwiseAND(_bits(hashed)) == _bits(hashed)


def _runs_from(place: Column, words: Column, lengths: list[int]) -> Column:
    """The word runs that start at a place, of the lengths that terms have; null for those that the text is too short for."""

    def run(n: int) -> Column:
        fits = place + n <= F.size(words)
        return F.when(fits, F.get(words, place) if n == 1 else phrase(F.slice(words, place + 1, n)))

    return F.array(*map(run, lengths)).cast("array<string>")


def anchored(
    df: DataFrame, keys: DataFrame, ids: list[str], text: str, scheme: str = LINK_SCHEME
) -> DataFrame:
    """Rows whose text holds a term of its project's vocabulary and names no person.

    ``keys`` are the vocabulary's anchor keys, best checkpointed: they are measured first. ``ids``
    name a row within its project.

    Words become rows where they lie, and a Bloom filter over the terms drops most of them at once: a word that starts no term, then
    each short run that is none. What is left meets the terms in an equi join, by broadcast while the counted size of the
    keys allows it. Beyond that the texts are read a first time for the distinct runs that the filter lets through; those that are no
    terms, which are few, are kept and broadcast instead, and whatever else passes the filter is a term.
    A row's other columns ride on its first word alone; of all others only hits go on to the one
    exchange that follows and to its sort, so these hold a row's text once however many words pass the filter.
    """
    size = keys.agg(
        F.coalesce(F.sum(F.octet_length("run") * 2 + F.octet_length("project_id")), F.lit(0)).alias("bytes"),
        F.count("*").alias("n"),
        F.sort_array(F.collect_set("words")).alias("lengths"),
    ).first()
    words = min(max(1 << (16 * size["n"]).bit_length(), LEAST_BITS), MOST_BITS) // 64
    rest = [c for c in df.columns if c not in ("project_id", *ids)]
    spoken = evaluated(
        df.where(~mentions_person(F.col(text), scheme)).select("project_id", *ids, F.struct(*rest).alias("_row")),
        "_words", tokens(F.col(f"_row.{text}")),
    )
    known = key_filter(keys, words).scalar()
    at, may = F.col("_at"), _may_be(_hash(F.col("_word"), False), known, words)
    runs = F.when(may, _runs_from(at, F.col("_words"), size["lengths"]))
    first = (at == 0) & (F.coalesce("_nth", F.lit(0)) == 0)
    found = F.col("project_id").isNotNull() & _may_be(_hash(F.col("_run"), True), known, words)
    made = (
        spoken.select("project_id", *ids, "_row", "_words", F.posexplode("_words").alias("_at", "_word"))
        .where(may | (at == 0))
        .select("project_id", *ids, "_row", "_at", F.posexplode_outer(runs).alias("_nth", "_run"))
        .select("project_id", *ids, F.when(found, F.col("_run")).alias("run"), F.when(first, F.col("_row")).alias("_row"))
        .where(F.col("run").isNotNull() | F.col("_row").isNotNull())
    )
    if size["bytes"] <= BROADCAST_BYTES:
        met = made.join(F.broadcast(keys.select("project_id", "run", F.lit(True).alias("_hit"))), ["project_id", "run"], "left")
    else:
        met = _met_but(made, _no_terms(made, keys))
    return (
        met.where(F.col("_hit") | F.col("_row").isNotNull())
        .groupBy("project_id", *ids)
        .agg(F.any_value("_row", F.lit(True)).alias("_row"), F.bool_or("_hit").alias("_hit"))
        .where("_hit")
        .select("project_id", *ids, "_row.*")
    )


def _no_terms(made: DataFrame, keys: DataFrame) -> DataFrame:
    """The distinct runs that are no terms, kept."""
    found = made.where("run is not null").select("project_id", "run").distinct()
    return durable(found.join(keys, ["project_id", "run"], "left_anti"))


def _met_but(made: DataFrame, wrong: DataFrame) -> DataFrame:
    """``_hit`` of every run that is not ``wrong``, which is broadcast while its counted size allows it."""
    size = wrong.agg(F.coalesce(F.sum(F.octet_length("run") * 2 + F.octet_length("project_id")), F.lit(0)).alias("bytes")).first()
    wrong = wrong.withColumn("_wrong", F.lit(True))
    met = made.join(F.broadcast(wrong) if size["bytes"] <= BROADCAST_BYTES else wrong, ["project_id", "run"], "left")
    return met.withColumn("_hit", F.col("run").isNotNull() & F.col("_wrong").isNull()).drop("_wrong")
