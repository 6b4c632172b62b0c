"""License scans: the license of every file, from its own words or from the nearest directory above.

Texts are compared with templates by the cosine of sparse TF-IDF vectors. What is compared of a file:

* its header, the lines that speak of a license together, with one-line notices (``TEMPLATES``); document
  frequencies are counted over the distinct headers and the notices;
* every such line, every paragraph and every block of comment lines that holds one, with whole licenses
  and the usual file headers (``license_forms``), and lines with the notices too; document frequencies
  are those of these forms, and a term's frequency in a text counts by its logarithm;
* the whole text of a license file, likewise.

An SPDX tag names its license itself. The whole text of a license file decides where it matches; otherwise
the best match does, then the first name. A license file decides for its directory; a file without a
license of its own takes that of the nearest directory above it that has one, by joins on paths.
Built-in functions only.

Texts are read once and reduced to these parts before anything is shuffled. Vectors are made for distinct
headers and parts, so that a header in a third of all files is one row; each is counted, weighted and compared in the task it was
brought to, so texts are shuffled and terms are not. Templates are a fixed list. The weights of headers' terms are broadcast while
their counted size allows it, and joined by shuffle beyond that.

Cases: a null or empty text or path has no header; a header that resembles no template well enough is
none; of several licenses in a directory the best match, then the first name, decides; files outside any
licensed directory get null; repeated rows give repeated rows; further columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_forms import forms
from .shared import kept

#: Names and typical notices of licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
MARKERS = "(?i)licen[sc]e|copyright|spdx|redistribution|cc by"
LICENSE_NAMES = "(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
THRESHOLD = 0.6
#: Terms of headers that are broadcast with their weights; beyond it they are joined by shuffle.
BROADCAST_BYTES = 64 << 20
SPDX = "(?i)spdx-license-identifier:[ \\t]*([A-Za-z0-9.+() \\t-]+)"
COMMENT = "^[ \\t]*(#|//|/?\\*|--|;|%|<!--)"
#: Between comment blocks, and lines without letters and digits.
CUT = "\u0001"
BLANK = f"\n[^\\p{{L}}\\p{{N}}{CUT}]*\n"


def header(path: Column, text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    lines = F.array_join(F.filter(F.split(whole, "\n"), lambda line: line.rlike(MARKERS)), "\n")
    names_it = F.coalesce(path, F.lit("")).rlike(LICENSE_NAMES)
    return F.trim(F.when(names_it & ~whole.rlike(MARKERS), whole).otherwise(lines))


def parts(path: Column, text: Column) -> Column:
    """What is compared of a file besides its header: (part, whole), whole for a license file's text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.split(text, "\n")
    blocks = F.split(F.array_join(F.transform(lines, lambda x: F.when(x.rlike(COMMENT), x).otherwise(CUT)), "\n"), CUT)
    found = F.array_distinct(F.transform(F.flatten(F.array(lines, F.split(text, BLANK), blocks)), lambda x: F.trim(x)))
    marked = F.transform(F.filter(found, lambda x: x.rlike(MARKERS)), lambda x: F.struct(x.alias("part"), F.lit(False).alias("whole")))
    whole = F.array(F.struct(F.trim(text).alias("part"), F.lit(True).alias("whole")))
    none = F.filter(whole, lambda x: F.lit(False))
    names_it = F.coalesce(path, F.lit("")).rlike(LICENSE_NAMES) & (F.trim(text) != "")
    return F.concat(F.when(text.rlike(MARKERS), marked).otherwise(none), F.when(names_it, whole).otherwise(none))


def tagged_license(text: Column) -> Column:
    """The first by name of the licenses in the text's SPDX tags, without the suffixes for later versions."""
    tags = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPDX), F.lit(1))
    # An exception follows the license it is granted to.
    names = F.flatten(F.transform(tags, lambda x: F.split(F.regexp_replace(x, "(?i) with +[^ ()]+", " "), "[ \\t()]+")))
    names = F.filter(names, lambda x: x.rlike("[A-Za-z]") & ~x.rlike("^(AND|OR|WITH|and|or|with)$"))
    return F.array_min(F.transform(names, lambda x: F.regexp_replace(x, "(-only|-or-later|[+]|-)$", "")))


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _weighted(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """``id``, ``term``, unit-length ``weight``."""
    weights = counts.join(idf, "term").withColumn("weight", F.col("tf") * F.col("idf"))
    norms = weights.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weights.join(norms, "id").select("id", "term", (F.col("weight") / F.col("norm")).alias("weight"))


def _model(spark: SparkSession, listed: list[tuple[str, str]], tf: Column) -> DataFrame:
    """``id``, ``term``, ``tf`` of (license, text) pairs, the id being a pair's place."""
    rows = [F.struct(F.lit(k).alias("id"), F.lit(text).alias("text")) for k, (_, text) in enumerate(listed)]
    texts = spark.range(1).select(F.inline(F.array(*rows)))
    return kept(texts.select("id", F.explode(terms(F.col("text"))).alias("term")).groupBy("id", "term").agg(tf.alias("tf")))


def _held(model: DataFrame, idf: DataFrame) -> DataFrame:
    """``term``, ``held``: the forms that hold a term, with its weight in each."""
    known = _weighted(model, idf).select("term", F.struct(F.col("id").alias("form"), F.col("weight").alias("known")).alias("one"))
    return known.groupBy("term").agg(F.collect_list("one").alias("held"))


def _matches(texts: DataFrame, tf: Column, weights: DataFrame, names: list[str], threshold: float, unknown: float = 0.0) -> DataFrame:
    """``id``, ``license`` and ``score`` of the texts (id, text) that match a form well enough; ``weights`` is (term, idf, held).

    ``texts`` is grouped by id, so that terms are counted, weighted and summed where a text lies: texts are shuffled, terms
    are not.
    """
    counted = texts.select("id", F.explode(terms(F.col("text"))).alias("term")).groupBy("id", "term").agg(tf.alias("tf"))
    weighed = counted.join(weights, "term", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    # The place -1 stands for the text itself: the square of its length.
    length = F.array(F.struct(F.lit(-1).alias("form"), F.col("weight").alias("known")))
    shares = F.concat(length, F.coalesce("held", F.filter(length, lambda x: F.lit(False))))
    sums = weighed.select("id", "weight", F.inline(shares)).groupBy("id", "form").agg(F.sum(F.col("weight") * F.col("known")).alias("dot"))
    whole = sums.groupBy("id").agg(
        F.sqrt(F.max(F.when(F.col("form") < 0, F.col("dot")))).alias("norm"),
        F.collect_list(F.when(F.col("form") >= 0, F.struct("form", "dot"))).alias("dots"),
    )
    licenses = F.array(*map(F.lit, names))
    scored = F.transform("dots", lambda d: F.struct((-F.round(d["dot"] / F.col("norm"), 9)).alias("minus"), F.get(licenses, d["form"]).alias("license")))
    # The best score, then the first name.
    best = F.array_min(F.filter(scored, lambda x: x["minus"] <= -threshold))
    found = whole.select("id", best.alias("best")).where("best is not null")
    return found.select("id", "best.license", (-F.col("best.minus")).alias("score"))


def header_licenses(headers: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``id``, ``license`` and ``score`` of the distinct headers (id, text) that match well enough."""
    listed = list(TEMPLATES.items())
    model = _model(headers.sparkSession, listed, F.count("*"))
    total = headers.count() + len(listed)
    own = headers.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    idf = kept(
        own.unionByName(model.select("term")).groupBy("term").agg(F.count("*").alias("df"))
        .select("term", (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    )
    weights = idf.join(F.broadcast(_held(model, idf)), "term", "left")
    size = idf.agg(F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0))).first()[0]
    weights = F.broadcast(weights) if size <= BROADCAST_BYTES else weights
    return _matches(headers, F.count("*"), weights, [name for name, _ in listed], threshold)


def part_licenses(parts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``id``, ``license`` and ``score`` of the distinct parts (id, text) that match a form well enough."""
    listed = [*forms(), *TEMPLATES.items()]
    count = F.log(F.count("*")) + 1.0
    model = _model(parts.sparkSession, listed, count)
    idf = kept(model.groupBy("term").agg((F.log((1.0 + len(listed)) / (1.0 + F.count("*"))) + 1.0).alias("idf")))
    weights = F.broadcast(kept(idf.join(_held(model, idf), "term")))  # the forms' own terms, a fixed list
    # A term of no form has a place in a part's length only.
    return _matches(parts, count, weights, [name for name, _ in listed], threshold, math.log(1.0 + len(listed)) + 1.0)


def ancestors(directory: Column) -> Column:
    """The directory and all above it, nearest first; the root is the empty string."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda up: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - up), "/"))


def scan_licenses(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` (file_id, path, text) as file_id, path, own_license, score, license and licensed_by.

    ``licensed_by`` is the directory a license is inherited from, null for an own one.
    """
    path = F.coalesce(F.col("path"), F.lit(""))
    slim = files.select(
        "file_id", "path", header(F.col("path"), F.col("text")).alias("header"),
        parts(F.col("path"), F.col("text")).alias("parts"), tagged_license(F.col("text")).alias("tag"),
    )
    slim = kept(
        slim.withColumn("directory", F.regexp_replace(path, "/?[^/]*$", ""))
        .withColumn("header_id", F.when(F.col("header") != "", F.unhex(F.sha2("header", 256))))
        .withColumn("part_ids", F.transform("parts", lambda x: F.struct(F.unhex(F.sha2(x["part"], 256)).alias("part_id"), x["whole"].alias("whole"))))
        .withColumn("names_it", path.rlike(LICENSE_NAMES)).withColumn("row", F.expr("uuid()"))
    )
    headers = slim.where("header_id is not null").groupBy(F.col("header_id").alias("id")).agg(F.max("header").alias("text"))
    matched = kept(header_licenses(headers, threshold)).withColumnRenamed("id", "header_id")
    single = slim.select(F.explode("parts.part").alias("part")).groupBy(F.unhex(F.sha2("part", 256)).alias("id")).agg(F.max("part").alias("text"))
    fitting = part_licenses(single, threshold).withColumnRenamed("id", "part_id")
    # Of each file the whole text's match first, then the best, then the first name.
    by_part = slim.select("row", F.inline("part_ids")).join(fitting, "part_id").select(
        "row", F.when(F.col("whole"), 0).otherwise(1).alias("rank"), (-F.col("score")).alias("minus"), "license"
    )
    by_header = slim.join(matched, "header_id").select("row", F.lit(1).alias("rank"), (-F.col("score")).alias("minus"), "license")
    by_tag = slim.where("tag is not null").select("row", F.lit(1).alias("rank"), F.lit(-1.0).alias("minus"), F.col("tag").alias("license"))
    chosen = by_part.unionByName(by_header).unionByName(by_tag).groupBy("row").agg(F.min(F.struct("rank", "minus", "license")).alias("best"))
    chosen = chosen.select("row", "best.license", (-F.col("best.minus")).alias("score"))
    owned = kept(slim.drop("header", "header_id", "parts", "part_ids", "tag").join(chosen, "row", "left").drop("row"))
    best = F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best")
    decided = owned.where("names_it and license is not null").groupBy("directory").agg(best).select("directory", "best.license")
    above = (
        owned.select("directory").distinct().select("directory", F.posexplode(ancestors(F.col("directory"))).alias("up", "above"))
        .join(decided.toDF("above", "inherited"), "above")
        .groupBy("directory").agg(F.min(F.struct("up", "above", "inherited")).alias("nearest"))
    )
    inherited = kept(above.select("directory", "nearest.above", "nearest.inherited"))
    own = F.col("license").isNotNull()
    return owned.join(inherited, "directory", "left").select(
        "file_id", "path", F.col("license").alias("own_license"), "score",
        F.coalesce("license", "inherited").alias("license"), F.when(~own, F.col("above")).alias("licensed_by"),
    )
