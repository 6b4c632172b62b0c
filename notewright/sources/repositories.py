"""What a project's repository contributes: deny lists, listed names, manifest names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.text import LINE_BREAK, strip_bom, strip_extension, trimmed
from ..functions.values import IGNORED_NAMES


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``(project_id, raw)`` of one file per project; the parent folder's name is the project."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return spark.read.text(path, wholetext=True).select(
        F.url_decode(folder).alias("project_id"), F.col("value").alias("raw")
    )


def read_listing(spark: SparkSession, root: str) -> DataFrame:
    """``(project_id, path)`` of every file below ``root/<project>/``. File contents are not read.

    ``root`` is a plain path or a URI; it is compared, as its file system writes it, with the start of
    every listed path.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    named = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString()
    base = named.rstrip("/") + "/"
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    )
    path = F.col("path")
    outside = F.raise_error(F.concat(F.lit(f"not below {base}: "), path))
    inside = F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(outside)
    return listed.select(inside.alias("inside")).select(
        F.substring_index("inside", "/", 1).alias("project_id"),
        F.regexp_replace("inside", "^[^/]*/", "").alias("path"),
    )


def deny_terms(files: DataFrame) -> DataFrame:
    """``(project_id, raw)`` to ``(project_id, term, pos)``: trimmed lines, no blanks or # comments."""
    return (
        files.select("project_id", F.posexplode_outer(F.split("raw", LINE_BREAK)).alias("pos", "line"))
        .select("project_id", trimmed(F.col("line")).alias("term"), "pos")
        .where((F.col("term") != "") & ~F.col("term").startswith("#"))
    )


def deny_lists(terms: DataFrame) -> DataFrame:
    """``(project_id, denied)`` with the terms in file order, as G8 applies them one after another.

    A list is one hand-written file, already a single value at the source; the array is that value
    again with its comments removed.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "term")))
    return terms.groupBy("project_id").agg(F.transform(ordered, lambda t: t["term"]).alias("denied"))


def repo_names(listing: DataFrame) -> DataFrame:
    """Distinct names at the repository root and one level down, without their last extension.

    Ignored names and dotfiles drop out at both levels, and so do children of an ignored root.
    """
    levels = F.split("path", "/")

    def listed(name: Column) -> Column:
        return ~name.isin(IGNORED_NAMES) & ~name.startswith(".") & (name != "")

    root, child = F.get(levels, F.lit(0)), F.get(levels, F.lit(1))
    return (
        listing.select(
            "project_id",
            F.explode_outer(
                F.when(
                    listed(root),
                    F.when(listed(child), F.array(root, child)).otherwise(F.array(root)),
                )
            ).alias("entry"),
        )
        .where("entry is not null")
        .select("project_id", strip_extension(F.col("entry")).alias("name"))
        .distinct()
    )


def manifest_names(manifests: DataFrame) -> DataFrame:
    """``(project_id, raw)`` to its package name and the names of both dependency groups.

    Invalid JSON gives nothing; a dependency group that is not an object is ignored.
    """
    none = F.array().cast("array<string>")
    # Two projections, as the parsed text is used twice: in one it would be parsed twice.
    pairs = manifests.select("project_id", V.guarded(strip_bom(F.col("raw"))).alias("pair"))
    parsed = pairs.select("project_id", V.first_of(F.col("pair")).alias("m"))
    manifest = F.col("m")
    return parsed.select(
        "project_id",
        F.explode_outer(
            F.array_compact(
                F.concat(
                    F.array(V.text_at(manifest, "$.name")),
                    F.coalesce(V.keys_at(manifest, "$.dependencies"), none),
                    F.coalesce(V.keys_at(manifest, "$.devDependencies"), none),
                )
            )
        ).alias("name"),
    ).where("name is not null").distinct()
