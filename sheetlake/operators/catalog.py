"""Operators on catalogs (file listings): set operations, counts, folder rule, directory lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths


def concat(*catalogs: DataFrame) -> DataFrame:
    """Bag union of catalogs (duplicates kept)."""
    out = catalogs[0]
    for c in catalogs[1:]:
        out = out.unionByName(c)
    return out


def union(*catalogs: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Set union; with ``key`` one row per key is kept (the first catalog wins ties by min)."""
    out = concat(*catalogs)
    if key is None:
        return out.distinct()
    others = [c for c in out.columns if c not in key]
    return out.groupBy(*key).agg(*[F.min(c).alias(c) for c in others]).select(*out.columns)


def extension_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("extension").agg(F.count(F.lit(1)).alias("count"))


def running_total(catalog: DataFrame, order: str = "root") -> DataFrame:
    """Files per ``order`` value and the running total in that order.

    The window runs over the per-root counts (one row per root), not over files.
    """
    per = catalog.groupBy(order).agg(F.count(F.lit(1)).alias("n_files"))
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.select(order, "n_files", F.sum("n_files").over(w).alias("running_total"))


def marker_folders(listing: DataFrame, marker: str = paths.DEFAULT_MARKER, path: str = "file_path") -> DataFrame:
    """Distinct folders whose path contains ``marker``, sorted.

    The folders come from file paths: distinct parents first, so a folder with
    millions of files is one row, then their ancestors.  Folders without files
    are in ``sources.catalog.folders``.
    """
    return all_folders(listing, path).where(paths.under_marker("folder", marker)).orderBy("folder")


def directory_entries(entries: DataFrame, base: str = "/") -> DataFrame:
    """Directories named in a sheet's first column: ``directory``, ``mentions``.

    ``entries``: cells of one sheet (``row``, ``column``, ``value``).  Column 1
    only; a first row that looks like a header is dropped; white space around a
    value goes, blanks are dropped; different spellings of one path (``.``,
    ``..``, repeated and last slashes) are one directory.
    """
    first = entries.where(F.col("column") == 1)
    header = (F.col("row") == 0) & paths.looks_like_header("value")
    cleaned = first.where(~header | F.col("value").isNull()).select(paths.clean("value").alias("directory"))
    return cleaned.where(F.col("directory").isNotNull()).groupBy(paths.resolved("directory", base).alias("directory")).agg(
        F.count(F.lit(1)).alias("mentions"))


def clean_directory_list(entries: DataFrame, existing_dirs: DataFrame, base: str = "/") -> DataFrame:
    """Directory list read from a sheet's first column, cleaned and checked against ``existing_dirs`` (column ``folder``).

    ``valid`` = the directory is among them; ``mentions`` = how often it was
    listed, in any spelling.  ``sources.catalog.existing`` looks at the file
    system instead.
    """
    known = existing_dirs.select(paths.resolved("folder", base).alias("directory")).distinct().withColumn("valid", F.lit(True))
    return directory_entries(entries, base).join(known, "directory", "left").select(
        "directory", F.coalesce("valid", F.lit(False)).alias("valid"), "mentions"
    )


def directory_counts(listed: DataFrame) -> DataFrame:
    """One row: how many listed directories are valid, how many are not, and all mentions."""
    return listed.agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"),
                      F.coalesce(F.sum("mentions"), F.lit(0)).cast("bigint").alias("mentions"))


def all_folders(listing: DataFrame, path: str = "file_path") -> DataFrame:
    """Every folder that holds at least one listed file, at any depth."""
    one = listing.select(paths.parent(path).alias("_parent"), F.col(path).alias("_path")).groupBy("_parent").agg(
        F.min("_path").alias("_path"))
    return one.select(F.explode(paths.ancestors(F.col("_path"))).alias("folder")).distinct()
