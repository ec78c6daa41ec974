"""Questions asked of the cell table: filters, header rows, counts, summaries, previews.

All are built-in DataFrame operators; filters on ``worksheet``/``row``/
``file_path`` reach the Parquet scan as pushed filters, and the top-k reports
plan as ``TakeOrderedAndProject`` (no global sort of the whole table).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import shorten, size_kb


def select(
    cells: DataFrame,
    worksheet: str | None = None,
    file_name: str | None = None,
    file_path: str | None = None,
    row: int | None = None,
    non_null: bool = False,
) -> DataFrame:
    """Filter cells by the usual equality conditions (each optional)."""
    cond: Column = F.lit(True)
    for col, val in (("worksheet", worksheet), ("file_name", file_name), ("file_path", file_path), ("row", row)):
        if val is not None:
            cond = cond & (F.col(col) == F.lit(val))
    if non_null:
        cond = cond & F.col("value").isNotNull()
    return cells.where(cond)


def header_row(cells: DataFrame, row: int = 0) -> DataFrame:
    """The given row of every sheet (row 0 = first row), sorted by column."""
    return (
        cells.where(F.col("row") == F.lit(row))
        .select("file_path", "worksheet", "column", "value")
        .orderBy("file_path", "worksheet", "column")
    )


def cells_per_file(cells: DataFrame) -> DataFrame:
    return cells.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_cells"))


def processed_paths(cells: DataFrame) -> DataFrame:
    """Distinct source paths present in the output (partial + final aggregate)."""
    return cells.select("file_path").distinct()


def output_summary(
    cells: DataFrame,
    unit: Sequence[str] = ("file_path", "worksheet"),
    size_bytes: Column | None = None,
    limit: int = 50,
    name: Column | None = None,
) -> DataFrame:
    """Per output unit: name, size in KB, row count, source file name; first ``limit`` by name.

    On written Parquet the unit is the physical file (``_metadata.file_name``)
    and the size ``_metadata.file_size``; see :func:`output_files_summary`.
    """
    name = name if name is not None else F.concat_ws("#", *[F.col(u) for u in unit])
    size_bytes = size_bytes if size_bytes is not None else F.octet_length(F.coalesce(F.col("value"), F.lit("")))
    per = cells.groupBy(name.alias("output_file")).agg(
        F.sum(size_bytes).alias("_bytes"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min("file_name").alias("source_file"),
    )
    return (
        per.select("output_file", size_kb("_bytes").alias("size_kb"), "n_rows", "source_file")
        .orderBy("output_file")
        .limit(limit)
    )


def output_files_summary(cells_files: DataFrame, limit: int = 50) -> DataFrame:
    """Same report over written Parquet: one row per physical output file."""
    meta = cells_files.select(
        F.col("_metadata.file_name").alias("output_file"),
        F.col("_metadata.file_size").alias("_size"),
        "file_name",
    )
    per = meta.groupBy("output_file").agg(
        F.max("_size").alias("_bytes"), F.count(F.lit(1)).alias("n_rows"), F.min("file_name").alias("source_file")
    )
    return (
        per.select("output_file", size_kb("_bytes").alias("size_kb"), "n_rows", "source_file")
        .orderBy("output_file")
        .limit(limit)
    )


def preview(cells: DataFrame, file_path: str, n: int = 10, path_chars: int = 40, value_chars: int = 30) -> DataFrame:
    """First ``n`` cells of one file in (worksheet, row, column) order, display-truncated."""
    return (
        cells.where(F.col("file_path") == F.lit(file_path))
        .orderBy("worksheet", "row", "column")
        .limit(n)
        .select(
            shorten("file_path", path_chars).alias("file_path"),
            "worksheet",
            "row",
            "column",
            shorten("value", value_chars).alias("value"),
        )
    )


def sheet_status(sheets: DataFrame, cells: DataFrame, keys: Sequence[str] = ("worksheet",)) -> DataFrame:
    """Every listed sheet with its cell count and ``converted`` / ``empty``.

    Empty sheets have no cells, so they never reach the output; this is the
    record of that decision (left join of the sheet list to per-sheet counts).
    """
    keys = list(keys)
    per_sheet = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"))
    n = F.coalesce(F.col("n_cells"), F.lit(0)).cast("bigint")
    return sheets.select(*keys).join(per_sheet, keys, "left").select(
        *keys, n.alias("n_cells"), F.when(n == 0, F.lit("empty")).otherwise(F.lit("converted")).alias("status")
    )
