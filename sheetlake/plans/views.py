"""Derived inputs built from the driver's tables, in Spark and in SQL.

No workbooks come with the test data, so tables stand in for them:

* ``files``: a file listing derived from ``customer`` -- one path per customer
  under a root per market segment, with a folder part and an extension that
  vary by key, a size, and the time of an event as discovery time.
* ``cells``: the long cell table of four tables read as worksheets of four
  workbooks (row order = primary key, columns numbered by position).

Each Spark view has a SQL twin (a CTE body) so the oracle runs the same logic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import reshape


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# files
# Fixed values of the derived listing: folder part by c_nationkey % 3 and
# extension by c_custkey % 5.
FOLDER_PARTS = ("/SOV/", "/sov/", "/SOV_data/")
FILE_EXTENSIONS = (".xlsx", ".XLSX", ".xls", ".xlsb", ".txt")


def _pick(key, options):
    out = F.lit(options[-1])
    for i in range(len(options) - 2, -1, -1):
        out = F.when(key == i, F.lit(options[i])).otherwise(out)
    return out


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, root, size, discovered_at (ISO text), c_custkey, c_nationkey."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("c_custkey"), "ts")
    root = F.concat(F.lit("/data/"), F.lower("c_mktsegment"))
    path = F.concat(
        root,
        _pick(F.pmod("c_nationkey", F.lit(3)), FOLDER_PARTS),
        F.lit("y"), F.col("c_nationkey").cast("string"),
        F.lit("/c"), F.col("c_custkey").cast("string"),
        _pick(F.pmod("c_custkey", F.lit(5)), FILE_EXTENSIONS),
    )
    return c.join(ev, "c_custkey", "left").select(
        path.alias("file_path"),
        root.alias("root"),
        (F.abs(F.col("c_acctbal")) * 100).cast("bigint").alias("size"),
        paths.iso_text("ts").alias("discovered_at"),
        "c_custkey",
        "c_nationkey",
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog a scan of ``files`` keeps: spreadsheet extensions only."""
    f = files(spark, sf_dir)
    return f.select(
        "file_path", paths.extension("file_path").alias("extension"), "discovered_at", "root", "size", "c_custkey"
    ).where(paths.is_spreadsheet("extension"))


SQL_ISO = (
    "CASE WHEN strftime({t}, '%f') = '000000' THEN strftime({t}, '%Y-%m-%dT%H:%M:%S') "
    "ELSE strftime({t}, '%Y-%m-%dT%H:%M:%S.%f') END"
)

SQL_EXT = "lower(regexp_extract(regexp_extract({p}, '[^/]*$', 0), '^.+(\\.[^.]+)$', 1))"

SQL_FILES = """
  SELECT '/data/' || lower(c.c_mktsegment)
           || CASE c.c_nationkey % 3 WHEN 0 THEN '/SOV/' WHEN 1 THEN '/sov/' ELSE '/SOV_data/' END
           || 'y' || CAST(c.c_nationkey AS VARCHAR) || '/c' || CAST(c.c_custkey AS VARCHAR)
           || CASE c.c_custkey % 5 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.xls'
                                   WHEN 3 THEN '.xlsb' ELSE '.txt' END AS file_path,
         '/data/' || lower(c.c_mktsegment) AS root,
         CAST(abs(c.c_acctbal) * 100 AS BIGINT) AS size,
         {iso} AS discovered_at,
         c.c_custkey, c.c_nationkey
  FROM customer c LEFT JOIN events e ON e.event_id = c.c_custkey
""".format(iso=SQL_ISO.format(t="e.ts"))

SQL_CATALOG = """
  SELECT file_path, {ext} AS extension, discovered_at, root, size, c_custkey
  FROM files
  WHERE {ext} IN ('.xlsx', '.xlsm', '.xlsb', '.xls')
""".format(ext=SQL_EXT.format(p="file_path"))


# ---------------------------------------------------------------------------
# cells
# Each stand-in worksheet: table, primary key, value columns in order.
SHEETS = (
    ("nation", "n_nationkey", ("n_nationkey", "n_name", "n_regionkey")),
    ("region", "r_regionkey", ("r_regionkey", "r_name")),
    ("supplier", "s_suppkey", ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")),
    ("customer", "c_custkey", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
)


def sheet_cells(spark: SparkSession, sf_dir: str, name: str, column_as: str = "number") -> DataFrame:
    """Cells of one stand-in worksheet: row = position in primary-key order."""
    _, pk, cols = next(s for s in SHEETS if s[0] == name)
    df = table(spark, sf_dir, name).select(*cols)
    indexed = reshape.with_row_index(df, [pk])
    return reshape.to_cells(
        indexed,
        lineage={
            "file_path": F.lit(f"/data/SOV/{name}.xlsx"),
            "file_name": F.lit(f"{name}.xlsx"),
            "worksheet": F.lit(name),
        },
        columns=list(cols),
        column_as=column_as,
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all stand-in worksheets (one row-index pass for all of them)."""
    return reshape.sheets_to_cells([
        (
            table(spark, sf_dir, name).select(*cols),
            pk,
            {"file_path": f"/data/SOV/{name}.xlsx", "file_name": f"{name}.xlsx", "worksheet": name},
            cols,
        )
        for name, pk, cols in SHEETS
    ])


def stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cells written to a folder of Parquet and read back: what queries on stored cells scan."""
    from ..session import scratch_dir
    from ..sources import cells_io

    folder = scratch_dir(spark, "cells")
    cells_io.write_cells(cells(spark, sf_dir), folder)
    return cells_io.read_cells(spark, folder)


def _sql_text(table_name: str, col: str) -> str:
    # doubles go through fixed-point text; see functions.text
    doubles = {"s_acctbal", "c_acctbal"}
    if col in doubles:
        return sql_number_text(col)
    if col.endswith("key"):
        return f"CAST({col} AS VARCHAR)"
    return col


def sql_number_text(expr: str) -> str:
    """Text of a double between 1e-4 and 1e15: the shortest that reads back, without a trailing ``.0``."""
    return f"regexp_replace(CAST({expr} AS VARCHAR), '\\.0$', '')"


def sql_sheet_cells(name: str, column_as: str = "number") -> str:
    _, pk, cols = next(s for s in SHEETS if s[0] == name)
    wide = ", ".join(f"{_sql_text(name, c)} AS v{i}" for i, c in enumerate(cols, start=1))
    parts = []
    for i in range(1, len(cols) + 1):
        col = f"CAST({i} AS BIGINT)" if column_as == "number" else f"'column_{i}'"
        parts.append(
            f"SELECT '/data/SOV/{name}.xlsx' AS file_path, '{name}.xlsx' AS file_name, '{name}' AS worksheet, "
            f"row, {col} AS \"column\", v{i} AS value FROM w_{name}"
        )
    body = " UNION ALL ".join(parts)
    return (
        f"(WITH w_{name} AS (SELECT CAST(row_number() OVER (ORDER BY {pk}) - 1 AS BIGINT) AS row, {wide} "
        f"FROM {name}) {body})"
    )


SQL_CELLS = " UNION ALL ".join(f"SELECT * FROM {sql_sheet_cells(n)}" for n, _, _ in SHEETS)


def with_ctes(body: str, **ctes: str) -> str:
    """``WITH name AS (sql), ... body``."""
    if not ctes:
        return body
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + " " + body
