"""Queries over the driver's tables, each with its DuckDB oracle SQL.

Every query reads whole tables (or views Spark derives from them); the SQL is
written independently against the same tables and must give the same rows,
column names and value types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import paths
from ..functions.text import as_text
from ..operators import catalog as cat
from ..operators import cells as cl
from ..operators import changes as ch
from ..operators import reshape as rs
from ..operators import synth
from . import views as V
from ..schema import CELL_AT, literal_rows
from .views import SQL_CATALOG, SQL_CELLS, SQL_FILES, with_ctes

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


CAT = dict(files=SQL_FILES, catalog=SQL_CATALOG)

# ---------------------------------------------------------------------------
# catalog


@register("catalog_scan", with_ctes("SELECT file_path, extension, discovered_at FROM catalog", **CAT))
def catalog_scan(spark, d):
    return V.catalog(spark, d).select("file_path", "extension", "discovered_at")


@register(
    "extension_counts",
    with_ctes("SELECT extension, COUNT(*) AS count FROM catalog GROUP BY extension", **CAT),
)
def extension_counts(spark, d):
    return cat.extension_counts(V.catalog(spark, d))


@register(
    "root_running_total",
    with_ctes(
        "SELECT root, n_files, CAST(SUM(n_files) OVER (ORDER BY root ROWS BETWEEN UNBOUNDED PRECEDING AND "
        "CURRENT ROW) AS BIGINT) AS running_total FROM (SELECT root, COUNT(*) AS n_files FROM catalog GROUP BY root)",
        **CAT,
    ),
)
def root_running_total(spark, d):
    return cat.running_total(V.catalog(spark, d), "root")


# Two scans over overlapping root sets (furniture is in both).
SCAN_A = ("/data/automobile", "/data/building", "/data/furniture")
SCAN_B = ("/data/furniture", "/data/household", "/data/machinery")


def _scans(spark, d):
    c = V.catalog(spark, d).select("file_path", "extension", "discovered_at", "root")
    a = c.where(F.col("root").isin(list(SCAN_A))).drop("root")
    b = c.where(F.col("root").isin(list(SCAN_B))).drop("root")
    return a, b


def _sql_in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


SQL_SCANS = (
    "SELECT file_path, extension, discovered_at FROM catalog WHERE root IN {a} {op} "
    "SELECT file_path, extension, discovered_at FROM catalog WHERE root IN {b}"
)


@register("catalog_concat", with_ctes(SQL_SCANS.format(a=_sql_in(SCAN_A), b=_sql_in(SCAN_B), op="UNION ALL"), **CAT))
def catalog_concat(spark, d):
    return cat.concat(*_scans(spark, d))


@register(
    "catalog_union_distinct", with_ctes(SQL_SCANS.format(a=_sql_in(SCAN_A), b=_sql_in(SCAN_B), op="UNION"), **CAT)
)
def catalog_union_distinct(spark, d):
    return cat.union(*_scans(spark, d))


@register(
    "sov_files",
    with_ctes("SELECT file_path, extension FROM catalog WHERE contains(replace(file_path, '\\', '/'), '/SOV/')", **CAT),
)
def sov_files(spark, d):
    c = V.catalog(spark, d)
    return c.where(paths.under_marker("file_path")).select("file_path", "extension")


SQL_FOLDERS = """
  SELECT DISTINCT array_to_string(parts[1:k], '/') AS folder
  FROM (SELECT parts, unnest(range(2, len(parts))) AS k
        FROM (SELECT string_split(replace(file_path, '\\', '/'), '/') AS parts FROM files))
"""


@register(
    "sov_folders",
    with_ctes("SELECT folder FROM folders WHERE contains(folder, '/SOV/') ORDER BY folder", files=SQL_FILES,
              folders=SQL_FOLDERS),
)
def sov_folders(spark, d):
    return cat.marker_folders(V.files(spark, d))


@register(
    "reader_routing",
    with_ctes(
        "SELECT file_path, ext AS extension, "
        "CASE ext WHEN '.xlsx' THEN 'openpyxl' WHEN '.xlsm' THEN 'openpyxl' WHEN '.xlsb' THEN 'pyxlsb' "
        "WHEN '.xls' THEN 'xlrd' ELSE 'openpyxl' END AS engine, "
        "CASE WHEN ext IN ('.xlsx', '.xlsm') THEN 'ooxml' ELSE 'unsupported' END AS reader "
        "FROM (SELECT file_path, " + V.SQL_EXT.format(p="file_path") + " AS ext FROM files)",
        files=SQL_FILES,
    ),
)
def reader_routing(spark, d):
    f = V.files(spark, d).select("file_path", paths.extension("file_path").alias("extension"))
    return f.select(
        "file_path", "extension", paths.engine_for("extension").alias("engine"),
        paths.reader_for("extension").alias("reader"),
    )


@register(
    "browser_listing",
    with_ctes(
        "SELECT regexp_extract(file_path, '[^/]*$', 0) AS file_name, extension, "
        "CASE WHEN NOT contains(file_path, '/') THEN '.' "
        "WHEN regexp_replace(file_path, '/[^/]*$', '') = '' THEN '/' "
        "ELSE regexp_replace(file_path, '/[^/]*$', '') END AS directory, "
        "substr(discovered_at, 1, 19) AS discovered FROM catalog",
        **CAT,
    ),
)
def browser_listing(spark, d):
    c = V.catalog(spark, d)
    return c.select(
        paths.base_name("file_path").alias("file_name"),
        "extension",
        paths.parent("file_path").alias("directory"),
        paths.display_time("discovered_at").alias("discovered"),
    )


# Directory list sheet: a header, then one entry per customer with stray white space and in several spellings:
# blank for customers in debt, empty (null) for the household segment; the
# folder part follows the segment, so some entries name folders that exist and
# some do not.
def _dir_entry(acctbal, nationkey, segment):
    part = (
        F.when(segment.isin("AUTOMOBILE", "BUILDING"), F.lit("/SOV/"))
        .when(segment == "FURNITURE", F.lit("/sov/"))
        .otherwise(F.lit("/SOV_data/"))
    )
    # the same folder in four spellings
    spelt = F.element_at(F.array(F.lit(""), F.lit("./"), F.lit("/"), F.lit("none/../")), F.pmod(nationkey, F.lit(4)) + 1)
    last = F.when(nationkey > 12, F.lit("/ \n")).otherwise(F.lit("\t"))
    path = F.concat(F.lit(" \t/data/"), spelt, F.lower(segment), part, F.lit("y"), nationkey.cast("string"), last)
    return (
        F.when(acctbal < 0, F.lit(" \t \n"))
        .when(segment == "HOUSEHOLD", F.lit(None).cast("string"))
        .otherwise(path)
    )


SQL_DIR_ENTRIES = """
  SELECT CAST(0 AS BIGINT) AS row, CAST(1 AS BIGINT) AS "column", 'Directory Path' AS value
  UNION ALL
  SELECT CAST(0 AS BIGINT), CAST(2 AS BIGINT), 'Name'
  UNION ALL
  SELECT row, CAST(1 AS BIGINT),
         CASE WHEN c_acctbal < 0 THEN ' ' || chr(9) || ' ' || chr(10) WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL
              ELSE ' ' || chr(9) || '/data/' || CASE c_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN './' WHEN 2 THEN '/' ELSE 'none/../' END
                   || lower(c_mktsegment)
                   || CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN '/SOV/'
                           WHEN c_mktsegment = 'FURNITURE' THEN '/sov/' ELSE '/SOV_data/' END
                   || 'y' || CAST(c_nationkey AS VARCHAR) || CASE WHEN c_nationkey > 12 THEN '/ ' || chr(10) ELSE chr(9) END END
  FROM (SELECT *, CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS row FROM customer)
  UNION ALL
  SELECT CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT), CAST(2 AS BIGINT), c_name FROM customer
"""


# a path's parts folded to its canonical text
SQL_RESOLVED = (
    "list_reduce(list_prepend('', string_split({p}, '/')), lambda done, part: CASE WHEN part IN ('', '.') THEN done "
    "WHEN part = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || part END)"
)
SQL_LISTED = (
    "SELECT directory, COUNT(*) AS mentions FROM (SELECT " + SQL_RESOLVED.format(p="value") + " AS directory FROM ("
    "  SELECT nullif(regexp_replace(value, '^\\s+|\\s+$', '', 'g'), '') AS value FROM entries WHERE \"column\" = 1 AND NOT ("
    "    row = 0 AND coalesce(contains(lower(value), 'path') OR contains(lower(value), 'folder') "
    "    OR contains(lower(value), 'directory'), false))"
    ") WHERE value IS NOT NULL) GROUP BY directory"
)
SQL_LIST_CHECKED = "SELECT directory, EXISTS (SELECT 1 FROM folders f WHERE f.folder = l.directory) AS valid, mentions FROM listed l"
_LIST_CTES = {"files": SQL_FILES, "folders": SQL_FOLDERS, "entries": SQL_DIR_ENTRIES, "listed": SQL_LISTED}


def _directory_sheet(spark, d):
    c = V.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_name", "c_acctbal")
    sheet = rs.with_row_index(c, ["c_custkey"]).withColumn("row", F.col("row") + 1)
    body = rs.to_cells(
        sheet.select(
            "row",
            _dir_entry(F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_mktsegment")).alias("entry"),
            "c_name",
        ),
        columns=["entry", "c_name"],
    )
    header = literal_rows(spark, [(0, 1, "Directory Path"), (0, 2, "Name")], CELL_AT)
    return body.unionByName(header)


@register("directory_list_clean", with_ctes(SQL_LIST_CHECKED, **_LIST_CTES))
def directory_list_clean(spark, d):
    return cat.clean_directory_list(_directory_sheet(spark, d), cat.all_folders(V.files(spark, d)))


@register(
    "directory_counts",
    with_ctes("SELECT count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid, CAST(sum(mentions) AS BIGINT) AS mentions "
              f"FROM ({SQL_LIST_CHECKED})", **_LIST_CTES),
)
def directory_counts(spark, d):
    return cat.directory_counts(cat.clean_directory_list(_directory_sheet(spark, d), cat.all_folders(V.files(spark, d))))


@register(
    "directory_list_checked",
    "SELECT c_mktsegment AS directory, c_mktsegment IN ('AUTOMOBILE', 'BUILDING') AS valid, count(*) AS mentions FROM customer GROUP BY 1",
)
def directory_list_checked(spark, d):
    """Listed directories looked up in the file system by tasks: two exist, one is a file, the others are not there."""
    from ..session import scratch_dir
    from ..sources import catalog as catalog_source
    from ..sources.files import filesystem, open_output, plain_path

    folder = plain_path(scratch_dir(spark, "listed"))
    for name in ("AUTOMOBILE", "BUILDING"):
        system, inner, _ = filesystem(f"{folder}/{name}")
        system.create_dir(inner, recursive=True)
    with open_output(f"{folder}/FURNITURE") as f:
        f.write(b"a file, not a directory")
    sheet = rs.with_row_index(V.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"])
    entry = F.concat(F.lit(f"{folder}/./"), F.col("c_mktsegment"), F.lit("//x/../\t"))
    cells = rs.to_cells(sheet.select("row", entry.alias("entry")), columns=["entry"])
    checked = catalog_source.existing(cat.directory_entries(cells))
    return checked.select(paths.base_name("directory").alias("directory"), "valid", "mentions")


@register(
    "absolute_paths",
    with_ctes("SELECT file_path, file_path AS one_slash, file_path AS three_slashes, replace(file_path, '/', '\\') AS windows, "
              "file_path AS posix FROM files", files=SQL_FILES),
)
def absolute_paths(spark, d):
    """Listing URIs in their usual forms, and separators of the other kind, as plain paths."""
    backslashes = F.translate("file_path", "/", "\\")
    return V.files(spark, d).select(
        "file_path", paths.absolute(F.concat(F.lit("file:"), "file_path")).alias("one_slash"),
        paths.absolute(F.concat(F.lit("file://"), "file_path")).alias("three_slashes"),
        backslashes.alias("windows"), paths.posix(backslashes).alias("posix"))


# ---------------------------------------------------------------------------
# reshape


@register(
    "row_index",
    "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT)"
    " AS row FROM orders",
)
def row_index(spark, d):
    o = V.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return rs.with_row_index(o, ["o_orderkey"], ["o_custkey"], name="row")


def _customer_with_nulls(spark, d):
    c = V.table(spark, d, "customer")
    return c.select(
        "c_custkey",
        "c_name",
        "c_nationkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment"),
    )


SQL_CUSTOMER_NULLS = (
    "SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS row, "
    "CAST(c_custkey AS VARCHAR) AS v1, c_name AS v2, CAST(c_nationkey AS VARCHAR) AS v3, "
    "CASE WHEN c_acctbal >= 0 THEN " + V.sql_number_text("c_acctbal") + " END AS v4, "
    "nullif(c_mktsegment, 'BUILDING') AS v5 FROM customer"
)


def _sql_unpivot(src: str, n: int, file_path: str, worksheet: str, named: bool = False) -> str:
    file_name = file_path.rsplit("/", 1)[-1]
    parts = []
    for i in range(1, n + 1):
        col = f"'column_{i}'" if named else f"CAST({i} AS BIGINT)"
        parts.append(
            f"SELECT '{file_path}' AS file_path, '{file_name}' AS file_name, '{worksheet}' AS worksheet, row, "
            f"{col} AS \"column\", v{i} AS value FROM {src}"
        )
    return " UNION ALL ".join(parts)


@register(
    "unpivot_wide_to_long",
    with_ctes(_sql_unpivot("w", 5, "/data/SOV/customer.xlsx", "customer"), w=SQL_CUSTOMER_NULLS),
)
def unpivot_wide_to_long(spark, d):
    c = rs.with_row_index(_customer_with_nulls(spark, d), ["c_custkey"])
    return rs.to_cells(
        c,
        lineage={
            "file_path": F.lit("/data/SOV/customer.xlsx"),
            "file_name": F.lit("customer.xlsx"),
            "worksheet": F.lit("customer"),
        },
        columns=["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    )


@register("unpivot_named_columns", "SELECT * FROM " + V.sql_sheet_cells("supplier", column_as="name"))
def unpivot_named_columns(spark, d):
    return V.sheet_cells(spark, d, "supplier", column_as="name")


@register("cells_schema", with_ctes("SELECT * FROM cells", cells=SQL_CELLS))
def cells_schema(spark, d):
    return V.cells(spark, d)


SQL_SUPPLIER_CELLS = "SELECT * FROM " + V.sql_sheet_cells("supplier")
SQL_PIVOT_SUPPLIER = (
    "SELECT file_path, worksheet, row, "
    + ", ".join(f"max(CASE WHEN \"column\" = {i} THEN value END) AS column_{i}" for i in range(1, 5))
    + " FROM sc GROUP BY file_path, worksheet, row"
)


@register("pivot_back", with_ctes(SQL_PIVOT_SUPPLIER, sc=SQL_SUPPLIER_CELLS))
def pivot_back(spark, d):
    return rs.to_wide(V.sheet_cells(spark, d, "supplier"), n_columns=4)


SQL_SUPPLIER_TEXT = (
    "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS row, CAST(s_suppkey AS VARCHAR) AS column_1,"
    " s_name AS column_2, CAST(s_nationkey AS VARCHAR) AS column_3, " + V.sql_number_text("s_acctbal")
    + " AS column_4 FROM supplier"
)


@register(
    "roundtrip_check",
    with_ctes(
        "SELECT (SELECT COUNT(*) FROM orig) AS n_rows, "
        "(SELECT COUNT(*) FROM (SELECT * FROM orig EXCEPT ALL SELECT * FROM back)) AS n_missing, "
        "(SELECT COUNT(*) FROM (SELECT * FROM back EXCEPT ALL SELECT * FROM orig)) AS n_extra",
        sc=SQL_SUPPLIER_CELLS,
        orig=SQL_SUPPLIER_TEXT,
        back="SELECT row, column_1, column_2, column_3, column_4 FROM (" + SQL_PIVOT_SUPPLIER + ")",
    ),
)
def roundtrip_check(spark, d):
    s = V.table(spark, d, "supplier")
    types = dict((f.name, f.dataType) for f in s.schema.fields)
    cols = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
    orig = rs.with_row_index(s.select(*cols), ["s_suppkey"]).select(
        "row", *[as_text(F.col(c), types[c]).alias(f"column_{i}") for i, c in enumerate(cols, start=1)]
    )
    back = rs.to_wide(V.sheet_cells(spark, d, "supplier"), n_columns=4).drop("file_path", "worksheet")
    # one shuffle of both sides: how often each row is in either
    sides = orig.withColumn("side", F.lit(1)).unionByName(back.withColumn("side", F.lit(-1)))
    surplus = sides.groupBy(*orig.columns).agg(
        F.sum("side").alias("surplus"), F.count(F.when(F.col("side") > 0, 1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    return surplus.agg(
        F.coalesce(F.sum("n"), zero).alias("n_rows"),
        F.coalesce(F.sum(F.greatest("surplus", zero)), zero).alias("n_missing"),
        F.coalesce(F.sum(F.greatest(-F.col("surplus"), zero)), zero).alias("n_extra"),
    )


# A sheet of 5,000 columns: each order's customer under its place among the order keys.
WIDE = 5_000


@register(
    "wide_roundtrip",
    f"SELECT CAST(o_orderkey // {WIDE} AS BIGINT) AS row, CAST(o_orderkey % {WIDE} + 1 AS BIGINT) AS \"column\", "
    "CAST(o_custkey AS VARCHAR) AS value FROM orders",
)
def wide_roundtrip(spark, d):
    """Cells of a sheet of 5,000 columns, pivoted to wide and unpivoted again; empty places left out."""
    from ..session import cut_lineage

    cells = V.table(spark, d, "orders").select(
        F.floor(F.col("o_orderkey") / WIDE).alias("row"), (F.col("o_orderkey") % WIDE + 1).cast("bigint").alias("column"),
        F.col("o_custkey").cast("string").alias("value"))
    wide = cut_lineage(rs.to_wide(cells, index=["row"], n_columns=WIDE))  # stored, as a wide sheet would be
    return rs.to_cells(wide).where(F.col("value").isNotNull()).select("row", "column", "value")


# Supplier sheet whose rows of suppliers in debt are blank, plus a blank third column.
def _blanked_supplier(spark, d):
    s = V.table(spark, d, "supplier")
    blank = F.col("s_acctbal") < 0
    keep = lambda c: F.when(~blank, F.col(c))
    return s.select(
        "s_suppkey",
        keep("s_suppkey").alias("k"),
        keep("s_name").alias("name"),
        F.lit(None).cast("string").alias("empty"),
        keep("s_nationkey").alias("nation"),
        keep("s_acctbal").alias("acctbal"),
    )


SQL_BLANK_SHEET = (
    "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS row, "
    "CASE WHEN s_acctbal >= 0 THEN CAST(s_suppkey AS VARCHAR) END AS v1, "
    "CASE WHEN s_acctbal >= 0 THEN s_name END AS v2, CAST(NULL AS VARCHAR) AS v3, "
    "CASE WHEN s_acctbal >= 0 THEN CAST(s_nationkey AS VARCHAR) END AS v4, "
    "CASE WHEN s_acctbal >= 0 THEN " + V.sql_number_text("s_acctbal") + " END AS v5 FROM supplier"
)


@register(
    "drop_blank_rows_cols",
    with_ctes(
        "SELECT sc.file_path, sc.file_name, sc.worksheet, nr.new_row AS row, nc.new_col AS \"column\", sc.value "
        "FROM sc JOIN nr ON sc.file_path = nr.file_path AND sc.worksheet = nr.worksheet AND sc.row = nr.row "
        "JOIN nc ON sc.file_path = nc.file_path AND sc.worksheet = nc.worksheet AND sc.\"column\" = nc.\"column\"",
        w=SQL_BLANK_SHEET,
        sc=_sql_unpivot("w", 5, "/data/SOV/supplier_blank.xlsx", "supplier"),
        nr="SELECT file_path, worksheet, row, CAST(row_number() OVER (PARTITION BY file_path, worksheet ORDER BY row)"
        " - 1 AS BIGINT) AS new_row FROM sc GROUP BY file_path, worksheet, row HAVING bool_or(value IS NOT NULL)",
        nc="SELECT file_path, worksheet, \"column\", CAST(row_number() OVER (PARTITION BY file_path, worksheet "
        "ORDER BY \"column\") AS BIGINT) AS new_col FROM sc GROUP BY file_path, worksheet, \"column\" "
        "HAVING bool_or(value IS NOT NULL)",
    ),
)
def drop_blank_rows_cols(spark, d):
    sheet = rs.with_row_index(_blanked_supplier(spark, d), ["s_suppkey"])
    c = rs.to_cells(
        sheet,
        lineage={
            "file_path": F.lit("/data/SOV/supplier_blank.xlsx"),
            "file_name": F.lit("supplier_blank.xlsx"),
            "worksheet": F.lit("supplier"),
        },
        columns=["k", "name", "empty", "nation", "acctbal"],
    )
    return rs.drop_blank(c)


# ---------------------------------------------------------------------------
# cells


@register(
    "empty_sheet_skip",
    "SELECT 'customer_' || CAST(c.c_custkey AS VARCHAR) AS worksheet, CAST(3 * COUNT(o.o_orderkey) AS BIGINT) AS n_cells,"
    " CASE WHEN COUNT(o.o_orderkey) = 0 THEN 'empty' ELSE 'converted' END AS status "
    "FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 40 "
    "GROUP BY c.c_custkey",
)
def empty_sheet_skip(spark, d):
    """One workbook, one sheet per customer holding its large orders; customers without any are empty sheets."""
    balance = V.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    o = V.table(spark, d, "orders").join(balance, "o_custkey").where(F.col("o_totalprice") > F.col("c_acctbal") * 40).select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    indexed = rs.with_row_index(o, ["o_orderkey"], ["o_custkey"])
    cells = rs.to_cells(
        indexed,
        lineage={
            "file_path": F.lit("/data/SOV/orders_by_customer.xlsx"),
            "file_name": F.lit("orders_by_customer.xlsx"),
            "worksheet": F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")),
        },
        columns=["o_orderkey", "o_orderstatus", "o_totalprice"],
    )
    sheets = V.table(spark, d, "customer").select(
        F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("worksheet")
    )
    return cl.sheet_status(sheets, cells)


@register("worksheet_filter", with_ctes("SELECT * FROM cells WHERE worksheet = 'nation'", cells=SQL_CELLS))
def worksheet_filter(spark, d):
    return cl.select(V.stored_cells(spark, d), worksheet="nation")


@register(
    "header_row",
    with_ctes(
        "SELECT file_path, worksheet, \"column\", value FROM cells WHERE row = 0 "
        "ORDER BY file_path, worksheet, \"column\"",
        cells=SQL_CELLS,
    ),
)
def header_row(spark, d):
    return cl.header_row(V.stored_cells(spark, d))


@register(
    "cells_per_file",
    with_ctes("SELECT file_path, COUNT(*) AS n_cells FROM cells GROUP BY file_path", cells=SQL_CELLS),
)
def cells_per_file(spark, d):
    return cl.cells_per_file(V.cells(spark, d))


@register("processed_paths", with_ctes("SELECT DISTINCT file_path FROM cells", cells=SQL_CELLS))
def processed_paths(spark, d):
    return cl.processed_paths(V.stored_cells(spark, d))


PROCESSED_BALANCE = 5000


def _previous_output(spark, d):
    """Cells written by an earlier run: the files of customers with a balance over 5,000, one row each."""
    c = V.catalog(spark, d).join(
        V.table(spark, d, "customer").where(F.col("c_acctbal") > PROCESSED_BALANCE).select("c_custkey"),
        "c_custkey", "left_semi",
    )
    return rs.to_cells(
        c.select("file_path", F.lit(0).alias("row"), "extension", "size"),
        lineage={"file_path": "file_path", "file_name": paths.base_name("file_path"), "worksheet": F.lit("Sheet1")},
        columns=["extension", "size"],
    )


@register(
    "skip_processed",
    with_ctes(
        "SELECT file_path, extension FROM catalog c WHERE NOT EXISTS "
        "(SELECT 1 FROM catalog p JOIN customer k ON k.c_custkey = p.c_custkey "
        f"WHERE k.c_acctbal > {PROCESSED_BALANCE} AND p.file_path = c.file_path)",
        **CAT,
    ),
)
def skip_processed(spark, d):
    from ..sources import ingest

    done = cl.processed_paths(_previous_output(spark, d))
    return ingest.skip_processed(V.catalog(spark, d), done).select("file_path", "extension")


@register(
    "existing_files",
    with_ctes(
        "SELECT file_path, extension FROM catalog c WHERE EXISTS "
        "(SELECT 1 FROM files f JOIN customer k ON k.c_custkey = f.c_custkey "
        "WHERE k.c_acctbal >= 0 AND f.file_path = c.file_path)",
        **CAT,
    ),
)
def existing_files(spark, d):
    from ..sources import ingest

    # files of customers in debt were removed since the catalog was made
    listing = V.files(spark, d).join(
        V.table(spark, d, "customer").where(F.col("c_acctbal") >= 0).select("c_custkey"), "c_custkey", "left_semi"
    )
    return ingest.only_existing(V.catalog(spark, d), listing).select("file_path", "extension")


SQL_DECODED = (
    "SELECT 'cell' AS kind, file_path, worksheet FROM cells UNION ALL "
    "SELECT 'error' AS kind, file_path, NULL AS worksheet FROM catalog "
    "WHERE extension NOT IN ('.xlsx', '.xlsm')"
)


@register(
    "run_stats",
    with_ctes(
        "SELECT file_path, COUNT(DISTINCT file_path) AS files, "
        "COUNT(DISTINCT CASE WHEN kind = 'cell' THEN file_path || '/' || worksheet END) AS sheets, "
        "COUNT(CASE WHEN kind = 'cell' THEN 1 END) AS rows, COUNT(CASE WHEN kind = 'error' THEN 1 END) AS errors "
        "FROM decoded GROUP BY ROLLUP (file_path)",
        cells=SQL_CELLS, files=SQL_FILES, catalog=SQL_CATALOG, decoded=SQL_DECODED,
    ),
)
def run_stats(spark, d):
    from ..sources import ingest

    cells = V.cells(spark, d).select(F.lit("cell").alias("kind"), "file_path", "worksheet")
    errors = (
        V.catalog(spark, d)
        .where(paths.reader_for("extension") == "unsupported")
        .select(F.lit("error").alias("kind"), "file_path", F.lit(None).cast("string").alias("worksheet"))
    )
    return ingest.file_stats(cells.unionByName(errors))


@register(
    "output_summary",
    with_ctes(
        "SELECT file_path || '#' || worksheet AS output_file, "
        "round(CAST(SUM(strlen(coalesce(value, ''))) AS DOUBLE) / CAST(1024 AS DOUBLE), 1) AS size_kb, "
        "COUNT(*) AS n_rows, min(file_name) AS source_file FROM cells GROUP BY 1 ORDER BY 1 LIMIT 50",
        cells=SQL_CELLS,
    ),
)
def output_summary(spark, d):
    return cl.output_summary(V.stored_cells(spark, d))


@register(
    "preview_head",
    with_ctes(
        "SELECT substr(file_path, 1, 40) AS file_path, worksheet, row, \"column\", substr(value, 1, 30) AS value "
        "FROM cells WHERE file_path = '/data/SOV/customer.xlsx' ORDER BY worksheet, row, \"column\" LIMIT 10",
        cells=SQL_CELLS,
    ),
)
def preview_head(spark, d):
    return cl.preview(V.stored_cells(spark, d), "/data/SOV/customer.xlsx")


@register(
    "cells_per_worksheet",
    with_ctes("SELECT worksheet, COUNT(*) AS n_cells FROM cells GROUP BY worksheet", cells=SQL_CELLS),
)
def cells_per_worksheet(spark, d):
    return V.cells(spark, d).groupBy("worksheet").agg(F.count(F.lit(1)).alias("n_cells"))


# ---------------------------------------------------------------------------
# change detection


@register("content_hash", "SELECT page_id, sha256(html) AS file_hash FROM pages")
def content_hash(spark, d):
    p = V.table(spark, d, "pages")
    return p.select("page_id", ch.content_hash("html").alias("file_hash"))


# Two catalog versions of the pages: pages with an anchor (#) were added after
# the old one, pages with a query (?) removed since; English and French pages
# were touched (new time) and the French ones really changed.
def _page_versions(spark, d):
    p = V.table(spark, d, "pages").select("page_id", "url", "html")
    key = F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("file_path")
    base = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id"))
    changed = F.col("url").contains("/fr/")
    touched = changed | F.col("url").contains("/en/")
    old = p.where(~F.col("url").contains("#")).select(
        key, base.alias("modified_at"), ch.content_hash("html").alias("file_hash")
    )
    new = p.where(~F.col("url").contains("?")).select(
        key,
        F.when(touched, base + F.expr("INTERVAL 1 DAY")).otherwise(base).alias("modified_at"),
        F.when(changed, F.concat("html", F.lit(" "))).otherwise(F.col("html")).alias("content"),
    )
    return old, new


@register(
    "change_status",
    "WITH o AS (SELECT 'page_' || CAST(page_id AS VARCHAR) AS file_path, page_id AS m, sha256(html) AS h "
    "FROM pages WHERE NOT contains(url, '#')), "
    "n AS (SELECT 'page_' || CAST(page_id AS VARCHAR) AS file_path, "
    "page_id + CASE WHEN contains(url, '/fr/') OR contains(url, '/en/') THEN 86400 ELSE 0 END AS m, "
    "CASE WHEN contains(url, '/fr/') THEN html || ' ' ELSE html END AS content FROM pages "
    "WHERE NOT contains(url, '?')) "
    "SELECT coalesce(o.file_path, n.file_path) AS file_path, "
    "CASE WHEN o.file_path IS NULL THEN 'new' WHEN n.file_path IS NULL THEN 'missing' "
    "WHEN o.m = n.m THEN 'unchanged' WHEN sha256(n.content) = o.h THEN 'unchanged' ELSE 'modified' END AS status "
    "FROM o FULL OUTER JOIN n ON o.file_path = n.file_path",
)
def change_status(spark, d):
    old, new = _page_versions(spark, d)
    return ch.status(old, new).select("file_path", "status")


@register(
    "latest_version",
    "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS version, event_type, value FROM ("
    "SELECT *, max(ts) OVER (PARTITION BY user_id) AS mx FROM events) WHERE ts = mx",
)
def latest_version(spark, d):
    e = V.table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    top = ch.latest(e, "user_id", "ts")
    return top.select(
        "event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("version"), "event_type",
        "value",
    )


# ---------------------------------------------------------------------------
# themed sheets (one themed row per order)

SQL_MIX = "((o_orderkey * 7919) % 1000003)"
SQL_INVOICE_AMOUNT = f"CAST(CAST(10000 + {SQL_MIX} % 990000 AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2))"


@register(
    "synth_theme_rules",
    "SELECT source_key, Invoice_ID, Customer_Name, Invoice_Date, Due_Date, Amount, Tax, "
    "CAST(Amount + Tax AS DECIMAL(18,2)) AS Total, Status, Payment_Method FROM ("
    "SELECT o_orderkey AS source_key, 'INV-' || CAST(10000 + o_orderkey % 90000 AS VARCHAR) AS Invoice_ID, "
    "'Customer#' || CAST(o_custkey AS VARCHAR) AS Customer_Name, CAST(o_orderdate AS DATE) AS Invoice_Date, "
    "CAST(o_orderdate AS DATE) + 30 AS Due_Date, " + SQL_INVOICE_AMOUNT + " AS Amount, "
    "CAST(" + SQL_INVOICE_AMOUNT + " * 0.08 AS DECIMAL(18,2)) AS Tax, "
    "CASE o_orderkey % 4 WHEN 0 THEN 'Paid' WHEN 1 THEN 'Pending' WHEN 2 THEN 'Overdue' ELSE 'Cancelled' END"
    " AS Status, CASE o_custkey % 4 WHEN 0 THEN 'Credit Card' WHEN 1 THEN 'Bank Transfer' WHEN 2 THEN 'Check' "
    "ELSE 'Cash' END AS Payment_Method FROM orders)",
)
def synth_theme_rules(spark, d):
    t = synth.theme(V.table(spark, d, "orders"), "financial_invoices")
    return t.withColumnRenamed("_seed", "source_key")


OFFSET_START_ROW = 5
OFFSET_GENERATED = "2024-01-01 00:00"
OFFSET_FILE = "/data/SOV/test_08_sales_orders.xlsx"


def _sql_money_text(expr: str) -> str:
    s = f"CAST({expr} AS VARCHAR)"
    return f"regexp_replace(regexp_replace({s}, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


SQL_PRICE = f"CAST(CAST(1000 + {SQL_MIX} % 49000 AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2))"
SQL_OFFSET_WIDE = (
    "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 + 4 AS BIGINT) AS row, "
    "'ORD-' || CAST(10000 + o_orderkey % 90000 AS VARCHAR) AS v1, 'Customer#' || CAST(o_custkey AS VARCHAR) AS v2, "
    "strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS v3, 'Product ' || CAST(o_orderkey % 1000 AS VARCHAR) AS v4, "
    "CAST(1 + o_orderkey % 100 AS VARCHAR) AS v5, " + _sql_money_text(SQL_PRICE) + " AS v6, "
    + _sql_money_text(f"CAST((1 + o_orderkey % 100) * {SQL_PRICE} AS DECIMAL(18,2))") + " AS v7, "
    "CASE o_orderkey % 4 WHEN 0 THEN 'Standard' WHEN 1 THEN 'Express' WHEN 2 THEN 'Overnight' "
    "ELSE 'International' END AS v8, "
    "CASE o_custkey % 4 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Shipped' WHEN 2 THEN 'Delivered' ELSE 'Cancelled' END"
    " AS v9 FROM orders"
)


def _sql_offset_fixed() -> str:
    fn = OFFSET_FILE.rsplit("/", 1)[-1]
    rows = []
    titles = ["'Sales Orders Report'", f"'Generated: {OFFSET_GENERATED}'",
              "'Total Records: ' || CAST((SELECT COUNT(*) FROM orders) AS VARCHAR)"]
    for i, t in enumerate(titles):
        for j in range(1, 10):
            v = t if j == 1 else "CAST(NULL AS VARCHAR)"
            rows.append(f"SELECT '{OFFSET_FILE}', '{fn}', 'Data', CAST({i} AS BIGINT), CAST({j} AS BIGINT), {v}")
    for j, h in enumerate(synth.HEADERS["sales_orders"], start=1):
        rows.append(f"SELECT '{OFFSET_FILE}', '{fn}', 'Data', CAST(3 AS BIGINT), CAST({j} AS BIGINT), '{h}'")
    return " UNION ALL ".join(rows)


@register(
    "synth_offset_sheet",
    with_ctes(
        "SELECT file_path, file_name, worksheet, row, \"column\", value FROM fixed UNION ALL "
        + _sql_unpivot("w", 9, OFFSET_FILE, "Data"),
        w=SQL_OFFSET_WIDE,
        fixed="SELECT * FROM (" + _sql_offset_fixed() + ") AS t(file_path, file_name, worksheet, row, \"column\", value)",
    ),
)
def synth_offset_sheet(spark, d):
    t = synth.theme(V.table(spark, d, "orders"), "sales_orders")
    return synth.offset_sheet(t, "sales_orders", OFFSET_START_ROW, OFFSET_FILE, generated=OFFSET_GENERATED)


# ---------------------------------------------------------------------------
# value text: what it says, read back, is the value itself


@register(
    "value_text_exact",
    "SELECT 'small' AS kind, l_orderkey AS id, l_linenumber AS part, (l_extendedprice * 1e-9) * 1e15 AS value, "
    "CAST(NULL AS VARCHAR) AS moment, true AS plain FROM lineitem UNION ALL "
    "SELECT 'large', l_orderkey, l_linenumber, (l_extendedprice * 1e30) * 1e-28, NULL, true FROM lineitem UNION ALL "
    "SELECT 'time', event_id, 0, NULL, strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), true FROM events",
)
def value_text_exact(spark, d):
    """Doubles far from 1 and timestamps as text; the text has no exponent and, cast back, is the source."""
    li, ev = V.table(spark, d, "lineitem"), V.table(spark, d, "events")
    double = li.schema["l_extendedprice"].dataType

    def numbers(kind, factor, scale):
        text = as_text(F.col("l_extendedprice") * F.lit(factor), double)
        return li.select(
            F.lit(kind).alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("part"),
            (text.cast("double") * F.lit(scale)).alias("value"), F.lit(None).cast("string").alias("moment"),
            text.rlike(r"^-?[0-9]+(\.[0-9]*[1-9])?$").alias("plain"))

    stamp = as_text("ts", ev.schema["ts"].dataType)
    times = ev.select(
        F.lit("time").alias("kind"), F.col("event_id").alias("id"), F.lit(0).cast(li.schema["l_linenumber"].dataType).alias("part"),
        F.lit(None).cast("double").alias("value"),
        F.date_format(stamp.cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment"),
        stamp.rlike(r"^[0-9-]{10} [0-9:]{8}(\.[0-9]*[1-9])?$").alias("plain"))
    return numbers("small", 1e-9, 1e15).unionByName(numbers("large", 1e30, 1e-28)).unionByName(times)


# ---------------------------------------------------------------------------
# end to end: workbooks written by Spark from a table, then scanned and ingested

WORKBOOK_ROWS = 50


@register(
    "ingest_workbooks",
    with_ctes(
        "SELECT file_name, 'customers' AS worksheet, CAST(0 AS BIGINT) AS row, CAST(1 AS BIGINT) AS \"column\", "
        "'c_custkey' AS value FROM h UNION ALL "
        "SELECT file_name, 'customers', CAST(0 AS BIGINT), CAST(2 AS BIGINT), 'c_name' FROM h UNION ALL "
        "SELECT file_name, 'customers', CAST(0 AS BIGINT), CAST(3 AS BIGINT), 'c_acctbal' FROM h UNION ALL "
        "SELECT file_name, 'customers', row, CAST(1 AS BIGINT), v1 FROM w UNION ALL "
        "SELECT file_name, 'customers', row, CAST(2 AS BIGINT), v2 FROM w UNION ALL "
        "SELECT file_name, 'customers', row, CAST(3 AS BIGINT), v3 FROM w",
        c="SELECT c_custkey, c_name, c_acctbal, c_nationkey, "
        "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer",
        w=f"SELECT 'nation_' || CAST(c_nationkey AS VARCHAR) || '_part_' || CAST(i // {WORKBOOK_ROWS} + 1 AS VARCHAR)"
        f" || '.xlsx' AS file_name, CAST(i % {WORKBOOK_ROWS} + 1 AS BIGINT) AS row, CAST(c_custkey AS VARCHAR) AS v1,"
        " c_name AS v2, " + V.sql_number_text("c_acctbal") + " AS v3 FROM c",
        h="SELECT DISTINCT file_name FROM w",
    ),
)
def ingest_workbooks(spark, d):
    """Customers of each nation written as workbooks (50 rows each), then catalog scan + ingest + cells."""
    from ..session import scratch_dir
    from ..sources import catalog as catalog_source
    from ..sources import cells_io, ingest

    folder, out = scratch_dir(spark, "workbooks"), scratch_dir(spark, "ingest")
    c = V.table(spark, d, "customer")
    synth.write_workbooks(
        c, folder, F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")), ["c_custkey"],
        ["c_custkey", "c_name", "c_acctbal"], sheet="customers", rows_per_file=WORKBOOK_ROWS,
    )
    ingest.run(spark, catalog_source.scan(spark, [folder]), out, path_rule=None)
    return cells_io.read_cells(spark, out).select("file_name", "worksheet", "row", "column", "value")


# Written workbooks, by number of the nation modulo 5: left as they are, a row's tag broken, a value changed under its
# checksum, plain text in place of the workbook, a sheet without rows.
SPOILED = ("good", "torn", "altered", "text", "empty")


def _spoil(batches):
    """Workbooks (path, kind) in; their bytes changed as the kind says."""
    import io
    import zipfile

    from ..sources.files import open_input, open_output

    for batch in batches:
        for path, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if kind == "good":
                continue
            with open_input(path) as f:
                book = zipfile.ZipFile(io.BytesIO(f.read()))
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                for name in book.namelist():
                    data = book.read(name)
                    if name.startswith("xl/worksheets/"):
                        if kind == "torn":
                            at = data.rindex(b"<row")
                            data = data[:at] + data[at:].replace(b"</c>", b"</d>", 1)
                        elif kind == "empty":
                            data = data[:data.index(b"<row")] + data[data.index(b"</sheetData"):]
                    z.writestr(name, data)
            data = out.getvalue()
            if kind == "altered":
                at = data.index(b"<v>", data.index(b'r="2"')) + 3
                data = data[:at] + (b"7" if data[at:at + 1] != b"7" else b"8") + data[at + 1:]
            with open_output(path) as f:
                f.write(b"this is not a workbook" if kind == "text" else data)
        yield batch


def _spoiled(written):
    nation = F.regexp_extract("file_path", r"nation_(\d+)_", 1).cast("int")
    kind = F.element_at(F.array(*[F.lit(k) for k in SPOILED]), F.pmod(nation, F.lit(5)) + 1)
    return written.select("file_path", kind.alias("kind")).mapInArrow(_spoil, "file_path string, kind string")


_SQL_PARTS = (
    "SELECT n AS nation, p + 1 AS part, least(" + str(WORKBOOK_ROWS) + ", c - p * " + str(WORKBOOK_ROWS) + ") AS rows FROM ("
    "SELECT c_nationkey AS n, count(*) AS c, unnest(range((count(*) + " + str(WORKBOOK_ROWS - 1) + ") // " + str(WORKBOOK_ROWS) + ")) AS p"
    " FROM customer GROUP BY c_nationkey)"
)


def _customer_workbooks(spark, d, folder):
    """Customers of each nation as workbooks of 50 rows: number, name and balance under a header row."""
    return synth.write_workbooks(
        V.table(spark, d, "customer"), folder, F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")), ["c_custkey"],
        ["c_custkey", "c_name", "c_acctbal"], sheet="customers", rows_per_file=WORKBOOK_ROWS)


@register(
    "ingest_faults",
    with_ctes(
        "SELECT cut, 'nation_' || nation || '_part_' || part || '.xlsx' AS file_name, "
        "CASE nation % 5 WHEN 0 THEN 'ok' WHEN 4 THEN 'empty' ELSE 'error' END AS status, "
        "CAST(CASE WHEN nation % 5 IN (0, 4) THEN 1 ELSE 0 END AS BIGINT) AS n_sheets, "
        "CAST(CASE nation % 5 WHEN 0 THEN 3 * (rows + 1) ELSE 0 END AS BIGINT) AS n_cells, "
        "CAST(CASE WHEN nation % 5 IN (0, 4) THEN 0 ELSE 1 END AS BIGINT) AS n_errors, "
        "CAST(CASE nation % 5 WHEN 0 THEN 3 * (rows + 1) ELSE 0 END AS BIGINT) AS stored_cells "
        "FROM parts, (VALUES ('whole'), ('ranges')) AS t(cut)",
        parts=_SQL_PARTS,
    ),
)
def ingest_faults(spark, d):
    """Good, damaged, empty and non-workbook files converted whole and cut into small byte ranges: ledger and cells."""
    from ..session import scratch_dir, ship_package
    from ..sources import catalog as catalog_source
    from ..sources import cells_io, ingest

    folder = scratch_dir(spark, "faults")
    written = _customer_workbooks(spark, d, folder)
    ship_package(spark)
    _spoiled(written).count()
    listed = catalog_source.scan(spark, [folder])
    out = None
    for cut, options in (("whole", {}), ("ranges", {"split_file_bytes": 0, "split_xml_bytes": 0, "range_xml_bytes": 700})):
        to = scratch_dir(spark, "faults-out")
        ingest.run(spark, listed, to, path_rule=None, **options)
        stored = cells_io.read_cells(spark, to).groupBy("file_path").agg(F.count("*").alias("stored"))
        one = cells_io.read_ledger(spark, f"{to}/ledger").join(stored, "file_path", "left").select(
            F.lit(cut).alias("cut"), paths.base_name("file_path").alias("file_name"), "status", "n_sheets", "n_cells", "n_errors",
            F.coalesce("stored", F.lit(0).cast("bigint")).alias("stored_cells"))
        out = one if out is None else out.unionByName(one)
    return out


def _widened(batches):
    """Workbooks of one sheet get a second one with the same rows, an empty one and, by name, one that is torn."""
    import io
    import re
    import zipfile

    from ..sources.files import open_input, open_output

    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open_input(path) as f:
                book = zipfile.ZipFile(io.BytesIO(f.read()))
            parts = {name: book.read(name) for name in book.namelist()}
            sheet = parts["xl/worksheets/sheet1.xml"]
            bare = sheet[:sheet.index(b"<row")] + sheet[sheet.index(b"</sheetData"):]
            torn = sheet.replace(b"</row>", b"</rwo>", 1)
            odd = int(re.search(r"nation_(\d+)_", path)[1]) % 2
            more = [("again", sheet), ("bare", bare)] + [("torn", torn)] * odd
            sheets, rels = parts["xl/workbook.xml"], parts["xl/_rels/workbook.xml.rels"]
            kind = re.search(rb'Type="([^"]*/worksheet)"', rels)[1]
            for i, (name, xml) in enumerate(more, start=2):
                parts[f"xl/worksheets/sheet{i}.xml"] = xml
                sheets = sheets.replace(b"</sheets>", f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"/></sheets>'.encode())
                rels = rels.replace(b"</Relationships>", b'<Relationship Id="rId%d" Type="%s" Target="worksheets/sheet%d.xml"/></Relationships>'
                                    % (i, kind, i))
            parts["xl/workbook.xml"], parts["xl/_rels/workbook.xml.rels"] = sheets, rels
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, data in parts.items():
                    z.writestr(name, data)
            with open_output(path) as f:
                f.write(out.getvalue())
        yield batch


@register(
    "ingest_partial",
    with_ctes(
        "SELECT cut, 'nation_' || nation || '_part_' || part || '.xlsx' AS file_name, CASE nation % 2 WHEN 1 THEN 'partial' ELSE 'ok' END AS status, "
        "CAST(3 AS BIGINT) AS n_sheets, CAST(1 AS BIGINT) AS n_empty_sheets, CAST(6 * (rows + 1) AS BIGINT) AS n_cells, "
        "CAST(nation % 2 AS BIGINT) AS n_errors, CASE nation % 2 WHEN 1 THEN 'torn' END AS failed_sheets, "
        "CAST(3 * (rows + 1) AS BIGINT) AS again_cells FROM parts, (VALUES ('whole'), ('sheets'), ('parts')) AS t(cut)",
        parts=_SQL_PARTS,
    ),
)
def ingest_partial(spark, d):
    """Workbooks of three good or empty sheets, every other with a torn one too, read whole, by sheet and in parts of a sheet."""
    from ..session import scratch_dir, ship_package
    from ..sources import catalog as catalog_source
    from ..sources import cells_io, ingest

    folder = scratch_dir(spark, "partial")
    ship_package(spark)
    _customer_workbooks(spark, d, folder).select("file_path").mapInArrow(_widened, "file_path string").count()
    listed = catalog_source.scan(spark, [folder])
    out = None
    for cut, options in (("whole", {}), ("sheets", {"split_file_bytes": 0, "split_xml_bytes": 0}),
                         ("parts", {"split_file_bytes": 0, "split_xml_bytes": 0, "range_xml_bytes": 700})):
        to = scratch_dir(spark, "partial-out")
        run_id = ingest.run(spark, listed, to, path_rule=None, **options)["run_id"]
        again = cells_io.read_cells(spark, to).where("worksheet = 'again'").groupBy("file_path").agg(F.count("*").alias("again_cells"))
        failed = spark.read.parquet(f"{to}/runs/run_id={run_id}/kind=error").groupBy("file_path").agg(
            F.array_join(F.sort_array(F.collect_list("worksheet")), ",").alias("failed_sheets"))
        one = cells_io.read_ledger(spark, f"{to}/ledger").join(again, "file_path", "left").join(failed, "file_path", "left").select(
            F.lit(cut).alias("cut"), paths.base_name("file_path").alias("file_name"), "status", "n_sheets", "n_empty_sheets", "n_cells",
            "n_errors", "failed_sheets", "again_cells")
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "flat_folder",
    "SELECT 'c_' || CAST(c_custkey AS VARCHAR) || '.xlsx' AS file_name, CAST(octet_length(encode(c_name)) AS BIGINT) AS size, true AS timed "
    "FROM customer",
)
def flat_folder(spark, d):
    """One folder with a file for each customer: read as a stream of names, looked up by all tasks."""
    from ..session import scratch_dir, ship_package
    from ..sources import catalog as catalog_source
    from ..sources.files import plain_path

    folder = plain_path(scratch_dir(spark, "flat"))
    ship_package(spark)

    def written(batches):
        from ..sources.files import open_output

        for batch in batches:
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_output(f"{folder}/c_{key}.xlsx") as f:
                    f.write(name.encode())
            yield batch.select(["c_custkey"])

    V.table(spark, d, "customer").select("c_custkey", "c_name").repartition(8).mapInArrow(written, "c_custkey bigint").count()
    return catalog_source.scan(spark, [folder]).select(
        paths.base_name("file_path").alias("file_name"), "size", F.col("modified_at").isNotNull().alias("timed"))


@register(
    "catalog_store",
    with_ctes(
        "SELECT step, root, CAST(CASE WHEN step = 'rescan' AND root = 'even' THEN n + 1 ELSE n END AS BIGINT) AS n_files FROM "
        "(SELECT CASE nation % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS root, count(*) AS n FROM parts GROUP BY 1) n, "
        "(VALUES ('first', 'even'), ('cached and fresh', 'even'), ('cached and fresh', 'odd'), ('write cut off', 'even'), "
        "('write cut off', 'odd'), ('rescan', 'even'), ('rescan', 'odd')) AS t(step, asked) WHERE asked = root "
        "UNION ALL SELECT 'skipped', why, 1 FROM (VALUES ('does not exist'), ('is not a directory')) AS s(why)",
        parts=_SQL_PARTS,
    ),
)
def catalog_store(spark, d):
    """A store filled root by root, a later version that is cut off before it counts, a rescan; roots that are no directories."""
    from ..session import cut_lineage, scratch_dir
    from ..sources import catalog as catalog_source
    from ..sources.files import open_output, plain_path

    top, store = plain_path(scratch_dir(spark, "roots")), scratch_dir(spark, "store")
    pick = F.when(F.col("c_nationkey") % 2 == 0, "even/nation_").otherwise("odd/nation_")
    synth.write_workbooks(V.table(spark, d, "customer"), top, F.concat(pick, F.col("c_nationkey").cast("string")), ["c_custkey"],
                          ["c_custkey", "c_name"], sheet="customers", rows_per_file=WORKBOOK_ROWS)
    even, odd = f"{top}/even", f"{top}/odd"
    with open_output(f"{top}/file.xls") as f:
        f.write(b"not a root")
    out = None

    def add(step, listed):
        nonlocal out
        one = cut_lineage(listed.groupBy(paths.base_name("root").alias("root")).agg(F.count("*").alias("n_files")).withColumn("step", F.lit(step)))
        out = one if out is None else out.unionByName(one)

    roots = [even, f"{top}/nothing", f"{top}/file.xls"]
    add("first", catalog_source.load_or_scan(spark, roots, store))
    with open_output(f"{even}/late.xlsx") as f:
        f.write(b"added after the scan")
    add("cached and fresh", catalog_source.load_or_scan(spark, [even, odd], store))
    catalog_source.write_version(catalog_source.load(spark, store).where("root like '%odd'"), store, [odd])
    add("write cut off", catalog_source.load_or_scan(spark, [even, odd], store))
    add("rescan", catalog_source.load_or_scan(spark, [even, odd], store, rescan=True))
    _, skipped = catalog_source.check_roots(roots)
    reasons = literal_rows(spark, [(why, 1, "skipped") for _, why in skipped],
                           StructType.fromDDL("root string, n_files bigint, step string"))
    return out.unionByName(reasons).select("step", "root", "n_files")


@register(
    "footer_report",
    with_ctes(
        "SELECT 'customer' AS what, count(*) AS n_rows, min(c_name) AS least FROM customer UNION ALL "
        "SELECT 'part', count(*), min(p_name) FROM part UNION ALL SELECT 'pages', count(*), min(url) FROM pages UNION ALL "
        "SELECT 'written cells', count(*), min(file_name) FROM cells",
        cells=SQL_CELLS,
    ),
)
def footer_report(spark, d):
    """Rows and smallest text of Parquet files from their footers: given tables, and the cell files of an output."""
    from ..session import scratch_dir
    from ..sources import cells_io

    out = None
    for name, column in (("customer", "c_name"), ("part", "p_name"), ("pages", "url")):
        files = literal_rows(spark, [(f, None) for f in V.table(spark, d, name).inputFiles()], StructType.fromDDL("path string, size bigint"))
        one = cells_io.footers(files, column).agg(F.sum("n_rows").alias("n_rows"), F.min("least").alias("least")).withColumn("what", F.lit(name))
        out = one if out is None else out.unionByName(one)
    to = scratch_dir(spark, "footers")
    cells_io.write_cells(V.cells(spark, d), f"{to}/runs/run_id=one/kind=cell")
    written = cells_io.output_files_report(spark, to, limit=1 << 30).agg(
        F.sum("n_rows").alias("n_rows"), F.min("source_file").alias("least")).withColumn("what", F.lit("written cells"))
    return out.unionByName(written).select("what", "n_rows", "least")


@register(
    "empty_frames",
    with_ctes("SELECT 'cells' AS frame, worksheet AS key, count(*) AS n FROM cells GROUP BY worksheet UNION ALL "
              "SELECT 'catalog', extension, count(*) FROM catalog GROUP BY extension", cells=SQL_CELLS, **CAT),
)
def empty_frames(spark, d):
    """Frames without rows keep their schema: a union with them changes neither rows nor columns."""
    from .. import schema

    cells = schema.empty(spark, schema.CELLS).unionByName(V.cells(spark, d).select(*schema.CELL_COLUMNS))
    listed = schema.empty(spark, schema.CATALOG).unionByName(V.catalog(spark, d), allowMissingColumns=True)
    return cells.groupBy(F.col("worksheet").alias("key")).agg(F.count("*").alias("n")).withColumn("frame", F.lit("cells")).unionByName(
        listed.groupBy(F.col("extension").alias("key")).agg(F.count("*").alias("n")).withColumn("frame", F.lit("catalog"))).select(
        "frame", "key", "n")


# Folders that names make awkward, by number of the nation modulo 4.
AWKWARD = ("_x", ".y", "a [1]", "flat")


@register(
    "scan_tree",
    with_ctes(
        "SELECT kind, path FROM (SELECT 'file' AS kind, "
        "CASE nation % 4 WHEN 0 THEN '_x' WHEN 1 THEN '.y' WHEN 2 THEN 'a [1]' ELSE 'flat' END || '/nation_' || nation || "
        "'_part_' || part || '.xlsx' AS path FROM parts UNION ALL "
        "SELECT 'folder', unnest(['_x', '.y', 'a [1]', 'flat', 'SOV', 'SOV/z']) UNION ALL SELECT 'marker', 'SOV/z')",
        parts=_SQL_PARTS,
    ),
)
def scan_tree(spark, d):
    """Workbooks under hidden, bracketed and flat folders and a folder without files, listed on the executors."""
    from ..session import scratch_dir
    from ..sources import catalog as catalog_source
    from ..sources.files import filesystem, plain_path

    folder = plain_path(scratch_dir(spark, "tree"))
    pick = F.element_at(F.array(*[F.lit(k) for k in AWKWARD]), F.pmod(F.col("c_nationkey"), F.lit(4)).cast("int") + 1)
    synth.write_workbooks(
        V.table(spark, d, "customer"), folder, F.concat(pick, F.lit("/nation_"), F.col("c_nationkey").cast("string")), ["c_custkey"],
        ["c_custkey", "c_name"], sheet="customers", rows_per_file=WORKBOOK_ROWS)
    system, inner, _ = filesystem(f"{folder}/SOV/z")
    system.create_dir(inner, recursive=True)
    below = F.substring(F.col("path"), len(folder) + 2, 1_000)
    files = catalog_source.scan(spark, [folder]).select(F.lit("file").alias("kind"), F.col("file_path").alias("path"))
    dirs = catalog_source.folders(spark, [folder]).where(F.col("folder") != folder)
    marked = dirs.where(paths.under_marker("folder")).select(F.lit("marker").alias("kind"), F.col("folder").alias("path"))
    dirs = dirs.select(F.lit("folder").alias("kind"), F.col("folder").alias("path"))
    return files.unionByName(dirs).unionByName(marked).select("kind", below.alias("path"))


_SQL_TWICE = (
    "SELECT 'nation_' || nation || '_part_' || part || '.xlsx' AS file_name, "
    "CASE nation % 3 WHEN 0 THEN 'changed' WHEN 1 THEN 'touched' ELSE 'same' END AS state, "
    "CAST(CASE nation % 3 WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS runs, "
    "CAST(CASE nation % 3 WHEN 0 THEN 2 * (rows + 1) ELSE 3 * (rows + 1) END AS BIGINT) AS latest_cells, "
    "CAST(CASE nation % 3 WHEN 0 THEN 5 * (rows + 1) ELSE 3 * (rows + 1) END AS BIGINT) AS all_cells FROM parts"
)


def _written_again(spark, d, folder):
    """Workbooks of a third of the nations get other content, those of another third the same bytes at a later time."""
    c = V.table(spark, d, "customer")
    stem = F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"))
    third = F.pmod(F.col("c_nationkey"), F.lit(3))
    synth.write_workbooks(c.where(third == 0), folder, stem, ["c_custkey"], ["c_custkey", "c_name"], sheet="customers",
                          rows_per_file=WORKBOOK_ROWS)

    def copied(batches):
        from ..sources.files import open_input, open_output

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_input(path) as f:
                    data = f.read()
                with open_output(path) as f:
                    f.write(data)
            yield batch

    from ..sources import catalog as catalog_source

    nation = F.regexp_extract("file_path", r"nation_(\d+)_", 1).cast("int")
    catalog_source.list_files(spark, [folder]).where(F.pmod(nation, F.lit(3)) == 1).select("file_path").mapInArrow(
        copied, "file_path string").count()


@register("reconvert_modified", with_ctes(_SQL_TWICE, parts=_SQL_PARTS))
def reconvert_modified(spark, d):
    """Converted, changed and touched, converted again: runs of each file, cells of its latest version and of all."""
    from ..operators.changes import detect
    from ..session import cut_lineage, scratch_dir
    from ..sources import catalog as catalog_source
    from ..sources import cells_io, ingest

    folder, to = scratch_dir(spark, "changing"), scratch_dir(spark, "changing-out")
    _customer_workbooks(spark, d, folder)
    ingest.run(spark, catalog_source.scan(spark, [folder]), to, path_rule=None)
    before = cut_lineage(cells_io.read_ledger(spark, f"{to}/ledger").select("file_path", "modified_at", "file_hash"))
    _written_again(spark, d, folder)
    listed = cut_lineage(catalog_source.scan(spark, [folder]))
    status = detect(before, listed).select("file_path", "status")
    ingest.run(spark, listed, to, path_rule=None)
    touched = listed.select("file_path", F.col("modified_at").alias("now")).join(before, "file_path").where("now <> modified_at")
    state = status.join(touched.select("file_path", F.lit(True).alias("t")), "file_path", "left").select(
        "file_path", F.when(F.col("status") == "modified", "changed").when(F.col("t"), "touched").otherwise("same").alias("state"))
    runs = cells_io.read_ledger(spark, f"{to}/ledger").groupBy("file_path").agg(F.count("*").alias("runs"))
    latest = cells_io.read_cells(spark, to).groupBy("file_path").agg(F.count("*").alias("latest_cells"))
    every = cells_io.read_cells(spark, to, latest_only=False).groupBy("file_path").agg(F.count("*").alias("all_cells"))
    return state.join(runs, "file_path").join(latest, "file_path").join(every, "file_path").select(
        paths.base_name("file_path").alias("file_name"), "state", "runs", "latest_cells", "all_cells")


@register(
    "stream_incremental",
    with_ctes(
        "SELECT 'nation_' || nation || '_part_' || part || '.xlsx' AS file_name, "
        "CASE WHEN nation % 2 = 1 OR nation % 3 = 0 THEN 'second' ELSE 'first' END AS batch, "
        "CAST(CASE WHEN nation % 6 = 0 THEN 2 ELSE 1 END AS BIGINT) AS runs, "
        "CAST(CASE WHEN nation % 6 = 0 THEN 2 ELSE 3 END * (rows + 1) AS BIGINT) AS n_cells FROM parts",
        parts=_SQL_PARTS,
    ),
)
def stream_incremental(spark, d):
    """Two availableNow streams over a tree with hidden and bracketed folders; in between files are added and a third of them changed."""
    from ..session import scratch_dir
    from ..sources import cells_io
    from ..streaming.stream import ingest_stream

    folder, to, checkpoint = (scratch_dir(spark, f"stream{x}") for x in ("", "-out", "-checkpoint"))
    c, nation = V.table(spark, d, "customer"), F.col("c_nationkey")
    pick = F.element_at(F.array(*[F.lit(k) for k in AWKWARD]), F.pmod(nation, F.lit(4)).cast("int") + 1)
    stem = F.concat(pick, F.lit("/nation_"), nation.cast("string"))

    def written(which, columns):
        synth.write_workbooks(c.where(which), folder, stem, ["c_custkey"], columns, sheet="customers", rows_per_file=WORKBOOK_ROWS)

    written(nation % 2 == 0, ["c_custkey", "c_name", "c_acctbal"])
    ingest_stream(spark, folder, to, checkpoint, path_rule=None).awaitTermination()
    written(nation % 2 == 1, ["c_custkey", "c_name", "c_acctbal"])
    written(nation % 6 == 0, ["c_custkey", "c_name"])
    ingest_stream(spark, folder, to, checkpoint, path_rule=None).awaitTermination()
    batch = F.when(F.max("run_id").startswith("stream-000000000"), "first").otherwise("second")
    runs = cells_io.read_ledger(spark, f"{to}/ledger").groupBy("file_path").agg(batch.alias("batch"), F.count("*").alias("runs"))
    cells = cells_io.read_cells(spark, to).groupBy("file_path").agg(F.count("*").alias("n_cells"))
    return runs.join(cells, "file_path").select(paths.base_name("file_path").alias("file_name"), "batch", "runs", "n_cells")


# ---------------------------------------------------------------------------
# smaller operators on stored cells and runs


@register(
    "numbered_cells",
    with_ctes(
        "SELECT worksheet, \"column\" AS column_number, COUNT(value) AS n_values FROM cells WHERE value IS NOT NULL GROUP BY ALL",
        cells=SQL_CELLS,
    ),
)
def numbered_cells(spark, d):
    """Stored cells whose column is its auto name: the number back from the name, cells without a value left out."""
    from ..functions.text import column_name, column_number

    named = cl.select(V.stored_cells(spark, d).withColumn("column", column_name("column")), non_null=True)
    return named.groupBy("worksheet", column_number("column").alias("column_number")).agg(F.count("value").alias("n_values"))


@register(
    "unpivot_all_but",
    "SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS BIGINT) AS row, CAST(1 AS BIGINT) AS \"column\", "
    "CAST(r_regionkey AS VARCHAR) AS value FROM region UNION ALL "
    "SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS BIGINT), CAST(2 AS BIGINT), r_name FROM region UNION ALL "
    "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT), CAST(1 AS BIGINT), CAST(n_nationkey AS VARCHAR) FROM nation "
    "UNION ALL SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT), CAST(2 AS BIGINT), n_name FROM nation "
    "UNION ALL SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT), CAST(3 AS BIGINT), CAST(n_regionkey AS VARCHAR) "
    "FROM nation",
)
def unpivot_all_but(spark, d):
    """Every column but the row number becomes cells, without a list of columns."""
    out = None
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey")):
        one = rs.to_cells(rs.with_row_index(V.table(spark, d, name), [key])).select("row", "column", "value")
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "modified_text",
    "SELECT event_id, " + V.SQL_ISO.format(t="ts") + " AS modified FROM events",
)
def modified_text(spark, d):
    return V.table(spark, d, "events").select("event_id", ch.modified_text("ts").alias("modified"))


@register(
    "old_output",
    with_ctes("SELECT worksheet, COUNT(*) AS n_cells, CAST(0 AS BIGINT) AS n_versions FROM cells GROUP BY worksheet", cells=SQL_CELLS),
)
def old_output(spark, d):
    """Cells stored without a version column, read with one."""
    from .. import schema
    from ..session import scratch_dir
    from ..sources import cells_io

    folder = scratch_dir(spark, "old")
    cells_io.write_cells(V.cells(spark, d), folder)
    read = cells_io.read_cells(spark, folder, extra=schema.CELL_VERSION)
    return read.groupBy("worksheet").agg(F.count("*").alias("n_cells"), F.count("source_modified_at").alias("n_versions"))


@register(
    "runs_read",
    with_ctes(
        "SELECT worksheet, count(*) AS n_cells, CAST(CASE worksheet WHEN 'nation' THEN count(value) ELSE 0 END AS BIGINT) AS rewritten "
        "FROM cells GROUP BY worksheet UNION ALL SELECT 'all processed paths', count(DISTINCT file_path), 0 FROM cells",
        cells=SQL_CELLS,
    ),
)
def runs_read(spark, d):
    """An output of three runs: one of all sheets, one that wrote a sheet again, one cut off before its ledger."""
    from .. import schema
    from ..session import scratch_dir
    from ..sources import cells_io

    to, cells = scratch_dir(spark, "runs"), V.cells(spark, d)
    again = cells.where(F.col("worksheet") == "nation").withColumn("value", F.concat(F.col("value"), F.lit("!")))
    for run_id, written in (("one", cells), ("two", again), ("cut-off", cells)):
        cells_io.write_cells(written, f"{to}/runs/run_id={run_id}/kind=cell")
    for day, (run_id, written) in enumerate((("one", cells), ("two", again)), start=1):
        done = {"run_id": F.lit(run_id), "status": F.lit("ok"), "run_at": F.make_timestamp(F.lit(2024), F.lit(1), F.lit(day), F.lit(0), F.lit(0), F.lit(0))}
        files = written.groupBy("file_path").agg(F.count("*").alias("n_cells"))
        files.select(*[(done[f.name] if f.name in done else F.col(f.name) if f.name in files.columns else F.lit(None).cast(f.dataType)).alias(f.name)
                       for f in schema.LEDGER.fields]).write.parquet(f"{to}/ledger/{run_id}")
    latest = cells_io.read_cells(spark, to).groupBy("worksheet").agg(
        F.count("*").alias("n_cells"), F.count(F.when(F.col("value").endswith("!"), 1)).alias("rewritten"))
    seen = cells_io.processed_paths(spark, to).agg(F.count("*").alias("n_cells")).select(
        F.lit("all processed paths").alias("worksheet"), "n_cells", F.lit(0).cast("bigint").alias("rewritten"))
    return latest.unionByName(seen)


@register(
    "gated_runs",
    with_ctes(
        "SELECT 'no marker' AS run, CAST(0 AS BIGINT) AS files, CAST(0 AS BIGINT) AS cells, CAST(0 AS BIGINT) AS errors, 0 AS code "
        "UNION ALL SELECT 'empty marker folder', count(*), CAST(sum(3 * (rows + 1)) AS BIGINT), 0, 0 FROM parts "
        "UNION ALL SELECT 'explicit list', 2, CAST(3 * ((SELECT rows FROM parts WHERE nation = 0 AND part = 1) + 1) AS BIGINT), 1, 2",
        parts=_SQL_PARTS,
    ),
)
def gated_runs(spark, d):
    """The gate without and with a marker folder (one without files), and an explicit list with a file that is no workbook."""
    from ..session import scratch_dir
    from ..sources import catalog as catalog_source
    from ..sources import ingest
    from ..sources.files import filesystem, open_output, plain_path

    folder = plain_path(scratch_dir(spark, "gate"))
    _customer_workbooks(spark, d, folder)
    listed = catalog_source.scan(spark, [folder])

    def totals(run, r):
        return (run, r["files"], r["rows"], r["errors"], ingest.exit_code(r))

    def gated(run):
        return totals(run, ingest.run(spark, listed, scratch_dir(spark, "gate-out"), path_rule="gate",
                                      folders=catalog_source.folders(spark, [folder])))

    rows = [gated("no marker")]
    system, inner, _ = filesystem(f"{folder}/SOV/2024")
    system.create_dir(inner, recursive=True)
    rows.append(gated("empty marker folder"))
    with open_output(f"{folder}/notes.txt") as f:
        f.write(b"not a workbook")
    rows.append(totals("explicit list", ingest.convert_files(
        spark, [f"{folder}/nation_0_part_1.xlsx", f"{folder}/notes.txt"], scratch_dir(spark, "gate-out"))))
    schema = StructType.fromDDL("run string, files bigint, cells bigint, errors bigint, code int")
    return literal_rows(spark, rows, schema)


@register(
    "run_ledger_totals",
    with_ctes(
        "SELECT count(*) AS files, CAST(sum(CASE WHEN nation % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS sheets, "
        "CAST(sum(CASE WHEN nation % 5 = 0 THEN 3 * (rows + 1) ELSE 0 END) AS BIGINT) AS rows, "
        "CAST(sum(CASE WHEN nation % 5 IN (0, 4) THEN 0 ELSE 1 END) AS BIGINT) AS errors, CAST(0 AS BIGINT) AS skipped FROM parts",
        parts=_SQL_PARTS,
    ),
)
def run_ledger_totals(spark, d):
    """Totals of a run over good, damaged, empty and non-workbook files, from its ledger."""
    from ..session import scratch_dir, ship_package
    from ..sources import catalog as catalog_source
    from ..sources import cells_io, ingest

    folder, to = scratch_dir(spark, "totals"), scratch_dir(spark, "totals-out")
    written = _customer_workbooks(spark, d, folder)
    ship_package(spark)
    _spoiled(written).count()
    ingest.run(spark, catalog_source.scan(spark, [folder]), to, path_rule=None)
    return ingest.run_totals(cells_io.read_ledger(spark, f"{to}/ledger"))
