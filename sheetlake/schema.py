"""Fixed schemas of every frame the engine produces, and empty frames of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Catalog of discovered spreadsheet files.  The first three columns are the
# catalog every caller knows; the rest come free with a file listing.
CATALOG = T.StructType([
    T.StructField("file_path", T.StringType(), False),
    T.StructField("extension", T.StringType(), True),
    T.StructField("discovered_at", T.StringType(), True),
    T.StructField("root", T.StringType(), True),
    T.StructField("size", T.LongType(), True),
    T.StructField("modified_at", T.TimestampType(), True),
])

CATALOG_BASE = ["file_path", "extension", "discovered_at"]

# One row per cell: the uniform long table every workbook is turned into.
CELLS = T.StructType([
    T.StructField("file_path", T.StringType(), False),
    T.StructField("file_name", T.StringType(), True),
    T.StructField("worksheet", T.StringType(), True),
    T.StructField("row", T.LongType(), True),
    T.StructField("column", T.LongType(), True),
    T.StructField("value", T.StringType(), True),
])

CELL_COLUMNS = [f.name for f in CELLS.fields]

# Cells with the version of the file they come from; outputs written without it read as null.
CELL_VERSION = T.StructType([T.StructField("source_modified_at", T.TimestampType(), True)])

# Position and text of a fixed cell (titles, headers) before lineage is added.
CELL_AT = T.StructType([
    T.StructField("row", T.LongType(), True),
    T.StructField("column", T.LongType(), True),
    T.StructField("value", T.StringType(), True),
])

# Same table with the column kept as its auto name ``column_N``.
CELLS_NAMED = T.StructType([
    f if f.name != "column" else T.StructField("column", T.StringType(), True)
    for f in CELLS.fields
])

# What the workbook decoder emits: cells, one summary row per sheet and one
# row per failure, so that a single decoding pass feeds cells, ledger and
# statistics.
DECODED = T.StructType([
    T.StructField("kind", T.StringType(), False),  # cell | sheet | error | file
    T.StructField("file_path", T.StringType(), False),
    T.StructField("file_name", T.StringType(), True),
    T.StructField("worksheet", T.StringType(), True),
    T.StructField("row", T.LongType(), True),
    T.StructField("column", T.LongType(), True),
    T.StructField("value", T.StringType(), True),
    T.StructField("n_rows", T.LongType(), True),
    T.StructField("n_cols", T.LongType(), True),
    T.StructField("message", T.StringType(), True),
    # per-file summary (kind = file): the run's ledger row
    T.StructField("status", T.StringType(), True),
    T.StructField("n_sheets", T.LongType(), True),
    T.StructField("n_empty_sheets", T.LongType(), True),
    T.StructField("n_cells", T.LongType(), True),
    T.StructField("n_errors", T.LongType(), True),
    T.StructField("modified_at", T.TimestampType(), True),
    T.StructField("file_hash", T.StringType(), True),
    # modification time of the file that a cell was read from
    T.StructField("source_modified_at", T.TimestampType(), True),
])

# Ledger of ingest runs: one row per file and run.
LEDGER = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("status", T.StringType(), False),  # ok | partial | error | empty
    T.StructField("n_sheets", T.LongType(), True),
    T.StructField("n_empty_sheets", T.LongType(), True),
    T.StructField("n_cells", T.LongType(), True),
    T.StructField("n_errors", T.LongType(), True),
    T.StructField("modified_at", T.TimestampType(), True),
    T.StructField("file_hash", T.StringType(), True),
    T.StructField("run_at", T.TimestampType(), True),
])

def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty frame that still carries ``schema`` (nullability included).

    Built as an empty local relation on the JVM side: creating it from a
    Python list would start Python workers for tasks that hold no rows.
    """
    try:
        from pyspark.sql.classic.dataframe import DataFrame as ClassicDataFrame

        jschema = spark._jsparkSession.parseDataType(schema.json())
        jdf = spark._jsparkSession.createDataFrame(spark._jvm.java.util.ArrayList(), jschema)
        return ClassicDataFrame(jdf, spark)
    except Exception:  # e.g. a Spark Connect session: no JVM at hand
        return spark.createDataFrame([], schema)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few fixed rows (titles, headers) as a JVM-side frame: ``inline`` of literal structs, no Python tasks."""
    from pyspark.sql import functions as F

    if not rows:
        return empty(spark, schema)
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, schema.fields)]) for r in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
