"""Reading and writing the cell table and the ledger (Parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..session import ship_package, shuffle_partitions


def count_matching(spark: SparkSession, path: str) -> int:
    """How many files and folders ``path`` (a glob allowed) matches."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hpath)
    return 0 if found is None else len(found)


def _exists(spark: SparkSession, path: str) -> bool:
    """True if ``path`` (a glob allowed) matches anything."""
    return count_matching(spark, path) > 0


def cells_location(output_dir: str) -> str:
    """Where an ingest output keeps its cells: the cell partitions of every run."""
    return f"{output_dir.rstrip('/')}/runs/run_id=*/kind=cell"


def _run_partitions(spark: SparkSession, output_dir: str, schema: S.T.StructType) -> DataFrame:
    """The ``kind=cell`` partitions of every run, with ``run_id`` as a (string) partition column.

    ``run_id`` and ``kind`` come from the folder names (no per-row work); the
    filter on ``kind`` prunes the other partitions before any file is opened.
    """
    with_parts = S.T.StructType(schema.fields + [
        S.T.StructField("run_id", S.T.StringType(), True), S.T.StructField("kind", S.T.StringType(), True)])
    df = spark.read.schema(with_parts).parquet(f"{output_dir.rstrip('/')}/runs")
    return df.where(F.col("kind") == "cell").drop("kind")


def read_cells(spark: SparkSession, path: str, extra: S.T.StructType | None = None,
               column_as: str = "number", latest_only: bool = True) -> DataFrame:
    """All cells with the fixed schema (no inference).

    ``path`` is an ingest output folder or any folder of cell Parquet (read
    recursively).  For an ingest output, ``latest_only`` (default) keeps each
    file's cells from its latest ledger run only: a file converted again
    (retried after errors, or changed) is not counted twice, and cells of a run
    whose ledger was never written are not visible.  ``column_as="name"``
    gives ``column`` as ``column_N`` text.  Columns added later
    (``extra``) read as null from older files.  Nothing there yet gives an
    empty frame; any other read error is raised.
    """
    schema = S.CELLS if extra is None else S.T.StructType(S.CELLS.fields + extra.fields)
    runs = cells_location(path)
    if _exists(spark, runs):
        df = _run_partitions(spark, path, schema)
        df = (_latest_runs_only(spark, df, path) if latest_only else df).drop("run_id")
    elif not _exists(spark, path):
        df = S.empty(spark, schema)
    else:
        df = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    if column_as == "name":
        df = df.withColumn("column", F.concat(F.lit("column_"), F.col("column").cast("string")))
    return df


def _latest_runs_only(spark: SparkSession, cells: DataFrame, output_dir: str) -> DataFrame:
    """Cells of each file's latest run that read it (ok, partial or empty); a run that could not keeps the earlier cells.

    Runs without a ledger are left out by their partition; of the others, only
    the (file, run) pairs that a later run replaced are taken away.  Those are
    few, so the cells are not shuffled unless very many files were converted
    again.
    """
    ledger = read_ledger(spark, f"{output_dir.rstrip('/')}/ledger").where(F.col("status").isin("ok", "partial", "empty"))
    runs = ledger.select("run_id").distinct()
    order = F.struct("run_at", "run_id")
    newest = ledger.groupBy("file_path").agg(F.max(order).alias("_newest"))
    replaced = ledger.join(newest, "file_path").where(order < F.col("_newest")).select("file_path", "run_id").distinct()
    # a semi join on the partition column: the ledger's runs prune the partitions when the query runs
    return cells.join(runs, "run_id", "left_semi").join(replaced, ["file_path", "run_id"], "left_anti")


def write_cells(cells: DataFrame, path: str, buckets: int | None = None, max_records_per_file: int = 5_000_000,
                layout: str = "by_file", mode: str = "append") -> None:
    """Write cells under ``path`` (append by default).

    ``by_file`` (default) range-partitions on (file_path, worksheet, row): a
    workbook's cells stay together and sorted, so Parquet row-group statistics
    prune by file, while a workbook with a third of all cells is cut into
    several tasks by row range instead of landing in one.  ``per_sheet``
    hashes (file_path, worksheet) like one output per sheet.  Spark names every
    part with a unique id, so appends never overwrite.
    """
    spark = cells.sparkSession
    n = buckets or shuffle_partitions(spark)
    cells = cells.select(*S.CELL_COLUMNS)
    if layout == "by_file":
        laid = cells.repartitionByRange(n, "file_path", "worksheet", "row")
    else:
        laid = cells.repartition(n, "file_path", "worksheet")
    (
        laid.sortWithinPartitions("file_path", "worksheet", "row", "column")
        .write.mode(mode)
        .option("maxRecordsPerFile", max_records_per_file)
        .parquet(path)
    )


def processed_paths(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ``file_path`` in the cells of any finished run (column-pruned scan)."""
    if not _exists(spark, cells_location(path)):
        return read_cells(spark, path).select("file_path").distinct()
    runs = read_ledger(spark, f"{path.rstrip('/')}/ledger").where(F.col("status").isin("ok", "partial", "empty", "error")).select("run_id").distinct()
    return _run_partitions(spark, path, S.CELLS).join(runs, "run_id", "left_semi").select("file_path").distinct()


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return S.empty(spark, S.LEDGER)
    return spark.read.schema(S.LEDGER).option("recursiveFileLookup", "true").parquet(path)


FOOTERS = S.T.StructType([
    S.T.StructField("path", S.T.StringType(), False), S.T.StructField("size", S.T.LongType(), True),
    S.T.StructField("n_rows", S.T.LongType(), True), S.T.StructField("n_groups", S.T.LongType(), True),
    S.T.StructField("least", S.T.StringType(), True), S.T.StructField("message", S.T.StringType(), True),
])


def _footers(column: str | None):
    """(path, size) of Parquet files in; rows, row groups and the smallest value of a text column out, from the footers."""

    def least_of(file) -> str | None:
        meta = file.metadata
        at = next((i for i in range(meta.num_columns) if meta.schema.column(i).path == column), None)
        if at is None:
            return None
        found = []
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            if stats is not None and stats.has_min_max:
                found.append(stats.min)
            elif stats is None or stats.null_count != meta.row_group(g).num_rows:  # not in the footer: the column itself
                found += [v for v in file.read_row_group(g, columns=[column]).column(0).to_pylist() if v is not None]
        return min((str(v) for v in found), default=None)

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        from .files import open_input

        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            out = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with open_input(path) as f:
                        file = pq.ParquetFile(f)
                        out.append((path, size, file.metadata.num_rows, file.metadata.num_row_groups,
                                    least_of(file) if column else None, None))
                except Exception as e:
                    out.append((path, size, None, None, None, f"{type(e).__name__}: {e}"))
            cols = zip(*out) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=FOOTERS.names)

    return run


def footers(files: DataFrame, column: str | None = None) -> DataFrame:
    """``FOOTERS`` rows of Parquet files (``path``, ``size``): tasks read the footers, no data page unless one lacks statistics.

    A file that cannot be read has a ``message`` instead of counts.
    """
    spark = files.sparkSession
    ship_package(spark)
    tasks = 4 * spark.sparkContext.defaultParallelism
    return files.select("path", "size").repartition(tasks, F.xxhash64("path")).mapInArrow(_footers(column), FOOTERS)


def output_files_report(spark: SparkSession, output_dir: str, limit: int = 50) -> DataFrame:
    """Per written cell file of an ingest output: name, size in KB, rows, source workbook; first ``limit`` by name.

    From the footers alone: the cells are not read.  All runs are included.
    """
    from ..functions.text import size_kb
    from .catalog import tree

    listed = tree(spark, [f"{output_dir.rstrip('/')}/runs"]).where(
        (F.col("kind") == "file") & F.col("path").contains("/kind=cell/") & F.col("path").endswith(".parquet"))
    return footers(listed, "file_name").select(
        F.substring_index("path", "/", -1).alias("output_file"), size_kb("size").alias("size_kb"), "n_rows",
        F.col("least").alias("source_file")).orderBy("output_file").limit(limit)
