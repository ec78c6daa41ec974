"""Workbook ingest: select what to convert, decode on executors, write cells and ledger.

Flow of one run (``run``):

1. ``select``: catalog minus files already done (anti join on the ledger, or
   on distinct ``file_path`` of the cells), minus files no longer listed (semi
   join on a fresh listing).  Joins, not driver-side sets.
2. ``read_workbooks``: ``mapInArrow`` over work units -- whole workbooks,
   the sheets of a large workbook, or byte ranges of a huge sheet -- spread by
   bytes; each task opens its files through pyarrow's file systems and decodes
   one unit at a time, emitting cell rows, one summary row per sheet, one row
   per failure (a bad file or sheet never stops the run) and one ``file`` row
   with the unit's ledger counts.
3. The decoded rows are written once, partitioned by kind, to the run's own
   folder; ledger and statistics are derived from that copy, so no workbook is
   decoded twice and a lost executor only re-decodes its own files.
4. The ``kind=cell`` part of that copy is the cell table; the ledger row of
   each file is written last: readers that join on the ledger never see a
   half-written run.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import paths
from ..operators.reshape import with_row_index
from ..session import cut_lineage, drop_cuts, scratch_dir, ship_package
from . import workbook


# ---------------------------------------------------------------------------
# selection


def skip_processed(catalog: DataFrame, processed: DataFrame, key: str = "file_path") -> DataFrame:
    """Catalog rows whose path is not in ``processed`` (anti join).

    Spark broadcasts ``processed`` when its runtime size is small (AQE) and
    shuffles both sides otherwise; nothing is collected to the driver.
    """
    return catalog.join(processed.select(key).distinct(), key, "left_anti")


def only_existing(catalog: DataFrame, listing: DataFrame, key: str = "file_path") -> DataFrame:
    """Catalog rows whose path is still present in a fresh ``listing`` (semi join)."""
    return catalog.join(listing.select(key), key, "left_semi")


#: Ledger states that count as done, by skip rule: without errors, or seen at all.
DONE = {"ledger": ("ok", "empty"), "seen": ("ok", "empty", "partial", "error")}


def done_from_ledger(ledger: DataFrame, states: Sequence[str] = DONE["ledger"]) -> DataFrame:
    """Paths whose latest ledger status counts as done; by default files whose last run had errors do not."""
    last = ledger.groupBy("file_path").agg(
        F.max_by(F.struct("status", "modified_at", "file_hash"), F.struct("run_at", "run_id")).alias("last"))
    return last.where(F.col("last.status").isin(list(states))).select("file_path", "last.modified_at", "last.file_hash")


def modified_since(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Paths of done files whose content has changed: another modification time, then another hash.

    Only files whose time differs from the ledger's are read (on executors,
    for the hash).  A file that cannot be read counts as changed: its
    conversion reports the error.
    """
    from ..operators.changes import hash_files

    old = done.select("file_path", F.col("modified_at").alias("_then"), F.col("file_hash").alias("_was"))
    touched = candidates.select("file_path", "modified_at").join(old, "file_path").where(
        F.col("modified_at") != F.col("_then")).select("file_path", "_was")
    # few files are touched between two runs: they are written, and where there is none nothing is hashed
    touched = cut_lineage(touched)
    if touched.isEmpty():
        return touched.select("file_path")
    now = hash_files(touched).select("file_path", F.col("file_hash").alias("_is"))
    return touched.join(now, "file_path").where(~F.col("_was").eqNullSafe(F.col("_is")) | F.col("_is").isNull()).select(
        "file_path")


# ---------------------------------------------------------------------------
# decoding on executors


def _arrow_schema():
    import pyarrow as pa

    kinds = {"string": pa.string(), "bigint": pa.int64(), "timestamp": pa.timestamp("us", tz="UTC")}
    return pa.schema([
        pa.field(f.name, kinds[f.dataType.simpleString()], nullable=f.nullable) for f in S.DECODED.fields
    ])


def _to_batch(rows: list[tuple], schema):
    import pyarrow as pa

    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def _cell_batch(chunk: workbook.Cells, modified, schema):
    """A stretch of cells as Arrow columns: what is the same for all its cells is repeated, not built row by row."""
    import pyarrow as pa

    n = len(chunk.values)
    same = {"kind": "cell", "file_path": chunk.path, "file_name": chunk.name, "worksheet": chunk.sheet,
            "source_modified_at": modified}
    given = {"row": chunk.rows, "column": chunk.columns, "value": chunk.values}
    return pa.RecordBatch.from_arrays(
        [pa.array(given[f.name], type=f.type) if f.name in given
         else pa.repeat(pa.scalar(same.get(f.name), type=f.type), n) for f in schema], schema=schema)


class _Out:
    """Gathers decoded rows into Arrow batches: cells by the stretch, other rows of many units together."""

    def __init__(self, batch_rows: int):
        self.schema, self.batch_rows, self.rows = _arrow_schema(), batch_rows, []
        self.cells, self.n_cells = [], 0

    def add(self, chunk, modified):
        """Batches that are full after a chunk of rows or cells."""
        if isinstance(chunk, workbook.Cells):
            self.cells.append(_cell_batch(chunk, modified, self.schema))
            self.n_cells += len(chunk.values)
            if self.n_cells >= self.batch_rows:
                yield from self._joined()
        else:
            self.rows.extend(r + _PAD for r in chunk)

    def file_row(self, path, name, status, n_sheets, n_empty, n_cells, n_errors, modified, file_hash):
        self.rows.append(("file", path, name, None, None, None, None, None, None, None,
                          status, n_sheets, n_empty, n_cells, n_errors, modified, file_hash, None))

    def _joined(self):
        import pyarrow as pa

        if self.cells:
            yield from pa.Table.from_batches(self.cells).combine_chunks().to_batches()
        self.cells, self.n_cells = [], 0

    def rest(self):
        yield from self._joined()
        if self.rows:
            yield _to_batch(self.rows, self.schema)


def file_status(n_sheets: int, n_empty: int, n_errors: int) -> str:
    """ok | partial (some sheets failed) | error (nothing read) | empty (only empty sheets)."""
    good = n_sheets - n_empty
    if n_errors:
        return "partial" if good else "error"
    return "ok" if good else "empty"


def status_column(n_sheets, n_empty, n_errors):
    """``file_status`` as a Column expression (for ledger rows summed over a file's units)."""
    good = n_sheets - n_empty
    return (
        F.when((n_errors > 0) & (good > 0), F.lit("partial"))
        .when(n_errors > 0, F.lit("error"))
        .when(good > 0, F.lit("ok"))
        .otherwise(F.lit("empty"))
    )


_PAD = (None,) * 8

UNITS = "file_path string, modified_at timestamp, sheet_index int, weight bigint, cut boolean"
PARTS = ("file_path string, modified_at timestamp, sheet_index int, sheet string, number int, part string, at bigint, length bigint, "
         "bytes bigint, bundle int, failed string")
PART_INDEX = PARTS + ", n_rows bigint, cols array<bigint>"


def _plan_partition(batches, split_bytes: int, range_bytes: int):
    """(path, modified_at, size) of large files in; units out: whole file, sheets, or sheets to be cut into parts."""
    import pyarrow as pa

    types = [pa.string(), pa.timestamp("us", tz="UTC"), pa.int32(), pa.int64(), pa.bool_()]
    for batch in batches:
        out = []
        for path, mod, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
            units = workbook.plan_units(path, split_bytes, range_bytes)
            total = sum(u[1] for u in units) or 1
            # weight in file bytes, shared out by the sheets' XML sizes
            out += [(path, mod, i, int((size or 0) * w / total) if i >= 0 else size, cut) for i, w, cut in units]
        cols = zip(*out) if out else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                         names=["file_path", "modified_at", "sheet_index", "weight", "cut"])


def _parts_schema():
    import pyarrow as pa

    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "timestamp": pa.timestamp("us", tz="UTC")}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in PARTS.split(", "))])


def _cut_partition(batches, part_bytes: int, bundle_bytes: int, folder: str, batch_rows: int = 10_000):
    """Sheets (path, modified_at, index) in; their parts out; a sheet that fails is one row without.

    A task stores all its parts in one file of its own below ``folder``.  Parts
    of a sheet that follow each other form bundles of about ``bundle_bytes``.
    """
    from .files import open_output

    target, store, rows = f"{folder}/{uuid.uuid4().hex}", None, []
    try:
        for batch in batches:
            for path, mod, idx in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if store is None:
                    store = open_output(target)
                sheet, out, message, before = workbook.sheet_name(path, idx), [], None, 0
                try:
                    for number, at, length, size in workbook.cut_sheet(path, idx, part_bytes, store):
                        out.append((path, mod, idx, sheet, number, target, at, length, size, before // bundle_bytes, None))
                        before += size
                except Exception as e:
                    out, message = [], f"{type(e).__name__}: {e}"
                rows += out or [(path, mod, idx, sheet, 0, None, None, None, 0, 0, message)]
                if len(rows) >= batch_rows:
                    yield _to_batch(rows, _parts_schema())
                    rows = []
        if rows:
            yield _to_batch(rows, _parts_schema())
    finally:
        if store is not None:
            store.close()


def _index_partition(batches):
    """First pass over parts: non-empty row count and column numbers of each, or why it fails."""
    import pyarrow as pa

    reader, given = workbook.Parts(), _parts_schema().names
    for batch in batches:
        n_rows, used, failed = [], [], []
        for path, *part, message in zip(*(batch.column(c).to_pylist() for c in ("file_path", "part", "at", "length", "failed"))):
            n, c = 0, []
            try:
                if message is None:
                    n, c = reader.index(path, *part)
            except Exception as e:
                message = f"{type(e).__name__}: {e}"
            n_rows.append(n)
            used.append(c)
            failed.append(message)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in given[:-1]), pa.array(failed, pa.string()), pa.array(n_rows, pa.int64()),
             pa.array(used, pa.list_(pa.int64()))], names=[f.split()[0] for f in PART_INDEX.split(", ")])


def _part_partition(batches, max_cells: int, batch_rows: int):
    """Second pass over parts: cells numbered with the sheet-wide offset and column map.

    A sheet any of whose parts failed gives what it gives when it is decoded
    whole: one error row and no cells.  The sheet's counts travel with its
    first part, the file's hash with the first part of its first sheet.
    """
    out, reader = _Out(batch_rows), workbook.Parts()
    for batch in batches:
        names = ("file_path", "modified_at", "sheet_index", "sheet", "number", "row_offset", "all_cols", "total_rows", "failed", "part", "at", "length")
        for path, modified, idx, sheet, number, offset, used, total, failed, *part in zip(*(batch.column(c).to_pylist() for c in names)):
            first = number == 0
            shown = workbook.plain_path(path)
            name = shown.rsplit("/", 1)[-1]
            if failed is not None:
                if first:
                    out.rows.append(workbook._error(shown, name, sheet, failed) + _PAD)
            else:
                if first:
                    out.rows.append(("sheet", shown, name, sheet, None, None, None, total, len(used), None) + _PAD)
                for chunk in reader.decode(path, sheet, part, offset, used, max_cells=max_cells):
                    yield from out.add(chunk, modified)
            read = first and failed is None
            out.file_row(shown, name, None, int(read), int(read and total == 0), total * len(used) if read else 0,
                         int(first and failed is not None), modified, workbook.content_hash(path) if first and idx == 0 else None)
    yield from out.rest()


def _decode_partition(batches, max_cells: int, batch_rows: int):
    """Arrow batches of units (path, modified_at, sheet index) in, Arrow batches of decoded rows out.

    A unit is a whole workbook (sheet index -1) or one sheet of a large one.
    After each unit one ``file`` row carries its part of the file's ledger
    counts; the first unit of a file also its hash.
    """
    out = _Out(batch_rows)
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(3)]
        for path, modified, idx in zip(*cols):
            n_sheets = n_empty = n_cells = n_errors = 0
            shown = workbook.plain_path(path)
            sheet = None if idx is None or idx < 0 else idx
            for chunk in workbook.decode_chunks(path, max_cells=max_cells, sheet_index=sheet):
                if not isinstance(chunk, workbook.Cells):
                    for r in chunk:
                        if r[0] == "sheet":
                            n_sheets += 1
                            n_empty += r[7] == 0
                            n_cells += r[7] * r[8]
                        elif r[0] == "error":
                            n_errors += 1
                yield from out.add(chunk, modified)
            out.file_row(shown, shown.rsplit("/", 1)[-1], file_status(n_sheets, n_empty, n_errors), n_sheets, n_empty,
                         n_cells, n_errors, modified, None if sheet else workbook.content_hash(path))
    yield from out.rest()


def read_workbooks(selected: DataFrame, files_per_task: int = 32, max_cells: int = 50_000,
                   n_files: int | None = None, batch_rows: int = 20_000, n_bytes: int | None = None,
                   bytes_per_task: int = 256 << 10, split_file_bytes: int = 8 << 20,
                   split_xml_bytes: int = 32 << 20, range_xml_bytes: int = 64 << 20,
                   cuts: list[str] | None = None) -> DataFrame:
    """Decode every selected workbook into ``schema.DECODED`` rows.

    ``selected`` needs ``file_path`` (a path or URI), optionally ``size`` and
    ``modified_at``.  Work units: a whole workbook, or -- for a file larger
    than ``split_file_bytes`` whose sheets hold more than ``split_xml_bytes``
    of XML -- each of its sheets, so one huge workbook is decoded by many
    tasks instead of one (only such files are opened for planning, and only
    their zip directory is read).  A sheet of more than ``range_xml_bytes`` of
    XML is cut further into byte ranges of its decompressed XML: a first pass
    counts each range's non-empty rows and columns, a window over those counts
    gives each range its row offset and an aggregate the sheet's column map,
    and a second pass emits the cells -- so even a single sheet holding a third
    of all cells is decoded by many tasks.  Units are spread by a hash over one task per
    ``bytes_per_task`` of input (about a second of decoding; by file count when
    sizes are unknown), never fewer than two tasks per core.  Each task holds
    one workbook (or sheet) at a time and emits it in chunks of at most
    ``max_cells`` rows.  ``cuts`` collects the lineage cuts of the planning,
    which the frame reads until it has been written.
    """
    modified = F.col("modified_at") if "modified_at" in selected.columns else F.lit(None).cast("timestamp")
    size = F.col("size") if "size" in selected.columns else F.lit(None).cast("bigint")
    ship_package(selected.sparkSession)
    paths_df = selected.select("file_path", modified.alias("modified_at"), size.alias("size")).dropDuplicates(
        ["file_path"])
    # the task count comes from the file count and bytes: scalars, not the data
    total = paths_df.count() if n_files is None else n_files
    floor = 2 * selected.sparkSession.sparkContext.defaultParallelism
    wanted = -(-n_bytes // max(1, bytes_per_task)) if n_bytes else -(-total // max(1, files_per_task))
    parts = max(1, min(max(floor, wanted), 256 * max(1, total)))
    large = F.col("size") > F.lit(split_file_bytes)
    units = paths_df.where(~large | F.col("size").isNull()).select(
        "file_path", "modified_at", F.lit(-1).alias("sheet_index"), F.col("size").alias("weight"))
    large_paths, cut_sheets = paths_df.where(large), None
    n_large = large_paths.count()
    if n_large:
        # planning reads a file's zip directory only: many files to a task
        planned = cut_lineage(
            large_paths.repartition(max(floor, -(-n_large // max(1, files_per_task))), F.xxhash64("file_path"))
            .mapInArrow(lambda it: _plan_partition(it, split_xml_bytes, range_xml_bytes), UNITS), cuts
        )
        units = units.unionByName(planned.where("not cut").drop("cut"))
        cut_sheets = planned.where("cut")
    # spread on a hash, not on the path itself: a repartition identical to an
    # exchange below it (the de-duplication's) would be dropped as redundant and
    # that exchange, carrying only paths, coalesced by AQE into a single task
    spread = units.repartition(parts, F.xxhash64("file_path", "sheet_index"))
    decoded = spread.select("file_path", "modified_at", "sheet_index").mapInArrow(
        lambda it: _decode_partition(it, max_cells, batch_rows), S.DECODED)
    parted = None if cut_sheets is None else _read_in_parts(cut_sheets, range_xml_bytes, max_cells, batch_rows, bytes_per_task, cuts)
    return decoded if parted is None else decoded.unionByName(parted)


def _read_in_parts(sheets: DataFrame, part_bytes: int, max_cells: int, batch_rows: int, bytes_per_task: int,
                   cuts: list[str] | None) -> DataFrame | None:
    """``schema.DECODED`` rows of huge sheets: inflated once into stored parts of whole rows, which are counted, then decoded.

    Tasks follow the bytes, not the number of sheets or parts: a sheet or a
    part that fills a task has one of its own, small ones share.  None if there
    are no sheets.
    """
    given = sheets.agg(F.count("*").alias("n"), F.sum("weight").alias("bytes")).first()
    if not given["n"]:
        return None
    spark = sheets.sparkSession
    folder = scratch_dir(spark, "parts")
    if cuts is not None:
        cuts.append(folder)
    floor, bundle_bytes = 2 * spark.sparkContext.defaultParallelism, 10 * max(1, bytes_per_task)  # XML is about ten times its file
    stored = cut_lineage(
        sheets.select("file_path", "modified_at", "sheet_index")
        .repartition(min(given["n"], max(floor, (given["bytes"] or 0) // max(1, bytes_per_task))), F.xxhash64("file_path", "sheet_index"))
        .mapInArrow(lambda it: _cut_partition(it, part_bytes, bundle_bytes, folder), PARTS), cuts)
    size = stored.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    # neighbouring parts share the opened workbook
    tasks = max(1, min(size["n"], max(floor, size["bytes"] // bundle_bytes)))
    spread = [F.xxhash64("file_path", "sheet_index", "bundle")]
    order = ["file_path", "sheet_index", "number"]
    index = cut_lineage(stored.repartition(tasks, *spread).sortWithinPartitions(*order).mapInArrow(_index_partition, PART_INDEX), cuts)
    # per sheet: all used columns (a set, at most the sheet width), the row total and the first failure;
    # per part: rows in the parts before it (a window over one row per part)
    key = ["file_path", "sheet_index"]
    totals = index.groupBy(*key).agg(
        F.sum("n_rows").alias("total_rows"),
        F.min(F.when(F.col("failed").isNotNull(), F.struct("number", "failed"))).getField("failed").alias("failed"),
    )
    used = index.select(*key, F.explode("cols").alias("col")).groupBy(*key).agg(
        F.sort_array(F.collect_set("col")).alias("all_cols"))
    per_sheet = totals.join(used, key, "left").withColumn(
        "all_cols", F.coalesce("all_cols", F.array().cast("array<bigint>")))
    before = Window.partitionBy(*key).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = index.drop("failed").withColumn("row_offset", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
    work = offsets.join(per_sheet, key).select(
        "file_path", "modified_at", "sheet_index", "sheet", "number", "part", "at", "length", "bundle", "row_offset", "all_cols", "total_rows",
        "failed")
    return work.repartition(tasks, *spread).sortWithinPartitions(*order).mapInArrow(
        lambda it: _part_partition(it, max_cells, batch_rows), S.DECODED)


# ---------------------------------------------------------------------------
# statistics


def file_stats(decoded: DataFrame) -> DataFrame:
    """Per file and total (rollup row with null ``file_path``): files, sheets, rows, errors.

    ``decoded`` needs ``kind`` in (cell, error, ...), ``file_path``, ``worksheet``.
    Two levels: cells collapse to one row per (file, sheet, kind) first -- a
    partial + final aggregate, so a workbook with a third of all cells costs
    one row per task before the shuffle -- and the distinct counts and the
    rollup run on that small table instead of expanding every cell row.
    """
    per_sheet = decoded.groupBy("file_path", "worksheet", "kind").agg(F.count(F.lit(1)).alias("n"))
    sheet_key = F.when(F.col("kind") == "cell", F.concat_ws("/", "file_path", "worksheet"))
    zero = F.lit(0).cast("bigint")
    return per_sheet.rollup("file_path").agg(
        F.countDistinct("file_path").alias("files"),
        F.countDistinct(sheet_key).alias("sheets"),
        F.coalesce(F.sum(F.when(F.col("kind") == "cell", F.col("n"))), zero).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("kind") == "error", F.col("n"))), zero).alias("errors"),
    )


def run_totals(ledger_run: DataFrame, skipped: int = 0) -> DataFrame:
    """Totals of one run from its ledger rows: files, sheets, rows (cells), errors, skipped."""
    return ledger_run.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum(F.col("n_sheets") - F.col("n_empty_sheets")), F.lit(0)).cast("bigint").alias("sheets"),
        F.coalesce(F.sum("n_cells"), F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.sum("n_errors"), F.lit(0)).cast("bigint").alias("errors"),
        F.lit(skipped).cast("bigint").alias("skipped"),
    )


# ---------------------------------------------------------------------------
# one run


def convert(spark: SparkSession, selected: DataFrame, output_dir: str, run_id: str,
            files_per_task: int = 32, n_files: int | None = None, n_bytes: int | None = None,
            split_file_bytes: int = 8 << 20, split_xml_bytes: int = 32 << 20, range_xml_bytes: int = 64 << 20,
            max_records_per_file: int = 5_000_000) -> DataFrame:
    """Decode ``selected`` paths once and write the run's rows and ledger.

    The decoded rows go to ``runs/run_id=<run>/kind=cell|sheet|error|file``: the
    ``kind=cell`` folders *are* the cell table (read with the fixed cell
    schema, the extra summary columns are never read), so cells are written
    once, straight from the decoding tasks, each task's files holding whole
    workbooks in sheet/row/column order.  The ledger (``ledger/<run>``) is a
    projection of the one-row-per-file ``kind=file`` part, written last.  Every
    folder belongs to the run and is written with overwrite, so replaying a run
    (retried job, replayed stream batch) replaces its output instead of adding
    to it.  Returns the run's ledger rows.
    """
    from . import cells_io

    out = output_dir.rstrip("/")
    run_dir = f"{out}/runs/run_id={run_id}"
    cuts: list[str] = []
    decoded = read_workbooks(selected, files_per_task=files_per_task, n_files=n_files, n_bytes=n_bytes,
                             split_file_bytes=split_file_bytes, split_xml_bytes=split_xml_bytes,
                             range_xml_bytes=range_xml_bytes, cuts=cuts)
    (
        decoded.write.mode("overwrite")
        .partitionBy("kind")
        .option("maxRecordsPerFile", max_records_per_file)
        .parquet(run_dir)
    )
    drop_cuts(spark, cuts)
    files = spark.read.schema(S.DECODED).parquet(f"{run_dir}/kind=file")
    # one instant for the whole run, fixed on the driver (a retried task writes the same value)
    run_at = F.lit(_dt.datetime.now(_dt.timezone.utc)).cast("timestamp")
    # a file split into sheet units has one partial row per unit: sum them
    per_file = files.groupBy("file_path").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("n_sheets", "n_empty_sheets", "n_cells", "n_errors")],
        F.max("modified_at").alias("modified_at"), F.max("file_hash").alias("file_hash"),
    )
    ledger = per_file.select(
        F.lit(run_id).alias("run_id"), "file_path",
        status_column(F.col("n_sheets"), F.col("n_empty_sheets"), F.col("n_errors")).alias("status"),
        "n_sheets", "n_empty_sheets", "n_cells", "n_errors",
        "modified_at", "file_hash", run_at.alias("run_at"),
    )
    ledger.write.mode("overwrite").parquet(f"{out}/ledger/{run_id}")
    return cells_io.read_ledger(spark, f"{out}/ledger/{run_id}")


def run(
    spark: SparkSession,
    catalog: DataFrame,
    output_dir: str,
    listing: DataFrame | None = None,
    skip: str = "ledger",
    run_id: str | None = None,
    files_per_task: int = 32,
    path_rule: str | None = "filter",
    marker: str = paths.DEFAULT_MARKER,
    split_file_bytes: int = 8 << 20,
    split_xml_bytes: int = 32 << 20,
    range_xml_bytes: int = 64 << 20,
    folders: DataFrame | None = None,
    any_extension: bool = False,
    max_files: int | None = None,
    first_part: int = 0,
) -> dict:
    """Convert the selected catalog files; return the run id and its totals.

    ``path_rule``: ``filter`` keeps files whose path contains ``marker``;
    ``gate`` converts the whole catalog but only if at least one marker folder
    exists (else nothing is done), ``folders`` (``catalog.folders``) adding
    those without files; ``None`` converts the whole catalog.

    ``skip``: ``ledger`` (files done per ledger; files whose last run had
    errors are retried, files modified since are converted again and keep
    their earlier cells as history), ``cells`` (any path present in the cells:
    the strict path-keyed rule), ``seen`` (as ``ledger``, but files with errors
    only once they are modified) or ``none``.  ``listing``: a fresh listing;
    catalog files missing from it are left out.  ``any_extension``: files that
    are no workbooks are taken too and become errors.  ``max_files``: convert
    them as runs ``<run_id>-<n>`` of at most so many files, ``n`` from
    ``first_part`` on, each with its own ledger.
    """
    from . import cells_io

    run_id = run_id or uuid.uuid4().hex
    out = output_dir.rstrip("/")
    candidates = catalog if any_extension else catalog.where(paths.is_spreadsheet(paths.extension("file_path")))
    if path_rule == "filter":
        candidates = candidates.where(paths.under_marker("file_path", marker))
    elif path_rule == "gate":
        from ..operators.catalog import marker_folders

        seen = marker_folders(catalog, marker)
        if folders is not None:
            seen = seen.unionByName(folders.where(paths.under_marker("folder", marker)).select("folder"))
        if seen.isEmpty():
            return {"files": 0, "sheets": 0, "rows": 0, "errors": 0, "skipped": 0, "run_id": None}
    if listing is not None:
        candidates = only_existing(candidates, listing)
    keep = ["file_path"] + [c for c in ("modified_at", "size") if c in candidates.columns]
    candidates = candidates.select(*keep).dropDuplicates(["file_path"])
    if skip in DONE:
        done = done_from_ledger(cells_io.read_ledger(spark, f"{out}/ledger"), DONE[skip])
    elif skip == "cells":
        done = cells_io.processed_paths(spark, out)
    else:
        done = None
    # one pass counts candidates and the ones still to do; the ledger this run
    # extends is only written after its decode job has finished
    if done is None:
        flagged = candidates.withColumn("_todo", F.lit(True))
    else:
        skipped = done.select("file_path").distinct()
        if skip in DONE and "modified_at" in candidates.columns:
            skipped = skipped.join(modified_since(candidates, done), "file_path", "left_anti")
        flagged = candidates.join(skipped.withColumn("_done", F.lit(True)),
                                  "file_path", "left").withColumn("_todo", F.col("_done").isNull())
    # kept between the count and the decode job so the listing and the joins run
    # once (recomputed from lineage if an executor holding it is lost)
    flagged = flagged.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        size = F.col("size") if "size" in flagged.columns else F.lit(None).cast("bigint")
        c = flagged.agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_todo"), 1)).alias("todo"),
            F.sum(F.when(F.col("_todo"), size)).alias("bytes"),
        ).first()
        todo = flagged.where("_todo")
        totals = {"files": 0, "sheets": 0, "rows": 0, "errors": 0}
        options = {"files_per_task": files_per_task, "split_file_bytes": split_file_bytes, "split_xml_bytes": split_xml_bytes,
                   "range_xml_bytes": range_xml_bytes}
        if c["todo"] and max_files is None:
            parts = [(run_id, todo, c["todo"], c["bytes"])]
        elif 0 < c["todo"] <= (max_files or 0):
            parts = [(f"{run_id}-{first_part:05d}", todo, c["todo"], c["bytes"])]
        elif c["todo"]:
            numbered = cut_lineage(with_row_index(todo, ["file_path"], name="_n").withColumn("_part", F.floor(F.col("_n") / max_files)))
            parts = [(f"{run_id}-{first_part + k:05d}", numbered.where(F.col("_part") == k), min(max_files, c["todo"] - k * max_files), None)
                     for k in range(-(-c["todo"] // max_files))]
        else:
            parts = []
        for part_id, files, n, size_of in parts:
            one = run_totals(convert(spark, files, out, part_id, n_files=n, n_bytes=size_of, **options)).first()
            totals = {k: v + one[k] for k, v in totals.items()}
    finally:
        flagged.unpersist()
    totals["skipped"] = int(c["n"] - c["todo"])
    totals["run_id"] = run_id
    return totals


def convert_files(spark: SparkSession, files: Sequence[str], output_dir: str, run_id: str | None = None) -> dict:
    """Convert an explicit list of files (globs allowed): no catalog, no path rule, no skip.

    An entry that is no file is refused (``ValueError``); a file that is no
    workbook becomes an error of the run.
    """
    from . import catalog as catalog_source

    return run(spark, catalog_source.from_paths(spark, files), output_dir, skip="none", path_rule=None,
               run_id=run_id, any_extension=True)


def exit_code(totals: dict) -> int:
    """0 when a run had no errors, 2 when any file or sheet failed."""
    return 2 if totals.get("errors") else 0
