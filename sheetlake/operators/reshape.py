"""Wide <-> long reshaping: row index, unpivot to cells, pivot back, blank drop.

Scale notes
-----------
* ``with_row_index`` never puts a whole sheet (or a whole table) into one
  task: rows are range-partitioned on (sheet keys, order keys), each partition
  counts its rows per sheet, a window over those counts (at most one row per
  partition and sheet) gives each partition its offset, and every row adds its
  position inside the partition.  A sheet holding a third of all rows is spread
  over many partitions like any other.
* ``to_cells`` makes one array of a row's texts and explodes it with positions
  (narrow, no shuffle); its plan is as small for 16,384 columns as for ten.
* ``to_wide`` is a partial + final aggregate on (sheet, row) (sort-based, as
  ``max`` over text is); the column list is passed so Spark does not run a
  distinct job.  Sheets of more than 64 columns are pivoted by blocks of 64
  columns, and a row's blocks are put together by number.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_text, column_name
from ..session import cut_lineage

#: Columns of a pivot up to which each is its own aggregate; wider sheets go by blocks of as many.
BLOCK = 64

_POS = "_sl_pos"
_PID = "_sl_pid"


def value_columns(df: DataFrame, exclude: Iterable[str]) -> list[str]:
    """Every column of ``df`` except the given ones, in order."""
    skip = set(exclude)
    return [c for c in df.columns if c not in skip]


def with_row_index(
    df: DataFrame,
    order_by: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    name: str = "row",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add a 0-based dense ``name`` per ``partition_by`` group in ``order_by`` order.

    Same result as ``row_number() over (partition by .. order by ..) - 1`` but
    without the one-task-per-group window (see module notes).  The order keys
    should be unique inside a group for a deterministic index.
    """
    keys = list(partition_by)
    order = [F.col(o) if isinstance(o, str) else o for o in order_by]
    # without an explicit count AQE sizes the range partitions from the data
    ranged = (df.repartitionByRange(num_partitions, *keys, *order) if num_partitions
              else df.repartitionByRange(*keys, *order)).sortWithinPartitions(*keys, *order)
    # position ids follow the sorted order inside each partition; the lineage cut
    # freezes them (and the sampled range bounds) before they are used twice
    tagged = cut_lineage(ranged.withColumn(_POS, F.monotonically_increasing_id()))
    tagged = tagged.withColumn(_PID, F.shiftright(F.col(_POS), 33))

    counts = tagged.groupBy(_PID, *keys).agg(
        F.count(F.lit(1)).alias("_sl_n"), F.min(_POS).alias("_sl_first")
    )
    before = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    # keys renamed on the offsets side: both sides come from the same lineage
    renamed = [f"_sl_k{i}" for i in range(len(keys))]
    offsets = counts.select(
        F.col(_PID).alias("_sl_opid"),
        *[F.col(k).alias(r) for k, r in zip(keys, renamed)],
        "_sl_first",
        F.coalesce(F.sum("_sl_n").over(before), F.lit(0)).alias("_sl_before"),
    )
    if not keys:
        # one row per partition: size is bounded by the partition count
        offsets = F.broadcast(offsets)
    cond = F.col(_PID) == F.col("_sl_opid")
    for k, r in zip(keys, renamed):
        cond = cond & F.col(k).eqNullSafe(F.col(r))
    joined = tagged.join(offsets, cond, "inner")
    index = (F.col(_POS) - F.col("_sl_first") + F.col("_sl_before")).alias(name)
    return joined.select(*df.columns, index)


def to_cells(
    df: DataFrame,
    row: str = "row",
    lineage: Mapping[str, Column | str] | None = None,
    keep: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    column_as: str = "number",
) -> DataFrame:
    """Unpivot a wide sheet (one row per sheet row) into cells.

    ``lineage`` maps output lineage columns (``file_path``, ``file_name``,
    ``worksheet``) to Columns or literals; ``keep`` are extra id columns carried
    through.  Value columns are all others (or ``columns``), numbered 1.. by
    position.  Each is cast to text *before* the unpivot.  Null cells are kept.
    """
    lineage = dict(lineage or {})
    ids = list(lineage) + [row] + list(keep)
    values = list(columns) if columns is not None else value_columns(df, set(ids) | {row} | set(keep))
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    lineage_cols = [
        (v if isinstance(v, Column) else (F.col(v) if v in df.columns else F.lit(v))).alias(k)
        for k, v in lineage.items()
    ]
    # one array a row, so the plan does not grow with the number of columns
    wide = df.select(
        *lineage_cols,
        F.col(row).cast("bigint").alias("row"),
        *[F.col(k) for k in keep],
        _texts(values, types).alias("_sl_values"),
    )
    long = wide.select(*lineage, "row", *keep, F.posexplode("_sl_values").alias("_sl_at", "value"))
    number = (F.col("_sl_at") + 1).cast("bigint")
    col = number if column_as == "number" else F.concat(F.lit("column_"), number.cast("string"))
    return long.select(*lineage, "row", *keep, col.alias("column"), "value")


def _texts(columns: Sequence[str], types: Mapping[str, T.DataType]) -> Column:
    """One array of the columns' texts; texts as they are go in by name, as SQL, thousands of them in one call."""
    if all(isinstance(types[c], T.StringType) for c in columns):
        return F.expr("array({})".format(", ".join("`{}`".format(c.replace("`", "``")) for c in columns)))
    return F.array(*[as_text(F.col(c), types[c]) for c in columns])


def sheets_to_cells(sheets: Sequence[tuple[DataFrame, str | Column, Mapping[str, str], Sequence[str]]]) -> DataFrame:
    """Many wide sheets of different widths -> one cell table, in one pass.

    Each entry: (frame, order key, lineage literals ``file_path``/``file_name``/
    ``worksheet``, value columns).  Every sheet becomes rows of (lineage, order
    key in its own type, array of value texts); the union gets one skew-safe row
    index per (file_path, worksheet) -- one lineage cut for all sheets instead
    of one per sheet -- and ``posexplode`` turns each array into numbered cells
    (nulls kept).
    """
    orders = [df.select((F.col(o) if isinstance(o, str) else o).alias("k")).schema["k"].dataType for df, o, _, _ in sheets]
    kinds = list(dict.fromkeys(orders))  # one order column for each type of key; a sheet fills its own
    parts = []
    for (df, order, lineage, cols), own in zip(sheets, orders):
        types = dict((f.name, f.dataType) for f in df.schema.fields)
        order_col = F.col(order) if isinstance(order, str) else order
        parts.append(df.select(
            *[F.lit(lineage[k]).alias(k) for k in ("file_path", "file_name", "worksheet")],
            *[(order_col if kind == own else F.lit(None).cast(kind)).alias(f"_sl_order{i}") for i, kind in enumerate(kinds)],
            F.array(*[as_text(F.col(c), types[c]) for c in cols]).alias("_sl_values"),
        ))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    indexed = with_row_index(stacked, [f"_sl_order{i}" for i in range(len(kinds))], ["file_path", "worksheet"])
    cells = indexed.select("file_path", "file_name", "worksheet", "row",
                           F.posexplode("_sl_values").alias("_sl_pos", "value"))
    return cells.select("file_path", "file_name", "worksheet", "row",
                        (F.col("_sl_pos") + 1).cast("bigint").alias("column"), "value")


def to_wide(
    cells: DataFrame,
    index: Sequence[str] = ("file_path", "worksheet", "row"),
    n_columns: int | None = None,
    columns: Sequence[int] | None = None,
    agg: str = "max",
) -> DataFrame:
    """Pivot cells back to one row per ``index`` with ``column_1..column_N``.

    Pass ``n_columns`` (kept per sheet by the ledger) or ``columns`` to avoid
    a distinct job.  Duplicate (index, column) keys are resolved by ``agg``.
    """
    if columns is None:
        if n_columns is None:
            # distinct column numbers: bounded by the widest sheet, not by the data
            n_columns = cells.agg(F.max("column")).first()[0] or 0
        columns = list(range(1, int(n_columns) + 1))
    columns = list(columns)
    pick = {"max": F.max, "min": F.min, "first": F.first}[agg]
    if len(columns) <= BLOCK:
        wide = cells.groupBy(*index).pivot("column", columns).agg(pick("value"))
        return wide.select(*index, *[F.col(str(c)).alias(f"column_{c}") for c in columns])
    # wide sheets: blocks of columns, then the blocks of a row by number; the plan has one branch a column of a block
    at = F.pmod(F.col("column") - 1, F.lit(BLOCK))
    blocks = cells.where(F.col("column").between(min(columns), max(columns))).groupBy(
        *index, F.floor((F.col("column") - 1) / BLOCK).cast("int").alias("_sl_block")).agg(
        F.array(*[pick(F.when(at == i, F.col("value"))) for i in range(BLOCK)]).alias("_sl_values"))
    rows = blocks.groupBy(*index).agg(F.map_from_entries(F.collect_list(F.struct("_sl_block", "_sl_values"))).alias("_sl_map"))
    last = (max(columns) - 1) // BLOCK
    none = F.array_repeat(F.lit(None).cast("string"), BLOCK)
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(last)), lambda b: F.coalesce(F.try_element_at("_sl_map", b), none)))
    flat = rows.select(*index, whole.alias("_sl_whole"))
    # as SQL text: thousands of columns in one call
    return flat.selectExpr(*[f"`{i}`" for i in index], *[f"_sl_whole[{c - 1}] AS column_{c}" for c in columns])


def drop_blank(cells: DataFrame, keys: Sequence[str] = ("file_path", "worksheet")) -> DataFrame:
    """Drop rows and columns whose cells are all null, then renumber densely.

    Rows stay 0-based, columns 1-based, per sheet.  Which rows and columns of a
    sheet are used is kept as bitmaps, one for 32,768 rows or columns: a few KB
    a sheet.  A cell's new row is the number of bits before its own, plus those
    of the sheet's earlier bitmaps.  Cells are shuffled once at most, to meet
    the bitmap of their row; the sheet's column bitmaps travel with it.
    """
    keys = list(keys)
    used = cells.where(F.col("value").isNotNull())
    rows = _bitmaps(used, keys, F.col("row") + 1).select(
        *keys, F.col("_bucket").alias("_rows"), F.col("_bits").alias("_row_bits"), F.col("_before").alias("_row_before"))
    columns = _bitmaps(used, keys, F.col("column")).groupBy(*keys).agg(
        F.collect_list(F.struct("_bucket", "_bits", "_before")).alias("_columns"))
    out = cells.withColumn("_rows", F.bitmap_bucket_number(F.col("row") + 1)).join(rows.join(columns, keys), [*keys, "_rows"])
    mine = F.get(F.filter("_columns", lambda c: c["_bucket"] == F.bitmap_bucket_number(F.col("column"))), 0)
    out = out.withColumn("_column", mine).withColumn("_at", F.bitmap_bit_position(F.col("row") + 1)).withColumn(
        "_on", F.bitmap_bit_position(F.col("column")))
    out = out.where(_bit(F.col("_row_bits"), F.col("_at")) & _bit(F.col("_column._bits"), F.col("_on")))
    new = {"row": F.col("_row_before") + _bits_before(F.col("_row_bits"), F.col("_at")),
           "column": F.col("_column._before") + _bits_before(F.col("_column._bits"), F.col("_on")) + 1}
    return out.select(*[new[c].cast("bigint").alias(c) if c in new else F.col(c) for c in cells.columns])


def _bitmaps(used: DataFrame, keys: list[str], number: Column) -> DataFrame:
    """The numbers of each group as bitmaps: keys, bucket, bits, and how many numbers lie in earlier buckets."""
    bits = used.groupBy(*keys, F.bitmap_bucket_number(number).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return bits.withColumn("_before", F.coalesce(F.sum(F.bitmap_count("_bits")).over(earlier), F.lit(0)))


def _byte(bits: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")


def _bit(bits: Column, at: Column) -> Column:
    return F.coalesce(F.getbit(_byte(bits, at), (at % 8).cast("int")) == 1, F.lit(False))


def _bits_before(bits: Column, at: Column) -> Column:
    """Number of bits set before a position."""
    whole = F.bitmap_count(F.substring(bits, F.lit(1), F.floor(at / 8).cast("int")))
    return whole + F.bit_count(_byte(bits, at).bitwiseAND((F.pow(F.lit(2), at % 8) - 1).cast("int")))


def named_columns(cells: DataFrame) -> DataFrame:
    """Cells with ``column`` as its auto name ``column_N``."""
    return cells.withColumn("column", column_name("column"))
