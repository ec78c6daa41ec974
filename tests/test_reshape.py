"""Row index, unpivot, pivot back, blank drop."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from sheetlake.operators import reshape


def test_row_index_matches_window_on_skewed_groups(spark):
    # key 0 holds a third of all rows
    rows = [(0 if i % 3 == 0 else i % 50, i, None if i % 17 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, o bigint, v bigint")
    got = reshape.with_row_index(df, ["o"], ["k"], num_partitions=7)
    want = df.withColumn("row", (F.row_number().over(Window.partitionBy("k").orderBy("o")) - 1).cast("bigint"))
    assert sorted(map(tuple, got.select("k", "o", "v", "row").collect())) == sorted(
        map(tuple, want.select("k", "o", "v", "row").collect()))


def test_row_index_global_and_null_keys(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 1)], "k string, o int")
    got = {(r.k, r.o): r.row for r in reshape.with_row_index(df, ["o"], ["k"]).collect()}
    assert got == {(None, 1): 0, (None, 3): 1, ("a", 1): 0, ("a", 2): 1}
    glob = [r.row for r in reshape.with_row_index(df, ["o", "k"]).orderBy("row").collect()]
    assert glob == [0, 1, 2, 3]


def test_to_cells_keeps_nulls_and_casts_each_column_first(spark):
    df = spark.createDataFrame([(0, 1, "a", 1.1), (1, 2, None, 10000000000.0)], "row long, x int, y string, z double")
    cells = reshape.to_cells(df, lineage={"file_path": F.lit("/f.xlsx"), "file_name": F.lit("f.xlsx"),
                                          "worksheet": F.lit("S")})
    assert cells.columns == ["file_path", "file_name", "worksheet", "row", "column", "value"]
    got = sorted((r.row, r.column, r.value) for r in cells.collect())
    assert got == [(0, 1, "1"), (0, 2, "a"), (0, 3, "1.1"), (1, 1, "2"), (1, 2, None), (1, 3, "10000000000")]
    named = reshape.to_cells(df, column_as="name")
    assert sorted({r.column for r in named.collect()}) == ["column_1", "column_2", "column_3"]


def test_drop_blank_rows_and_columns(spark):
    cells = spark.createDataFrame(
        [("f", "S", r, c, v) for r, c, v in [
            (0, 1, "a"), (0, 2, None), (0, 3, "b"),
            (1, 1, None), (1, 2, None), (1, 3, None),
            (2, 1, None), (2, 2, None), (2, 3, "c"),
        ]],
        "file_path string, worksheet string, row long, column long, value string",
    )
    got = sorted((r.row, r.column, r.value) for r in reshape.drop_blank(cells).collect())
    assert got == [(0, 1, "a"), (0, 2, "b"), (1, 1, None), (1, 2, "c")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.text("abc", max_size=3)), min_size=3, max_size=3),
                min_size=1, max_size=12))
def test_unpivot_then_pivot_returns_the_input(spark, grid):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(grid)], "row long, a string, b string, c string")
    cells = reshape.to_cells(df, lineage={"file_path": F.lit("/f"), "worksheet": F.lit("S")})
    assert cells.count() == len(grid) * 3
    back = reshape.to_wide(cells, n_columns=3).orderBy("row")
    assert [tuple(r)[3:] for r in back.collect()] == [tuple(row) for row in grid]


def test_lineage_cuts_are_tracked_and_dropped(spark):
    from sheetlake.session import cut_lineage, drop_lineage_cuts

    drop_lineage_cuts(spark)
    cut = cut_lineage(spark.range(10))
    assert cut.count() == 10
    assert drop_lineage_cuts(spark) == 1


def test_sheets_to_cells_equals_one_sheet_at_a_time(spark):
    a = spark.createDataFrame([(2, "x", 1.5), (1, None, 2.0)], "k long, s string, d double")
    b = spark.createDataFrame([(10, True), (5, False), (7, None)], "k long, flag boolean")
    lin = lambda n: {"file_path": f"/f/{n}.xlsx", "file_name": f"{n}.xlsx", "worksheet": n}
    stacked = reshape.sheets_to_cells([(a, "k", lin("a"), ["k", "s", "d"]), (b, "k", lin("b"), ["k", "flag"])])
    one = []
    for df, name, cols in ((a, "a", ["k", "s", "d"]), (b, "b", ["k", "flag"])):
        idx = reshape.with_row_index(df, ["k"])
        one.append(reshape.to_cells(idx, lineage={k: F.lit(v) for k, v in lin(name).items()}, columns=cols))
    expected = one[0].unionByName(one[1])
    assert sorted(map(tuple, stacked.collect())) == sorted(map(tuple, expected.collect()))


def test_write_cells_layouts_read_back_whole(spark, tmp_path):
    from sheetlake.sources import cells_io

    cells = spark.createDataFrame(
        [(f"/f{i % 3}.xlsx", f"f{i % 3}.xlsx", f"S{i % 2}", i, j, f"v{i}.{j}") for i in range(40) for j in (1, 2)],
        "file_path string, file_name string, worksheet string, row long, column long, value string",
    )
    for layout in ("by_file", "per_sheet"):
        out = str(tmp_path / layout)
        cells_io.write_cells(cells, out, buckets=4, layout=layout)
        cells_io.write_cells(cells.limit(0), out, buckets=4, layout=layout)  # appending nothing changes nothing
        back = cells_io.read_cells(spark, out)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


def test_sheets_ordered_by_keys_of_any_type(spark):
    import datetime as dt

    from sheetlake.operators import reshape

    def sheet(name, rows, kind):
        frame = spark.createDataFrame(rows, f"k {kind}, v string").repartition(3)
        return frame, "k", {"file_path": f"/{name}", "file_name": name, "worksheet": "s"}, ["v"]

    cells = reshape.sheets_to_cells([
        sheet("text", [("b", "2"), ("a", "1"), ("c", "3")], "string"),
        sheet("fraction", [(1.75, "3"), (1.25, "1"), (1.5, "2")], "double"),
        sheet("day", [(dt.date(2024, 1, 2), "2"), (dt.date(2024, 1, 1), "1")], "date"),
        sheet("whole", [(10, "2"), (9, "1")], "long"),
    ])
    assert all(int(r.value) == r.row + 1 for r in cells.collect()) and cells.count() == 10
