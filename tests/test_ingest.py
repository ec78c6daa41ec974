"""Catalog scan and workbook ingest end to end on real files."""

from __future__ import annotations

from pyspark.sql import functions as F
from xlsx_fixture import write_xlsx

from sheetlake import schema as S
from sheetlake.operators import catalog as cat
from sheetlake.operators import cells as cl
from sheetlake.sources import catalog, cells_io, ingest


def test_scan_skips_bad_roots_dedups_and_finds_upper_case(spark, tree):
    roots = [str(tree), str(tree / "missing"), str(tree / "no_sov/data4.xlsx"), str(tree)]
    c = catalog.scan(spark, roots)
    got = sorted((r.file_path.replace(str(tree), ""), r.extension) for r in c.collect())
    assert got == [
        ("/no_sov/data4.xlsx", ".xlsx"),
        ("/project1/SOV/2024/broken.xlsx", ".xlsx"),
        ("/project1/SOV/2024/data1.xlsx", ".xlsx"),
        ("/project1/SOV/2024/data2.XLSX", ".xlsx"),
        ("/project2/SOV/archive/nested/data3.xls", ".xls"),
    ]
    assert [f.name for f in c.schema.fields][:3] == S.CATALOG_BASE


def test_scan_of_nothing_keeps_schema(spark, tmp_path):
    c = catalog.scan(spark, [str(tmp_path / "nope")])
    assert c.count() == 0 and c.columns[:3] == S.CATALOG_BASE


def test_marker_folders_of_the_tree(spark, tree):
    c = catalog.list_files(spark, [str(tree)])
    got = [r.folder.replace(str(tree), "") for r in cat.marker_folders(c).collect()]
    assert got == ["/project1/SOV/2024", "/project2/SOV/archive", "/project2/SOV/archive/nested"]


def test_ingest_run_end_to_end(spark, tree):
    out = str(tree / "deep/new/output")  # created with parents
    c = catalog.scan(spark, [str(tree)])
    first = ingest.run(spark, c, out)
    # /SOV/ files only: data1 (2 sheets), data2 (1 sheet + 1 empty), data3.xls (error), broken (error)
    assert (first["files"], first["sheets"], first["rows"], first["errors"], first["skipped"]) == (4, 3, 24, 2, 0)
    cells = cells_io.read_cells(spark, out)
    assert cells.columns == S.CELL_COLUMNS
    assert cells.where(F.col("file_path").isNull()).count() == 0
    sample = [
        (r.row, r.column, r.value)
        for r in cells.where(F.col("worksheet") == "Sheet1").orderBy("row", "column").collect()
    ]
    assert sample[:3] == [(0, 1, "1"), (0, 2, "a"), (0, 3, "1.1")] and len(sample) == 15
    per_file = {r.file_path.rsplit("/", 1)[-1]: r.n_cells for r in cl.cells_per_file(cells).collect()}
    assert per_file == {"data1.xlsx": 21, "data2.XLSX": 3}
    ledger = {r.file_path.rsplit("/", 1)[-1]: r.status for r in cells_io.read_ledger(spark, f"{out}/ledger").collect()}
    assert ledger == {"data1.xlsx": "ok", "data2.XLSX": "ok", "data3.xls": "error", "broken.xlsx": "error"}

    # second run: converted files are skipped, failed ones retried (and fail again)
    second = ingest.run(spark, c, out)
    assert (second["files"], second["rows"], second["errors"], second["skipped"]) == (2, 0, 2, 2)
    assert cells_io.read_cells(spark, out).count() == 24

    # strict path-keyed rule: anything with cells is skipped, errors too once nothing is new
    write_xlsx(tree / "project1/SOV/2024/data5.xlsx", {"New": [[7, 8]]})
    third = ingest.run(spark, catalog.scan(spark, [str(tree)]), out, skip="cells")
    assert third["rows"] == 2
    assert cells_io.read_cells(spark, out).count() == 26


def test_gate_and_no_path_rule(spark, tree):
    c = catalog.scan(spark, [str(tree)])
    out = str(tree / "o_all")
    r = ingest.run(spark, c, out, path_rule=None)
    assert r["files"] == 5 and r["rows"] == 26
    nothing = tree / "flat"
    nothing.mkdir()
    write_xlsx(nothing / "x.xlsx", {"S": [[1]]})
    g = ingest.run(spark, catalog.scan(spark, [str(nothing)]), str(tree / "o_gate"), path_rule="gate")
    assert g["files"] == 0 and g["run_id"] is None


def test_replayed_run_does_not_duplicate(spark, tree):
    c = catalog.scan(spark, [str(tree)])
    out = str(tree / "o_replay")
    sel = c.where(F.col("file_path").contains("/SOV/")).select("file_path", "modified_at")
    ingest.convert(spark, sel, out, "run-a")
    ingest.convert(spark, sel, out, "run-a")
    assert cells_io.read_cells(spark, out).count() == 24
    assert cells_io.read_ledger(spark, f"{out}/ledger").count() == 4


def test_only_existing_and_skip_processed(spark):
    c = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "file_path string")
    listing = spark.createDataFrame([("/a",), ("/c",)], "file_path string")
    done = spark.createDataFrame([("/c",), ("/c",)], "file_path string")
    kept = ingest.skip_processed(ingest.only_existing(c, listing), done)
    assert [r.file_path for r in kept.collect()] == ["/a"]


def test_load_or_scan_uses_saved_catalog_until_rescan(spark, tree):
    store = str(tree / "catalog_store")
    first = catalog.load_or_scan(spark, [str(tree)], store)
    n = first.count()
    write_xlsx(tree / "no_sov/late.xlsx", {"S": [[1]]})
    assert catalog.load_or_scan(spark, [str(tree)], store).count() == n
    assert catalog.load_or_scan(spark, [str(tree)], store, rescan=True).count() == n + 1


def test_empty_frames_keep_schema(spark):
    assert S.empty(spark, S.CELLS).schema == S.CELLS
    assert cells_io.read_cells(spark, "/definitely/not/here").columns == S.CELL_COLUMNS


def test_explicit_file_list_and_exit_code(spark, tree):
    out = str(tree / "o_list")
    files = [str(tree / "project1/SOV/2024/data1.xlsx"), str(tree / "project1/SOV/2024/broken.xlsx")]
    r = ingest.convert_files(spark, files, out)
    assert (r["files"], r["sheets"], r["rows"], r["errors"]) == (2, 2, 21, 1)
    assert ingest.exit_code(r) == 2
    named = cells_io.read_cells(spark, out, column_as="name")
    assert sorted({x.column for x in named.collect()}) == ["column_1", "column_2", "column_3"]


def test_workbooks_written_by_spark_read_back(spark, tmp_path):
    from sheetlake.operators import synth

    df = spark.createDataFrame([(k % 3, k, f"n{k}", k * 1.5) for k in range(25)], "g long, k long, s string, x double")
    written = synth.write_workbooks(df, str(tmp_path / "wb"), F.concat(F.lit("g"), F.col("g").cast("string")),
                                    ["k"], ["k", "s", "x"], rows_per_file=4)
    assert written.count() == 3 + 2 + 2  # groups of 9, 8 and 8 rows, at most 4 rows per file
    out = str(tmp_path / "out")
    ingest.run(spark, catalog.scan(spark, [str(tmp_path / "wb")]), out, path_rule=None)
    cells = cells_io.read_cells(spark, out)
    assert cells.count() == (25 + written.count()) * 3
    first = {(r.row, r.column): r.value for r in cells.where(F.col("file_name") == "g0_part_1.xlsx").collect()}
    assert first[(0, 1)] == "k" and first[(1, 1)] == "0" and first[(2, 3)] == "4.5"


def test_partial_file_retried_without_duplicate_cells(spark, tmp_path):
    import zipfile

    src = tmp_path / "in/SOV"
    src.mkdir(parents=True)
    good = tmp_path / "good.xlsx"
    write_xlsx(good, {"Fine": [[1, 2], [3, 4]], "Broken": [[9]]})
    # rebuild the workbook with the second sheet's XML damaged: that sheet fails, the first converts
    with zipfile.ZipFile(good) as zin, zipfile.ZipFile(src / "mixed.xlsx", "w") as zout:
        for item in zin.namelist():
            data = zin.read(item)
            if item == "xl/worksheets/sheet2.xml":
                data = b"<worksheet><sheetData><row"
            zout.writestr(item, data)
    out = str(tmp_path / "out")
    c = catalog.scan(spark, [str(tmp_path / "in")])
    first = ingest.run(spark, c, out)
    assert (first["sheets"], first["rows"], first["errors"]) == (1, 4, 1)
    assert [r.status for r in cells_io.read_ledger(spark, f"{out}/ledger").collect()] == ["partial"]
    second = ingest.run(spark, c, out)  # partial files are retried by default
    assert second["files"] == 1
    assert cells_io.read_cells(spark, out).count() == 4
    assert cells_io.read_cells(spark, out, latest_only=False).count() == 8


def test_large_workbook_is_split_into_sheet_units(spark, tmp_path):
    src = tmp_path / "in/SOV"
    src.mkdir(parents=True)
    sheets = {f"S{i}": [[i, j, f"v{j}"] for j in range(200)] for i in range(6)}
    sheets["Empty"] = []
    write_xlsx(src / "big.xlsx", sheets)
    write_xlsx(src / "small.xlsx", {"A": [[1]]})
    c = catalog.scan(spark, [str(tmp_path / "in")])
    whole, split = str(tmp_path / "whole"), str(tmp_path / "split")
    r1 = ingest.run(spark, c, whole)
    # thresholds of 0 bytes: every multi-sheet workbook is cut into its sheets
    r2 = ingest.run(spark, c, split, split_file_bytes=0, split_xml_bytes=0)
    assert {k: r1[k] for k in ("files", "sheets", "rows", "errors")} == {k: r2[k] for k in ("files", "sheets", "rows", "errors")}
    assert r2["files"] == 2 and r2["rows"] == 6 * 200 * 3 + 1
    a = sorted(tuple(r) for r in cells_io.read_cells(spark, whole).collect())
    b = sorted(tuple(r) for r in cells_io.read_cells(spark, split).collect())
    assert a == b
    led = {r.file_path.rsplit("/", 1)[-1]: (r.status, r.n_sheets, r.n_empty_sheets, r.n_cells)
           for r in cells_io.read_ledger(spark, f"{split}/ledger").collect()}
    assert led == {"big.xlsx": ("ok", 7, 1, 3600), "small.xlsx": ("ok", 1, 0, 1)}


def test_single_huge_sheet_is_split_into_byte_ranges(spark, tmp_path):
    src = tmp_path / "in/SOV"
    src.mkdir(parents=True)
    rows = [[i, f"t{i}", None if i % 7 == 0 else i * 0.5] for i in range(600)]
    rows[50] = [None, None, None]  # a blank row inside the sheet
    write_xlsx(src / "one.xlsx", {"Only": rows}, offsets={"Only": (3, 2)})
    write_xlsx(src / "two.xlsx", {"A": [[1, 2]], "B": [[3]] * 40})
    c = catalog.scan(spark, [str(tmp_path / "in")])
    whole, split = str(tmp_path / "whole"), str(tmp_path / "split")
    r1 = ingest.run(spark, c, whole)
    # every file planned, every sheet over 2,000 bytes of XML cut into ranges of about that size
    r2 = ingest.run(spark, c, split, split_file_bytes=0, split_xml_bytes=0, range_xml_bytes=2000)
    keys = ("files", "sheets", "rows", "errors")
    assert {k: r1[k] for k in keys} == {k: r2[k] for k in keys}
    a = sorted(tuple(r) for r in cells_io.read_cells(spark, whole).collect())
    b = sorted(tuple(r) for r in cells_io.read_cells(spark, split).collect())
    assert a == b and len(a) == 599 * 3 + 2 + 40
    led = {r.file_path.rsplit("/", 1)[-1]: (r.status, r.n_sheets, r.n_cells)
           for r in cells_io.read_ledger(spark, f"{split}/ledger").collect()}
    assert led == {"one.xlsx": ("ok", 1, 599 * 3), "two.xlsx": ("ok", 2, 42)}
    n_units = spark.read.parquet(f"{split}/runs/run_id={r2['run_id']}/kind=file").count()
    assert n_units > 5  # the single sheet was decoded as several ranges


def test_unreadable_saved_catalog_falls_back_to_a_scan(spark, tree):
    store = tree / "bad_store"
    store.mkdir()
    (store / "part-0.parquet").write_bytes(b"not parquet at all")
    c = catalog.load_or_scan(spark, [str(tree)], str(store))
    assert c.count() == 5


def test_unreadable_cell_output_fails_loudly(spark, tmp_path):
    import pytest

    out = tmp_path / "out/runs/run_id=r1/kind=cell"
    out.mkdir(parents=True)
    (out / "part-0.parquet").write_bytes(b"garbage")
    with pytest.raises(Exception):
        cells_io.read_cells(spark, str(tmp_path / "out"), latest_only=False).count()


def test_output_files_report_of_an_ingest(spark, tree):
    out = str(tree / "o_report")
    ingest.run(spark, catalog.scan(spark, [str(tree)]), out)
    rep = cells_io.output_files_report(spark, out).collect()
    assert sum(r.n_rows for r in rep) == 24
    assert {r.source_file for r in rep} <= {"data1.xlsx", "data2.XLSX"}
    assert all(r.size_kb > 0 for r in rep)
    assert cells_io.output_files_report(spark, str(tree / "nothing")).count() == 0


def test_nested_roots_list_each_file_once(spark, tree):
    c = catalog.scan(spark, [str(tree), str(tree / "project1")])
    paths = [r.file_path for r in c.collect()]
    assert len(paths) == len(set(paths)) == 5


def test_explicit_file_list_accepts_globs(spark, tree):
    c = catalog.from_paths(spark, [str(tree / "project1/SOV/2024/*.xlsx"), str(tree / "no_sov/data4.xlsx")])
    got = sorted(r.file_path.rsplit("/", 1)[-1] for r in c.collect())
    assert got == ["broken.xlsx", "data1.xlsx", "data4.xlsx"]
    assert {r.extension for r in c.collect()} == {".xlsx"}
