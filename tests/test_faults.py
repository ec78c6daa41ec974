"""Damaged files, awkward names, refused lists, catalog stores and files that change between runs."""

from __future__ import annotations

import os
import zipfile

import pytest
from xlsx_fixture import write_xlsx

from sheetlake import schema as S
from sheetlake.operators import changes
from sheetlake.sources import catalog, cells_io, ingest, workbook


def _rewritten(path, change):
    """The workbook at ``path`` with its parts passed through ``change(name, data)``."""
    with zipfile.ZipFile(path) as z:
        parts = {n: change(n, z.read(n)) for n in z.namelist()}
    with zipfile.ZipFile(path, "w") as z:
        for n, data in parts.items():
            z.writestr(n, data)


def _status(spark, out):
    return {r.file_path.rsplit("/", 1)[-1]: r.status for r in cells_io.read_ledger(spark, f"{out}/ledger").collect()}


def test_strict_workbooks_are_read_and_sheetless_ones_are_errors(tmp_path):
    strict, bare = tmp_path / "strict.xlsx", tmp_path / "bare.xlsx"
    for p in (strict, bare):
        write_xlsx(p, {"A": [[1, "x"], [2.5, "y"]]})
    plain = [r for chunk in workbook.decode_path(str(strict)) for r in chunk]
    _rewritten(strict, lambda n, data: data
               .replace(b"http://schemas.openxmlformats.org/spreadsheetml/2006/main", b"http://purl.oclc.org/ooxml/spreadsheetml/main")
               .replace(b"http://schemas.openxmlformats.org/officeDocument/2006/relationships",
                        b"http://purl.oclc.org/ooxml/officeDocument/relationships"))
    assert [r for chunk in workbook.decode_path(str(strict)) for r in chunk] == plain
    _rewritten(bare, lambda n, data: b'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"/>'
               if n == "xl/workbook.xml" else data)
    rows = [r for chunk in workbook.decode_path(str(bare)) for r in chunk]
    assert len(rows) == 1 and rows[0][0] == "error" and "no sheets" in rows[0][9]


def test_an_impossible_date_is_one_cell_not_the_sheet(tmp_path):
    p = tmp_path / "d.xlsx"
    import datetime as dt

    write_xlsx(p, {"A": [[dt.date(2024, 1, 2), "x"], [dt.date(2024, 1, 3), "y"]]})
    serial = str(float((dt.datetime(2024, 1, 2) - dt.datetime(1899, 12, 30)).days)).encode()
    _rewritten(p, lambda n, data: data.replace(serial, b"99999999999"))
    values = [r[6] for chunk in workbook.decode_path(str(p)) for r in chunk if r[0] == "cell"]
    assert values == ["99999999999", "x", "2024-01-03", "y"]


def test_damaged_sheet_gives_one_error_and_no_cells_at_any_size(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name in ("start", "middle", "end", "tail"):
        write_xlsx(src / f"{name}.xlsx", {"A": [[i, f"t{i}"] for i in range(600)], "B": [[1]]})
    where = {"start": b'<row r="2"', "middle": b'<row r="300"', "end": b'<row r="600"', "tail": b"</sheetData>"}
    for name, mark in where.items():
        _rewritten(src / f"{name}.xlsx", lambda n, data, mark=mark: data.replace(mark, mark + b"<", 1) if n.endswith("sheet1.xml") else data)
    listed = catalog.scan(spark, [str(src)])
    seen = []
    for options in ({}, {"split_file_bytes": 0, "split_xml_bytes": 0}, {"split_file_bytes": 0, "split_xml_bytes": 0, "range_xml_bytes": 1500}):
        out = str(tmp_path / f"out{len(seen)}")
        ingest.run(spark, listed, out, path_rule=None, **options)
        ledger = sorted((r.file_path, r.status, r.n_sheets, r.n_cells, r.n_errors)
                        for r in cells_io.read_ledger(spark, f"{out}/ledger").collect())
        seen.append((ledger, sorted(map(tuple, cells_io.read_cells(spark, out).collect()))))
    assert seen[0] == seen[1] == seen[2]
    assert {x[1:] for x in seen[0][0]} == {("partial", 1, 1, 1)} and len(seen[0][1]) == 4


def test_a_run_that_cannot_read_a_file_keeps_its_earlier_cells(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    write_xlsx(src / "a.xlsx", {"A": [[1, 2], [3, 4]], "B": [[5]]})
    _rewritten(src / "a.xlsx", lambda n, data: data[:-20] if n.endswith("sheet2.xml") else data)
    ingest.run(spark, catalog.scan(spark, [str(src)]), out, path_rule=None)
    assert _status(spark, out) == {"a.xlsx": "partial"} and cells_io.read_cells(spark, out).count() == 4
    (src / "a.xlsx").write_bytes(b"gone bad")
    second = ingest.run(spark, catalog.scan(spark, [str(src)]), out, path_rule=None)
    assert second["errors"] == 1 and cells_io.read_cells(spark, out).count() == 4
    third = ingest.run(spark, catalog.scan(spark, [str(src)]), out, path_rule=None, skip="cells")
    assert (third["files"], third["skipped"]) == (0, 1)


def test_modified_files_are_converted_again_and_touched_ones_are_not(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for name in ("same", "touched", "changed"):
        write_xlsx(src / f"{name}.xlsx", {"A": [[1, 2]]})
    ingest.run(spark, catalog.scan(spark, [str(src)]), out, path_rule=None)
    old = cells_io.read_ledger(spark, f"{out}/ledger")
    assert old.where("file_hash is null").isEmpty()
    write_xlsx(src / "changed.xlsx", {"A": [[7, 8, 9]]})
    for name in ("touched", "changed"):
        os.utime(src / f"{name}.xlsx", (2_000_000_000, 2_000_000_000))
    listed = catalog.scan(spark, [str(src)])
    assert {r.file_path.rsplit("/", 1)[-1]: r.status for r in changes.detect(old, listed).collect()} == {
        "same.xlsx": "unchanged", "touched.xlsx": "unchanged", "changed.xlsx": "modified"}
    again = ingest.run(spark, listed, out, path_rule=None)
    assert (again["files"], again["skipped"]) == (1, 2)
    cells = cells_io.read_cells(spark, out, extra=S.CELL_VERSION)
    assert cells.count() == 2 + 2 + 3 and cells_io.read_cells(spark, out, latest_only=False).count() == 2 + 2 + 2 + 3
    versions = {r.file_name: r.source_modified_at.year for r in cells.collect()}
    assert versions["changed.xlsx"] == 2033 and versions["same.xlsx"] != 2033
    (src / "same.xlsx").unlink()
    gone = changes.hash_files(listed.where("file_path like '%same.xlsx'")).first()
    assert gone.file_hash is None and gone.message


def test_names_and_folders(spark, tmp_path):
    for folder in ("_x/.hidden", "Reports [2024]/{a}", "flat", "empty/SOV/z", "we:ird *?"):
        (tmp_path / folder).mkdir(parents=True)
    names = ["_x/.hidden/_a.xlsx", "Reports [2024]/{a}/b (1).XLSX", "flat/.c.xlsx", "we:ird *?/d%20e.xlsm", "top.xls"]
    for n in names:
        (tmp_path / n).write_bytes(b"x")
    listed = catalog.scan(spark, [str(tmp_path), str(tmp_path / "nope"), str(tmp_path / "top.xls")])
    assert sorted(r.file_path for r in listed.collect()) == sorted(str(tmp_path / n) for n in names)
    folders = {r.folder for r in catalog.folders(spark, [str(tmp_path)]).collect()}
    assert str(tmp_path / "empty/SOV/z") in folders and str(tmp_path) in folders and len(folders) == 1 + 9
    usable, skipped = catalog.check_roots([str(tmp_path), str(tmp_path / "nope"), str(tmp_path / "top.xls"), str(tmp_path) + "/"])
    assert usable == [str(tmp_path)] and [why for _, why in skipped] == ["does not exist", "is not a directory"]
    rows = catalog.tree(spark, [str(tmp_path)]).where("kind = 'file' and path like '%top.xls'").collect()
    assert rows[0].size == 1 and rows[0].modified_at is not None


def test_explicit_lists(spark, tmp_path):
    write_xlsx(tmp_path / "a [1].xlsx", {"A": [[1]]})
    (tmp_path / "n.txt").write_text("text")
    with pytest.raises(ValueError, match="nope.xlsx"):
        catalog.from_paths(spark, [str(tmp_path / "a [1].xlsx"), str(tmp_path / "nope.xlsx")])
    with pytest.raises(ValueError, match="not a file"):
        catalog.from_paths(spark, [str(tmp_path)])
    r = ingest.convert_files(spark, [str(tmp_path / "a [1].xlsx"), str(tmp_path / "n.txt")], str(tmp_path / "out"))
    assert (r["files"], r["rows"], r["errors"]) == (2, 1, 1)


def test_catalog_store_keeps_every_root(spark, tmp_path):
    roots = [tmp_path / x for x in ("one", "two", "bare")]
    for r in roots:
        r.mkdir()
    for r in roots[:2]:
        write_xlsx(r / "a.xlsx", {"A": [[1]]})
    store = str(tmp_path / "store")
    ask = lambda *rs, **k: sorted(r.file_path for r in catalog.load_or_scan(spark, [str(x) for x in rs], store, **k).collect())
    assert ask(roots[0], roots[2]) == [str(roots[0] / "a.xlsx")]
    write_xlsx(roots[0] / "late.xlsx", {"A": [[1]]})
    write_xlsx(roots[2] / "late.xlsx", {"A": [[1]]})
    assert ask(roots[1]) == [str(roots[1] / "a.xlsx")]
    # both roots of the first scan are still covered, the one without spreadsheets too
    assert ask(*roots) == [str(roots[0] / "a.xlsx"), str(roots[1] / "a.xlsx")]
    assert len(ask(*roots, rescan=True)) == 4 and len(ask(*roots)) == 4
