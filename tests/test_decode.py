"""Workbook decoder (plain Python, runs inside executor tasks)."""

from __future__ import annotations

import datetime as dt

from xlsx_fixture import SAMPLE, write_xlsx

from sheetlake.sources import workbook


def _rows(path):
    out = []
    for chunk in workbook.decode_path(str(path)):
        out.extend(chunk)
    return out


def _cells(rows, sheet=None):
    return [(r[3], r[4], r[5], r[6]) for r in rows if r[0] == "cell" and (sheet is None or r[3] == sheet)]


def test_sample_sheet_gives_rows_times_columns_cells(tmp_path):
    p = tmp_path / "s.xlsx"
    write_xlsx(p, {"Data": SAMPLE})
    cells = _cells(_rows(p))
    assert len(cells) == 15
    assert cells[:3] == [("Data", 0, 1, "1"), ("Data", 0, 2, "a"), ("Data", 0, 3, "1.1")]
    assert cells[-1] == ("Data", 4, 3, "5.5")


def test_first_row_is_data_not_header(tmp_path):
    p = tmp_path / "h.xlsx"
    write_xlsx(p, {"S": [["HeaderA", "HeaderB"], [1, 4], [2, 5]]})
    cells = _cells(_rows(p))
    assert cells[0] == ("S", 0, 1, "HeaderA")
    assert len(cells) == 6


def test_value_text_rules(tmp_path):
    p = tmp_path / "v.xlsx"
    write_xlsx(p, {"S": [[1e10, 1 / 3, -2.5, True], [dt.date(2024, 1, 31), dt.datetime(2024, 2, 1, 13, 5, 7), "x", False]]})
    vals = [c[3] for c in _cells(_rows(p))]
    assert vals == ["10000000000", "0.3333333333333333", "-2.5", "true", "2024-01-31", "2024-02-01 13:05:07", "x", "false"]


def test_blank_rows_and_columns_dropped_and_renumbered(tmp_path):
    p = tmp_path / "b.xlsx"
    write_xlsx(p, {"S": [[None, "a", None, "b"], [None, None, None, None], [None, "c", None, None]]}, offsets={"S": (4, 3)})
    rows = _rows(p)
    sheet = [r for r in rows if r[0] == "sheet"][0]
    assert (sheet[7], sheet[8]) == (2, 2)
    assert _cells(rows) == [("S", 0, 1, "a"), ("S", 0, 2, "b"), ("S", 1, 1, "c"), ("S", 1, 2, None)]


def test_empty_sheet_reported_without_cells(tmp_path):
    p = tmp_path / "e.xlsx"
    write_xlsx(p, {"Empty": [], "Full": [[1]]})
    rows = _rows(p)
    sheets = {r[3]: (r[7], r[8]) for r in rows if r[0] == "sheet"}
    assert sheets == {"Empty": (0, 0), "Full": (1, 1)}
    assert _cells(rows) == [("Full", 0, 1, "1")]


def test_corrupt_and_unsupported_files_give_one_error_row(tmp_path):
    bad = tmp_path / "bad.xlsx"
    bad.write_text("plain text")
    old = tmp_path / "old.xls"
    old.write_bytes(b"\xd0\xcf")
    for p in (bad, old):
        rows = _rows(p)
        assert len(rows) == 1 and rows[0][0] == "error" and rows[0][9]


def test_file_uri_paths(tmp_path):
    p = tmp_path / "u.xlsx"
    write_xlsx(p, {"S": [[1]]})
    rows = _rows("file:" + str(p))
    assert rows[1][1] == str(p)


def test_number_text():
    assert workbook.number_text(3.0) == "3"
    assert workbook.number_text(0.1 + 0.2) == "0.30000000000000004"
    assert workbook.number_text(-0.0000001) == "-0.0000001"
    assert workbook.number_text(-0.0) == "0" and workbook.number_text(1e33) == "1" + "0" * 33


def test_stored_digits_are_kept():
    stored = {"0.0000001234": "0.0000001234", "1E-7": "0.0000001", "-1.50e+3": "-1500", "007.10": "7.1", "12345678901234567890": "12345678901234567890",
              "0.123456789012": "0.123456789012", ".5": "0.5", "5.": "5", "-0.0": "0", "+3": "3", "1e2": "100", "12.34e1": "123.4", "x": "x"}
    assert {k: workbook.stored_number_text(k) for k in stored} == stored


def test_date_text():
    e = workbook._EPOCH_1900
    assert workbook.date_text(e, "45000") == "2023-03-15" and workbook.date_text(e, "45000.5") == "2023-03-15 12:00:00"
    assert workbook.date_text(e, repr(45000 + 3723.25 / 86400)) == "2023-03-15 01:02:03.25"
    assert workbook.date_text(e, "1e9") == "1000000000" and workbook.date_text(e, "-800000.5") == "-800000.5"


def test_two_pass_mode_gives_the_same_rows(tmp_path):
    p = tmp_path / "big.xlsx"
    write_xlsx(p, {"S": [[None, "a", None, 1], [None, None, None, None], [None, "c", None, 2.5]]}, offsets={"S": (2, 2)})
    one = [r for chunk in workbook.decode_path(str(p)) for r in chunk]
    two = [r for chunk in workbook.decode_path(str(p), two_pass_bytes=0) for r in chunk]
    assert one == two and len(_cells(one)) == 4


def test_max_cells_chunks(tmp_path):
    p = tmp_path / "chunks.xlsx"
    write_xlsx(p, {"S": [[i, i + 1, i + 2] for i in range(10)]})
    chunks = list(workbook.decode_path(str(p), max_cells=7))
    assert max(len(c) for c in chunks) <= 7 and sum(len(c) for c in chunks) == 31


def test_rich_text_phonetic_runs_and_early_dates(tmp_path):
    import zipfile

    p = tmp_path / "rich.xlsx"
    write_xlsx(p, {"S": [["x", dt.date(1900, 1, 1), dt.date(1900, 3, 1)]]})
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sst = (f'<?xml version="1.0"?><sst {ns}><si><r><t>Hello </t></r><r><t>world</t></r>'
           f'<rPh sb="0" eb="1"><t>HW</t></rPh></si></sst>')
    out = tmp_path / "rich2.xlsx"
    with zipfile.ZipFile(p) as zin, zipfile.ZipFile(out, "w") as zout:
        for item in zin.namelist():
            zout.writestr(item, sst if item == "xl/sharedStrings.xml" else zin.read(item))
    vals = [c[3] for c in _cells(_rows(out))]
    assert vals == ["Hello world", "1900-01-01", "1900-03-01"]


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_values = st.one_of(
    st.none(),
    st.integers(min_value=-10**12, max_value=10**12),
    st.floats(min_value=-1e9, max_value=1e9, allow_nan=False).map(lambda x: round(x, 4)),
    st.booleans(),
    st.text(alphabet="abcXYZ <>&'\"é", min_size=1, max_size=6).filter(lambda t: t.strip() == t),
)


def _expected_text(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return workbook.number_text(float(v)) if isinstance(v, float) else str(v)
    return v


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(_values, min_size=3, max_size=3), min_size=1, max_size=8))
def test_decoded_values_follow_the_text_rules(tmp_path_factory, grid):
    p = tmp_path_factory.mktemp("prop") / "g.xlsx"
    write_xlsx(p, {"S": grid})
    cells = _cells(_rows(p))
    # expected: blank rows and columns dropped, the rest in order
    keep_rows = [r for r in grid if any(v is not None for v in r)]
    keep_cols = [j for j in range(3) if any(r[j] is not None for r in grid)]
    want = [("S", i, k + 1, _expected_text(r[j])) for i, r in enumerate(keep_rows) for k, j in enumerate(keep_cols)]
    assert cells == want


def test_sheet_documents_hold_whole_rows_and_read_the_sheet_once():
    import io
    from xml.etree import ElementTree as ET

    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    for prefix in ("x:", ""):
        rows = "".join(f'<{prefix}row r="{i}"><{prefix}c r="A{i}"><{prefix}v>{i}</{prefix}v></{prefix}c></{prefix}row>' for i in range(1, 51))
        xml = (f'<?xml version="1.0"?><{prefix}worksheet xmlns{":x" if prefix else ""}="{ns}"><{prefix}dimension ref="A1:A50"/>'
               f'<{prefix}sheetData>{rows}</{prefix}sheetData><{prefix}pageMargins/></{prefix}worksheet>').encode()

        class Once(io.BytesIO):
            read_bytes = 0

            def read(self, n=-1):
                out = super().read(n)
                Once.read_bytes += len(out)
                return out

        for size, chunk in ((200, 64), (1, 7), (10**9, 1 << 20)):
            Once.read_bytes = 0
            documents = list(workbook.sheet_documents(Once(xml), size, chunk))
            seen = [int(r.get("r")) for d in documents for r in ET.fromstring(d).iter(f"{{{ns}}}row")]
            assert seen == list(range(1, 51)) and Once.read_bytes == len(xml)
            assert (len(documents) == 1) == (size == 10**9)
    none = f'<worksheet xmlns="{ns}"><sheetData/></worksheet>'.encode()
    assert list(workbook.sheet_documents(io.BytesIO(none), 10)) == [none]


def test_pattern_and_parser_read_the_same_cells(tmp_path):
    """Sheets read by the cell pattern and, spelt so that it does not apply, by the XML parser."""
    import zipfile

    p = tmp_path / "p.xlsx"
    write_xlsx(p, {"S": [[1, "a & b <c>", 2.5, True, dt.date(2024, 1, 31), None], [None, "\u00e9\u4e2d", -1e-7, False, dt.datetime(2024, 1, 1, 6), "x"]]})
    inline = (b'<c r="F1" t="inlineStr"><is><t xml:space="preserve"> in &amp; line &#x41;</t></is></c><c r="G1" t="str"><f>A1&amp;"x"</f>'
              b'<v>1x</v></c><c r="H1" t="e"><v>#N/A</v></c><c r="I1" s="1"/><c r="J1"><v></v></c></row>')
    edits = {"plain": lambda x: x, "comment": lambda x: x.replace(b"<sheetData>", b"<!-- c --><sheetData>"),
             "reordered": lambda x: x.replace(b'<c r="F1" t="inlineStr">', b'<c t="inlineStr" r="F1">'),
             "cdata": lambda x: x.replace(b"<v>1x</v>", b"<v><![CDATA[1x]]></v>"),
             "rich": lambda x: x.replace(b'<t xml:space="preserve"> in &amp; line &#x41;</t>', b'<r><t xml:space="preserve"> in &amp; </t></r><r><t>line A</t></r>')}
    got = {}
    for name, edit in edits.items():
        out = tmp_path / f"{name}.xlsx"
        with zipfile.ZipFile(p) as zin, zipfile.ZipFile(out, "w") as zout:
            for item in zin.namelist():
                data = zin.read(item)
                if item.startswith("xl/worksheets/"):
                    data = edit(data.replace(b"</row>", inline, 1))
                    assert workbook._is_plain(data, "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}") == (name not in ("comment", "cdata"))
                zout.writestr(item, data)
        got[name] = _cells(_rows(out))
    assert all(g == got["plain"] for g in got.values())
    values = [c[3] for c in got["plain"]][:8]
    assert values == ["1", "a & b <c>", "2.5", "true", "2024-01-31", " in & line A", "1x", "#N/A"]


def test_1904_date_system(tmp_path):
    import zipfile

    p = tmp_path / "d.xlsx"
    write_xlsx(p, {"S": [[dt.date(2024, 1, 31)]]})
    out = tmp_path / "d1904.xlsx"
    with zipfile.ZipFile(p) as zin, zipfile.ZipFile(out, "w") as zout:
        for item in zin.namelist():
            data = zin.read(item)
            if item == "xl/workbook.xml":
                data = data.replace(b"<sheets>", b'<workbookPr date1904="1"/><sheets>')
            zout.writestr(item, data)
    # the same serial counts from 1904-01-01 instead of 1899-12-30: 1462 days later
    assert [c[3] for c in _cells(_rows(out))] == [str(dt.date(2024, 1, 31) + dt.timedelta(days=1462))]


@settings(max_examples=200, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_number_text_reads_back(x):
    text = workbook.number_text(x)
    assert float(text) == x and "e" not in text.lower()
