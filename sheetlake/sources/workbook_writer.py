"""Write .xlsx workbooks with the standard library only (runs inside tasks).

``write_xlsx(path, {"Sheet": [[1, "a", 1.1], ...]})``: rows of Python values
(int, float, str, bool, datetime.date/datetime, None).  Strings go to the
shared-string table, dates get a date style.  ``offsets`` places a sheet's
grid at a given 1-based (row, column) start, leaving blank rows/columns above
and to the left.  ``path`` may be a file object.
"""

from __future__ import annotations

import datetime as dt
import numbers
import zipfile
from xml.sax.saxutils import escape


def _col_letters(n: int) -> str:
    s = ""
    while n:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return s


def _serial(v) -> float:
    """Excel date serial (1900 system, which counts a non-existent 1900-02-29 as day 60)."""
    base = dt.datetime(1899, 12, 30)
    if isinstance(v, dt.datetime):
        x = (v - base).total_seconds() / 86400.0
    else:
        x = float((dt.datetime(v.year, v.month, v.day) - base).days)
    return x - 1 if x < 61 else x


def write_xlsx(path, sheets: dict, offsets: dict | None = None) -> None:
    offsets = offsets or {}
    shared: list[str] = []
    index: dict[str, int] = {}
    sheet_xml = []
    for name, rows in sheets.items():
        r0, c0 = offsets.get(name, (1, 1))
        out = []
        for i, row in enumerate(rows):
            cells = []
            rn = r0 + i
            for j, v in enumerate(row):
                if v is None:
                    continue
                ref = f"{_col_letters(c0 + j)}{rn}"
                if isinstance(v, float) and v != v:
                    continue  # NaN: an empty cell
                if isinstance(v, bool):
                    cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, numbers.Integral):
                    cells.append(f'<c r="{ref}"><v>{int(v)}</v></c>')
                elif isinstance(v, numbers.Real):
                    cells.append(f'<c r="{ref}"><v>{float(v)!r}</v></c>')
                elif isinstance(v, (dt.date, dt.datetime)):
                    style = 2 if isinstance(v, dt.datetime) else 1
                    cells.append(f'<c r="{ref}" s="{style}"><v>{_serial(v)!r}</v></c>')
                else:
                    s = str(v)
                    if s not in index:
                        index[s] = len(shared)
                        shared.append(s)
                    cells.append(f'<c r="{ref}" t="s"><v>{index[s]}</v></c>')
            out.append(f'<row r="{rn}">{"".join(cells)}</row>')
        sheet_xml.append(
            '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/'
            f'spreadsheetml/2006/main"><sheetData>{"".join(out)}</sheetData></worksheet>'
        )
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    wb = (
        f'<?xml version="1.0" encoding="UTF-8"?><workbook {ns} {rns}><sheets>'
        + "".join(
            f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>'
            for i, n in enumerate(sheets, start=1)
        )
        + "</sheets></workbook>"
    )
    rels = (
        '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/'
        '2006/relationships">'
        + "".join(
            f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/'
            f'worksheet" Target="worksheets/sheet{i}.xml"/>'
            for i in range(1, len(sheets) + 1)
        )
        + "</Relationships>"
    )
    sst = (
        f'<?xml version="1.0" encoding="UTF-8"?><sst {ns} count="{len(shared)}" uniqueCount="{len(shared)}">'
        + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared)
        + "</sst>"
    )
    styles = (
        f'<?xml version="1.0" encoding="UTF-8"?><styleSheet {ns}><cellXfs count="3">'
        '<xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="22"/></cellXfs></styleSheet>'
    )
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:  # path or writable file object
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.'
                   'openxmlformats.org/package/2006/content-types"/>')
        z.writestr("xl/workbook.xml", wb)
        z.writestr("xl/_rels/workbook.xml.rels", rels)
        z.writestr("xl/sharedStrings.xml", sst)
        z.writestr("xl/styles.xml", styles)
        for i, x in enumerate(sheet_xml, start=1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", x)
