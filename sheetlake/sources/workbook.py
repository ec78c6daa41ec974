"""Workbook bytes -> decoded rows (runs inside executor tasks; no Spark import).

Office Open XML workbooks (``.xlsx``/``.xlsm``) are zip archives of XML parts;
they are read with the standard library only.  Every sheet is read without a
header (the first row is data); fully blank rows and columns are dropped and
the rest renumbered densely (rows from 0, columns from 1); every remaining
(row, column) pair becomes one cell, empty ones with a null value.

Value text: numbers with all stored digits, without exponent and without
trailing zeros; dates ``yyyy-MM-dd`` (with `` HH:mm:ss`` when a time is
present, and milliseconds when there are any), booleans ``true``/``false``,
text as stored.  Formulas give their cached value.

Rows are tuples in the order of ``schema.DECODED``:
(kind, file_path, file_name, worksheet, row, column, value, n_rows, n_cols, message).
"""

from __future__ import annotations

import datetime as _dt
import functools
import hashlib
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree as ET
from xml.parsers import expat

import numpy as np

from .files import open_input, plain_path

# The namespaces of spreadsheet parts and of relationship ids, in the usual and in the strict form.
NAMESPACES = {
    "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}":
        "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}",
    "{http://purl.oclc.org/ooxml/spreadsheetml/main}": "{http://purl.oclc.org/ooxml/officeDocument/relationships}",
}

# Built-in number format ids that show dates or times.
DATE_FORMAT_IDS = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36,
                             45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58])
OOXML_EXTENSIONS = (".xlsx", ".xlsm")

_DATE_TOKENS = re.compile(r"[dmyhs]", re.IGNORECASE)
_EPOCH_1900 = _dt.datetime(1899, 12, 30)
_EPOCH_1904 = _dt.datetime(1904, 1, 1)


_NUMBER = re.compile(r"([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?")


@functools.lru_cache(maxsize=1 << 14)
def stored_number_text(raw: str) -> str:
    """A stored number's text: its digits as they are, exponent expanded, needless zeros left out."""
    raw = raw.strip()
    if raw.isdigit() and raw[0] != "0":
        return raw
    found = _NUMBER.fullmatch(raw)
    if not found or not (found[2] or found[3]):
        return raw  # not a number: what is stored
    sign, whole, part, power = found.groups()
    digits, point = whole + part, len(whole) + int(power or 0)
    digits = "0" * max(0, -point) + digits + "0" * max(0, point - len(digits))
    point = max(0, point)
    head, tail = digits[:point].lstrip("0") or "0", digits[point:].rstrip("0")
    text = f"{head}.{tail}" if tail else head
    return "0" if text == "0" else ("-" if sign == "-" else "") + text


def number_text(x: float) -> str:
    """Text of a number under the value rules (see module doc)."""
    return str(x) if x != x or x in (float("inf"), float("-inf")) else stored_number_text(repr(float(x)))


@functools.lru_cache(maxsize=1 << 14)
def date_text(epoch: _dt.datetime, raw: str) -> str:
    """A date serial as text, to the millisecond; a serial that is no date stays a number."""
    try:
        x = float(raw)
        if epoch is _EPOCH_1900 and 0 < x < 60:
            x += 1  # serials before the non-existent 1900-02-29 count from 1899-12-31
        days = int(x // 1)
        when = epoch + _dt.timedelta(days=days, milliseconds=round((x - days) * 86_400_000))
    except (OverflowError, ValueError):
        return stored_number_text(raw)
    if when.time() == _dt.time(0):
        return when.date().isoformat()
    text = when.isoformat(" ", "milliseconds")
    return text.rstrip("0").rstrip(".") if "." in text else text


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n


def _text_of(el, ns: str) -> str:
    """Text of a shared or inline string: its ``<t>``, or the ``<t>`` of its rich-text runs.

    Phonetic guides (``<rPh>``) also hold ``<t>`` elements; they are not part of the value.
    """
    t = el.find(f"{ns}t")
    if t is not None:
        return t.text or ""
    return "".join(r.findtext(f"{ns}t", "") for r in el.findall(f"{ns}r"))


def _sheet_list(zf: zipfile.ZipFile) -> tuple[ET.Element, str, list[tuple[str, str | None]]]:
    """The workbook part, its namespace, and (name, part) of each sheet; no sheet list is an error."""
    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    ns = wb.tag[: wb.tag.find("}") + 1]
    if ns not in NAMESPACES:
        raise ValueError(f"not a workbook: root element {wb.tag}")
    rels = {}
    if "xl/_rels/workbook.xml.rels" in zf.namelist():
        for r in ET.fromstring(zf.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target", "")
            rels[r.get("Id")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)
    sheets = [(s.get("name"), rels.get(s.get(f"{NAMESPACES[ns]}id"))) for s in wb.iter(f"{ns}sheet")]
    if not sheets:
        raise ValueError("the workbook lists no sheets")
    return wb, ns, sheets


def _is_date_format(code: str) -> bool:
    stripped = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    return stripped.lower() != "general" and bool(_DATE_TOKENS.search(stripped))


# A cell as writers usually spell it; a sheet with any cell that is spelt otherwise is read by the XML parser alone.
_CELL = re.compile(
    rb'<c r="([A-Z]{1,3})[0-9]{1,7}"(?: s="([0-9]+)")?(?: t="([a-zA-Z]+)")?(?:/>|>(?:<f[^>]*/>|<f[^>]*>[^<]*</f>)?'
    rb'(?:<v/>|<v>([^<]*)</v>)?(?:<is>(?:<t/>|<t(?: [^>]*)?>([^<]*)</t>)?</is>)?</c>)')
_CELL_TAG = re.compile(rb"<c[\s>/]")
_PREFIXED = re.compile(rb"<[A-Za-z_][\w.-]*:(?:c|row|sheetData|worksheet)[\s>/]")
_ROW_NUMBER = re.compile(rb"[^>]*?\sr=\"([0-9]+)\"")
_REFERENCE = re.compile(r"&(?:#([0-9]+)|#x([0-9A-Fa-f]+)|(lt|gt|amp|quot|apos));")
_ENTITY = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def _plain(raw: bytes) -> str:
    """Text between two tags, references resolved."""
    text = raw.decode()
    if "&" not in text:
        return text
    return _REFERENCE.sub(lambda m: chr(int(m[1])) if m[1] else chr(int(m[2], 16)) if m[2] else _ENTITY[m[3]], text)


def _is_plain(data: bytes, ns: str) -> bool:
    """Whether a sheet document is well-formed UTF-8 XML without anything that needs the XML parser to read its cells."""
    head = data[:512]
    root = b'<worksheet xmlns="' + ns.strip("{}").encode() + b'"'
    if root not in head or (b"encoding=" in head and not re.search(rb"encoding=[\"']utf-8[\"']", head, re.IGNORECASE)):
        return False
    if b"<!" in data or b"\r" in data or data.count(b"<?") > head.startswith(b"<?xml") or _PREFIXED.search(data):
        return False
    try:
        expat.ParserCreate(namespace_separator="}").Parse(data, True)
    except expat.ExpatError:
        return False
    return True


class _Book:
    def __init__(self, zf: zipfile.ZipFile):
        self.zf = zf
        wb, self.ns, self.sheets = _sheet_list(zf)
        ns, names = self.ns, set(zf.namelist())
        pr = wb.find(f"{ns}workbookPr")
        self.epoch = _EPOCH_1904 if pr is not None and pr.get("date1904") in ("1", "true") else _EPOCH_1900
        self._shared = None if "xl/sharedStrings.xml" in names else []
        self.date_styles = set()
        if "xl/styles.xml" in names:
            st = ET.fromstring(zf.read("xl/styles.xml"))
            custom = {}
            for f in st.iter(f"{ns}numFmt"):
                custom[int(f.get("numFmtId"))] = f.get("formatCode", "")
            xfs = st.find(f"{ns}cellXfs")
            for i, xf in enumerate(xfs if xfs is not None else []):
                fid = int(xf.get("numFmtId", "0"))
                if fid in DATE_FORMAT_IDS or (fid in custom and _is_date_format(custom[fid])):
                    self.date_styles.add(i)

    @property
    def shared(self) -> list[str]:
        """The shared strings, read when the first cell needs one."""
        if self._shared is None:
            held = []
            for _, el in ET.iterparse(self.zf.open("xl/sharedStrings.xml")):
                if el.tag == f"{self.ns}si":
                    held.append(_text_of(el, self.ns))
                    el.clear()
            self._shared = held
        return self._shared

    def value(self, c) -> str | None:
        t = c.get("t", "n")
        if t == "inlineStr":
            is_ = c.find(f"{self.ns}is")
            return _text_of(is_, self.ns) if is_ is not None else None
        v = c.find(f"{self.ns}v")
        if v is None or v.text is None:
            return None
        raw = v.text
        if t == "s":
            return self.shared[int(raw)]
        if t == "b":
            return "true" if raw.strip() in ("1", "true") else "false"
        if t in ("str", "e", "d"):
            return raw
        if self.date_styles and int(c.get("s", "0")) in self.date_styles:
            return date_text(self.epoch, raw)
        return stored_number_text(raw)

    def iter_rows(self, part: str, source=None) -> Iterator[tuple[int, list[tuple[int, str]]]]:
        """(row, [(column, text), ...]) of the non-empty cells, 1-based physical positions.

        ``source``: a file object with the sheet XML (a row range) instead of the part.
        """
        row_no = 0
        row_tag, cell_tag = f"{self.ns}row", f"{self.ns}c"
        letters_ix: dict[str, int] = {}
        digits = "0123456789"
        for _, el in ET.iterparse(source if source is not None else self.zf.open(part)):
            if el.tag != row_tag:
                continue
            row_no = int(el.get("r", row_no + 1))
            col_no = 0
            found = []
            for c in el.iter(cell_tag):
                ref = c.get("r")
                if ref:
                    letters = ref.rstrip(digits)
                    col_no = letters_ix.get(letters) or letters_ix.setdefault(letters, _col_index(letters))
                else:
                    col_no += 1
                val = self.value(c)
                if val is not None and val != "":
                    found.append((col_no, val))
            el.clear()
            if found:
                yield row_no, found

    def text(self, kind: bytes, style: bytes, raw: bytes, inline: bytes) -> str | None:
        """``value`` of a cell from the bytes of its type, style, ``<v>`` and inline text."""
        if kind == b"inlineStr":
            return _plain(inline)
        if not raw:
            return None
        if kind == b"s":
            return self.shared[int(raw)]
        if kind in (b"", b"n"):
            if style and self.date_styles and int(style) in self.date_styles:
                return date_text(self.epoch, raw.decode())
            return stored_number_text(raw.decode())
        return ("true" if raw.strip() in (b"1", b"true") else "false") if kind == b"b" else (
            _plain(raw) if kind in (b"str", b"e", b"d") else stored_number_text(_plain(raw)))

    def document_rows(self, data: bytes) -> Iterator[tuple[int, list[tuple[int, str]]]]:
        """``iter_rows`` of a sheet document in memory: by one pattern over its cells where it is plain, else parsed."""
        if not _is_plain(data, self.ns):
            yield from self.iter_rows("", source=io.BytesIO(data))
            return
        begin = re.search(rb"<sheetData(?:\s[^>]*)?>", data)
        body = data[begin.end():data.rfind(b"</sheetData>")] if begin and not begin[0].endswith(b"/>") else b""
        rows = body.split(b"<row")[1:]
        found = [_CELL.findall(r) for r in rows]
        if sum(map(len, found)) != len(_CELL_TAG.findall(body)):
            yield from self.iter_rows("", source=io.BytesIO(data))
            return
        number, columns = 0, {}
        text = functools.lru_cache(maxsize=1 << 14)(self.text)
        for row, cells in zip(rows, found, strict=True):
            m = _ROW_NUMBER.match(row)
            number = int(m[1]) if m else number + 1
            out = []
            for letters, style, kind, raw, inline in cells:
                value = text(kind, style, raw, inline)
                if value:
                    column = columns.get(letters) or columns.setdefault(letters, _col_index(letters.decode()))
                    out.append((column, value))
            if out:
                yield number, out

    def part_size(self, part: str) -> int:
        return self.zf.getinfo(part).file_size


def _error(path, name, sheet, message):
    return ("error", path, name, sheet, None, None, None, None, None, message)


class Cells(NamedTuple):
    """A stretch of a sheet's cells, by column: one entry per cell in rows, columns and values."""

    path: str
    name: str
    sheet: str
    rows: np.ndarray
    columns: np.ndarray
    values: list

    def tuples(self) -> list[tuple]:
        return [("cell", self.path, self.name, self.sheet, r, c, v, None, None, None)
                for r, c, v in zip(self.rows.tolist(), self.columns.tolist(), self.values)]


def _cell_chunks(path: str, name: str, sheet: str, rows, col_ix: dict[int, int], first_row: int,
                 max_cells: int) -> Iterator[Cells]:
    """The cells of rows [(number, [(column, text)])], empty ones included, at most ``max_cells`` at a time."""
    width = len(col_ix)
    held: list = []
    start = first_row

    def chunk() -> Cells:
        n = len(held) // width
        out = Cells(path, name, sheet, np.repeat(np.arange(start, start + n), width), np.tile(np.arange(1, width + 1), n), held)
        return out

    for _, found in rows:
        values = [None] * width
        for c, v in found:
            values[col_ix[c] - 1] = v
        held.extend(values)
        if len(held) + width > max_cells:
            yield chunk()
            start += len(held) // width
            held = []
    if held:
        yield chunk()


# Sheet parts larger than this (uncompressed XML bytes) are read twice instead of held.
TWO_PASS_BYTES = 64 << 20


def _decode_sheet(book: _Book, path: str, name: str, sheet_name: str, part: str | None, max_cells: int,
                  two_pass_bytes: int) -> Iterator[list[tuple] | Cells]:
    """A sheet's summary row, then its cells in chunks; an error row if it fails, and then no cells."""
    try:
        if part is None:
            raise KeyError(f"no part for sheet {sheet_name!r}")
        held = n_rows = None
        if book.part_size(part) <= two_pass_bytes:
            # one pass: the sheet's non-empty cells are held until its width is known
            held = list(book.document_rows(book.zf.read(part)))
            n_rows, used = len(held), {c for _, found in held for c, _ in found}
        else:
            # two passes: first only the used column numbers, then stream the values
            n_rows, used = 0, set()
            for _, found in book.iter_rows(part):
                n_rows += 1
                used.update(c for c, _ in found)
    except Exception as e:  # one bad sheet does not stop the file
        yield [_error(path, name, sheet_name, f"{type(e).__name__}: {e}")]
        return
    col_ix = {c: i for i, c in enumerate(sorted(used), start=1)}
    yield [("sheet", path, name, sheet_name, None, None, None, n_rows, len(col_ix), None)]
    yield from _cell_chunks(path, name, sheet_name, held if held is not None else book.iter_rows(part), col_ix, 0, max_cells)


def decode_bytes_file(fileobj, path: str, max_cells: int = 50_000,
                      two_pass_bytes: int = TWO_PASS_BYTES,
                      sheet_index: int | None = None) -> Iterator[list[tuple] | Cells]:
    """Decode one workbook (or only its sheet number ``sheet_index``) from a seekable file object.

    Yields lists of summary and error rows, and stretches of cells.  Memory: a sheet up to ``two_pass_bytes`` of XML is
    held as its non-empty cells; a larger one is parsed twice (row/column
    numbers first, values second), holding only the index sets.
    """
    name = path.rsplit("/", 1)[-1]
    try:
        book = _Book(zipfile.ZipFile(fileobj))
    except Exception as e:  # not a workbook at all: one error row for the file
        yield [_error(path, name, None, f"{type(e).__name__}: {e}")]
        return
    sheets = book.sheets if sheet_index is None else book.sheets[sheet_index:sheet_index + 1]
    for sheet_name, part in sheets:
        yield from _decode_sheet(book, path, name, sheet_name, part, max_cells, two_pass_bytes)


_SHEET_DATA = re.compile(rb"<([A-Za-z_][\w.-]*:)?sheetData\b[^>]*?(/?)>")
_ROOT_TAG = re.compile(rb"<([A-Za-z_][\w.:-]*)[\s>]")


def sheet_documents(stream, part_bytes: int, chunk: int = 1 << 20) -> Iterator[bytes]:
    """A sheet's XML, read once from its beginning to its end, as documents of about ``part_bytes`` that hold whole rows.

    Each document has the sheet's head and closing tags.  The last one ends as
    the sheet itself does, so what is wrong there shows when it is parsed; a
    sheet without rows is one document.
    """
    buf = bytearray()
    begin = None
    while begin is None:
        data = stream.read(chunk)
        buf += data
        begin = _SHEET_DATA.search(buf)
        if not data or (begin and begin.group(2)):  # no sheetData, or one without rows
            yield bytes(buf) + stream.read()
            return
    head, prefix = bytes(buf[:begin.end()]), begin.group(1) or b""
    root = _ROOT_TAG.search(head, head.find(b"<", head.find(b"?>") + 1 if head.startswith(b"<?") else 0)).group(1)
    tail = b"</" + prefix + b"sheetData></" + root + b">"
    row_start, data_end = re.compile(rb"<" + re.escape(prefix) + rb"row[\s>/]"), b"</" + prefix + b"sheetData"
    del buf[:begin.end()]
    seen = 0  # up to here no cut can lie
    while True:
        end = buf.find(data_end, seen)
        m = row_start.search(buf, max(seen, part_bytes)) if len(buf) > part_bytes else None
        while m and (end < 0 or m.start() < end):
            yield head + bytes(buf[:m.start()]) + tail
            end -= m.start() if end >= 0 else 0
            del buf[:m.start()]
            m = row_start.search(buf, part_bytes) if len(buf) > part_bytes else None
        if end >= 0:
            break
        seen = max(0, len(buf) - 64)  # a tag split over two reads stays whole
        data = stream.read(chunk)
        if not data:
            break
        buf += data
    yield head + bytes(buf) + stream.read()


def cut_sheet(path: str, sheet_index: int, part_bytes: int, store) -> Iterator[tuple[int, int, int, int]]:
    """Inflate a sheet once and add its documents, deflated, to an open file: (number, place, stored bytes, bytes of XML)."""
    with open_input(path) as f:
        book = zipfile.ZipFile(f)
        _, part = _sheet_list(book)[2][sheet_index]
        with book.open(part) as stream:
            for number, document in enumerate(sheet_documents(stream, part_bytes)):
                at, data = store.tell(), zlib.compress(document, 1)
                store.write(data)
                yield number, at, len(data), len(document)


class Parts:
    """Reads stored parts; a workbook's strings and styles and the file of its parts stay open for the parts that follow."""

    def __init__(self):
        self.path = self.book = self.file = None
        self.store = self.stored = None

    def rows(self, path: str, store: str, at: int, length: int) -> Iterator[tuple[int, list[tuple[int, str]]]]:
        if path != self.path:
            if self.file is not None:
                self.file.close()
            self.file = open_input(path)
            self.path, self.book = path, _Book(zipfile.ZipFile(self.file))
        if store != self.store:
            opened = open_input(store)
            if self.stored is not None:
                self.stored.close()
            self.store, self.stored = store, opened
        self.stored.seek(at)
        return self.book.document_rows(zlib.decompress(self.stored.read(length)))

    def index(self, path: str, *part) -> tuple[int, list[int]]:
        """Non-empty row count and column numbers of one part (first pass of a split sheet)."""
        n, cols = 0, set()
        for _, found in self.rows(path, *part):
            n += 1
            cols.update(c for c, _ in found)
        return n, sorted(cols)

    def decode(self, path: str, sheet: str, part: tuple, row_offset: int, cols: list[int], max_cells: int = 50_000) -> Iterator[Cells]:
        """Cells of one part, numbered with the sheet-wide row offset and column map."""
        shown = plain_path(path)
        col_ix = {c: i for i, c in enumerate(cols, start=1)}
        yield from _cell_chunks(shown, shown.rsplit("/", 1)[-1], sheet, self.rows(path, *part), col_ix, row_offset, max_cells)


def sheet_name(path: str, sheet_index: int) -> str | None:
    """Name of a sheet, None if even that cannot be read."""
    try:
        with open_input(path) as f:
            return _sheet_list(zipfile.ZipFile(f))[2][sheet_index][0]
    except Exception:
        return None


def plan_units(path: str, split_bytes: int, range_bytes: int | None = None) -> list[tuple]:
    """Work units of one workbook: ``(sheet index, XML bytes, whether the sheet is to be cut into parts)``.

    ``[(-1, bytes, False)]`` is the whole file; otherwise one unit per sheet.

    Only the zip directory and the workbook part are read.  A workbook whose
    sheet XML adds up to more than ``split_bytes`` is cut into its sheets so
    that one large workbook is decoded by many tasks; a sheet of more than
    ``range_bytes`` of XML is cut further.  Anything that cannot be planned
    stays one whole unit (its decoding reports the error).
    """
    shown = plain_path(path)
    ext = ("." + shown.rsplit(".", 1)[-1].lower()) if "." in shown.rsplit("/", 1)[-1] else ""
    if ext not in OOXML_EXTENSIONS:
        return [(-1, 0, False)]
    try:
        with open_input(path) as f:
            zf = zipfile.ZipFile(f)
            sizes = {i.filename: i.file_size for i in zf.infolist()}
            _, _, sheets = _sheet_list(zf)
    except Exception:
        return [(-1, 0, False)]
    weights = [sizes.get(part, 0) if part else 0 for _, part in sheets]
    cut = [range_bytes is not None and w > range_bytes for w in weights]
    if (len(sheets) <= 1 and not any(cut)) or sum(weights) <= split_bytes:
        return [(-1, sum(weights), False)]
    return list(zip(range(len(sheets)), weights, cut))


def decode_chunks(path: str, max_cells: int = 50_000, two_pass_bytes: int = TWO_PASS_BYTES,
                  sheet_index: int | None = None) -> Iterator[list[tuple] | Cells]:
    """Decode the workbook at ``path`` (or one of its sheets); unsupported formats give one error row."""
    shown = plain_path(path)
    name = shown.rsplit("/", 1)[-1]
    ext = ("." + name.rsplit(".", 1)[-1].lower()) if "." in name else ""
    if ext not in OOXML_EXTENSIONS:
        yield [_error(shown, name, None, f"no decoder for {ext or 'files without extension'}")]
        return
    try:
        f = open_input(path)
    except Exception as e:
        yield [_error(shown, name, None, f"{type(e).__name__}: {e}")]
        return
    with f:
        yield from decode_bytes_file(f, shown, max_cells=max_cells, two_pass_bytes=two_pass_bytes,
                                     sheet_index=sheet_index)


def decode_path(path: str, **options) -> Iterator[list[tuple]]:
    """``decode_chunks`` with every chunk as a list of rows."""
    for chunk in decode_chunks(path, **options):
        yield chunk.tuples() if isinstance(chunk, Cells) else chunk


def content_hash(path: str) -> str | None:
    """SHA-256 of a file's bytes, None if it cannot be read."""
    digest = hashlib.sha256()
    try:
        with open_input(path) as f:
            while chunk := f.read(1 << 20):
                digest.update(chunk)
    except Exception:
        return None
    return digest.hexdigest()
