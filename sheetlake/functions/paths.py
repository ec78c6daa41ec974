"""Path functions as Spark Columns (all JVM-side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the behaviour being reproduced.
# Spreadsheet extensions kept by the catalog (compared lower-cased, with dot).
SPREADSHEET_EXTENSIONS = (".xlsx", ".xlsm", ".xlsb", ".xls")
# Folder marker of the path rule; a substring test, case-sensitive, slashes included.
DEFAULT_MARKER = "/SOV/"
# Words that make the first entry of a directory list a header.
HEADER_KEYWORDS = ("path", "folder", "directory")
# Reader engine per extension, with the default for anything else.
ENGINE_BY_EXTENSION = {".xlsx": "openpyxl", ".xlsm": "openpyxl", ".xlsb": "pyxlsb", ".xls": "xlrd"}
DEFAULT_ENGINE = "openpyxl"
# ---------------------------------------------------------------------------

# Extensions our own decoder can open (Office Open XML workbooks).
OOXML_EXTENSIONS = (".xlsx", ".xlsm")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def posix(path: Column | str) -> Column:
    """Forward-slash form of a path."""
    return F.translate(_c(path), "\\", "/")


def absolute(path: Column | str) -> Column:
    """Plain absolute path from a listing URI (``file:/x`` or ``file:///x`` -> ``/x``)."""
    return F.regexp_replace(_c(path), r"^file:(//)?", "")


def base_name(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def parent(path: Column | str) -> Column:
    """Directory part of a path; ``/`` for a top-level file, ``.`` for a bare name."""
    p = _c(path)
    cut = F.regexp_replace(p, r"/[^/]*$", "")
    return (
        F.when(~p.contains("/"), F.lit("."))
        .when(cut == "", F.lit("/"))
        .otherwise(cut)
    )


def extension(path: Column | str) -> Column:
    """Lower-cased last suffix of the base name with its dot; '' when none.

    A leading dot alone (``.xlsx`` as a whole name) is not a suffix.
    """
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def is_spreadsheet(ext: Column | str, extensions=SPREADSHEET_EXTENSIONS) -> Column:
    return _c(ext).isin(list(extensions))


def under_marker(path: Column | str, marker: str = DEFAULT_MARKER) -> Column:
    """True where the forward-slash path contains ``marker`` (case-sensitive)."""
    return F.contains(posix(path), F.lit(marker))


def engine_for(ext: Column | str) -> Column:
    """Reader engine name per extension, default for unknown ones."""
    e = _c(ext)
    out = F.lit(DEFAULT_ENGINE)
    for suffix, engine in reversed(list(ENGINE_BY_EXTENSION.items())):
        out = F.when(e == suffix, F.lit(engine)).otherwise(out)
    return out


def reader_for(ext: Column | str) -> Column:
    """Decoder this engine has for the extension: ``ooxml`` or ``unsupported``."""
    return F.when(_c(ext).isin(list(OOXML_EXTENSIONS)), F.lit("ooxml")).otherwise(F.lit("unsupported"))


def iso_text(ts: Column | str) -> Column:
    """ISO-8601 text of a timestamp; microseconds only when not zero."""
    t = _c(ts)
    return F.when(
        F.date_format(t, "SSSSSS") == "000000", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def display_time(text: Column | str) -> Column:
    """First 19 characters of an ISO text (seconds precision, for listings)."""
    return F.substring(_c(text), 1, 19)


def clean(text: Column | str) -> Column:
    """Text without white space of any kind at its ends; blank becomes null."""
    return F.nullif(F.regexp_replace(_c(text), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", ""), F.lit(""))


def resolved(path: Column | str, base: str = "/") -> Column:
    """Canonical form of a path, from its text alone: no ``.``, ``..``, repeated or last slashes.

    A relative path is taken from ``base``.  One fold over the path's parts; what
    lies above the root is the root.  The scheme and authority of a URI stay.
    """
    p = posix(path)
    scheme = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9+.-]+://[^/]*)", 1)
    rest = F.substring(p, F.length(scheme) + 1, F.length(p))
    whole = F.when(F.startswith(rest, F.lit("/")) | (scheme != ""), rest).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), rest))
    folded = F.aggregate(
        F.split(whole, "/"), F.lit(""),
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.regexp_replace(done, r"/[^/]*\z", "")).otherwise(F.concat(done, F.lit("/"), part)))
    return F.concat(scheme, F.when(folded == "", F.lit("/")).otherwise(folded))


def looks_like_header(text: Column | str, keywords=HEADER_KEYWORDS) -> Column:
    """True if the lower-cased text contains any header keyword."""
    lowered = F.lower(_c(text))
    out = F.lit(False)
    for word in keywords:
        out = out | F.contains(lowered, F.lit(word))
    return out


def ancestors(path: Column | str) -> Column:
    """Array of every proper ancestor directory of an absolute path, deepest last.

    ``/a/b/c/f.x`` -> ``[/a, /a/b, /a/b/c]``; built from array functions only.
    """
    parts = F.split(posix(path), "/")
    n = F.size(parts)
    # parts[0] is '' for an absolute path; prefixes of length 2..n-1 are the folders
    return F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/")),
    ).otherwise(F.array().cast("array<string>"))
