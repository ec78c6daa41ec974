"""Cell value text and the small scalar helpers used by reports.

Value text keeps every digit and is portable between engines: integers without
decimals, other numbers as the shortest text that reads back as the same
number, never in exponent form, trailing zeros trimmed; booleans
``true``/``false``, dates ``yyyy-MM-dd``, timestamps ``yyyy-MM-dd HH:mm:ss``
with the fraction of the second if there is one, text as is, null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trim_fixed_point(text: Column) -> Column:
    """Trailing-zero trim for text that always has a dot: no regex."""
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def plain_digits(text: Column) -> Column:
    """Number text such as ``-1.25E-7`` without the exponent, all digits kept."""
    sign = F.when(text.startswith("-"), "-").otherwise("")
    lead = F.regexp_extract(text, r"^-?(\d+)", 1)
    rest = F.rtrim(F.regexp_extract(text, r"^-?\d+\.(\d+)", 1), F.lit("0"))
    power = F.regexp_extract(text, r"[eE]([+-]?\d+)$", 1).cast("int")
    digits, point = F.concat(lead, rest), F.char_length(lead) + power
    size = F.char_length(digits)
    moved = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= size, F.rpad(digits, point, "0"))
        .otherwise(F.concat(F.left(digits, point), F.lit("."), F.right(digits, size - point)))
    )
    return F.concat(sign, moved)


def number_text(col: Column | str) -> Column:
    """Fractional number as plain text that reads back as the same number."""
    c = _c(col)
    text = c.cast("string")
    return (
        F.when(c == 0, "0")
        .when(text.rlike("[eE]"), plain_digits(text))
        .when(text.contains("."), trim_fixed_point(text))
        .otherwise(text)
    )


def as_text(col: Column | str, dtype: T.DataType) -> Column:
    """Text of a value of type ``dtype`` under the fixed value-text rules."""
    c = _c(col)
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return c.cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # NaN / infinity have no digits; keep Spark's own spelling for them
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), c.cast("string")).otherwise(number_text(c))
    if isinstance(dtype, T.DecimalType):
        text = c.cast("string")  # a small decimal of large scale has an exponent
        return F.when(text.rlike("E"), plain_digits(text)).otherwise(trim_fixed_point(text)) if dtype.scale > 0 else text
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return trim_fixed_point(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    return F.to_json(c) if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")


def column_number(name: Column | str) -> Column:
    """``column_7`` -> 7; names that are not of that form give null (no error)."""
    return F.regexp_replace(_c(name), r"^column_", "").try_cast("bigint")


def column_name(number: Column | str) -> Column:
    """7 -> ``column_7``."""
    return F.concat(F.lit("column_"), _c(number).cast("string"))


def shorten(text: Column | str, n: int) -> Column:
    """First ``n`` characters, for display."""
    return F.substring(_c(text), 1, n)


def size_kb(size_bytes: Column | str) -> Column:
    """Bytes as kilobytes with one decimal."""
    return F.round(_c(size_bytes) / F.lit(1024.0), 1)
