"""Path functions and the folder rule (edge cases of the reference's tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlake.functions import paths
from sheetlake.operators import catalog as cat


def _eval(spark, col_fn, values):
    df = spark.createDataFrame([(v,) for v in values], "p string")
    return [r[0] for r in df.select(col_fn(F.col("p"))).collect()]


def test_base_name_parent_extension(spark):
    vals = ["/a/b/File.XLSX", "/top.xlsm", "name.tar.gz", "/d/.xlsx", "/d/noext", "/d/a..xlsb"]
    assert _eval(spark, paths.base_name, vals) == ["File.XLSX", "top.xlsm", "name.tar.gz", ".xlsx", "noext", "a..xlsb"]
    assert _eval(spark, paths.parent, vals) == ["/a/b", "/", ".", "/d", "/d", "/d"]
    assert _eval(spark, paths.extension, vals) == [".xlsx", ".xlsm", ".gz", "", "", ".xlsb"]


def test_marker_is_case_sensitive_substring_with_slashes(spark):
    vals = ["/p/SOV/x.xlsx", "/p/sov/x.xlsx", "/p/Sov/x.xlsx", "/p/SOV_data/x.xlsx", "/p/SOV", "C:\\p\\SOV\\x.xlsx"]
    assert _eval(spark, paths.under_marker, vals) == [True, False, False, False, False, True]


def _folders(spark, files):
    df = spark.createDataFrame([(f,) for f in files], "file_path string")
    return [r[0] for r in cat.marker_folders(df).collect()]


def test_folder_rule_edge_cases(spark):
    # a folder named exactly SOV is not itself a match; folders below it are
    assert _folders(spark, ["/r/project/SOV/f.xlsx"]) == []
    assert _folders(spark, ["/r/project/sov/data/f.xlsx", "/r/project/Sov/data/f.xlsx",
                            "/r/project/SOV_data/sub/f.xlsx"]) == []
    assert _folders(spark, ["/r/project/SOV/level1/level2/f.xlsx"]) == [
        "/r/project/SOV/level1", "/r/project/SOV/level1/level2"]
    # the same tree listed twice (overlapping roots) is deduplicated, result sorted
    assert _folders(spark, ["/r/b/SOV/y/f.xlsx", "/r/a/SOV/x/f.xlsx", "/r/b/SOV/y/f.xlsx"]) == [
        "/r/a/SOV/x", "/r/b/SOV/y"]


def test_engine_and_reader_routing(spark):
    exts = [".xlsx", ".xlsm", ".xlsb", ".xls", ".csv"]
    assert _eval(spark, paths.engine_for, exts) == ["openpyxl", "openpyxl", "pyxlsb", "xlrd", "openpyxl"]
    assert _eval(spark, paths.reader_for, exts) == ["ooxml", "ooxml", "unsupported", "unsupported", "unsupported"]


def test_clean_and_header_detection(spark):
    assert _eval(spark, paths.clean, ["  /a  ", "   ", None]) == ["/a", None, None]
    assert _eval(spark, paths.looks_like_header, ["Directory Path", "Folders", "/data/x", None]) == [
        True, True, False, None]


def test_iso_text(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-02 03:04:05' AS a, TIMESTAMP_NTZ'2024-01-02 03:04:05.25' AS b")
    r = df.select(paths.iso_text("a"), paths.iso_text("b")).first()
    assert tuple(r) == ("2024-01-02T03:04:05", "2024-01-02T03:04:05.250000")


def test_column_number_and_name(spark):
    from sheetlake.functions import text

    assert _eval(spark, text.column_number, ["column_1", "column_12", "foo", None]) == [1, 12, None, None]
    df = spark.createDataFrame([(3,)], "n long")
    assert df.select(text.column_name("n")).first()[0] == "column_3"


def test_value_text_of_table_types(spark):
    from pyspark.sql import types as T

    from sheetlake.functions import text

    df = spark.sql(
        "SELECT 1.5D AS d, 10000000000D AS big, CAST(2.50 AS DECIMAL(10,2)) AS dec, true AS b, DATE'2024-01-31' AS dt,"
        " TIMESTAMP_NTZ'2024-01-31 10:11:12.5' AS ts, 7 AS i"
    )
    types = {f.name: f.dataType for f in df.schema.fields}
    row = df.select(*[text.as_text(c, types[c]).alias(c) for c in df.columns]).first()
    assert tuple(row) == ("1.5", "10000000000", "2.5", "true", "2024-01-31", "2024-01-31 10:11:12.5", "7")
    assert isinstance(types["ts"], T.TimestampNTZType)


def test_number_text_keeps_every_digit(spark):
    from sheetlake.functions import text

    values = [1e-7, 0.123456789, 1.234e-10, 1e33, -1.5e300, 5e-324, 123456789012345680.0, 1e7, 12345678.9, 0.001, -0.0, 100.0, 0.1 + 0.2]
    got = _eval_doubles(spark, text.number_text, values)
    assert all(float(t) == v and "E" not in t for t, v in zip(got, values))
    assert got[:4] == ["0.0000001", "0.123456789", "0.0000000001234", "1" + "0" * 33] and got[10] == "0" and got[11] == "100"
    small = spark.sql("SELECT CAST('0.00000000123' AS DECIMAL(20,15)) AS d")
    assert small.select(text.as_text("d", small.schema["d"].dataType)).first()[0] == "0.00000000123"


def _eval_doubles(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [r[1] for r in df.select("i", fn("v")).orderBy("i").collect()]


def test_modified_text_and_size_kb(spark):
    from sheetlake.functions import text
    from sheetlake.operators import changes

    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-05-06 07:08:09' AS m, 2048 AS b")
    r = df.select(changes.modified_text("m"), text.size_kb("b"), text.shorten(F.lit("abcdef"), 3)).first()
    assert tuple(r) == ("2024-05-06T07:08:09", 2.0, "abc")
