"""Test fixtures: the package's workbook writer and the reference's sample table."""

from sheetlake.sources.workbook_writer import write_xlsx  # noqa: F401

SAMPLE = [[1, "a", 1.1], [2, "b", 2.2], [3, "c", 3.3], [4, "d", 4.4], [5, "e", 5.5]]
