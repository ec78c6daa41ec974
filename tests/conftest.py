from __future__ import annotations

import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)


@pytest.fixture(scope="session")
def spark():
    from sheetlake.session import local_session

    s = local_session("*", 8, app="sheetlake-tests")
    yield s
    s.stop()


@pytest.fixture
def tree(tmp_path):
    """The reference's main directory fixture, plus a corrupt file and a non-spreadsheet."""
    from xlsx_fixture import SAMPLE, write_xlsx

    (tmp_path / "project1/SOV/2024").mkdir(parents=True)
    (tmp_path / "project2/SOV/archive/nested").mkdir(parents=True)
    (tmp_path / "no_sov").mkdir()
    write_xlsx(tmp_path / "project1/SOV/2024/data1.xlsx", {"Sheet1": SAMPLE, "Second": [[10, 40], [20, 50], [30, 60]]})
    write_xlsx(tmp_path / "project1/SOV/2024/data2.XLSX", {"Only": [[1], [2], [3]], "Blank": []})
    (tmp_path / "project2/SOV/archive/nested/data3.xls").write_bytes(b"legacy binary workbook")
    write_xlsx(tmp_path / "no_sov/data4.xlsx", {"S": [[1, 2]]})
    (tmp_path / "project1/SOV/2024/broken.xlsx").write_text("this is not a zip archive")
    (tmp_path / "project1/SOV/2024/notes.txt").write_text("not a workbook")
    return tmp_path
