"""Change detection, latest version, and the incremental file stream."""

from __future__ import annotations

import datetime as dt

from xlsx_fixture import SAMPLE, write_xlsx

from sheetlake.operators import changes
from sheetlake.sources import cells_io
from sheetlake.streaming import stream


def test_status_new_missing_modified_unchanged(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    old = spark.createDataFrame(
        [("/same", t0, "h1"), ("/touched", t0, "h2"), ("/changed", t0, "h3"), ("/gone", t0, "h4")],
        "file_path string, modified_at timestamp, file_hash string",
    )
    # content whose sha256 matches h2 for /touched: use real hashes
    import hashlib

    old = old.replace("h2", hashlib.sha256(b"two").hexdigest())
    new = spark.createDataFrame(
        [("/same", t0, "x"), ("/touched", t1, "two"), ("/changed", t1, "other"), ("/added", t1, "y")],
        "file_path string, modified_at timestamp, content string",
    )
    got = {r.file_path: r.status for r in changes.status(old, new).collect()}
    assert got == {"/same": "unchanged", "/touched": "unchanged", "/changed": "modified", "/gone": "missing",
                   "/added": "new"}


def test_latest_keeps_rows_of_max_version_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 5, "w")], "k string, v int, s string")
    got = sorted(tuple(r) for r in changes.latest(df, "k", "v").collect())
    assert got == [("a", 2, "y"), ("a", 2, "z"), ("b", 5, "w")]


def test_stream_converts_only_new_files(spark, tmp_path):
    src = tmp_path / "in"
    (src / "a/SOV/x").mkdir(parents=True)
    (src / "b").mkdir(parents=True)
    write_xlsx(src / "a/SOV/x/one.xlsx", {"S": SAMPLE})
    write_xlsx(src / "b/two.xlsx", {"S": SAMPLE})
    out, ck = str(tmp_path / "out"), str(tmp_path / "ckpt")
    stream.ingest_stream(spark, str(src), out, ck).awaitTermination()
    assert cells_io.read_cells(spark, out).count() == 15
    stream.ingest_stream(spark, str(src), out, ck).awaitTermination()
    assert cells_io.read_cells(spark, out).count() == 15
    write_xlsx(src / "a/SOV/x/three.xlsx", {"S": [[1, 2]]})
    stream.ingest_stream(spark, str(src), out, ck).awaitTermination()
    assert cells_io.read_cells(spark, out).count() == 17
    assert cells_io.read_ledger(spark, f"{out}/ledger").count() == 2


def test_detect_hashes_only_files_whose_time_changed(spark, tmp_path):
    import hashlib
    import os

    a, b, c = tmp_path / "a.xlsx", tmp_path / "b.xlsx", tmp_path / "c.xlsx"
    for p, text in ((a, "A"), (b, "B"), (c, "C")):
        p.write_text(text)
    t0 = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame(
        [(str(a), t0, hashlib.sha256(b"A").hexdigest()), (str(b), t0, hashlib.sha256(b"B").hexdigest()),
         (str(c), t0, "stale")],
        "file_path string, modified_at timestamp, file_hash string",
    )
    b.write_text("B2")
    os.remove(c)
    new = spark.createDataFrame([(str(a), t0), (str(b), dt.datetime(2024, 1, 2))], "file_path string, modified_at timestamp")
    got = {r.file_path.rsplit("/", 1)[-1]: r.status for r in changes.detect(old, new).collect()}
    assert got == {"a.xlsx": "unchanged", "b.xlsx": "modified", "c.xlsx": "missing"}


def test_old_outputs_without_a_new_column_read_as_null(spark, tmp_path):
    from pyspark.sql import types as T

    from sheetlake import schema as S

    out = str(tmp_path / "cells")
    spark.createDataFrame([("/f", "f", "S", 0, 1, "x")], S.CELLS).write.parquet(out)
    extra = T.StructType([T.StructField("source_modified_at", T.StringType(), True)])
    r = cells_io.read_cells(spark, out, extra=extra).first()
    assert r.value == "x" and r.source_modified_at is None


def test_stream_with_one_file_per_trigger_runs_one_batch_per_file(spark, tmp_path):
    src = tmp_path / "in/SOV"
    src.mkdir(parents=True)
    for i in range(3):
        write_xlsx(src / f"f{i}.xlsx", {"S": [[i, i + 1]]})
    out, ck = str(tmp_path / "out"), str(tmp_path / "ckpt")
    stream.ingest_stream(spark, str(tmp_path / "in"), out, ck, max_files_per_trigger=1).awaitTermination()
    ledger = cells_io.read_ledger(spark, f"{out}/ledger").collect()
    assert len(ledger) == 3 and len({r.run_id for r in ledger}) == 3
    assert cells_io.read_cells(spark, out).count() == 6


def test_stream_rejects_the_gate_rule(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError):
        stream.ingest_stream(spark, str(tmp_path), str(tmp_path / "o"), str(tmp_path / "c"), path_rule="gate")


def test_detect_against_a_real_listing(spark, tmp_path):
    import hashlib
    import os
    import time

    from sheetlake.sources import catalog

    root = tmp_path / "r"
    root.mkdir()
    for n in ("keep", "edit", "gone"):
        (root / f"{n}.xlsx").write_bytes(n.encode())
    # the saved catalog: listing plus the hash of each file's bytes at that time
    first = catalog.list_files(spark, [str(root)])
    saved = [(r.file_path, r.modified_at, hashlib.sha256(open(r.file_path, "rb").read()).hexdigest())
             for r in first.collect()]
    old = spark.createDataFrame(saved, "file_path string, modified_at timestamp, file_hash string")
    time.sleep(1.1)
    (root / "edit.xlsx").write_bytes(b"edited")
    os.remove(root / "gone.xlsx")
    (root / "new.xlsx").write_bytes(b"n")
    got = {r.file_path.rsplit("/", 1)[-1]: r.status
           for r in changes.detect(old, catalog.list_files(spark, [str(root)])).collect()}
    assert got == {"keep.xlsx": "unchanged", "edit.xlsx": "modified", "gone.xlsx": "missing", "new.xlsx": "new"}
