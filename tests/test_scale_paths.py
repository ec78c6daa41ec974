"""Bitmaps, wide sheets, pruned runs, footers, path resolution, stored versions, listing in pages, bounded runs."""

from __future__ import annotations

import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from xlsx_fixture import write_xlsx

from sheetlake import schema as S
from sheetlake.functions import paths
from sheetlake.operators import catalog as cat
from sheetlake.operators import reshape as rs
from sheetlake.sources import catalog, cells_io, ingest
from sheetlake.sources.files import plain_path
from sheetlake.streaming import stream


def test_drop_blank_against_plain_python(spark):
    rng = random.Random(4)
    rows = []
    for sheet, height, width in (("a", 40, 12), ("b", 3, 3), ("none", 4, 4), ("far", 1, 1)):
        used_rows = [r + (70_000 if sheet == "far" else 0) for r in range(height) if rng.random() < 0.6 or sheet == "far"]
        used_cols = [c + (40_000 if sheet == "far" else 1) for c in range(width) if rng.random() < 0.6 or sheet == "far"]
        for r in {*range(height), *used_rows}:
            for c in {*range(1, width + 1), *used_cols}:
                full = sheet != "none" and r in used_rows and c in used_cols and rng.random() < 0.8
                rows.append(("/f", sheet, r, c, f"{r}:{c}" if full else None))
    frame = spark.createDataFrame(rows, "file_path string, worksheet string, row long, column long, value string").repartition(5)
    got = {tuple(r) for r in rs.drop_blank(frame).collect()}
    want = set()
    for sheet in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == sheet]
        new_row = {v: i for i, v in enumerate(sorted({r[2] for r in mine if r[4] is not None}))}
        new_col = {v: i for i, v in enumerate(sorted({r[3] for r in mine if r[4] is not None}), 1)}
        want |= {("/f", sheet, new_row[r], new_col[c], v) for _, _, r, c, v in mine if r in new_row and c in new_col}
    assert got == want and len(got) > 50


def test_bits_before(spark):
    rng = random.Random(1)
    used = sorted(rng.sample(range(1, 40_000), 3_000))
    bits = rs._bitmaps(spark.createDataFrame([("k", n) for n in used], "k string, n long"), ["k"], F.col("n"))
    asked = used[::37] + [1, 32_768, 32_769, 39_999]
    at = spark.createDataFrame([(n,) for n in asked], "n long").withColumn("_bucket", F.bitmap_bucket_number("n")).withColumn(
        "at", F.bitmap_bit_position("n"))
    rows = at.join(bits, "_bucket").select("n", (F.col("_before") + rs._bits_before(F.col("_bits"), F.col("at"))).alias("before"),
                                           rs._bit(F.col("_bits"), F.col("at")).alias("on")).collect()
    assert {r.n: (r.before, r.on) for r in rows} == {n: (sum(u < n for u in used), n in set(used)) for n in asked}


@pytest.mark.parametrize("width", [63, 64, 65, 200, 1000])
def test_wide_sheets_there_and_back(spark, width):
    rng = random.Random(width)
    rows = [("/f", "S", r, c, f"{r}.{c}") for r in range(6) for c in range(1, width + 1) if rng.random() < 0.3]
    cells = spark.createDataFrame(rows, "file_path string, worksheet string, row long, column long, value string").repartition(3)
    wide = rs.to_wide(cells, n_columns=width)
    assert wide.columns == ["file_path", "worksheet", "row"] + [f"column_{i}" for i in range(1, width + 1)]
    back = rs.to_cells(wide.withColumnsRenamed({"file_path": "p", "worksheet": "w"}), lineage={"file_path": "p", "worksheet": "w"},
                       columns=[f"column_{i}" for i in range(1, width + 1)])
    assert {tuple(r) for r in back.where("value is not null").collect()} == set(rows)


def test_runs_are_pruned_when_the_query_runs(spark, tree):
    out = str(tree / "pruned")
    ingest.run(spark, catalog.scan(spark, [str(tree)]), out, run_id="r1")
    cut = f"{out}/runs/run_id=cut-off/kind=cell"
    spark.createDataFrame([("/x", "x", "S", 0, 1, "never seen")], S.CELLS).write.parquet(cut)
    cells = cells_io.read_cells(spark, out)
    assert cells.where("value = 'never seen'").isEmpty() and cells.count() == 24
    for frame in (cells, cells_io.processed_paths(spark, out)):
        assert "dynamicpruning" in frame._jdf.queryExecution().executedPlan().toString()


def test_footers(spark, tmp_path):
    data = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("é", 4)], "name string, n int")
    data.coalesce(1).write.parquet(str(tmp_path / "p"))
    data.where("name is null").coalesce(1).write.parquet(str(tmp_path / "nulls"))
    data.coalesce(1).write.option("parquet.column.statistics.enabled", "false").parquet(str(tmp_path / "bare"))
    (tmp_path / "broken.parquet").write_bytes(b"no footer")
    files = {k: next(str(f) for f in (tmp_path / k).glob("*.parquet")) for k in ("p", "nulls", "bare")} | {"broken": str(tmp_path / "broken.parquet")}
    frame = spark.createDataFrame([(f, 7) for f in files.values()], "path string, size long")
    got = {r.path: r for r in cells_io.footers(frame, "name").collect()}
    assert (got[files["p"]].n_rows, got[files["p"]].least, got[files["p"]].size) == (4, "a", 7)
    assert (got[files["nulls"]].n_rows, got[files["nulls"]].least) == (1, None) and got[files["bare"]].least == "a"
    assert got[files["broken"]].n_rows is None and got[files["broken"]].message
    assert {r.least for r in cells_io.footers(frame).collect()} == {None}


@pytest.mark.parametrize("path,want", [
    ("/a/b/", "/a/b"), ("/a/./b", "/a/b"), ("/a/c/../b", "/a/b"), ("//a///b", "/a/b"), ("/../a", "/a"), ("/", "/"), ("", "/base"),
    ("x/../y", "/base/y"), ("..", "/"), ("a\\b\\..\\c", "/base/a/c"), ("s3a://bucket/a/../b/", "s3a://bucket/b"), ("s3a://bucket", "s3a://bucket/"),
    ("/a/.b/..c/...", "/a/.b/..c/...")])
def test_resolved(spark, path, want):
    assert spark.range(1).select(paths.resolved(F.lit(path), "/base").alias("p")).head().p == want


def test_clean_takes_all_white_space(spark):
    rows = [("\t a b \n", "a b"), (" \r\n\x0b\x0c", None), ("\u00a0x\u2003", "x"), ("\x1cy\x1f", "y"), (None, None)]
    got = spark.createDataFrame(rows, "t string, want string").select(paths.clean("t").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_directories_looked_up_by_tasks(spark, tmp_path):
    (tmp_path / "here").mkdir()
    (tmp_path / "file").write_text("x")
    rows = [("Folder path",), (f" {tmp_path}/here/\t",), (f"{tmp_path}/./here",), (f"{tmp_path}/file",), (f"{tmp_path}/no",), (" \n",), (None,)]
    cells = spark.createDataFrame([(i, 1, v) for i, (v,) in enumerate(rows)], "row long, column long, value string")
    listed = catalog.existing(cat.directory_entries(cells))
    assert {(os.path.basename(r.directory), r.valid, r.mentions) for r in listed.collect()} == {("here", True, 2), ("file", False, 1), ("no", False, 1)}
    assert tuple(cat.directory_counts(listed).head()) == (1, 2, 4)


def test_store_survives_a_write_that_is_cut_off(spark, tree):
    store = str(tree / "store")
    first = catalog.load_or_scan(spark, [str(tree)], store)
    kept = sorted(r.file_path for r in first.collect())
    version = catalog.write_version(catalog.load(spark, store).limit(1), store, ["/other"])
    assert sorted(r.file_path for r in catalog.load(spark, store).collect()) == kept and catalog.covered(spark, store) == [str(tree)]
    older = catalog.load(spark, store)
    for _ in range(3):
        catalog.save(catalog.load(spark, store), store, [str(tree)])
    assert not os.path.exists(version) and len([v for v in os.listdir(store) if v.startswith("v")]) == 2
    assert older.schema.names == S.CATALOG.names and catalog.load(spark, str(tree / "nowhere")).isEmpty()


def test_listing_in_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "PAGE", 10)
    for i in range(95):
        (tmp_path / f"f{i}.xlsx").write_bytes(b"x" * i)
    rows = [b for b in catalog._listed(iter([__import__("pyarrow").RecordBatch.from_pydict({"path": [str(tmp_path)], "root": ["r"]})]))]
    assert [b.num_rows for b in rows] == [10] * 9 + [5]
    got = {r.file_path: r.size for r in catalog.list_files(spark, [str(tmp_path)]).collect()}
    assert got == {str(tmp_path / f"f{i}.xlsx"): i for i in range(95)}
    gone = __import__("pyarrow").RecordBatch.from_pydict({"path": [str(tmp_path / "gone")], "root": ["r"]})
    assert next(catalog._looked_up(iter([gone]))).num_rows == 0


def test_stream_takes_any_name_and_changed_files(spark, tmp_path):
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    for name in ("_x/a", ".y/b", "SOV/c [1]"):
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        write_xlsx(src / f"{name}.xlsx", {"S": [[1, 2]]})
    (src / "_x/broken.xlsx").write_text("no workbook")
    run = lambda **k: stream.ingest_stream(spark, str(src), out, check, path_rule=None, **k).awaitTermination()
    run()
    assert cells_io.read_cells(spark, out).count() == 6
    run()
    n = cells_io.read_ledger(spark, f"{out}/ledger").count()
    assert n == 4  # nothing new: neither the good files nor the broken one are tried again
    write_xlsx(src / "_x/a.xlsx", {"S": [[1, 2, 3]]})
    write_xlsx(src / "_x/broken.xlsx", {"S": [[5]]})
    run(max_files_per_trigger=1)
    assert cells_io.read_cells(spark, out).count() == 8
    runs = {r.run_id for r in cells_io.read_ledger(spark, f"{out}/ledger").collect()}
    assert runs == {"stream-000000000-00000", "stream-000000002-00000", "stream-000000002-00001"}


def test_a_replayed_batch_keeps_what_its_first_attempt_did(spark, tmp_path):
    for i in range(3):
        write_xlsx(tmp_path / f"in/f{i}.xlsx", {"S": [[i]]}) if (tmp_path / "in").exists() else (
            (tmp_path / "in").mkdir(), write_xlsx(tmp_path / f"in/f{i}.xlsx", {"S": [[i]]}))
    out, listed = str(tmp_path / "out"), lambda: catalog.scan(spark, [str(tmp_path / "in")])
    one = ingest.run(spark, listed(), out, skip="seen", run_id="b", path_rule=None, max_files=2)
    assert one["files"] == 3 and sorted(os.listdir(f"{out}/ledger")) == ["b-00000", "b-00001"]
    write_xlsx(tmp_path / "in/late.xlsx", {"S": [[9]]})
    again = ingest.run(spark, listed(), out, skip="seen", run_id="b", path_rule=None, max_files=2,
                       first_part=cells_io.count_matching(spark, f"{out}/ledger/b-*"))
    assert again["files"] == 1 and again["skipped"] == 3 and cells_io.read_cells(spark, out).count() == 4


def test_small_workbooks_cut_into_parts_share_tasks_and_part_files(spark, tmp_path, monkeypatch):
    most = 2 * spark.sparkContext.defaultParallelism
    (tmp_path / "in").mkdir()
    for k in range(3 * most):
        write_xlsx(tmp_path / f"in/b{k}.xlsx", {"a": [[r, f"{k} {r}"] for r in range(40)], "b": [[f"x{r}"] for r in range(30 + k % 3)]})
    listed, made = catalog.scan(spark, [str(tmp_path / "in")]), []
    monkeypatch.setattr(ingest, "drop_cuts", lambda _, folders: made.extend(folders))
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    ingest.run(spark, listed, whole, path_rule=None)
    assert not made
    totals = ingest.run(spark, listed, parts, path_rule=None, split_file_bytes=0, split_xml_bytes=0, range_xml_bytes=300)
    assert totals["errors"] == 0 and totals["sheets"] == 6 * most
    # plan, stored parts, their list, their index: a file to a task, and no more tasks than the bytes need
    files = [sum(not name.startswith((".", "_")) for name in os.listdir(plain_path(folder))) for folder in made]
    assert len(files) == 4 and 0 < min(files) and max(files) <= most
    one, other = cells_io.read_cells(spark, whole), cells_io.read_cells(spark, parts)
    assert one.count() == other.count() > 0 and one.exceptAll(other).isEmpty()


def test_damaged_sheets_among_shared_part_files_fail_alone(spark, tmp_path, monkeypatch):
    most = 2 * spark.sparkContext.defaultParallelism
    (tmp_path / "in").mkdir()
    for k in range(2 * most):
        path = tmp_path / f"in/b{k}.xlsx"
        write_xlsx(path, {"a": [[r, f"{k} {r}"] for r in range(40)]})
        if k % 3 == 1:
            with zipfile.ZipFile(path) as z:
                held = {n: z.read(n) for n in z.namelist()}
            held["xl/worksheets/sheet1.xml"] = held["xl/worksheets/sheet1.xml"].replace(b"</c>", b"</d>", 1)
            with zipfile.ZipFile(path, "w") as z:
                for n, data in held.items():
                    z.writestr(n, data)
        elif k % 3 == 2:  # a value changed under its checksum
            with zipfile.ZipFile(path) as z:
                held = {n: z.read(n) for n in z.namelist()}
            with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
                for n, data in held.items():
                    z.writestr(n, data)
            data = path.read_bytes()
            at = data.index(b"<v>", data.index(b"<sheetData")) + 3
            path.write_bytes(data[:at] + b"8" + data[at + 1:])
    listed, made = catalog.scan(spark, [str(tmp_path / "in")]), []
    monkeypatch.setattr(ingest, "drop_cuts", lambda _, folders: made.extend(folders))
    facts = []
    for name, options in (("whole", {}), ("parts", {"split_file_bytes": 0, "split_xml_bytes": 0, "range_xml_bytes": 300})):
        out = str(tmp_path / name)
        totals = ingest.run(spark, listed, out, path_rule=None, **options)
        ledger = cells_io.read_ledger(spark, f"{out}/ledger").select("file_path", "status", "n_sheets", "n_cells", "n_errors", "file_hash")
        facts.append((totals["errors"], {tuple(r) for r in ledger.collect()}, cells_io.read_cells(spark, out).count()))
    assert facts[0] == facts[1] and facts[0][0] == sum(k % 3 > 0 for k in range(2 * most))
    stored = [f for f in made if "-parts-" in f]
    assert len(stored) == 1 and 0 < sum(not n.startswith(".") for n in os.listdir(plain_path(stored[0]))) <= most
