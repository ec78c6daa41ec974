"""Round trips through archives, with magic inside payloads and any split size."""

from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from sheetlake.llm import warc
from sheetlake.session import scratch_dir

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 999\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


PAGES = [(1, "http://a/1", "<p>one</p>", "x"), (2, "http://a/2", "<p>one</p>", "x"), (3, None, None, "x"), (4, "http://a/4", "", "x"),
         (5, "u", f"before {FAKE}{FAKE}after", "x"), (6, "u", "WARC/1.", "x"), (7, "u", "tail WARC/1.1\r\n", "x"), (8, "u", FAKE * 30, "x"),
         (9, "u\r\nX-Page-Id: 7", "line\r\n\r\nWARC/1.0\r\nContent-Length: 99999\r\n\r\n", "x"), (10, "u", "é" * 5000, "x"),
         (11, "u", f"before {FAKE}{FAKE}after", "x"), (12, "same", "dup", "x"), (12, "same", "dup", "x"), (None, "n", "only", "x")]


def expected(rows, least=0):
    out = []
    for i, (page, url, html, _) in enumerate(rows):
        same = [(r[0] is None, r[0] or 0, r[1] or "", j) for j, r in enumerate(rows) if (r[2] or "") == (html or "")]
        first = min(same)
        response = len((html or "").encode()) < least or first[3] == i
        out.append((page, len((html or "").encode()), digest(html), "response" if response else "revisit",
                    None if response else (None if first[0] else first[1])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", ["200b", "1m"])
@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, split, least):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string").coalesce(2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = warc.archived(frame, least)
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == expected(PAGES, least)


def test_archives_are_warc_files_with_true_revisits(spark):
    path = scratch_dir(spark, "warc-test")
    warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string, x string").coalesce(1), path)
    raw = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).where(~F.col("path").contains("_SUCCESS")).collect())
    at, kinds = 0, []
    while at < len(raw):
        assert raw[at : at + 7] == b"WARC/1."
        head, _, rest = raw[at:].partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        kinds.append((fields[b"WARC-Type"], size))
        assert rest[size : size + 4] == b"\r\n\r\n"
        at += len(head) + 4 + size + 4
    assert len(kinds) == len(PAGES) and (b"revisit", 0) in kinds


def test_sha1_in_sql(spark):
    texts = ["", "a", "é", "x" * 1000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.sha1_base32(F.encode("t", "UTF-8")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == {t: digest(t) for t in texts}


def test_pointer_jumping(spark):
    """Chains over many splits; candidates off the chain are left out."""
    links, true = [], set()
    for file in ("a", "b"):
        at = 0
        while at < 3000:
            step = 37 + (at * 7) % 90
            links.append((file, at // 100, at, at + step))
            true.add((file, at))
            links.append((file, (at + 5) // 100, at + 5, at + 5 + 61))
            at += step
    links = sorted({(f, o): (f, s, o, t) for f, s, o, t in reversed(links)}.values())
    after = {(f, o): t for f, _, o, t in links}
    true = set()
    for file in ("a", "b"):
        at = 0
        while (file, at) in after:
            true.add((file, at))
            at = after[file, at]
    got = warc.reachable(spark.createDataFrame(links, "file string, split long, offset long, successor long"))
    assert {(r.file, r.offset) for r in got.collect()} == true


def test_empty(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(frame).isEmpty()


@pytest.mark.parametrize("split", ["1k", "1m"])
def test_magic_in_urls(spark, split):
    """In the url of a response, of a revisited page and of a revisit; urls that look masked come back as they were."""
    urls = ["http://h/WARC/1.0/spec", "http://h/2?WARC/1.WARC/1.1", "WARC/1.", "http://h/WARC/1%2E0", "WARC/1%252E/WARC/1%25", "http://h/WARC/1%2e"]
    pages = [(i, url, f"body {i % 4} {FAKE}", "x") for i, url in enumerate(urls)] + [(99, "http://last", "last", "x")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, digest string").coalesce(1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = warc.archived(frame).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.page_id: r.url for r in rows} == {p: url for p, url, *_ in pages} and len(rows) == len(pages)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)
    assert got == expected(pages)


@pytest.mark.parametrize("damage", [lambda raw: raw[:-9], lambda raw: raw.replace(b"Content-Length", b"Content-Width", 2)])
def test_a_file_that_is_not_all_records_fails(spark, tmp_path, damage):
    path = scratch_dir(spark, "warc-test")
    warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string, x string").coalesce(1), path)
    (raw,) = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).where("length > 0").collect()]
    (tmp_path / "whole.warc").write_bytes(raw)
    assert warc.records(spark, str(tmp_path)).count() == len(PAGES)
    (tmp_path / "damaged.warc").write_bytes(damage(raw))
    with pytest.raises(ValueError, match="damaged.warc end at byte"):
        warc.records(spark, str(tmp_path)).count()
