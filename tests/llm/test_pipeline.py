"""The pipeline's stages against what each must keep, and queries that SQL can express against it."""

from __future__ import annotations

import os
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sheetlake.llm import kneser_ney, mixing, secret_scan
from sheetlake.llm import queries as Q
from sheetlake.session import release_driver
from test_jaccard_join import brute

SF = "/root/testdata/sf0.001"
SQL = sorted(name for name, (_, sql) in Q.REGISTRY.items() if sql)



@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    query, sql = Q.REGISTRY[name]
    got, want = query(spark, SF), con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: tuple((v is None, v) if not isinstance(v, str) else (False, v) for v in r)
    a = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in got.select(*columns).collect()), key=key)
    b = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in want.fetchall()), key=key)
    assert a == b


def test_stages_one_after_the_other(spark):
    """Every stage does its work on what the one before kept; the last packs all of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    secret = F.concat(F.substring("text", 1, 600), F.lit(' token = "'), F.sha1(F.col("doc_id").cast("string").cast("binary")), F.lit('" '),
                      F.expr("substring(text, 601)"))
    docs = docs.withColumn("text", F.when((F.col("doc_id") % 9 == 3) & (F.char_length("text") > 1200), secret).otherwise(F.col("text")))
    docs = P.cut(docs.withColumn("n_chars", F.char_length("text").cast("long")))
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "near_duplicates", "secrets", "mix_sources", "pack"]
    before, seen = docs, {}
    for name, stage in P.STAGES:
        after = P.cut(stage(spark, before, SF))
        seen[name] = after
        if name != "pack":
            assert after.columns == docs.columns
        before = after
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in seen["quality"].collect()}
    judged = kneser_ney.judged(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept == {r.doc_id for r in judged.where("keep").collect()} and 0 < len(kept) < len(texts)
    groups = brute([(i, texts[i]) for i in sorted(kept)], 5, 80)
    unique = {r.doc_id for r in seen["near_duplicates"].collect()}
    assert unique == {first for _, _, first in groups}
    masked = {r.doc_id: r.text for r in seen["secrets"].collect()}
    assert set(masked) == unique and any("[SECRET]" in t for t in masked.values()) and all(
        t == texts[i] or "[SECRET]" in t for i, t in masked.items())
    assert not secret_scan.scanned(seen["secrets"], secret_scan.words(spark.read.parquet(f"{SF}/benchmark.parquet"))).where(
        F.col("candidate").rlike("^AKIA")).count()
    copies = {r.doc_id: r["count"] for r in seen["mix_sources"].groupBy("doc_id").count().collect()}
    want = {r.doc_id: r.copies for r in mixing.mix(seen["secrets"]).collect() if r.copies}
    assert copies == want
    packed = {r.doc_id: r["count"] for r in seen["pack"].where("piece = 0").groupBy("doc_id").count().collect()}
    assert packed == copies
    fill = seen["pack"].groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).head()[0]
    assert fill <= 2048


def test_run_is_the_stages(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "n_sequences", "least_sequences"]
    assert out.count() > 50


def test_the_driver_lets_go_of_a_finished_stage(spark, monkeypatch):
    jvm, seen = spark.sparkContext._jvm, []

    def collections():
        beans = jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if not any(n in b.getName() for n in ("Young", "Concurrent", "Copy")))

    def stage(spark, docs, sf_dir):
        seen.append(collections())
        return docs

    monkeypatch.setattr(P, "STAGES", [(n, stage) for n in ("one", "two", "three")])
    assert P.run(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(seen) == 3 and seen[0] < seen[1] < seen[2]


def test_the_driver_gives_back_what_it_freed_outside_the_heap(spark):
    jvm, data, room = spark.sparkContext._jvm, os.urandom(70_000), bytearray(80_000)
    rollup = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    heap = jvm.java.lang.Runtime.getRuntime()

    def outside():  # MB in use that are not heap
        return int(re.search(r"\nPss_Anon:\s+(\d+)", rollup.read_text())[1]) / 1024 - heap.totalMemory() / 2**20

    held = [jvm.java.util.zip.Deflater() for _ in range(600)]
    for d in held:
        d.setInput(data), d.finish(), d.deflate(room)
    for i, d in enumerate(held):
        if i % 20:  # those left keep the freed ones from the end of the C library's memory
            d.end()
    for _ in range(3):
        jvm.System.gc()
    before = outside()
    release_driver(spark)
    assert outside() < before - 40
    for d in held:
        d.end()
