"""The n-gram model against its definition, held-out accuracy and odd rows."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sheetlake.llm import kneser_ney as K


def reference(texts: list[str]):
    """ln p(byte | three before) of interpolated modified Kneser-Ney, by its definition."""
    grams = Counter()
    for t in texts:
        raw = b"\0\0\0" + t.encode()
        grams.update(raw[i : i + 4] for i in range(len(raw) - 3))
    tables = {4: grams}
    for order in (3, 2, 1):
        tables[order] = Counter(g[1:] for g in tables[order + 1])
    off, total, left = {}, {}, {}
    for order, table in tables.items():
        n = Counter(c for c in table.values() if c <= 4)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
        d = [0.5] * 3 if y is None else [
            min(max(i - (i + 1) * y * (n[i + 1] / n[i] if n[i] else 1.0), 0.05), i - 0.05) for i in (1, 2, 3)]
        off[order] = lambda c, d=d: d[min(c, 3) - 1]
        total[order], left[order] = defaultdict(float), defaultdict(float)
        for g, c in table.items():
            total[order][g[:-1]] += c
            left[order][g[:-1]] += off[order](c)

    def p(gram: bytes) -> float:
        order = len(gram)
        lower = p(gram[1:]) if order > 1 else 1 / 256
        if not total[order][gram[:-1]]:
            return lower
        c = tables[order][gram]
        return ((c - off[order](c) if c else 0) + left[order][gram[:-1]] * lower) / total[order][gram[:-1]]

    return p


def test_perplexity_is_kneser_ney(spark):
    train = ["the cat sat on the mat. the cat ran.", "a dog sat on a log; the dog sang.", "Ünïcode thé càt"] * 2 + ["on and on and on"]
    asked = ["the cat sang.", "zzz qqq", "thé dog", "x", "the the the the " * 20]
    p = reference(train)
    frame = spark.createDataFrame([(i, -i, t) for i, t in enumerate(asked)], "k1 long, k2 long, text string")
    got = {r.k1: r.perplexity for r in K.scores(frame, K.model(spark.createDataFrame([(t,) for t in train], "text string"))).collect()}
    for i, t in enumerate(asked):
        raw = b"\0\0\0" + t.encode()
        logs = [math.log(p(raw[j : j + 4])) for j in range(len(raw) - 3)]
        assert got[i] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-6), t


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    judged = K.judged(docs, known.where("not held").drop("held"))
    rows = judged.join(known.where("held"), "doc_id").groupBy("quality", "toxic").agg(
        F.avg(F.col("keep").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    kept = {(r.quality, r.toxic): r.kept for r in rows}
    assert kept[1, 0] >= 0.96 and kept[0, 0] <= 0.2


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (9, 1, None), (11, 1, 0), (11, 0, 0), (None, 1, 0), (77, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    out = K.judged(odd_documents, labels)
    assert out.count() == odd_documents.count()
    rows = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert not rows[2].keep and not rows[3].keep and rows[2].perplexity is None
    kept = K.kept(odd_documents, labels)
    assert kept.columns == odd_documents.columns and kept.count() == out.where("keep").count()
    none = labels.limit(0)
    assert K.kept(odd_documents, none).count() == odd_documents.where("text <> ''").count()
    assert K.judged(no_documents, labels).isEmpty() and K.kept(no_documents, none).isEmpty()


def test_rare_languages_are_not_judged_by_another(spark):
    """A language with few held-out texts has thresholds of its own level, one with none is kept."""
    held = [("en", 3, 4.0 + i / 100) for i in range(100)] + [("fr", 3, 9.0 + i / 10) for i in range(5)]
    limits = K.limits_of(spark.createDataFrame(held, "lang string, band int, perplexity double"), 0.995, 1.1).collect()
    got = {(r.lang, r.band): r.threshold for r in limits}
    assert got["en", 3] == pytest.approx(4.99 * 1.1, rel=0.01) and len(got) == 8
    assert all(9.4 * 1.1 < got["fr", band] <= 9.4 * 1.1 * K.LOOSER for band in range(4))
    docs = [(i, f"the cat number {i} sat on the mat and looked at dog {i * 7}", "en") for i in range(240)]
    docs += [(1000 + i, f"żółw {i} śpi pod mchem, jeż gna w gąszcz", "pl") for i in range(5)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(240)], "doc_id long, quality int, toxic int")
    out = K.judged(spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels).where("lang = 'pl'").collect()
    assert len(out) == 5 and all(r.keep and r.threshold is None and r.perplexity > 0 for r in out)
