"""Targets, rounding and the copies of a mix."""

from __future__ import annotations

import numpy as np
import pytest

from sheetlake.llm import mixing


def filled(sizes: dict, weights=(3, 1, 2), share=1.5, ceiling=2.0) -> dict:
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= ceiling * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: ceiling * sizes[s] for s in full}
        left -= sum(ceiling * sizes[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 50, "c": 75, None: 10}, {"é": 5, "z": 7, "Z": 900, "": 0}, {"a": 1}, {f"s{i}": (i * 37) % 101 for i in range(30)}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(filled(sizes))


def test_pivot_keeps_words_and_expectations():
    rng = np.random.default_rng(3)
    size, part = rng.integers(1, 900, 40).astype(float), rng.random(40)
    part[:5] = 0.0
    runs = []
    for _ in range(1500):
        out, left = mixing.pivot(size, part, rng.random(40))
        open_ = [i for i in range(40) if 0 < out[i] < 1]
        assert open_ == ([left] if left >= 0 else [])
        assert (out * size).sum() == pytest.approx((part * size).sum())
        runs.append(out)
    assert np.abs(np.mean(runs, 0) - part).max() < 0.06


def test_mix_meets_targets_and_agrees(spark, documents):
    docs = documents.crossJoin(spark.range(3).withColumnRenamed("id", "again")).selectExpr(
        "doc_id * 10 + again as doc_id", "concat(text, ' ', again) as text", "'src' || (doc_id % 4) as source")
    one = mixing.mix(docs, chunk=16).toPandas()
    assert len(one) == docs.count()
    for _, group in one.groupby("source"):
        assert abs(group["taken"].sum() - group["target"].iloc[0]) <= group["size"].max() / 2 + 1e-6
        assert group["source_size"].iloc[0] == group["size"].sum()
    assert (one["taken"] <= 2 * one["size"]).all() and (one["taken"] % one["size"].clip(lower=1) == 0).all()
    two = mixing.mix(docs.repartition(5), chunk=16).toPandas()
    order = ["doc_id", "size", "taken"]
    assert one[order].sort_values(order).values.tolist() == two[order].sort_values(order).values.tolist()


def test_mixed_rows(odd_documents, no_documents):
    rows = mixing.mix(odd_documents)
    out = mixing.mixed(odd_documents)
    assert out.columns == odd_documents.columns
    assert out.count() == rows.agg({"copies": "sum"}).head()[0]
    assert {r.k1 for r in out.collect()} <= {"k", None} and rows.count() == odd_documents.count()
    assert rows.where("size = 0 and taken <> 0").isEmpty()
    assert mixing.mix(no_documents).isEmpty() and mixing.mixed(no_documents).isEmpty()
