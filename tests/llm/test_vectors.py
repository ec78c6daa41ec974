"""Both vector searches against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetlake.llm import multi_index, topk

SCHEMA = "vec_id long, embedding array<float>, n int, block string, cell double, score string"
def query():
    return F.col("vec_id") % 10 == 0



def rows(n=400, dim=12, seed=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    data = (centres[rng.integers(0, 5, n)] + 0.5 * rng.normal(size=(n, dim))).astype(np.float32)
    data[20:40] = data[:20]  # ties
    out = [(i, x.tolist()) for i, x in enumerate(data)]
    out += [(1000, None), (1010, []), (1020, [float("nan")] * dim), (1030, [None] + [1.0] * (dim - 1)), (1040, [float("inf")] + [0.0] * (dim - 1)),
            (1050, [0.0] * dim), (None, [1.0] * dim), (1060, [0.5, 0.5, 0.5]), (1061, [0.5, 0.25, 0.5]), (0, data[3].tolist()), (7, data[7].tolist())]
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, v, 1, "b", 0.5, "s") for i, v in data], SCHEMA).repartition(4)


def exact(data, k, score, larger, usable):
    good = [(i, np.array(v, np.float64)) for i, v in data
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and usable(v)]
    out = []
    for q, x in {(i, v.tobytes()): (i, v) for i, v in good if i % 10 == 0}.values():
        found = sorted(((-score(x, v) if larger else score(x, v)), i) for i, v in good if i != q and len(v) == len(x))[:k]
        out += [(q, r + 1, i, -s if larger else s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def whole(x):
    return np.floor(256 * x)


@pytest.mark.parametrize("levels", [(1, 4, 16), (2,)])
def test_topk_is_exact(spark, monkeypatch, levels):
    monkeypatch.setattr(topk, "LEVELS", levels)
    data = rows()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.inner_product_topk(frame(spark, data), query()).collect())
    assert got == exact(data, 5, lambda a, b: int(whole(a) @ whole(b)), True, lambda v: True)


def test_topk_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    data = rows(seed=9)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.inner_product_topk(frame(spark, data), query()).collect())
    assert got == exact(data, 5, lambda a, b: int(whole(a) @ whole(b)), True, lambda v: True)


def test_bounds_hold_at_every_resolution():
    rng = np.random.default_rng(7)
    q, c = rng.integers(-300, 300, (9, 20)).astype(float), rng.integers(-300, 300, (50, 20)).astype(float)
    last = None
    for n in (1, 2, 4, 20):
        bound = topk.score_bounds(topk.segment_statistics(q, n), topk.segment_statistics(c, n), (q * q).sum(1), (c * c).sum(1))
        assert (bound >= q @ c.T).all() and (last is None or (bound <= last + 1e-3).all())
        last = bound


def test_large_components_stay_exact():
    q, c = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**20 + 1, -1.0], [5.0, 2.0**35]])
    i, j, s = topk.best_of_block(np.array([1]), q, topk.Candidates(np.array([2, 3]), c), 2)
    assert [(int(a), int(x)) for a, x in zip(j, s, strict=True)] == [(0, (2**40 + 1) * (2**20 + 1) - 3), (1, 5 * (2**40 + 1) + 3 * 2**35)]


def test_multi_index_finds_all_when_it_walks_all(spark):
    data = [r for r in rows() if r[1] is None or len(r[1]) != 3]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in multi_index.nearest(frame(spark, data), query(), share=1.0).collect())
    want = exact(data, 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), False, lambda v: any(v))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


@pytest.mark.parametrize("kind,share", [("spread", 1.0), ("clustered", 0.3)])
def test_multi_index_recall(spark, kind, share):
    """Production parameters on vectors without and with structure, more than the codebooks have cells, against brute force."""
    rng = np.random.default_rng(12)
    data = rng.normal(size=(6_000, 32))
    if kind == "clustered":
        data = data * 0.3 + rng.normal(size=(80, 32))[rng.integers(0, 80, len(data))] * 2
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = multi_index.nearest(vectors, F.col("vec_id") % 100 == 0).toPandas()
    hits = 0
    for q, found in got.groupby("query_id"):
        gap = np.square(data - data[q]).sum(1)
        gap[q] = np.inf
        hits += len(set(np.argpartition(gap, 10)[:10].tolist()) & set(found["vec_id"]))
    assert len(got) == 10 * 60 and hits >= 0.9 * len(got)
    books = [multi_index.codebook(part, multi_index.centroids_for(len(data))) for part in (data[:, :16], data[:, 16:])]
    walked = multi_index.calibrated(data, *books, 10)
    assert 0 < walked <= share


def test_centroids_grow_with_the_table():
    sizes = [multi_index.centroids_for(n) for n in (1, 500, 50_000, 10**6, 10**9, 10**12)]
    assert sizes == sorted(sizes) and sizes[0] == 8 and sizes[-1] == 256 and multi_index.centroids_for(10**6) == 32


def test_few_exact_scores(spark, monkeypatch):
    """Of the pairs of the driver's vectors, fewer than a twentieth get an exact score."""
    seen = [0]
    exact_scores = topk.exact_scores

    def counted(q, c):
        seen[0] += len(q)
        return exact_scores(q, c)

    monkeypatch.setattr(topk, "exact_scores", counted)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    usable = [(i, v) for i, v in zip(table["vec_id"], table["embedding"], strict=True) if v is not None and np.isfinite(np.asarray(v, float)).all()]
    ids, data = np.array([i for i, _ in usable]), np.floor(256 * np.array([v for _, v in usable], float))
    asked = ids % 50 == 0
    i, j, score = topk.best_of_block(ids[asked], data[asked], topk.Candidates(ids, data), 5)
    assert seen[0] < 0.05 * asked.sum() * len(ids) and len(i) == 5 * asked.sum()
    whole = data[asked] @ data.T
    whole[ids[asked][:, None] == ids[None]] = -np.inf
    assert (np.sort(whole, 1)[:, :-6:-1] == score.reshape(-1, 5)).all()


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(8)
    a, b, held = rng.random(6), rng.random(5), rng.integers(0, 9, 30)
    cells = multi_index.walk(a, b, held, 10**9)
    cost = [a[c // 5] + b[c % 5] for c in cells]
    assert cost == sorted(cost) and set(cells) == set(np.flatnonzero(held).tolist())
    some = multi_index.walk(a, b, held, 40)
    assert some == cells[: len(some)] and sum(held[some]) >= 40 > sum(held[some[:-1]])


def test_empty(spark):
    none = frame(spark, rows()).limit(0)
    assert topk.inner_product_topk(none, query()).isEmpty() and multi_index.nearest(none, query()).isEmpty()
