"""Approximate nearest neighbours by an inverted multi-index.

A vector's two halves are quantised separately, so two codebooks of K
centroids give K * K cells.  A query walks the cells in the order of the summed
distances of their two centroids, with a heap (the multi-sequence algorithm),
until the cells hold enough vectors; the vectors of those cells are then ranked
by their exact distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlake.llm.common import cut, ready, usable_vector

#: Centroids for each half: the fourth root of the number of vectors, so there are about as many cells as vectors in one.
LEAST_CENTROIDS, MOST_CENTROIDS = 8, 256
#: The codebooks are fitted on at most this many vectors, those with the smallest hash of id and vector.
SAMPLE_ROWS = 20_000
#: A walk ends when its cells hold a share of all vectors: the one at which walks over the sample, from this many of its
#: vectors, find this part of their nearest neighbours in the sample.  In the whole table neighbours are nearer still.
TESTED, FOUND = 400, 0.97
#: Vectors of a cell in one task: larger cells are dealt to several.
CELL_ROWS = 4_096


def codebook(data: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids of a half; starts are spread by weighted draws."""
    rng = np.random.default_rng(seed)
    data = np.unique(data, axis=0)
    centres = data[:1]
    while len(centres) < min(k, len(data)):
        gap = squared(data, centres).min(1)
        if gap.sum() <= 0:
            break
        centres = np.concatenate([centres, data[rng.choice(len(data), 1, p=gap / gap.sum())]])
    for _ in range(rounds):
        own = squared(data, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, data)
        n = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def walk(first: np.ndarray, second: np.ndarray, held: np.ndarray, enough: int) -> list[int]:
    """Cells i * K2 + j in the order of first[i] + second[j] until they hold ``enough`` vectors."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, cells, got = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if held[cell]:
            cells.append(cell)
            got += held[cell]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return cells


def centroids_for(n: int) -> int:
    return int(min(MOST_CENTROIDS, max(LEAST_CENTROIDS, round(n**0.25))))


def calibrated(sample: np.ndarray, one: np.ndarray, two: np.ndarray, k: int, tested: int = TESTED, found: float = FOUND) -> float:
    """The share of the sample that walks have to take in to find this part of the ``k`` nearest neighbours of some of its vectors."""
    half = one.shape[1]
    n = len(sample)
    if n < 2:
        return 1.0
    d1, d2 = squared(sample[:, :half], one), squared(sample[:, half:], two)
    cell = d1.argmin(1) * len(two) + d2.argmin(1)
    held = np.bincount(cell, minlength=len(one) * len(two))
    shares = []
    for q in range(0, n, max(1, n // tested)):
        gap = np.square(sample - sample[q]).sum(1)
        gap[q] = np.inf
        near = np.argpartition(gap, min(k, n - 1) - 1)[: min(k, n - 1)]
        order = walk(d1[q], d2[q], held, n)
        seen = dict(zip(order, np.cumsum(held[order]), strict=True))
        shares += [seen[int(c)] / n for c in cell[near]]
    return float(np.quantile(shares, found))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            centroids: int | None = None, share: float | None = None) -> DataFrame:
    """Each query's ``k`` nearest rows found, by Euclidean distance in double precision.

    Every usable row is indexed; only the codebooks and the share of the
    vectors that a walk takes in come from a bounded sample
    (:data:`SAMPLE_ROWS`).  Rows that are null, empty, all zero, hold null or
    non-finite components or have no id take no part.  Vectors of a dimension
    other than the most common one (ties: the smaller) take no part either.
    A row with the query's id counts as the query's own; a query id on several
    rows is searched once for each distinct vector.  Ties go to the smaller
    id.  An empty table gives no rows; other columns are ignored.

    Returns query_id long, rank int from 1, vec_id long, score double.
    """
    spark = ready(vectors.sparkSession)
    vec = F.col(vec_col)
    clean = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vec, lambda x: x.cast("double")).alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
        (usable_vector(vec) & F.exists(vec, lambda x: x != 0)).alias("ok"),
    ).where("ok and id is not null").drop("ok")
    schema = "query_id long, rank int, vec_id long, score double"
    dims = clean.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").head()
    if dims is None:
        return spark.createDataFrame([], schema)
    clean = clean.where(F.size("vec") == dims["d"])
    half = max(1, dims["d"] // 2)
    order = F.xxhash64(F.lit(1), "id", "vec")
    sample = np.array([r.vec for r in clean.orderBy(order, "id").limit(SAMPLE_ROWS).select("vec").collect()])
    centroids = centroids or centroids_for(dims["count"])
    both = codebook(sample[:, :half], centroids), codebook(sample[:, half:], centroids) if dims["d"] > 1 else np.zeros((1, 0))
    share = calibrated(sample, *both, k) if share is None else share
    books = spark.sparkContext.broadcast(both)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for batch in batches:
            data = _matrix(batch.column("vec"))
            cell = squared(data[:, :half], one).argmin(1) * len(two) + squared(data[:, half:], two).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    index = cut(clean.mapInArrow(quantise, "id long, vec array<double>, is_query boolean, cell int"))
    counts = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}  # at most K * K rows
    held = np.zeros(len(books.value[0]) * len(books.value[1]), np.int64)
    held[list(counts)] = list(counts.values())
    enough = int(np.ceil(share * held.sum()))
    held_at = spark.sparkContext.broadcast(held)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for batch in batches:
            data = _matrix(batch.column("vec"))
            d1, d2 = squared(data[:, :half], one), squared(data[:, half:], two)
            cells = [walk(a, b, held_at.value, enough) for a, b in zip(d1, d2, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))],
                                             [*batch.schema.names, "cells"])

    def rank(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            c_ids, c = right.column("id").to_numpy(), _matrix(right.column("vec").combine_chunks())
            q_ids, q = left.column("id").to_numpy(), _matrix(left.column("vec").combine_chunks())
            for name, qid, x in zip(left.column("query").to_pylist(), q_ids, q, strict=True):
                gap = np.sqrt(np.square(c - x).sum(1))
                gap[c_ids == qid] = np.inf
                n = min(k, int(np.isfinite(gap).sum()))
                if not n:
                    continue
                limit = np.partition(gap, n - 1)[n - 1]
                near = np.flatnonzero(gap <= limit)
                near = near[np.lexsort((c_ids[near], gap[near]))][:n]
                found["query"] += [name] * n
                found["query_id"] += [int(qid)] * n
                found["vec_id"] += c_ids[near].tolist()
                found["score"] += gap[near].tolist()
        kinds = [pa.int64()] * 3 + [pa.float64()]
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(found.items(), kinds, strict=True)})

    pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / CELL_ROWS)).cast("int")
    # at most K * K rows
    sizes = index.groupBy("cell").agg(F.count("*").alias("n")).select("cell", pieces.alias("pieces"))
    asked = cut(index.where("is_query").select("id", "vec").distinct().withColumn(
        "query", F.monotonically_increasing_id())).mapInArrow(
            visits, "id long, vec array<double>, query long, cells array<int>")
    asked = asked.withColumn("cell", F.explode("cells")).drop("cells").join(F.broadcast(sizes), "cell").withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    stored = index.drop("is_query").join(F.broadcast(sizes), "cell").withColumn(
        "piece", F.pmod(F.xxhash64("id", "vec"), F.col("pieces")).cast("int")).drop("pieces")
    near = asked.groupBy("cell", "piece").cogroup(stored.groupBy("cell", "piece")).applyInArrow(
        rank, "query long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
