"""Exact top-k search by inner product, pruned with segment means and deviations from coarse to fine.

Cut a vector into segments of ``len`` components with mean m and deviation s.
For two vectors the squared distance is at least the sum over segments of
``len * ((m1 - m2)^2 + (s1 - s2)^2)``, at any resolution, and more segments
give a closer bound.  As ``2 * inner = |q|^2 + |v|^2 - distance^2``, a lower
bound of the distance is an upper bound of the score.  A query block meets a
candidate block at the coarsest resolution first; only pairs whose bound
reaches the k-th best exact score so far go to the next one, and only the last
survivors get exact scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlake.llm.common import ready, usable_vector
from sheetlake.llm.vector_blocks import grid, packed, unpacked

#: Numbers of segments, coarse to fine; the finest level of a vector has a segment for each component.
LEVELS = (1, 4, 16, 64, 256, 1024)
#: Vectors in a candidate block and in a query block.
BLOCK_ROWS, QUERY_ROWS = 1024, 256


def segment_statistics(data: np.ndarray, segments: int) -> np.ndarray:
    """Per row and segment sqrt(len) * mean, then sqrt(len) * deviation: distances between these rows are lower bounds."""
    parts = np.array_split(data, min(segments, data.shape[1]), axis=1)
    mean = np.stack([p.mean(1) for p in parts], 1)
    dev = np.stack([p.std(1) for p in parts], 1)
    root = np.sqrt([p.shape[1] for p in parts])
    return np.concatenate([mean * root, dev * root], 1)


def score_bounds(q: np.ndarray, c: np.ndarray, q_norm: np.ndarray, c_norm: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products from lower bounds of the distances between segment statistics."""
    nearest = (q * q).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (q @ c.T)
    bound = (q_norm[:, None] + c_norm[None] - nearest) / 2
    return bound + 1e-9 * (q_norm[:, None] + c_norm[None]) + 1e-6  # what rounding may have taken off


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products row by row; Python integers where doubles could round."""
    if _doubles_do(q, c):
        return np.einsum("ij,ij->i", q, c)
    return np.array([sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, c, strict=True)], object)


def _doubles_do(q: np.ndarray, c: np.ndarray) -> bool:
    return np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1]) < 2.0**52


def levels_of(dim: int) -> list[int]:
    return [n for n in LEVELS if n < dim] + [dim]


class Candidates:
    """The candidates of a task with their norms and segment statistics."""

    def __init__(self, ids: np.ndarray, data: np.ndarray) -> None:
        self.ids, self.data, self.norm = ids, data, (data * data).sum(1)
        self.levels = [segment_statistics(data, n) for n in levels_of(data.shape[1])]


def best_of_block(q_ids: np.ndarray, q: np.ndarray, c: Candidates, k: int) -> tuple[np.ndarray, ...]:
    """(query row, candidate row, score) of each query's k best candidates, ties to the smaller id.

    From level to level only queries and candidates that are part of a
    surviving pair are looked at; exact scores are computed for the most
    promising pairs of a level, which set the floor, and for the last survivors.
    """
    norm = (q * q).sum(1)
    alive = q_ids[:, None] != c.ids[None]
    floor = np.full(len(q), -np.inf)
    n_top = min(k, len(c.ids))
    for level, stats in zip(levels_of(q.shape[1]), c.levels, strict=True):
        rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows):
            break
        some = np.ix_(rows, cols)
        bound = score_bounds(segment_statistics(q[rows], level), stats[cols], norm[rows], c.norm[cols])
        bound[~alive[some]] = -np.inf
        if n_top == k and len(cols) >= k:
            # exact scores of the k most promising candidates give the score that others must reach
            top = np.argpartition(bound, len(cols) - k, axis=1)[:, -k:]
            score = exact_scores(q[np.repeat(rows, k)], c.data[cols[top.ravel()]]).astype(np.float64).reshape(top.shape)
            score[~np.take_along_axis(alive[some], top, 1)] = -np.inf
            floor[rows] = np.maximum(floor[rows], score.min(1))
        alive[some] &= bound >= floor[rows][:, None]
    i, j = np.nonzero(alive)
    score = np.concatenate([exact_scores(q[i[at : at + 65_536]], c.data[j[at : at + 65_536]])
                            for at in range(0, len(i), 65_536)] or [np.empty(0)])
    order = np.lexsort((c.ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], score[keep]


def inner_product_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256,
                       id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` highest integer inner products over all other rows.

    Components become ``floor(scale * x)`` in double precision.  Rows that are
    null, empty, hold null or non-finite components or have no id take no
    part.  Vectors meet those of their own dimension only.  A row with the
    query's id counts as the query's own; a query id on several rows is
    searched once for each distinct vector.  Ties go to the smaller id, equal
    rows under one id all count.  An empty table gives no rows; other columns
    are ignored.  A score beyond 64 bits fails the job.

    Returns query_id long, rank int from 1, vec_id long, score long.
    """
    ready(vectors.sparkSession)
    clean = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vec"),
        is_query.alias("is_query"),
        usable_vector(F.col(vec_col)).alias("ok"),
    ).where("ok and id is not null")
    queries = clean.where("is_query").select("id", "vec").distinct()

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            c = Candidates(*unpacked(right))
            for at in range(left.num_rows):
                one = left.slice(at, 1)
                q_ids, q = unpacked(one)
                i, j, s = best_of_block(q_ids, q, c, k)
                found["query"] += [(one.column("block")[0].as_py() << 16) + int(x) for x in i]
                found["query_id"] += q_ids[i].tolist()
                found["vec_id"] += c.ids[j].tolist()
                found["score"] += [int(x) for x in s]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in found.items()})

    near = grid(packed(queries, QUERY_ROWS), packed(clean.select("id", "vec"), BLOCK_ROWS)).applyInArrow(
        search, "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
