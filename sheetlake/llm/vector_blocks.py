"""Vectors packed into blocks of rows, and the grid that brings every query block to every candidate block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.common import cut

SCHEMA = "dim int, n int, ids binary, data binary, block long"


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """(id long, vec array) -> blocks of at most ``rows`` vectors of one dimension: ids int64, data float64.

    Rows stay in their partition; a block is a slice of an Arrow batch.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            vec = batch.column(1)
            sizes = np.diff(vec.offsets.to_numpy())
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            out: dict[str, list] = {"dim": [], "n": [], "ids": [], "data": [], "block": []}
            for dim in np.unique(sizes):
                which = np.flatnonzero(sizes == dim)
                for at in range(0, len(which), rows):
                    take = which[at : at + rows]
                    data = flat[starts[take][:, None] + np.arange(dim)]
                    for name, value in (("dim", int(dim)), ("n", len(take)), ("ids", ids[take].tobytes()),
                                        ("data", np.ascontiguousarray(data).tobytes()), ("block", number)):
                        out[name].append(value)
                    number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["dim"], pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["ids"], pa.binary()),
                 pa.array(out["data"], pa.binary()), pa.array(out["block"], pa.int64())], list(out))

    return vectors.mapInArrow(pack, SCHEMA)


def unpacked(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the matrix of all blocks of a group (one dimension)."""
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in blocks.column("ids").to_pylist()])
    dim = blocks.column("dim")[0].as_py()
    data = np.concatenate([np.frombuffer(x, np.float64) for x in blocks.column("data").to_pylist()])
    return ids, data.reshape(-1, dim)


def grid(queries: DataFrame, candidates: DataFrame, per_cell: int = 8):
    """Cogrouped blocks: a cell of the grid holds about ``per_cell`` blocks of either side, and any two blocks meet in one cell.

    Query blocks are dealt to rows of the grid and repeated along its columns,
    candidate blocks the other way round, so a task's memory is a few blocks
    whatever the size of the table.
    """
    queries, candidates = cut(queries), cut(candidates)
    down = max(1, -(-queries.count() // per_cell))
    along = max(1, -(-candidates.count() // per_cell))
    deal = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    left = queries.withColumn("down", deal(down)).withColumn(
        "along", F.explode(F.sequence(F.lit(0), F.lit(along - 1))))
    right = candidates.withColumn("along", deal(along)).withColumn(
        "down", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    return left.groupBy("dim", "down", "along").cogroup(right.groupBy("dim", "down", "along"))
