"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlake.session import cut_lineage, release_driver, ship_package, shuffle_partitions

__all__ = ["BROADCAST_BYTES", "WORD", "cut", "join_small", "lean", "partitions", "release_driver", "table", "usable_vector", "words_in", "ready"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A list of keys whose measured rows come to at most this many bytes is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 64 << 20

cut = cut_lineage
partitions = shuffle_partitions


def ready(spark: SparkSession) -> SparkSession:
    """Executors can import this package after this call (needed where Python runs inside tasks)."""
    ship_package(spark)
    return spark


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task's function that gives what it has freed back to the system when it ends: workers live on and take the next task."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                trim(0)

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_in(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_small(df: DataFrame, keys: DataFrame, on: list[str], how: str, n_keys: int, row_bytes: int = 100) -> DataFrame:
    """Join a wide frame with a list of keys (or spans) of measured length.

    Up to :data:`BROADCAST_BYTES` of them travel to the wide rows; beyond that
    both sides are shuffled.  The result is the same either way.  A row of a few
    numbers takes about 100 bytes once it is hashed; where rows hold arrays,
    ``n_keys`` counts the elements and ``row_bytes`` is an element's.
    """
    return df.join(F.broadcast(keys) if n_keys * row_bytes <= BROADCAST_BYTES else keys, on, how)


def usable_vector(vec: Column) -> Column:
    """True for a vector that is present, not empty and made of finite components only."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~bad, F.lit(False))
