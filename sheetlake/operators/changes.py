"""Change detection between catalog versions and latest-version selection.

Status per file: ``new`` (only in the new catalog), ``missing`` (only in the
old one), ``unchanged`` (same modification time, or a different time but the
same content hash) and ``modified`` (different time and different hash).
The hash is only computed where the times differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..session import ship_package


def content_hash(content: Column | str) -> Column:
    """SHA-256 of the content as lower-case hex."""
    c = F.col(content) if isinstance(content, str) else content
    return F.sha2(c.cast("binary"), 256)


def modified_text(ts: Column | str) -> Column:
    return paths.iso_text(ts)


def status(
    old: DataFrame,
    new: DataFrame,
    key: str = "file_path",
    modified: str = "modified_at",
    old_hash: str = "file_hash",
    new_content: str | None = "content",
    new_hash: str | None = None,
) -> DataFrame:
    """Compare two catalog versions (full outer join on ``key``).

    ``old`` carries the hash recorded at its time (``old_hash``); ``new`` has
    either the content (hashed only for rows whose time changed) or a hash.
    Output: key, status, old/new modification time, new hash where computed.
    """
    o = old.select(
        F.col(key).alias("_k"), F.col(modified).alias("_old_m"), F.col(old_hash).alias("_old_h"),
        F.lit(True).alias("_in_old"),
    )
    n = new.select(F.col(key).alias("_k"), F.col(modified).alias("_new_m"), F.lit(True).alias("_in_new"))
    time_changed = ~F.col("_old_m").eqNullSafe(F.col("_new_m"))
    both = F.col("_in_old").isNotNull() & F.col("_in_new").isNotNull()
    if new_hash is not None:
        source = new.select(F.col(key).alias("_k"), F.col(new_hash).alias("_h"))
    else:
        # keys and times decide first; only files with another time are hashed
        touched = o.join(n, "_k").where(time_changed).select("_k")
        source = new.select(F.col(key).alias("_k"), F.col(new_content).alias("_content")).join(touched, "_k", "left_semi").select(
            "_k", content_hash("_content").alias("_h"))
    j = o.join(n, "_k", "full_outer").join(source, "_k", "left")
    h = F.when(both & time_changed, F.col("_h"))
    st = (
        F.when(F.col("_in_old").isNull(), F.lit("new"))
        .when(F.col("_in_new").isNull(), F.lit("missing"))
        .when(~time_changed, F.lit("unchanged"))
        .when(h == F.col("_old_h"), F.lit("unchanged"))
        .otherwise(F.lit("modified"))
    )
    return j.select(F.col("_k").alias(key), st.alias("status"), h.alias("new_hash"))


def latest(df: DataFrame, key: Sequence[str] | str, version: str) -> DataFrame:
    """Rows carrying the highest ``version`` per ``key`` (ties all kept).

    Skew-safe form: the per-key maximum is a partial + final aggregate (one row
    per key), then a semi join on (key, version) -- the rows of one hot key are
    spread by version instead of landing in one window task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    top = df.groupBy(*keys).agg(F.max(version).alias(version))
    return df.join(top, keys + [version], "left_semi")


def _hash_partition(batches):
    import hashlib

    import pyarrow as pa

    from ..sources.files import open_input

    for batch in batches:
        hashes, messages = [], []
        for path in batch.column(0).to_pylist():
            try:
                h = hashlib.sha256()
                with open_input(path) as f:
                    while chunk := f.read(1 << 20):
                        h.update(chunk)
                hashes.append(h.hexdigest())
                messages.append(None)
            except Exception as e:
                hashes.append(None)
                messages.append(f"{type(e).__name__}: {e}")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.string()), pa.array(messages, pa.string())],
                                         names=["file_path", "file_hash", "message"])


def hash_files(paths_df: DataFrame, files_per_task: int = 16) -> DataFrame:
    """file_path, file_hash, message: SHA-256 of each file's bytes, computed on executors, streamed in 1 MB chunks.

    Only the given paths are read; a path that cannot be read gets a null hash
    and a message.
    """
    spark = paths_df.sparkSession
    ship_package(spark)
    p = paths_df.select("file_path").distinct()
    n = max(1, -(-p.count() // files_per_task))
    # a hash of the path, so the spread is not merged with the distinct's exchange (see ingest)
    return p.repartition(n, F.xxhash64("file_path")).mapInArrow(
        _hash_partition, "file_path string, file_hash string, message string")


def detect(old: DataFrame, new_listing: DataFrame) -> DataFrame:
    """Status of every file between a saved catalog (with ``file_hash``) and a fresh listing.

    ``new_listing``: ``file_path``, ``modified_at`` (no bytes).  Only files whose
    modification time changed are read and hashed, on executors.
    """
    o = old.select("file_path", F.col("modified_at").alias("_old_m"))
    n = new_listing.select("file_path", F.col("modified_at").alias("_new_m"))
    changed = o.join(n, "file_path", "inner").where(~F.col("_old_m").eqNullSafe(F.col("_new_m")))
    hashes = hash_files(changed)
    new_with_hash = new_listing.select("file_path", "modified_at").join(hashes.drop("message"), "file_path", "left")
    found = status(old, new_with_hash, new_hash="file_hash")
    bad = hashes.where("message is not null").select("file_path", "message")
    return found.join(bad, "file_path", "left").withColumn(
        "status", F.when(F.col("message").isNotNull(), F.lit("unreadable")).otherwise(F.col("status")))
