"""Incremental conversion as a stream.

Every micro-batch lists the tree on the executors and converts what the ledger
does not have yet, or has with other content.  The listing is the batch scan's
own: no name is special, and a file changed in place is converted again, which
a file source -- it skips names that start with ``_`` or ``.`` and remembers
paths only -- would not do.  The stream itself is a clock: one row a
micro-batch, its offset kept in the checkpoint.

What a micro-batch converts goes to runs of its own, ``<stream>-<batch>-<n>``.
A replayed batch starts after the runs that its first attempt completed, whose
files the ledger has by then; a run that was cut off has no ledger, is not
read, and its files are converted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import paths
from ..sources import catalog as catalog_source
from ..sources import ingest
from ..sources.cells_io import count_matching


#: More files than a run can have: one run a micro-batch.
ALL = 1 << 31


def ticks(spark: SparkSession) -> DataFrame:
    """A row each micro-batch: one for every ``availableNow`` start, or one a processing-time trigger."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()


def ingest_stream(
    spark: SparkSession,
    root: str,
    output_dir: str,
    checkpoint: str,
    stream_id: str = "stream",
    path_rule: str | None = "filter",
    marker: str = paths.DEFAULT_MARKER,
    available_now: bool = True,
    processing_time: str | None = None,
    max_files_per_trigger: int | None = None,
):
    """Start the incremental conversion; returns the ``StreamingQuery``.

    ``available_now`` processes everything new and stops (a scheduled run);
    otherwise ``processing_time`` sets a trigger interval for a long-running job.
    ``max_files_per_trigger`` bounds each run (a backlog of a million files
    becomes many bounded runs, each with its own ledger).  A file that failed is
    tried again when it has changed, not at every trigger.
    """
    if path_rule not in ("filter", None):
        # a gate would leave the files of a skipped batch out, without a trace
        raise ValueError("streams support path_rule='filter' or None; use ingest.run for the gate")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        run_id = f"{stream_id}-{batch_id:09d}"
        done = count_matching(session, f"{output_dir.rstrip('/')}/ledger/{run_id}-*")
        ingest.run(session, catalog_source.scan(session, [root]), output_dir, skip="seen", run_id=run_id, path_rule=path_rule,
                   marker=marker, max_files=max_files_per_trigger or ALL, first_part=done)

    writer = ticks(spark).writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
