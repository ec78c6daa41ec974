"""Session helpers: a local session for tests and benches, and lineage cuts.

Nothing here overrides what a cluster already configured: the checkpoint
folder is taken from the session (``spark.checkpoint.dir``) and a private
one is only made for local sessions where none is set.
"""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sheetlake") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # local sizing: small inputs still split over every core
        .config("spark.sql.files.maxPartitionBytes", os.environ.get("SHEETLAKE_MAX_PARTITION_BYTES", "32m"))
        .config("spark.sql.files.openCostInBytes", "1m")
        .config("spark.driver.memory", os.environ.get("SHEETLAKE_DRIVER_MEMORY", "16g"))
    )
    if os.environ.get("SHEETLAKE_EVENT_LOG"):
        builder = builder.config("spark.eventLog.enabled", "true").config(
            "spark.eventLog.dir", os.environ["SHEETLAKE_EVENT_LOG"])
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Order: the context's checkpoint dir, then ``spark.checkpoint.dir``; only a
    local session with neither gets a private folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; a shared folder is required on a cluster")
        configured = tempfile.mkdtemp(prefix="sheetlake-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared checkpoint folder and read it back.

    The same guarantee as ``checkpoint()`` -- the result is on the shared file
    system, later stages never recompute (or re-randomise) its lineage, and a
    lost executor costs nothing -- but columnar and compressed instead of
    serialised rows.  Folders are named per call and left for the cluster's
    checkpoint clean-up, like RDD checkpoints; a caller that knows when its
    frame is done gives a list (``made``) and passes it to ``drop_cuts``.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/sheetlake-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _CUTS.setdefault(id(spark.sparkContext._jsc), []).append(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_CUTS: dict[int, list[str]] = {}


def drop_cuts(spark: SparkSession, paths: list[str]) -> None:
    """Delete these lineage-cut folders; nothing may read their frames any more."""
    sc = spark.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    known = _CUTS.get(id(sc._jsc), [])
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(conf).delete(hp, True)
        if p in known:
            known.remove(p)


def drop_lineage_cuts(spark: SparkSession) -> int:
    """Delete all lineage-cut folders this context wrote; call when their frames are no longer used."""
    paths = list(_CUTS.get(id(spark.sparkContext._jsc), []))
    drop_cuts(spark, paths)
    return len(paths)


def release_driver(spark: SparkSession) -> None:
    """Let go of what finished jobs have left on the driver: plans, broadcasts, the entries of their shuffles.

    The driver of many short jobs would rather grow to its limit than collect.
    Spark asks for the same every half hour (``spark.cleaner.periodicGC.interval``).
    What the JVM has freed outside its heap (compilers, compression, threads that
    ended) the C library keeps for later; it is given back to the system too.
    """
    gc.collect()  # frames that Python has dropped hold their plans no longer
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # by reflection: the server's own class is not public
    invoke = next(m for m in jvm.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    call = spark.sparkContext._gateway.new_array(jvm.Object, 4)  # bean, command, no parameters, no signature
    call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with contextlib.suppress(Py4JJavaError):  # a JVM without this command (before 17.0.9, or not on glibc) goes on as it is
        invoke.invoke(server, call)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder (for intermediate outputs)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/sheetlake-{name}-{uuid.uuid4().hex}"


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sheetlake`` importable in executor Python workers (once per context).

    Functions run on executors (decoder, workbook writer, file hasher) live in
    this package; a zip of it is written to the shared checkpoint folder and
    added with ``addPyFile`` -- what ``--py-files`` does -- so workers import
    it wherever the driver runs from.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import io
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(pkg):
            if "__pycache__" in folder:
                continue
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    target = f"{scratch_dir(spark, 'pyfiles')}/sheetlake.zip"
    jvm = sc._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(target)
    stream = hpath.getFileSystem(sc._jsc.hadoopConfiguration()).create(hpath, True)
    try:
        stream.write(bytearray(buf.getvalue()))
    finally:
        stream.close()
    sc.addPyFile(target)
    _SHIPPED.add(key)
