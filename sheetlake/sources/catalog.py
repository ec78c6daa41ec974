"""File catalog: scan directory trees, explicit file lists, cached catalogs.

A tree is listed on the executors, level by level: a frame of folders in, their
files and folders out, the folders being the next level.  No name is special
(hidden names, brackets), folders without files are seen, and the driver holds
neither files nor folders.  A folder that cannot be listed is an error row.
"""

from __future__ import annotations

import datetime as _dt
import logging
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import paths
from ..session import cut_lineage, ship_package
from .files import filesystem, plain_path

_log = logging.getLogger(__name__)

#: One row per entry of a tree: file, folder, or an error under the path that could not be listed.
TREE = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("root", T.StringType(), True),
    T.StructField("kind", T.StringType(), False),  # file | folder | error
    T.StructField("size", T.LongType(), True),
    T.StructField("modified_at", T.TimestampType(), True),
    T.StructField("message", T.StringType(), True),
])

_ROOTS = T.StructType([T.StructField("root", T.StringType())])


def check_roots(roots: Sequence[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """(roots that are directories, [(root, why it is skipped)]), each root once."""
    from pyarrow import fs as pafs

    usable, skipped = [], []
    for root in dict.fromkeys(plain_path(str(r)).rstrip("/") or "/" for r in roots):
        try:
            system, inner, _ = filesystem(root)
            kind = system.get_file_info([inner])[0].type
            if kind == pafs.FileType.Directory:
                usable.append(root)
                continue
            reason = "does not exist" if kind == pafs.FileType.NotFound else "is not a directory"
        except Exception as e:  # no such file system, no access: skipped like a missing one
            reason = f"{type(e).__name__}: {e}"
        skipped.append((root, reason))
        _log.warning("root %s skipped: %s", root, reason)
    return usable, skipped


#: Entries of a folder that a listing task hands on at a time.
PAGE = 10_000


def _entries(path: str) -> Iterator[tuple]:
    """(path, kind, size, modification time) of a folder's entries, one by one; local files come without the last two.

    A local folder is read as its directory stream, so its names are never held
    together; other file systems answer with the folder's list.
    """
    import os

    from pyarrow import fs as pafs

    kinds = {pafs.FileType.File: "file", pafs.FileType.Directory: "folder"}
    system, inner, prefix = filesystem(path)
    if isinstance(system, pafs.LocalFileSystem):
        with os.scandir(inner) as entries:
            for e in entries:
                kind = "folder" if e.is_dir() else "file" if e.is_file() else None
                if kind:
                    yield prefix + e.path, kind, None, None
        return
    for i in system.get_file_info(pafs.FileSelector(inner, recursive=False)):
        if i.type in kinds:
            yield prefix + i.path, kinds[i.type], i.size if i.is_file else None, i.mtime


def _tree_batch(rows: list[tuple]):
    import pyarrow as pa

    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.string()]
    cols = zip(*rows) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=TREE.names)


def _listed(batches: Iterator) -> Iterator:
    """Folders (path, root) in, their entries out, a page at a time."""
    for batch in batches:
        for path, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = []
            try:
                for entry, kind, size, at in _entries(path):
                    rows.append((entry, root, kind, size, at, None))
                    if len(rows) >= PAGE:
                        yield _tree_batch(rows)
                        rows = []
            except Exception as e:
                rows.append((path, root, "error", None, None, f"{type(e).__name__}: {e}"))
            yield _tree_batch(rows)


def _looked_up(batches: Iterator) -> Iterator:
    """Tree rows of files without size and time in, with both out; a file that is gone by now has no row."""
    from pyarrow import fs as pafs

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            system, inner, _ = filesystem(row["path"])
            info = system.get_file_info([inner])[0]
            if info.type == pafs.FileType.File:
                out.append((row["path"], row["root"], "file", info.size, info.mtime, None))
        yield _tree_batch(out)


def tree(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Every file and folder below the usable roots (the roots included as folders), and errors: ``TREE`` rows.

    One small job per level of the tree; a level's folders are spread over the
    executors.  A task reads a folder as a stream of names and hands them on in
    pages; sizes and times are asked for afterwards, by all tasks alike, so one
    folder with very many files is neither held whole nor looked up by one task.
    Overlapping roots list their common part once for each.
    """
    usable, _ = check_roots(roots)
    if not usable:
        return S.empty(spark, TREE)
    ship_package(spark)
    most = 4 * spark.sparkContext.defaultParallelism
    level = S.literal_rows(spark, [(r, r, "folder", None, None, None) for r in usable], TREE)
    found, n = level, len(usable)
    while n:
        folders = level.where("kind = 'folder'").select("path", "root")
        level = cut_lineage(folders.repartition(min(n, most), F.xxhash64("path")).mapInArrow(_listed, TREE))
        found = found.unionByName(level)
        n = level.where("kind = 'folder'").count()
    bare = (F.col("kind") == "file") & F.col("modified_at").isNull()
    asked = found.where(bare).repartition(most, F.xxhash64("path", "root")).mapInArrow(_looked_up, TREE)
    return cut_lineage(found.where(~bare).unionByName(asked))


def existing(directories: DataFrame, column: str = "directory") -> DataFrame:
    """``directories`` with ``valid``: whether tasks find a directory of that name in the file system."""
    ship_package(directories.sparkSession)

    def looked(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        for batch in batches:
            names, valid = batch.column(0).to_pylist(), []
            for name in names:
                try:
                    system, inner, _ = filesystem(name)
                    valid.append(system.get_file_info([inner])[0].type == pafs.FileType.Directory)
                except Exception:  # no such file system, no access
                    valid.append(False)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(valid, pa.bool_())], names=["_directory", "valid"])

    names = directories.select(column).where(F.col(column).isNotNull()).distinct()
    checked = names.mapInArrow(looked, "_directory string, valid boolean")
    return directories.join(checked, F.col(column) == F.col("_directory"), "left").drop("_directory").withColumn(
        "valid", F.coalesce("valid", F.lit(False)))


def list_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Every file under the usable roots: file_path, root, size, modified_at (bytes not read)."""
    return tree(spark, roots).where("kind = 'file'").select(
        F.col("path").alias("file_path"), "root", "size", "modified_at")


def folders(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Every folder under the usable roots, with or without files: folder, root."""
    return tree(spark, roots).where("kind = 'folder'").select(F.col("path").alias("folder"), "root")


def scan(spark: SparkSession, roots: Sequence[str], discovered_at: str | None = None) -> DataFrame:
    """Catalog of spreadsheet files under ``roots``; roots that are no directories are skipped (see ``check_roots``).

    One row per path even when roots overlap; fixed schema even when empty.
    """
    when = discovered_at or _dt.datetime.now().isoformat()
    usable, _ = check_roots(roots)
    cat = list_files(spark, usable).select(
        "file_path",
        paths.extension("file_path").alias("extension"),
        F.lit(when).alias("discovered_at"),
        "root",
        "size",
        "modified_at",
    ).where(paths.is_spreadsheet("extension"))
    # only nested roots can list a file twice; the roots list is small, so decide here
    nested = any(a != b and b.startswith(a.rstrip("/") + "/") for a in usable for b in usable)
    return cat.dropDuplicates(["file_path"]) if nested else cat


def _expanded(spark: SparkSession, entry: str) -> list[tuple[str, int, _dt.datetime]]:
    """(path, size, modification time) of an entry of an explicit list: the file of that name, else a glob's files."""
    from pyarrow import fs as pafs

    def facts(path: str):
        system, inner, prefix = filesystem(path)
        info = system.get_file_info([inner])[0]
        return info.type, (prefix + inner, info.size, info.mtime)

    kind, row = facts(entry)
    if kind == pafs.FileType.File:
        return [row]
    if kind == pafs.FileType.Directory or not any(c in entry for c in "*?[{"):
        return []
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(entry)
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return [facts(st.getPath().toString())[1] for st in found if st.isFile()]


def from_paths(spark: SparkSession, files: Sequence[str], discovered_at: str | None = None) -> DataFrame:
    """Catalog of an explicit file list (globs allowed), each file once.

    Every entry must be a file or a glob that matches files; otherwise the list
    is refused with a ``ValueError`` that names all such entries.  Extensions
    are not checked here: a file that is no workbook becomes an error when it
    is converted.
    """
    when = discovered_at or _dt.datetime.now().isoformat()
    found, refused = {}, []
    for entry in files:
        rows = _expanded(spark, str(entry))
        found.update({r[0]: r for r in rows})
        if not rows:
            refused.append(str(entry))
    if refused:
        raise ValueError(f"not a file: {', '.join(refused)}")
    rows = [(p, None, when, None, size, at) for p, size, at in found.values()]
    return S.literal_rows(spark, rows, S.CATALOG).withColumn("extension", paths.extension("file_path"))


# A catalog store is a folder of versions.  A version counts once its mark is there, which is written last; the highest
# one is the store's content.  Nothing is renamed or replaced, so readers always find a whole catalog.
_MARK = "COMMITTED"


def _versions(spark: SparkSession, path: str, committed: bool = True) -> list[str]:
    """Folders of the store's versions, in order (a few: older ones are deleted)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/v*" + (f"/{_MARK}" if committed else ""))
    found = pattern.getFileSystem(conf).globStatus(pattern) or []
    return sorted(str((st.getPath().getParent() if committed else st.getPath()).toString()) for st in found)


def write_version(catalog: DataFrame, path: str, roots: Sequence[str]) -> str:
    """Write a version of the store without its mark: it does not count yet."""
    spark = catalog.sparkSession
    last = max((int(v.rsplit("/v", 1)[1].split("-")[0]) for v in _versions(spark, path, committed=False)), default=0)
    version = f"{path.rstrip('/')}/v{last + 1:09d}-{uuid.uuid4().hex[:8]}"
    catalog.select(*[f.name for f in S.CATALOG.fields]).write.parquet(f"{version}/catalog")
    S.literal_rows(spark, [(r,) for r in roots], _ROOTS).write.parquet(f"{version}/roots")
    return version


def save(catalog: DataFrame, path: str, roots: Sequence[str] = ()) -> None:
    """Add a version to the store at ``path``: the catalog and the roots it covers; the one before stays for its readers."""
    spark = catalog.sparkSession
    version = write_version(catalog, path, roots)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(f"{version}/{_MARK}")
    fs = mark.getFileSystem(conf)
    fs.create(mark, False).close()
    done = _versions(spark, path)
    for old in _versions(spark, path, committed=False):
        if len(done) > 1 and old < done[-2]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The catalog in the store's latest version; an empty one if it has none."""
    done = _versions(spark, path)
    return spark.read.schema(S.CATALOG).parquet(f"{done[-1]}/catalog") if done else S.empty(spark, S.CATALOG)


def covered(spark: SparkSession, path: str) -> list[str]:
    """Roots that the store's latest version covers, those without spreadsheets included (one row a root)."""
    done = _versions(spark, path)
    return [r[0] for r in spark.read.schema(_ROOTS).parquet(f"{done[-1]}/roots").distinct().collect()] if done else []


def load_or_scan(spark: SparkSession, roots: Sequence[str], path: str, rescan: bool = False) -> DataFrame:
    """The catalog of ``roots`` from a store that keeps every root ever scanned.

    Roots that the store covers come from it (roots without spreadsheets
    included), the others are scanned and added; ``rescan`` scans all asked
    for.  A store that cannot be read counts as empty.  A failure to save does
    not stop the caller.
    """
    usable, _ = check_roots(roots)
    try:
        known, cached = covered(spark, path), load(spark, path)
    except Exception as e:
        _log.warning("catalog store not readable: %s", e)
        known, cached = [], S.empty(spark, S.CATALOG)
    missing = [r for r in usable if rescan or r not in known]
    if not missing:
        return cached.where(F.col("root").isin(usable))
    everything = cached.where(~F.col("root").isin(missing)).unionByName(cut_lineage(scan(spark, missing)))
    try:
        save(everything, path, sorted({*known, *missing}))
    except Exception as e:
        _log.warning("catalog not saved: %s", e)
    return everything.where(F.col("root").isin(usable))
