"""WARC archives: records written by Spark's text writer, read back by byte ranges with boundary-chain verification.

Reading: Spark splits the files anywhere and cuts each split at the magic
``WARC/1.``.  Every cut is a candidate record: its header gives the offset where
the next record must begin.  A magic inside a payload is a candidate as well,
but no chain of successors leads to it from the start of the file.  The tasks
emit candidate and successor offsets; pointer jumping from offset 0 finds the
candidates that are reachable, and only those are records.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetlake.llm.common import cut, join_small, ready
from sheetlake.session import scratch_dir

MAGIC = "WARC/1."
#: The alphabet of base32, for digests made of SQL functions.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: What follows every payload.
END = "\r\n\r\n"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column, from SQL functions: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    fives = [F.lpad(F.conv(F.substring(digest, at, 5), 16, 32), 4, "0") for at in range(1, 40, 5)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def masked(value: Column) -> Column:
    """A header value without the magic: its dot percent-encoded, and values that already look so encoded once more."""
    again = F.regexp_replace(value, r"WARC/1%(?=(?:25)*2E)", "WARC/1%25")
    return F.replace(again, F.lit(MAGIC), F.lit("WARC/1%2E"))


def unmasked(value: Column) -> Column:
    """The value that :func:`masked` was given."""
    plain = F.replace(value, F.lit("WARC/1%2E"), F.lit(MAGIC))
    return F.regexp_replace(plain, r"WARC/1%25(?=(?:25)*2E)", "WARC/1%")


def _line(name: str, value: Column) -> Column:
    """A header line, nothing for null; line breaks in a value become spaces, a magic is masked."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), masked(F.regexp_replace(value, r"[\r\n]+", " ")), F.lit("\r\n")), F.lit(""))


def write(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
          body_col: str = "html") -> None:
    """One record per row, payload the body in UTF-8 (null: empty).

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest id (null last; then the smallest url) is a response that holds
    the payload; the others are revisits that name it.  Rows that repeat id,
    url and payload are all written as responses; the reader settles them.
    Which rows are copies is found on digests; the payloads are not shuffled.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        body.alias("body")).withColumns(
        {"size": F.octet_length("body").cast("long"), "digest": sha1_base32(F.encode("body", "UTF-8"))})
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url")
    copies = cut(rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(
        F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    out = join_small(rows, copies, ["digest"], "left", copies.count())
    revisit = F.col("first").isNotNull() & ~(F.col("first.page_id").eqNullSafe(F.col("page_id"))
                                             & F.col("first.url").eqNullSafe(F.col("url")))
    number = lambda c: F.col(c).cast("string")
    head = F.concat(
        F.lit("1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        F.lit("WARC-Record-ID: <urn:uuid:"), F.uuid(), F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"),
        _line("WARC-Target-URI", F.col("url")), _line("X-Page-Id", number("page_id")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), number("size"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
                                 _line("X-Refers-To-Page", number("first.page_id")),
                                 _line("WARC-Refers-To-Target-URI", F.col("first.url")))).otherwise(""),
        F.lit("Content-Length: "), F.when(revisit, "0").otherwise(number("size")), F.lit("\r\n\r\n"),
        F.when(revisit, "").otherwise(F.col("body")), F.lit("\r\n"))
    out.select(F.concat(F.lit(MAGIC), head).alias("value")).write.option("lineSep", "\r\n").text(path)


_HEADER = re.compile(rb"[01]\r\n((?:[^\r\n]+\r\n)+)\r\n")
_PIECES = "file string, file_size long, split long, at long, length long, body_at long, body_size long, head binary, digest string, raw binary"


def _candidate(chunk: bytes) -> tuple[int, int, bytes] | None:
    """(where the payload starts, its size, header lines) of a chunk that follows a magic; None without a header."""
    found = _HEADER.match(chunk)
    size = found and re.search(rb"(?im)^Content-Length:[ \t]*(\d+)[ \t]*\r$", found[1])
    return (found.end(), int(size[1]), found[1]) if size else None


def pieces(spark: SparkSession, path: str, all_bytes: bool = False) -> DataFrame:
    """Every stretch from one magic to the next: file, its size, split, place within the split, length, and its header if it has one.

    A piece that holds its whole payload carries the payload's digest; another
    (a magic lies inside), or with ``all_bytes`` every piece, carries its bytes.
    """
    lines = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))
    names = [c.split()[0] for c in _PIECES.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.binary(), pa.string(), pa.binary()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = None, 0
        for batch in batches:
            out: list[tuple] = []
            for file, file_size, split, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, split) != where:
                    where, at = (file, split), 0
                head = _candidate(chunk)
                whole = head is not None and head[0] + head[1] <= len(chunk)
                digest = base64.b32encode(hashlib.sha1(chunk[head[0] : head[0] + head[1]]).digest()).decode() if whole else None
                out.append((file, file_size, split, at, len(chunk), *(head or (None, None, None)), digest,
                            None if whole and not all_bytes else chunk))
                at += len(chunk) + len(MAGIC)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return lines.mapInArrow(scan, _PIECES)


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate of a split leaves the split."""
    leaves: dict[int, int] = {}
    for offset, successor in zip(pdf["offset"][::-1], pdf["successor"][::-1], strict=True):
        leaves[offset] = leaves.get(successor, successor)
    return pdf.assign(to=[leaves[x] for x in pdf["offset"]])[["file", "offset", "to"]]


def _followed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split on the chains from its reached entries."""
    after, kept = dict(zip(pdf["offset"], pdf["successor"], strict=True)), set()
    for at in pdf["offset"][pdf["entry"]]:
        while at in after and at not in kept:
            kept.add(at)
            at = after[at]
    return pdf[pdf["offset"].isin(kept)][["file", "offset"]]


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) of the records: candidates that the chain of successors reaches from offset 0.

    links: file, split, offset, successor.  A task shortens the chains of its
    split to one jump that leaves it; pointer jumping over these jumps doubles
    their reach in every round, so rounds grow with the logarithm of a file's
    splits; at last each split follows its chain from where it was reached.
    """
    links = cut(links)
    ordered = lambda f: lambda pdf: f(pdf.sort_values("offset"))
    jumps = cut(links.groupBy("file", "split").applyInPandas(ordered(_exits), "file string, offset long, to long"))
    known = jumps.select("file", "offset")
    reached = cut(known.where("offset = 0"))
    n = reached.count()
    while n:
        step = reached.join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        reached = cut(reached.union(step.join(known, ["file", "offset"], "left_semi")).distinct())
        before, n = n, reached.count()
        if n == before:
            break
        on = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("next"))
        jumps = cut(jumps.join(on, ["file", "to"], "left").select(
            "file", "offset", F.coalesce("next", "to").alias("to")))
    entries = links.join(reached.withColumn("entry", F.lit(True)), ["file", "offset"], "left").fillna(False, ["entry"])
    return entries.groupBy("file", "split").applyInPandas(_followed, "file string, offset long")


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below a path: file, offset, head (header lines), payload_size, digest of the stored payload.

    Offsets within a file come from the lengths of the pieces before, summed by
    split.  Payloads that hold a magic are put together from their pieces.
    A file whose chain of records does not start at its first byte and end at
    its last fails: nothing after a broken or foreign stretch is left out unseen.
    """
    ready(spark)
    found = cut(pieces(spark, path))
    # where a split's first piece starts: the bytes of all pieces of earlier splits of that file
    spans = found.groupBy("file", "split").agg((F.max(F.col("at") + F.col("length")) + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0))).drop("bytes")
    placed = found.join(starts, ["file", "split"]).withColumn(
        "offset", F.col("base") + F.col("at") - len(MAGIC)).drop("base").where("offset >= 0")
    heads = placed.where("head is not null")
    body_from = F.col("offset") + len(MAGIC) + F.col("body_at")
    links = heads.select("file", "split", "offset", (body_from + F.col("body_size") + len(END)).alias("successor"))
    true = cut(heads.drop("raw").join(reachable(links), ["file", "offset"], "left_semi"))
    ends = true.groupBy("file").agg(F.max(body_from + F.col("body_size") + len(END)).alias("end"))
    broken = found.groupBy("file").agg(F.max("file_size").alias("file_size")).join(ends, "file", "left").where(
        "not (end <=> file_size)").orderBy("file").first()
    if broken:
        raise ValueError(f"records of {broken['file']} end at byte {broken['end'] or 0} of {broken['file_size']}")
    whole = true.where("digest is not null").select("file", "offset", "head", F.col("body_size").alias("payload_size"), "digest")
    torn = true.where("digest is null").select("file", "offset", "head", "body_at", "body_size",
                                               (body_from + F.col("body_size")).alias("past"))
    if torn.isEmpty():
        return whole
    # a payload with a magic inside: the pieces from its record to its end, in order; those that looked whole are read again
    span = placed.select("file", "split", "at", F.col("offset").alias("place")).join(torn, "file").where(
        "place >= offset and place < past")
    parts = pieces(spark, path, all_bytes=True).select("file", "split", "at", "raw").join(span, ["file", "split", "at"])
    parts = parts.groupBy("file", "offset", "head", "body_at", "body_size").agg(
        F.sort_array(F.collect_list(F.struct("place", "raw"))).alias("parts"))
    joined = F.expr(f"reduce(slice(parts, 2, size(parts)), parts[0].raw, (a, b) -> concat(a, CAST('{MAGIC}' AS BINARY), b.raw))")
    body = parts.withColumn("body", joined).withColumn(
        "body", F.expr("substring(body, CAST(body_at + 1 AS INT), CAST(body_size AS INT))"))
    complete = F.when(F.octet_length("body") == F.col("body_size"), F.col("body")).otherwise(
        F.raise_error(F.concat(F.lit("payload is not whole at "), "file", F.lit(" "), F.col("offset"))))
    return whole.unionByName(body.withColumn("body", complete).select(
        "file", "offset", "head", F.col("body_size").alias("payload_size"), sha1_base32(F.col("body")).alias("digest")))


def _header(head: Column, name: str) -> Column:
    value = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)$", 1)
    return F.when(value != "", value)


def page_records(spark: SparkSession, path: str, min_bytes: int = 0) -> DataFrame:
    """Digest of every archived page, as :func:`write` stored it: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Response payloads are digested anew from the archive; a revisit states the
    length and digest of the payload it does not repeat.  Responses that still
    share a payload of at least ``min_bytes`` bytes (rows that repeat id, url
    and payload) become revisits of the first in file order.  A record whose
    payload does not have the digest its header states fails the job.
    """
    head = F.col("head").cast("string")
    read = records(spark, path).select(
        "file", "offset", _header(head, "X-Page-Id").cast("long").alias("page_id"),
        unmasked(_header(head, "WARC-Target-URI")).alias("url"), _header(head, "WARC-Type").alias("stored_as"),
        _header(head, "X-Payload-Length").cast("long").alias("payload_bytes"),
        _header(head, "WARC-Payload-Digest").alias("stated"),
        _header(head, "X-Refers-To-Page").cast("long").alias("names"), "payload_size", "digest")
    stated = F.regexp_replace("stated", "^sha1:", "")
    sound = (F.col("stored_as") == "revisit") | (
        (stated == F.col("digest")) & (F.col("payload_bytes") == F.col("payload_size")))
    read = cut(read.withColumn("payload_digest", F.when(sound, stated).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its record at "), "file", F.lit(" "), F.col("offset"))))))
    again = read.where("stored_as = 'response'").where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(
        F.min(F.struct("file", "offset")).alias("first"), F.min("page_id").alias("first_page"), F.count("*").alias("n")
    ).where("n > 1").drop("n")
    out = join_small(read, again, ["payload_digest"], "left", again.count())
    repeat = (F.col("stored_as") == "response") & F.col("first").isNotNull() & (F.col("first") != F.struct("file", "offset"))
    return out.select(
        "page_id", "payload_bytes", "payload_digest",
        F.when(repeat, "revisit").otherwise(F.col("stored_as")).alias("record_type"),
        F.when(repeat, F.col("first_page")).otherwise(F.col("names")).alias("refers_to"), "url")


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages to WARC files in the shared folder, read them back and return :func:`page_records`.

    A null body is an empty payload; a null id or url leaves its header out and
    comes back as null; an empty table gives no rows; other columns are
    ignored.
    """
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    write(pages, path, min_bytes)
    return page_records(spark, path, min_bytes)
