"""Removal of repeated byte strings across a corpus with suffix arrays built by linear grouping.

A string of ``length`` bytes that starts in two places holds, at the same place
of both, the same anchor: the ``GRAM`` bytes with the smallest hash among those
of its window.  So all occurrences of a repeated string meet under an anchor,
and an anchor that occurs once belongs to no repeated string.

* Tasks find the anchors of their texts, with a hash of each anchor's context:
  all bytes that a window around it can reach.  Counting is by anchor and
  context, pre-aggregated.  A context that occurs twice is repeated as a whole.
* The distinct contexts of an anchor that has several meet in one task.  Suffix
  arrays over what lies to the right of the anchors, and over what lies to the
  left read backwards, order them; of two orders and their common prefixes
  follows for every window position whether another context has that window.
* The repeated windows go back to the documents as intervals, which are merged
  and cut out.

Documents are numbered by their place in the scan of a table; a frame that is
more than a filtered table, whose rows might come in another order when it is
read again, is written first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.common import cut, join_small, partitions, ready
from sheetlake.llm.shingles import mixed
from sheetlake.llm.suffix_array import suffix_array

#: Bytes of a repeated string, and of an anchor.
LENGTH, GRAM = 200, 64
#: Bytes that are one symbol of a suffix array; contexts in one array.
PIECE, BATCH = 16, 2_048
#: More distinct contexts of an anchor than this are split by the bytes beside it.
GROUP = 1 << 15
#: Bytes of a text hashed at a time.
_STEP = 1 << 20
#: Strings are hashed as polynomials over a prime field, twice: a prime of 31 bits and two points.
_PRIME = (1 << 31) - 1
_POINTS = (1_103_515_245, 715_827_883)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for 0 <= x < 2**62."""
    x = (x & _PRIME) + (x >> 31)
    x = (x & _PRIME) + (x >> 31)
    return np.where(x >= _PRIME, x - _PRIME, x)


def _power(point: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a point and of its inverse."""
    if point not in _powers or len(_powers[point][0]) < n:
        out = []
        for base in (point, pow(point, -1, _PRIME)):
            row = np.ones(1, np.int64)
            while len(row) < max(n, 1 << 12):
                row = np.concatenate([row, _reduced(row * pow(base, len(row), _PRIME))])
            out.append(row)
        _powers[point] = (out[0], out[1])
    return _powers[point]


class Hashes:
    """Hashes of the strings of a text, by first and last place."""

    def __init__(self, text: bytes):
        data = np.frombuffer(text, np.uint8).astype(np.int64) + 1
        # at most 2**8 * 2**31 a byte and 2**22 bytes: the sums stay below 2**62
        self.parts = [(np.concatenate([np.zeros(1, np.int64), np.cumsum(data * up[: len(data)])]), down)
                      for up, down in (_power(p, len(data) + 1) for p in _POINTS)]

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        one, two = (_reduced(_reduced(total[last] - total[first]) * down[first]) for total, down in self.parts)
        return mixed((one.astype(np.uint64) << np.uint64(31)) | two.astype(np.uint64))


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash of the gram, hash of the context) of the anchors of all windows of a text."""
    none = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    if len(text) < length:
        return none
    reach = length - gram
    if len(text) > _STEP + 4 * length:  # long texts in stretches that overlap by what a window and its contexts need
        out = []
        for at in range(0, len(text), _STEP):
            start, end = max(0, at - length), min(len(text), at + _STEP + 2 * length)
            place, one, two = anchors(text[start:end], length, gram)
            place = place + start
            keep = (place >= at) & (place < at + _STEP)
            out.append((place[keep], one[keep], two[keep]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
    hashes = Hashes(text)
    starts = np.arange(len(text) - gram + 1)
    h = hashes.of(starts, starts + gram)
    # the smallest hash of each window, the last of equal ones: its place is in the low bits
    low = np.uint64(0xFFFFFF)
    best = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    span, width = 1, reach + 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
    place = np.unique((low - (best & low)).astype(np.int64))
    first, last = np.maximum(place - reach, 0), np.minimum(place + length, len(text))
    context = hashes.of(first, last)
    shape = ((place - first) * 1_000 + (last - place)).astype(np.uint64)  # contexts cut by an end of the text differ in shape
    return place, h[place], mixed(context ^ mixed(shape))


def _is_scan(df: DataFrame) -> bool:
    """Whether a frame is a table's rows in the order of its files, with columns chosen and rows filtered at most."""
    steps = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return all(re.match(r"[\s:+-]*(?:Project|Filter|Relation) ", line + " ") or "Relation [" in line for line in steps if line.strip())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    if not _is_scan(docs):
        docs = cut(docs.select(id_col, text_col))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def all_anchors(rows: DataFrame) -> DataFrame:
    """row, place, gram, context of every anchor of every text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = [anchors(t.encode()) for t in some.column("text").to_pylist()]
                n = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(some.column("row").to_numpy(), n)), pa.array(np.concatenate([f[0] for f in found])),
                     pa.array(np.concatenate([f[1] for f in found]).view(np.int64)),
                     pa.array(np.concatenate([f[2] for f in found]).view(np.int64))], ["row", "place", "gram", "context"])

    return rows.select("row", "text").mapInArrow(find, "row long, place long, gram long, context long")


def context_bytes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, context, left, right: the bytes around one occurrence of each wanted context (row, place, gram, context)."""
    lists = cut(wanted.groupBy("row").agg(F.collect_list(F.struct("place", "gram", "context")).alias("at")))
    joined = join_small(rows.select("row", "text"), lists, ["row"], "inner", lists.agg(F.sum(F.size("at"))).head()[0] or 0, 40)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                out: list[tuple] = []
                for text, places in zip(some.column("text").to_pylist(), some.column("at").to_pylist(), strict=True):
                    raw = text.encode()
                    out += [(p["gram"], p["context"], raw[max(0, p["place"] - LENGTH + GRAM) : p["place"]],
                             raw[p["place"] : p["place"] + LENGTH]) for p in places]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                    ["gram", "context", "left", "right"])

    return joined.mapInArrow(take, "gram long, context long, left binary, right binary")


def _matrix(texts: list[bytes], width: int, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes, zeros after the end, and their lengths."""
    sizes = np.array([len(t) for t in texts])
    wide = -(-width // PIECE) * PIECE
    out = np.frombuffer(b"".join((t[::-1] if backwards else t).ljust(wide, b"\0") for t in texts), np.uint8).reshape(len(texts), wide)
    return out, sizes


def _ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lexicographic order of the rows, from a suffix array over their pieces, and the bytes that neighbours have in common."""
    n, wide = rows.shape
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64).reshape(-1, PIECE // 8)
    by = np.lexsort(words.T[::-1])
    new = np.concatenate([[False], (words[by[1:]] != words[by[:-1]]).any(1)])
    symbols = np.empty(len(words), np.int64)
    symbols[by] = np.cumsum(new) + 1
    per = wide // PIECE
    text = np.zeros((n, per + 1), np.int64)  # a row's pieces, then the separator
    text[:, :per] = symbols.reshape(n, per)
    array = np.array(suffix_array(text.reshape(-1).tolist()))
    order = array[array % (per + 1) == 0] // (per + 1)
    same = rows[order[1:]] == rows[order[:-1]]
    common = np.where(same.all(1), wide, same.argmin(1))
    return order, common


def repeated_windows(groups: np.ndarray, left: list[bytes], right: list[bytes], length: int = LENGTH) -> np.ndarray:
    """[context, d]: whether another context of its group has the same window that starts d bytes before the anchor.

    All contexts of a group are in; ``right`` starts with the anchor itself.
    """
    reach = length - GRAM
    l_rows, l_size = _matrix(left, reach, backwards=True)
    r_rows, r_size = _matrix(right, length)
    l_order, l_common = _ordered(l_rows)
    r_order, r_common = _ordered(r_rows)
    n = len(groups)
    _, group = np.unique(groups, return_inverse=True)  # a context can be in several groups, where it must not meet itself
    out = np.zeros((n, reach + 1), bool)
    l_class, r_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(reach + 1):
        # classes of contexts with the same d bytes before the anchor, and the same rest of the window from it on
        l_class[l_order] = np.concatenate([[0], np.cumsum(l_common < d)])
        r_class[r_order] = np.concatenate([[0], np.cumsum(r_common < length - d)])
        takes = np.flatnonzero((l_size >= d) & (r_size >= length - d))
        key = (l_class[takes] * n + r_class[takes]) * n + group[takes]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        out[takes[by[1:][same]], d] = True
        out[takes[by[:-1][same]], d] = True
    return out


def _runs(mask: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(row, from, to): bytes relative to the anchor that the marked windows of a row cover."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return [(int(r), -int(e) + 1, length - int(s)) for r, s, e in zip(row, start, end, strict=True)]


def _split(hot: DataFrame) -> DataFrame:
    """Each context of a group under two new ones: with half of the open bytes to the right, or to the left, made part of the anchor.

    A window around the anchor reaches at least half of what it has besides to
    one side, so two contexts with the same window meet in one of the two.
    """
    more = F.ceil((F.lit(LENGTH - GRAM) - F.col("l") - F.col("r")) / 2).cast("int")
    right = hot.withColumn("r", F.col("r") + more).where(F.octet_length("right") >= F.lit(GRAM) + F.col("r")).withColumn(
        "key", F.xxhash64("key", F.lit("r"), F.substring("right", F.lit(GRAM + 1), F.col("r"))))
    left = hot.withColumn("l", F.col("l") + more).where(F.octet_length("left") >= F.col("l")).withColumn(
        "key", F.xxhash64("key", F.lit("l"), F.substring("left", F.octet_length("left") - F.col("l") + 1, F.col("l"))))
    return right.unionByName(left)


def resolved(contexts: DataFrame, group: int | None = None) -> DataFrame:
    """gram, context, spans: what of each context is repeated in another of its anchor.  contexts: gram, context, left, right.

    Groups of more than ``group`` contexts are split by the bytes beside the
    anchor until they are small, or until the whole window is part of it: then
    all its contexts have it.
    """
    group = group or GROUP
    level = contexts.dropDuplicates(["gram", "context"]).withColumns({"key": F.col("gram"), "l": F.lit(0), "r": F.lit(0)})
    found = None
    while True:
        level = cut(level)
        sizes = level.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        sized = level.join(sizes, "key")
        small = _resolved_groups(sized.where(F.col("n") <= group))
        found = small if found is None else found.unionByName(small)
        hot = sized.where(F.col("n") > group).drop("n")
        if hot.isEmpty():
            return found.groupBy("gram", "context").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        whole = F.col("l") + F.col("r") >= LENGTH - GRAM
        span = F.struct((-F.col("l")).alias("from"), (F.lit(LENGTH) - F.col("l")).alias("to"))
        found = found.unionByName(hot.where(whole).select("gram", "context", F.array(span).alias("spans")))
        level = _split(hot.where(~whole))


def _resolved_groups(contexts: DataFrame) -> DataFrame:
    """``resolved`` for contexts in groups (key) that fit a task."""
    spark = contexts.sparkSession
    dealt = contexts.repartition(partitions(spark), "key").sortWithinPartitions("key", "context")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close(rows: list[tuple]) -> pa.RecordBatch:
            found: dict[int, list] = {}
            if rows:
                mask = repeated_windows(np.array([r[0] for r in rows]), [r[3] for r in rows], [r[4] for r in rows])
                for i, start, end in _runs(mask, LENGTH):
                    found.setdefault(i, []).append({"from": start, "to": end})
            kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[i][1] for i in found], pa.int64()), pa.array([rows[i][2] for i in found], pa.int64()),
                 pa.array(list(found.values()), kind)], ["gram", "context", "spans"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "gram", "context", "left", "right")), strict=True):
                if len(held) >= BATCH and held[-1][0] != row[0]:
                    yield close(held)
                    held = []
                held.append(row)
        yield close(held)

    return dealt.mapInArrow(work, "gram long, context long, spans array<struct<from: int, to: int>>")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """row, spans: for each row with repeated strings, where they lie (from, to); an end may be past that of the text."""
    found = cut(all_anchors(rows))
    kinds = cut(found.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one")))
    groups = kinds.groupBy("gram").agg(F.count("*").alias("contexts"), F.max("n").alias("most")).where("contexts > 1 or most > 1")
    kinds = cut(kinds.join(groups.select("gram", "contexts"), "gram"))
    several = kinds.where("contexts > 1").select("one.row", "one.place", "gram", "context")
    spans = resolved(context_bytes(rows, several))
    whole = F.array(F.struct(F.lit(-LENGTH).alias("from"), F.lit(2 * LENGTH).alias("to")))
    spans = cut(kinds.where("n > 1").select("gram", "context", whole.alias("spans")).unionByName(
        spans.join(kinds.where("n > 1"), ["gram", "context"], "left_anti")))
    at = found.join(spans, ["gram", "context"]).select("row", "place", F.explode("spans").alias("s"))
    reach = LENGTH - GRAM  # a context that is repeated as a whole: all it holds
    start = F.greatest(F.col("s.from"), F.lit(-reach)) + F.col("place")
    end = F.least(F.col("s.to"), F.lit(LENGTH)) + F.col("place")
    lists = at.groupBy("row").agg(F.collect_list(F.struct(F.greatest(start, F.lit(0)).alias("from"), end.alias("to"))).alias("spans"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), merged_lists(batch.column("spans"))], ["row", "spans"])

    return lists.mapInArrow(joined, "row long, spans array<struct<from: long, to: long>>")


def merged_lists(spans: pa.ListArray) -> pa.ListArray:
    """Lists of spans (from, to), in each list those that touch made one."""
    sizes = np.diff(spans.offsets.to_numpy())
    fields = spans.flatten().flatten()
    base = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) << 40  # lists one after the other on one line
    start, end = fields[0].to_numpy() + base, fields[1].to_numpy() + base
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]])) if len(start) else np.empty(0, np.int64)
    last = np.append(first[1:], len(start))[: len(first)] - 1
    rows = start[first] >> 40
    low = (1 << 40) - 1
    values = pa.StructArray.from_arrays([pa.array(start[first] & low), pa.array(end[last] & low)], ["from", "to"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(sizes)))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """Every document without the bytes that a repeated string of :data:`LENGTH` bytes covers.

    Strings are judged on the input: all their occurrences go, overlapping ones
    and those within one document included; none crosses documents.  Null texts
    are empty; empty and short texts lose nothing; rows that repeat a text are
    copies of each other; a null id stays null.  An empty table gives no rows;
    other columns are ignored.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, unless not asked for, kept (the remaining bytes).
    """
    spark = ready(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    spans = cut(repeated_spans(rows))
    joined = join_small(rows, spans, ["row"], "left", spans.agg(F.sum(F.size("spans"))).head()[0] or 0, 40)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
              ("kept_sha256", pa.string()), *[("kept", pa.binary())] * with_bytes]

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, out = batch.slice(at, 256), []
                for doc, text, found in zip(*(some.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                    raw = text.encode()
                    parts, last = [], 0
                    for span in found or ():  # a span may end past the text
                        parts.append(raw[last : span["from"]])
                        last = min(span["to"], len(raw))
                    kept = b"".join([*parts, raw[last:]])
                    row = (doc, len(raw), len(raw) - len(kept), len(found or ()), hashlib.sha256(kept).hexdigest())
                    out.append((*row, kept) if with_bytes else row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], [n for n, _ in fields])

    return joined.mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
                             + ", kept binary" * with_bytes)
