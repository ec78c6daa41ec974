"""Best-fit packing of tokenised documents into sequences by bin completion.

Only how many pieces there are of each length decides the packing, and lengths
are at most the sequence length: the search works on that histogram, whose size
is bounded by the sequence length whatever the number of documents.  A filling
found for one sequence is used as often as its lengths last.  The documents
then find their sequence by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetlake.llm.common import cut, lean, partitions, ready

#: Tokens of a sequence; the id that ends a document.
LENGTH, END_ID = 2048, 0
#: Branch and bound: fillings tried for a largest piece, items of a searched filling, nodes in all.
WIDTH, DEPTH, NODES = 6, 4, 20_000
#: Texts encoded at a time.
BATCH = 256


# -- search on the histogram -------------------------------------------------


def best_fit(have: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing: (lengths, times); the largest piece, then always the largest that still fits."""
    have, out = have.copy(), []
    while have.any():
        at, room, used = int(np.flatnonzero(have)[-1]), length, []
        left = have.copy()
        while at > 0:
            used.append(at)
            left[at] -= 1
            room -= at
            fits = np.flatnonzero(left[: room + 1])
            at = int(fits[-1]) if len(fits) else 0
        times = int(min(have[x] // used.count(x) for x in set(used)))
        for x in used:
            have[x] -= times
        out.append((tuple(used), times))
    return out


def fillings(have: np.ndarray, room: int, width: int = WIDTH, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, least waste first: none is another with a piece replaced by smaller ones.

    A piece that fills the room exactly dominates every other filling.  Else
    pieces are taken in falling order; a filling that could hold one more piece
    or exchange its last for a larger available one is dominated and left out.
    """
    sizes = np.flatnonzero(have[: room + 1])
    if not len(sizes):
        return [()]
    if sizes[-1] == room:
        return [(room,)]
    found: list[tuple[int, tuple[int, ...]]] = []

    def extend(used: tuple[int, ...], room: int, most: int) -> bool:
        """Adds fillings; True when enough of them waste nothing."""
        end = int(np.searchsorted(sizes, min(most, room), side="right"))
        choices = [int(x) for x in sizes[max(0, end - 4 * width) : end][::-1] if have[x] > used.count(int(x))]
        if not choices:
            found.append((room, used))
            return sum(1 for r, _ in found if r == 0) >= width
        if len(used) + 1 >= depth:  # the last one searched: the best fit, then greedily on
            while choices:
                used, room = (*used, choices[0]), room - choices[0]
                end = int(np.searchsorted(sizes, min(choices[0], room), side="right"))
                choices = next(([int(x)] for x in sizes[:end][::-1] if have[x] > used.count(int(x))), [])
            found.append((room, used))
            return sum(1 for r, _ in found if r == 0) >= width
        for x in choices:
            rest = room - x
            if rest and rest <= x and have[rest] > (*used, x).count(rest):  # a pair that ends exactly dominates what follows
                found.append((0, (*used, x, rest)))
                if sum(1 for r, _ in found if r == 0) >= width:
                    return True
                continue
            if extend((*used, x), rest, x):
                return True
        return False

    extend((), room, room)
    found.sort(key=lambda f: (f[0], len(f[1]), [-x for x in f[1]]))
    kept: list[tuple[int, ...]] = []
    for _, one in found:
        if len(kept) < width and not any(dominates(other, one) for other in kept):
            kept.append(one)
    return kept


def dominates(one: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether the pieces of ``other`` can be laid into pieces of ``one``; each filling dominates itself.

    Pieces go one to one where there are many of them.
    """
    if len(other) > 2 * DEPTH:
        return len(other) <= len(one) and all(a >= b for a, b in zip(one, other, strict=False))

    def lay(i: int, rooms: tuple[int, ...]) -> bool:
        return i == len(other) or any(
            lay(i + 1, (*rooms[:j], room - other[i], *rooms[j + 1 :])) for j, room in enumerate(rooms) if room >= other[i])

    return sum(other) <= sum(one) and lay(0, one)


def completed(have: np.ndarray, length: int, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Bin completion: for the largest piece left, branch over its undominated fillings, depth first.

    The incumbent starts as the best-fit packing.  A branch ends when what it
    has wasted exceeds what a packing with one sequence less could waste, so
    the search ends early once the number of sequences meets the lower bound
    ceil(tokens / length); else after ``nodes`` nodes with the best so far.
    """
    total = int((have * np.arange(len(have))).sum())
    least = -(-total // length)
    best = best_fit(have, length)
    most = sum(t for _, t in best)
    if most <= least:
        return best
    # (histogram, waste so far, path) with the children still to try on a stack
    stack = [(have.copy(), 0, ())]
    while stack and nodes > 0 and most > least:
        nodes -= 1
        left, waste, path = stack.pop()
        if waste > (most - 1) * length - total:
            continue
        if not left.any():
            count = sum(t for _, t in _unrolled(path))
            if count < most:
                most, best = count, _unrolled(path)
            continue
        largest = int(np.flatnonzero(left)[-1])
        left[largest] -= 1
        options = fillings(left, length - largest)
        left[largest] += 1
        for rest in reversed(options):
            used = (largest, *rest)
            times = int(min(left[x] // used.count(x) for x in set(used)))
            child = left.copy()
            for x in used:
                child[x] -= times
            lost = waste + times * (length - sum(used))
            if lost <= (most - 1) * length - total:
                stack.append((child, lost, (path, used, times)))
    return best


def _unrolled(path: tuple) -> list[tuple[tuple[int, ...], int]]:
    out = []
    while path:
        path, used, times = path
        out.append((used, times))
    return out[::-1]


# -- documents ---------------------------------------------------------------


def encoder(path: str):
    """texts -> lists of ids, for a tokenizer file (.json), or faster for the same vocabulary as ranks (.tiktoken).

    With a file of ranks, texts that spell a special token go through the
    tokenizer file of the same name, which reads it as that token; it is loaded
    when the first such text comes.
    """
    from tokenizers import Tokenizer

    if not path.endswith(".tiktoken"):
        whole = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    import base64
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = path.removesuffix(".tiktoken") + ".json"
    with open(full) as described:
        marks = [t["content"] for t in json.load(described)["added_tokens"]]
    loaded: list[Tokenizer] = []

    def encode(texts: list[str]) -> list[list[int]]:
        out = []
        for t in texts:
            if any(m in t for m in marks):
                loaded.extend([Tokenizer.from_file(full)] * (not loaded))
                out.append(loaded[0].encode(t, add_special_tokens=False).ids)
            else:
                out.append(fast.encode_ordinary(t))
        return out

    return encode


def cut_points(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, the first piece takes what is left over."""
    first = n % length or min(n, length)
    return [(0, first)] + [(at, length) for at in range(first, n, length)]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document (null text: empty)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.slice(at, BATCH)
                out = []
                for doc, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                    ids = np.array([*ids, END_ID], "<u4")
                    for number, (start, size) in enumerate(cut_points(len(ids), length)):
                        out.append((doc, number, start, size, zlib.crc32(ids[start : start + size].tobytes())))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(lean(tokenised), "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, nodes: int = NODES, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece with the end id alone.  Rows that repeat
    a doc_id or a whole row are packed each for itself; a null doc_id stays
    null.  An empty table gives no rows; other columns are ignored.
    n_sequences and least_sequences, the same in all rows, tell how many
    sequences there are and the lower bound ceil(tokens / length): where they
    are equal the packing is optimal, else the search ended after ``nodes``
    nodes with the best it had found, or showed that the bound cannot be met.
    """
    spark = ready(docs.sparkSession)
    rows = cut(pieces(docs, tokenizer, length, id_col, text_col))
    have = np.zeros(length + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most `length` rows
        have[r["length"]] = r["count"]
    # (length, first rank, pieces per sequence, sequence of the first, place in it): bounded by the histogram
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, sequence = np.zeros(length + 1, np.int64), 0
    for used, times in completed(have, length, nodes):
        place = 0
        for size in sorted(set(used), reverse=True):
            n = used.count(size)
            slots.setdefault(size, []).append((int(taken[size]), n, sequence, place))
            taken[size] += n * times
            place += n * size
        sequence += times
    least = -(-int((have * np.arange(length + 1)).sum()) // length)
    plan = spark.sparkContext.broadcast({s: np.array(v, np.int64).T for s, v in slots.items()})

    # rank among the pieces of a length: by rank in a bucket, after the buckets before it
    buckets = max(1, partitions(spark))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("length", "bucket", "base")
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "bucket"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def seated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, place = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                first, n, sequence, offset = plan.value[int(s)]
                rows_ = np.flatnonzero(size == s)
                slot = np.searchsorted(first, rank[rows_], side="right") - 1
                turn = rank[rows_] - first[slot]
                seq[rows_] = sequence[slot] + turn // n[slot]
                place[rows_] = offset[slot] + turn % n[slot] * s
            keep = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(seq), pa.array(place)],
                                             [*keep.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(
        lean(seated), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumns(
        {"n_sequences": F.lit(sequence).cast("long"), "least_sequences": F.lit(least).cast("long")})
