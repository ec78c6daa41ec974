"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

The distinct shingles of a text, rarest first, make its list.  Two sets that
reach the threshold share a shingle among the first ones of both lists (the
prefixes).  Texts with the same set are one class from the start.  A pair of
classes that meet on a prefix shingle must pass

* the length filter: neither set is much larger than the other,
* the positional filter: what lies behind the shingle in both lists is enough,
* the suffix filter: the counts of both sets over fixed cells of the hash space
  differ by no more than the sets may,

and is then verified once, on the whole sets.  In a prefix list of more than a few
classes, the one with the shingle furthest in front is the hub and meets the
others first; what these links join needs no further pair.  Rounds of hubs
leave few lists with several components, and those are joined in full, across
components only.  So a group of thousands of copies costs about one
verification per copy and not one per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.common import cut, join_small, lean, ready, release_driver
from sheetlake.llm.components import components
from sheetlake.llm.shingles import mixed, shingle_sets

#: Cells of the hash space over which document frequencies are counted: 8 MB whatever the corpus.
FREQUENCY_BITS = 20
_CHUNK = 1024
#: Cells of the suffix filter.
CELLS = 64
#: A prefix list of at most this many classes is joined in full at once.
SHORT = 32
#: Rounds of hubs before what is left of longer lists is joined in full.
HUB_ROUNDS = 3
#: Texts hashed at a time.
_TEXTS = 512


def _need(n, t: int):
    """The smallest overlap that a set of n shingles can have with a set that it links to: ceil(t * n / 100)."""
    return -(-n * t // 100)


def _overlap(a: Column, b: Column, t: int) -> Column:
    """The overlap that links two sets of these sizes: 100 * i >= t * (a + b - i)."""
    return F.ceil((a + b) * F.lit(t) / F.lit(100 + t) - F.lit(1e-9))


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """How many (document, shingle) pairs of all documents fall in each cell of the hash space."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << FREQUENCY_BITS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                sets = shingle_sets(batch.column("text").slice(at, _TEXTS).to_pylist(), k)
                cells = (np.concatenate(sets) >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)
                total += np.bincount(cells, minlength=len(total))
        parts = total.reshape(-1, _CHUNK)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())],
                                         ["chunk", "counts"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(c, np.int64) for c in rows.column("counts").to_pylist()], axis=0)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(lean(count), "chunk int, counts binary").withColumn(
        "part", F.pmod(F.spark_partition_id(), F.lit(64)))
    for keys in (("chunk", "part"), ("chunk",)):  # many tasks add up in two steps
        parts = parts.groupBy(*keys).applyInArrow(add, "chunk int, counts binary")
    total = np.zeros((1 << FREQUENCY_BITS) // _CHUNK * _CHUNK, np.int64)
    for r in parts.collect():  # 2 ** FREQUENCY_BITS counts in all
        total[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["counts"], np.int64)
    return total


def _fingerprint(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        one = mixed(s + np.uint64(len(s))).sum(dtype=np.uint64)
        two = mixed(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big")


def profiles(docs: DataFrame, k: int, t: int, rank: Broadcast) -> DataFrame:
    """The columns of every document but its text, with n (set size), set_id, cells and prefix (rarest first)."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = rank.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                some = batch.slice(at, _TEXTS)
                ids, cells, prefixes = [], [], []
                sets = shingle_sets(some.column("text").to_pylist(), k)
                for s in sets:
                    ids.append(_fingerprint(s) if len(s) else None)
                    if not len(s) or ids[-1] in seen:  # one profile per set and task is enough
                        cells.append(None), prefixes.append(None)
                        continue
                    seen.add(ids[-1])
                    cells.append(np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) % CELLS, minlength=CELLS), 32_767))
                    first = len(s) - _need(len(s), t) + 1
                    order = np.lexsort((s, often[(s >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)]))[:first]
                    prefixes.append(s[order].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(f.name) for f in kept), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(cells, pa.list_(pa.int16())), pa.array(prefixes, pa.list_(pa.int64()))],
                    [*(f.name for f in kept), "n", "set_id", "cells", "prefix"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(lean(profile), f"{schema}, n long, set_id binary, cells array<short>, prefix array<long>")


def whole_sets(docs: DataFrame, k: int, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """(cid, shingles) for the classes (set_id, cid) that are wanted."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                found = [(_fingerprint(s), s.view(np.int64)) for s in shingle_sets(batch.column("text").slice(at, _TEXTS).to_pylist(), k)
                         if len(s)]
                found = [(i, s) for i, s in found if i not in seen and not seen.add(i)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.binary()),
                                                  pa.array([s for _, s in found], pa.list_(pa.int64()))], ["set_id", "shingles"])

    all_sets = docs.select("text").mapInArrow(lean(sets), "set_id binary, shingles array<long>")
    return join_small(all_sets, wanted, ["set_id"], "inner", n_wanted).select("cid", "shingles").dropDuplicates(["cid"])


def _passes(t: int, x: str, y: str) -> Column:
    """Length and positional filter for two postings of one list; not the first shingle in common: another list has the pair."""
    c = lambda side, name: F.col(f"{side}.{name}")
    need = _overlap(c(x, "n"), c(y, "n"), t)
    return ((F.least(c(x, "n"), c(y, "n")) * 100 >= F.greatest(c(x, "n"), c(y, "n")) * t)
            & (F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos")) >= need)
            & ~(c(x, "before").eqNullSafe(c(y, "before")) & c(x, "before").isNotNull()))


def _cells_differ(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a.cast("int") - b.cast("int"))), F.lit(0), lambda s, v: s + v)


def _suffix(t: int, x: str, y: str) -> Column:
    """The suffix filter: sets whose cells differ by more than the sets may cannot link."""
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    return _cells_differ(F.col(f"{x}.cells"), F.col(f"{y}.cells")) <= a + b - 2 * _overlap(a, b, t)


def _verified(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The links among distinct pairs (a, b): both whole sets, each pair once.  Pairs are a written table."""
    n = pairs.count()
    if not n:
        return pairs
    right = join_small(sets.withColumnsRenamed({"cid": "b", "shingles": "two"}), pairs, ["b"], "inner", n)
    hubs = pairs.select(F.col("a").alias("cid")).distinct()
    left = join_small(sets, hubs, ["cid"], "left_semi", n).withColumnsRenamed({"cid": "a", "shingles": "one"})
    i = F.size(F.array_intersect("one", "two"))
    return cut(right.join(left, "a").where(i * 100 >= (F.size("one") + F.size("two") - i) * t).select("a", "b"))


def _row_keys(id_col: str, text_col: str) -> dict[str, Column]:
    """128 bits that name a row's id and text."""
    return {"k1": F.xxhash64(F.lit(31), F.col(text_col), F.col(id_col)), "k2": F.xxhash64(F.lit(32), F.col(id_col), F.col(text_col))}


def linked(docs: DataFrame, k: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with the size of their shingle set and the component of their links.

    Two documents link when the Jaccard similarity of their ``k``-word shingle
    sets is at least ``threshold`` percent.  component_id is the smallest
    doc_id that links reach, the document's own included.  Null, empty and
    word-free texts have no shingles and no links.  Rows that repeat a text
    link as any others do; a null doc_id takes part but names no component; a
    component (or a text without words) with null ids only has a null
    component_id.  An empty table gives no rows; other columns are ignored.

    Returns doc_id, n_shingles, component_id, the component's own number
    (null without words) and the hashes k1, k2 of id and text.
    """
    spark = ready(docs.sparkSession)
    release_driver(spark)  # this is the operator of the most jobs: it begins without what others left
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *[c.alias(n) for n, c in _row_keys(id_col, text_col).items()])
    rank = spark.sparkContext.broadcast(frequencies(docs, k))
    rows = cut(profiles(docs, k, threshold, rank))
    rank.destroy()  # the rows are written: neither the driver nor the executors need it any more
    release_driver(spark)
    named = rows.where("set_id is not null")
    classes = cut(named.where("prefix is not null").dropDuplicates(["set_id"]).select(
        "set_id", "n", "cells", "prefix").withColumn("cid", F.monotonically_increasing_id()))
    postings = classes.select("cid", "n", "prefix", F.posexplode("prefix").alias("pos", "shingle")).select(
        "cid", "n", "pos", "shingle", F.when(F.col("pos") > 0, F.try_element_at("prefix", F.col("pos"))).alias("before"))
    # lists of one class, by far the most, are counted away before rows meet
    several = postings.groupBy("shingle").agg(F.count("*").alias("members")).where("members > 1")
    lists = cut(postings.join(several, "shingle"))
    labels = None if lists.isEmpty() else _links(docs, k, threshold, classes, lists)
    members = named.select("doc_id", "n", "set_id", "k1", "k2").join(classes.select("set_id", "cid"), "set_id")
    label = F.col("cid")
    if labels is not None:
        members = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left")
        label = F.coalesce("label", "cid")
    members = members.withColumn("component", label)
    first = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "component", "k1", "k2"]
    bare = rows.where("set_id is null").withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("long")})
    return members.join(first, "component").select(*columns).unionByName(bare.select(*columns))


def representatives(docs: DataFrame, k: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id (null last).

    Texts without words stay.  Which documents go is decided on hashes of id
    and text; of rows that repeat both, one stays.
    """
    rows = linked(docs, k, threshold, id_col, text_col)
    rows = rows.where("component is not null")
    release_driver(docs.sparkSession)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("first"))
    stays = (F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2"))
    keys = cut(rows.join(first, "component").groupBy("k1", "k2").agg(
        F.max(stays).alias("stays"), F.count("*").alias("rows")).withColumnsRenamed({"k1": "__k1", "k2": "__k2"}))
    n_gone, n = keys.agg(F.count_if(~F.col("stays")), F.count_if(F.expr("stays and rows > 1"))).head()
    gone = keys.where("not stays").select("__k1", "__k2")
    out = docs.withColumns({f"__{n}": c for n, c in _row_keys(id_col, text_col).items()})
    out = join_small(out, gone, ["__k1", "__k2"], "left_anti", n_gone)
    repeated = keys.where("stays and rows > 1").select("__k1", "__k2")
    if n:
        one = join_small(out, repeated, ["__k1", "__k2"], "left_semi", n).dropDuplicates(["__k1", "__k2"])
        out = join_small(out, repeated, ["__k1", "__k2"], "left_anti", n).unionByName(one)
    return out.drop("__k1", "__k2")


def _links(docs: DataFrame, k: int, t: int, classes: DataFrame, lists: DataFrame) -> DataFrame | None:
    """(node, label) over the classes that share a prefix shingle and link."""
    about = classes.select("cid", "n", "cells")
    short = lists.where(F.col("members") <= SHORT).withColumn("label", F.col("cid"))
    # one row per class with its places in long lists: in each round a label meets its class, not every posting
    places = cut(lists.where(F.col("members") > SHORT).groupBy("cid", "n").agg(
        F.collect_list(F.struct("shingle", "pos", "before")).alias("places")))
    pairs, any_long = _joined(short, about, t), not places.isEmpty()
    if any_long:
        pairs = pairs.unionByName(_stars(_postings(places.withColumn("label", F.col("cid"))), about, t, 0)).distinct()
    pairs = cut(pairs)
    # the texts are read once more, for the sets of all classes that can take part in a verification
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(places.select("cid")).distinct()
    wanted = cut(wanted.join(classes.select("cid", "set_id"), "cid"))
    sets = cut(whole_sets(docs, k, wanted, wanted.count()))
    labels, now, tested = None, None, pairs
    for turn in range(1, HUB_ROUNDS + 2):
        release_driver(docs.sparkSession)
        found = _verified(pairs, sets, t)
        new = not found.isEmpty()
        if new:  # without a new link the components are those of the round before
            labels = components(found if labels is None else found.unionByName(
                labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
        if turn > HUB_ROUNDS or not any_long:
            break
        if new or now is None:
            now = _open(places, labels)
            if now.isEmpty():
                break
        pairs = _stars(now, about, t, turn) if turn < HUB_ROUNDS else _joined(now, about, t)
        swapped = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = cut(pairs.join(swapped, ["a", "b"], "left_anti"))
        tested = tested.unionByName(pairs)
    return labels


def _postings(places: DataFrame) -> DataFrame:
    """A row for each place of a labelled class in a long list."""
    return places.select("cid", "n", "label", F.inline("places"))


def _open(places: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The postings, with the labels of their classes, of the long lists that hold several components."""
    label = F.col("cid")
    if labels is not None:
        places, label = places.join(labels.withColumnRenamed("node", "cid"), "cid", "left"), F.coalesce("label", "cid")
    now = _postings(places.withColumn("label", label))
    several = now.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return cut(now.join(several.select("shingle"), "shingle", "left_semi"))


def _stars(now: DataFrame, about: DataFrame, t: int, turn: int) -> DataFrame:
    """Distinct pairs (a, b) of the hub of each list with the others of another component."""
    # the first hub is the class with the shingle furthest in front; then the front one of a component drawn anew each turn
    draw = F.xxhash64(F.lit(turn), "label") if turn else F.lit(0)
    hubs = now.groupBy("shingle").agg(F.min(F.struct(draw.alias("draw"), "pos", "cid", "n", "before", "label")).alias("x"))
    met = hubs.join(now.select("shingle", F.struct("cid", "n", "pos", "before", "label").alias("y")), "shingle")
    pairs = met.where(F.col("x.label") != F.col("y.label")).where(_passes(t, "x", "y")).select(
        F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    one = about.select(F.col("cid").alias("a"), F.struct("n", "cells").alias("x"))
    two = about.select(F.col("cid").alias("b"), F.struct("n", "cells").alias("y"))
    return pairs.join(two, "b").join(one, "a").where(_suffix(t, "x", "y")).select("a", "b")


def _joined(now: DataFrame, about: DataFrame, t: int) -> DataFrame:
    """Distinct pairs (a, b) across components that share a list and pass all filters: a is the smaller set."""
    full = now.join(about.select("cid", "cells"), "cid")
    # the smaller of two sets must have the shingle in its shorter index prefix
    index = F.col("n") - _overlap(F.col("n"), F.col("n"), t) + 1
    x, y = full.where(F.col("pos") < index).alias("x"), full.alias("y")
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.cid") < F.col("y.cid")))
    return x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") != F.col("y.label")) & ordered
                  & _passes(t, "x", "y") & _suffix(t, "x", "y")).select(
        F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
