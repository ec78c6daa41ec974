"""Mixing sources to target weights by weighted pivotal dependent rounding.

A source's target over its size is the number of copies each of its documents
should get.  The whole part is certain; the fraction is a probability that has
to become 0 or 1.  Two documents with fractions meet: the transfer of words
from one to the other is drawn at random so that one of them becomes integral,
the words expected in total stay the same, and so does each document's
expectation.  Tasks round chunks of a source, largest documents first, and
leave one fraction each; these residuals are rounded in the next level of the
tree, until one is left for a source.  That one goes to the nearer of 0 and 1,
so a source gets its target up to half a document, mostly a small one; all other
documents keep their expectations exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlake.llm.common import cut, join_small, lean, partitions, ready, words_in

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix holds this share of all words; a source gives at most CEILING times its words.
SHARE, CEILING = 1.5, 2
#: Documents that meet in one task of a level.
CHUNK = 2_000
SEED = 20_240


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size) -> with target: the share of all words by weight, no source above its ceiling.

    Sources fill up in the order of ceiling / weight; what a full one leaves is
    shared by the others by weight.  One row per source, so a plain window.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int")))
    fill = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    upto, everything = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * float(ceiling)
    left = F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum(cap).over(upto), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    level = weighed.withColumns({"place": F.row_number().over(fill), "level": left / weight_left, "cap": cap})
    # the first that does not fill up sets the level of all after it
    first = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("place", "level"))).over(everything)
    full = first.isNull() | (F.col("place") < first["place"])
    return level.withColumn("target", F.when(full, F.col("cap")).otherwise(
        F.least(first["level"] * F.col("weight"), F.col("cap")))).select("source", "source_size", "target")


def pivot(size: np.ndarray, part: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round fractions one after the other against a carried one; the fractions and the place of the one left, or -1.

    A step moves words between the carried document and the next until either
    is at 0 or 1; which of the two ways is drawn so that both expectations hold.
    """
    part, carried = part.copy(), -1
    for i in range(len(part)):
        if not 0 < part[i] < 1:
            continue
        if carried < 0:
            carried = i
            continue
        a, b, p, q = size[carried], size[i], part[carried], part[i]
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
        rise = draw[i] < down / (up + down)
        moved = up if rise else -down
        p, q = p + moved / a, q - moved / b
        end_p, end_q = ((1 - p) * a <= 1e-9 * a, q <= 1e-9) if rise else (p <= 1e-9, 1 - q <= 1e-9)
        if not (end_p or end_q):  # rounding errors only: the nearer of the two ends
            end_p = True
        if end_p:
            part[carried] = float(rise)
            part[i] = float(not rise) if end_q else q
            carried = -1 if end_q else i
        else:
            part[carried], part[i] = p, float(not rise)
    return part, carried


def _rounded(key_seed: int):
    """A task's chunks, streamed: every row out once, rounded, or marked as the residual of its chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def place(batch: pa.RecordBatch) -> tuple[int, int]:
            return batch.column("source_no")[0].as_py(), batch.column("chunk")[0].as_py()

        def close() -> list[pa.RecordBatch]:
            chunk = pa.Table.from_batches(held).combine_chunks()
            source, number = place(held[0])
            draw = np.random.Generator(np.random.Philox(key=[source & (2**63 - 1), (key_seed << 32) + number])).random(chunk.num_rows)
            part, left = pivot(chunk.column("size").to_numpy().astype(float), chunk.column("part").to_numpy().astype(float), draw)
            held.clear()
            return chunk.set_column(chunk.schema.get_field_index("part"), "part", pa.array(part)).append_column(
                "left", pa.array(np.arange(len(part)) == left)).to_batches()

        for batch in batches:
            source, number = batch.column("source_no").to_numpy(), batch.column("chunk").to_numpy()
            new = np.flatnonzero((source[1:] != source[:-1]) | (number[1:] != number[:-1])) + 1
            for at, end in zip([0, *new], [*new, batch.num_rows], strict=True):
                if end == at:
                    continue
                some = batch.slice(at, end - at)
                if held and place(held[0]) != place(some):
                    yield from close()
                held.append(some)
        if held:
            yield from close()

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING,
        seed: int = SEED, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """How often the mix takes each document.

    Null or empty texts have size 0 and are taken 0 times.  A null source is a
    source of its own, the last.  Sources without words get target 0.  Rows
    that repeat all of id, text and source are rounded one by one (which of
    them is taken is not distinguishable).  An empty table gives no rows;
    other columns are ignored.  Reruns over the same rows agree: draws depend on
    the seed and on the rows' own hashes, not on where they lie.

    Returns doc_id, size, source_size, target, taken (words), copies, source and the row's hashes tie, tie2.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        words_in(F.col(text_col)).alias("size"),
        *[c.alias(n) for n, c in _keys(seed, id_col, text_col, source_col).items()])
    # rows that repeat all of these are counted, then numbered, so that they spread over the chunks like any others
    often = rows.groupBy("doc_id", "source", "size", "tie", "tie2").agg(F.count("*").cast("int").alias("again"))
    rows = cut(often.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("again")))))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, ceiling)
    counts = rows.groupBy("source").count().withColumnRenamed("count", "n").withColumnRenamed("source", "source_of")
    plan = cut(sources.join(counts, F.col("source").eqNullSafe(F.col("source_of"))).drop("source_of").withColumn(
        "source_no", F.xxhash64(F.lit(seed + 1), "source")))
    named = rows.withColumnRenamed("source", "in_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    spread = named.join(plan, F.col("in_source").eqNullSafe(F.col("source")), "inner").drop("in_source")
    whole = F.floor(F.col("ratio") + 1e-12)
    spread = spread.withColumn("ratio", ratio).withColumn("whole", whole.cast("long")).withColumn(
        "part", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("ratio") - whole)).otherwise(0.0)).drop("ratio")
    columns = ["doc_id", "source", "source_no", "size", "source_size", "target", "tie", "tie2", "again", "whole", "part", "n"]
    level, done, schema = spread.select(*columns), None, None
    number, most = 0, plan.agg(F.max("n")).head()[0] or 0
    while True:
        chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / chunk))
        dealt = level.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed + number), "tie", "again"), chunks).cast("long"))
        dealt = dealt.repartition(partitions(spark), "source_no", "chunk").sortWithinPartitions(
            "source_no", "chunk", F.desc("size"), "tie", "tie2", "again")
        schema = schema or ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", left boolean"
        out = cut(dealt.mapInArrow(lean(_rounded(seed + number)), schema))
        number += 1
        most = -(-most // chunk)
        if most <= 1:
            # the last fraction of a source has no partner: it goes to the nearer end
            out = out.withColumn("part", F.round("part"))
            done = out if done is None else done.unionByName(out)
            break
        settled = out.where("not left")
        done = settled if done is None else done.unionByName(settled)
        # as many residuals as chunks had one: the next level deals them anew
        level = out.where("left").drop("left", "chunk").withColumn("n", F.ceil(F.col("n") / chunk))
    copies = (F.col("whole") + F.round("part").cast("long")).alias("copies")
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies, "source", "tie", "tie2")


def mixed(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          **options) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it, with the columns of ``docs``.

    Rows find their copies by a 128-bit hash of id, text and source.  Rows that
    repeat all three share the copies of their hash evenly.  Documents without
    words come as often as the whole part of their source's ratio.
    """
    names = {"id_col": id_col, "text_col": text_col, "source_col": source_col}
    n_of = cut(mix(docs, seed=seed, **names, **options).groupBy(
        F.col("tie").alias("__tie"), F.col("tie2").alias("__tie2")).agg(
        F.sum("copies").alias("__copies"), F.count("*").alias("__rows")))
    keyed = docs.withColumns({f"__{n}": c for n, c in _keys(seed, **names).items()})
    once = join_small(keyed, n_of, ["__tie", "__tie2"], "inner", n_of.count())
    if not n_of.where("__rows > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("__tie", "__tie2").orderBy(F.lit(0)))
        share = F.floor((F.col("__copies") + F.col("__rows") - place) / F.col("__rows"))
        once = once.where("__rows = 1").unionByName(once.where("__rows > 1").withColumn("__copies", share))
    return once.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def _keys(seed: int, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    return {"tie": F.xxhash64(F.lit(seed), F.col(text_col), F.col(id_col)),
            "tie2": F.xxhash64(F.lit(seed + 7), F.col(id_col), F.col(source_col), F.col(text_col))}
