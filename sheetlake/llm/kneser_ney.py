"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, and perplexities by sharded joins.

The n-grams are runs of four bytes of the UTF-8 text.  Trusted documents are
those labelled good and not toxic.  One half of them (by a hash of the text)
trains the model, the other half sets the thresholds: in each language and
length band, a high quantile of the perplexities of trusted text, with a
margin, looser while a language has few of them.  Documents above their
threshold are rejected; a language without such texts is not judged.

Counting and smoothing are joins and aggregations of count tables.  To score
documents, tasks turn batches of them into lists "n-gram: which documents, how
often", cut by the shard of the n-gram; a shard holds the n-grams with the same
last two context bytes, so an n-gram's whole chain of lower orders is there.
Shards meet the lists and give partial log-probabilities, which are summed by
document.  Tables of one and two bytes are at most 65,536 rows and go to all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.common import cut, join_small, lean, partitions, ready

ORDER = 4
#: N-grams of a shard of the model, about, and shards at least; hot contexts are dealt over salted copies of a shard.
SHARD_ROWS, SHARDS = 1 << 18, 16
#: Documents and bytes of a batch that is listed at once.
BATCH_DOCS, BATCH_BYTES = 256, 1 << 20
#: Thresholds: this quantile of trusted perplexities times the margin, in bands of UTF-8 bytes.
QUANTILE, MARGIN, BANDS = 0.995, 1.1, (64, 256, 1024)
#: Held-out trusted texts from which the quantile of a language, or of its band, counts alone.  With fewer it is mixed, in
#: proportion, with a looser bound: for a language LOOSER times the higher of its own quantile and that of the length band,
#: for its band the higher of the language's bound and the length band's.
ENOUGH, LOOSER = 50, 1.5

#: Spreads the contexts over the shards.
_MULT = 40_503


def _codes(text: bytes) -> np.ndarray:
    """The n-gram that ends at each byte, as a number; zero bytes stand before the text."""
    data = np.frombuffer(bytes(ORDER - 1) + text, np.uint8).astype(np.int64)
    n = len(data) - ORDER + 1
    out = np.zeros(n, np.int64)
    for i in range(ORDER):
        out = (out << 8) | data[i : i + n]
    return out


def _shard(context: np.ndarray, shards: int) -> np.ndarray:
    """By the last two bytes of the context."""
    return ((context & 0xFFFF) * _MULT >> 8) % shards


def _shard_column(context: Column, shards: int) -> Column:
    return F.pmod(F.shiftright(context.bitwiseAND(F.lit(0xFFFF)) * F.lit(_MULT), 8), F.lit(shards)).cast("int")


def document_keys(text: Column, lang: Column) -> dict[str, Column]:
    """128 bits that name a text in a language: equal documents are one."""
    return {"k1": F.xxhash64(F.lit(11), text, lang), "k2": F.xxhash64(F.lit(12), lang, text)}


# -- training ----------------------------------------------------------------


def counts(texts: DataFrame) -> DataFrame:
    """(code, c): how often each n-gram occurs in the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                codes = [_codes(t.encode()) for t in batch.column(0).slice(at, BATCH_DOCS).to_pylist() if t]
                if codes:
                    code, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])

    return texts.select("text").mapInArrow(lean(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("c"))


def discounts(table: DataFrame) -> list[float]:
    """Modified Kneser-Ney: what is taken off counts of 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    few = {r["c"]: r["n"] for r in table.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n = [few.get(i, 0) for i in range(5)]
    if not n[1] or not n[2]:
        return [0.5, 0.5, 0.5]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(i - (i + 1) * y * (n[i + 1] / n[i] if n[i] else 1.0), 0.05), i - 0.05) for i in (1, 2, 3)]


def model(texts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per order from 1: (code, p) of the seen n-grams, interpolated down to the uniform; (context, g) the weight of the lower order.

    Orders below the highest count in how many different ways an n-gram is
    continued to the left, not how often it occurs.
    """
    tables = [cut(counts(texts))]
    for order in range(ORDER - 1, 0, -1):
        keep = F.lit((1 << (8 * order)) - 1)
        tables.insert(0, cut(tables[0].groupBy(F.col("code").bitwiseAND(keep).alias("code")).agg(F.count("*").alias("c"))))
    probabilities, weights = [], []
    for order, table in enumerate(tables, 1):
        one, two, more = discounts(table)
        off = F.when(F.col("c") == 1, one).when(F.col("c") == 2, two).otherwise(more)
        seen = table.withColumns({"context": F.shiftright("code", 8), "off": off})
        total = seen.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("off") / F.sum("c")).alias("g"))
        seen = seen.join(total, "context")
        if order == 1:
            lower = F.lit(1 / 256)
        else:
            below = probabilities[-1].select(F.col("code").alias("suffix"), F.col("p").alias("lower"))
            seen = seen.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1))).join(below, "suffix")
            lower = F.col("lower")
        probabilities.append(cut(seen.select("code", ((F.col("c") - F.col("off")) / F.col("total") + F.col("g") * lower).alias("p"))))
        weights.append(cut(total.select("context", "g")))
    return probabilities, weights


# -- scoring -----------------------------------------------------------------


def _lists(docs: DataFrame, shards: int, salts: int) -> DataFrame:
    """shard, salt, batch, blob: the n-grams of a batch of documents that belong to a shard, with documents and counts.

    The first shard of a batch also names its documents.
    """

    def pack(arrays: list[np.ndarray]) -> bytes:
        parts = [a.tobytes() for a in arrays]
        return zlib.compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts), 1)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                # as many texts as fit, one at least
                fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, side="right"))
                end = min(max(fit, at + 1), at + BATCH_DOCS, batch.num_rows)
                some = batch.slice(at, end - at)
                keys = np.stack([some.column("k1").to_numpy(), some.column("k2").to_numpy()], 1)
                texts = [t.encode() for t in some.column("text").to_pylist()]
                codes = [_codes(t) for t in texts]
                local = np.repeat(np.arange(end - at), [len(c) for c in codes])
                code = np.concatenate(codes)
                item = np.sort((_shard(code >> 8, shards) << 40) | (code << 8) | local)
                first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.empty(0, int)
                often = np.diff(np.append(first, len(item)))
                item = item[first]
                rows: dict[str, list] = {"shard": [], "batch": [], "blob": []}
                edges = np.searchsorted(item >> 40, np.arange(shards + 1))
                for shard in range(shards):
                    some, n = item[edges[shard] : edges[shard + 1]], often[edges[shard] : edges[shard + 1]]
                    if not len(some) and shard:
                        continue
                    gram = (some >> 8) & 0xFFFFFFFF
                    new = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.empty(0, int)
                    rows["shard"].append(shard), rows["batch"].append(number)
                    rows["blob"].append(pack([
                        gram[new].astype(np.uint32), np.diff(np.append(new, len(gram))).astype(np.uint16),
                        (some & 0xFF).astype(np.uint8), np.minimum(n, 255).astype(np.uint8), n[n >= 255].astype(np.int64),
                        keys if shard == 0 else keys[:0]]))
                number, at = number + 1, end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["shard"], pa.int32()), pa.array(rows["batch"], pa.int64()), pa.array(rows["blob"], pa.binary())],
                    list(rows))

    return docs.select("k1", "k2", "text").mapInArrow(lean(listed), "shard int, batch long, blob binary").withColumn(
        "salt", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int"))


def _unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zlib.decompress(blob)
    kinds = (np.uint32, np.uint16, np.uint8, np.uint8, np.int64, np.int64)
    sizes = np.frombuffer(raw[:48], np.int64)
    ends = 48 + np.cumsum(sizes)
    return [np.frombuffer(raw[e - s : e], k) for e, s, k in zip(ends, sizes, kinds, strict=True)]


def _pick(table: tuple[np.ndarray, np.ndarray], at: np.ndarray, missing: float) -> np.ndarray:
    """The table's value at each key, or ``missing``."""
    keys, values = table
    if not len(keys):
        return np.full(len(at), missing)
    place = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
    return np.where(keys[place] == at, values[place], missing)


def _sorted_table(rows: list) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted((r[0], r[1]) for r in rows)
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


def log_probabilities(grams: np.ndarray, p: dict, g: dict, unseen: float) -> np.ndarray:
    """ln p of each n-gram: the highest order that was seen, times the weights of the contexts above it."""
    out = _pick(p[1], grams & 0xFF, np.nan)
    out = np.where(np.isnan(out), unseen, out)
    for order in range(2, ORDER + 1):
        gram = grams & ((1 << (8 * order)) - 1)
        whole = _pick(p[order], gram, np.nan)
        out = np.where(np.isnan(whole), _pick(g[order], gram >> 8, 1.0) * out, whole)
    return np.log(out)


def scores(docs: DataFrame, trained: tuple[list[DataFrame], list[DataFrame]]) -> DataFrame:
    """(k1, k2, perplexity) of every text that has any; docs: k1, k2, text."""
    spark = docs.sparkSession
    probabilities, weights = trained
    tasks = partitions(spark)
    n_shards, grams = SHARDS, probabilities[-1].count()
    while n_shards * SHARD_ROWS < grams and n_shards < 1 << 16:  # a shard is some of the 2^16 two-byte contexts
        n_shards *= 2
    salts = max(1, 4 * tasks // n_shards)
    # tables of one and two bytes: at most 256 and 65,536 rows
    low = {"p": {o: _sorted_table(probabilities[o - 1].collect()) for o in (1, 2)}, "g": {2: _sorted_table(weights[1].collect())}}
    low["unseen"] = weights[0].head()["g"] / 256
    low = spark.sparkContext.broadcast(low)

    def packed_rows(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("code")
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "kind": pa.array([key[1].as_py()], pa.int32()),
                         "batch": pa.array([-1], pa.int64()),
                         "blob": pa.array([np.array([rows.num_rows]).tobytes() + rows.column("code").to_numpy().tobytes()
                                           + rows.column("value").to_numpy().tobytes()], pa.binary())})

    parts = None
    for order in (3, 4):
        for kind, frame, code, value in ((order, probabilities[order - 1], "code", "p"), (10 + order, weights[order - 1], "context", "g")):
            context = F.shiftright(code, 8) if kind < 10 else F.col(code)
            part = frame.select(_shard_column(context, n_shards).alias("shard"), F.lit(kind).alias("kind"),
                                F.col(code).alias("code"), F.col(value).alias("value"))
            parts = part if parts is None else parts.unionByName(part)
    shards = parts.groupBy("shard", "kind").applyInArrow(packed_rows, "shard int, kind int, batch long, blob binary").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # the rows of a shard's model come before the lists that they score; a list is read, scored and dropped
    together = shards.unionByName(_lists(docs, n_shards, salts).withColumn("kind", F.lit(100))).repartition(
        tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, where, p, g = low.value, None, {}, {}
        for batch in batches:
            for shard, salt, kind, number, blob in zip(*(batch.column(c) for c in ("shard", "salt", "kind", "batch", "blob")), strict=True):
                if (shard, salt) != where:
                    where = (shard, salt)
                    none = (np.empty(0, np.int64), np.empty(0))
                    p, g = {**base["p"], 3: none, 4: none}, {**base["g"], 3: none, 4: none}
                kind, blob = kind.as_py(), blob.as_py()
                if kind < 100:
                    n = int(np.frombuffer(blob[:8], np.int64)[0])
                    (p if kind < 10 else g)[kind % 10] = (np.frombuffer(blob, np.int64, n, 8), np.frombuffer(blob, np.float64, n, 8 + 8 * n))
                    continue
                grams, per, local, few, many, keys = _unpacked(blob)
                often, local = few.astype(np.int64), local.astype(np.int64)
                often[few == 255] = many
                keys = keys.reshape(-1, 2)
                logs = np.repeat(log_probabilities(grams.astype(np.int64), p, g, base["unseen"]), per)
                size = max(len(keys), int(local.max(initial=-1)) + 1)
                ln, n = np.bincount(local, logs * often, size), np.bincount(local, often, size)
                rows = np.arange(size) if len(keys) else np.flatnonzero(n)
                name = lambda i: pa.array(keys[:, i]) if len(keys) else pa.nulls(len(rows), pa.int64())  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number.as_py()] * len(rows), pa.int64()), pa.array(rows, pa.int32()), pa.array(ln[rows]),
                     pa.array(n[rows].astype(np.int64)), name(0), name(1)], ["batch", "local", "ln", "n", "k1", "k2"])

    partial = together.mapInArrow(lean(scored), "batch long, local int, ln double, n long, k1 long, k2 long")
    summed = partial.groupBy("batch", "local").agg(F.sum("ln").alias("ln"), F.sum("n").alias("n"), F.max("k1").alias("k1"),
                                                   F.max("k2").alias("k2"))
    # equal documents have equal sums up to the order of adding: one of them stands for all
    return summed.where("n > 0").groupBy("k1", "k2").agg(F.min(F.exp(-F.col("ln") / F.col("n"))).alias("perplexity"))


def band_of(size: Column) -> Column:
    """The length band of a text of so many bytes."""
    out = F.lit(len(BANDS))
    for i, below in reversed(list(enumerate(BANDS))):
        out = F.when(size < below, i).otherwise(out)
    return out


def limits_of(held: DataFrame, quantile: float, margin: float) -> DataFrame:
    """(lang, band, threshold) of every language with held-out trusted texts: lang, band, perplexity."""
    level = [F.count("*").alias("n"), (F.percentile_approx("perplexity", quantile, 10_000) * margin).alias("t")]
    cells = cut(held.cube("lang", "band").agg(F.grouping_id().alias("gid"), *level))
    bands = F.explode(F.sequence(F.lit(0), F.lit(len(BANDS)))).alias("band")
    langs = cells.where("gid = 1").select("lang", F.col("n").alias("n_lang"), F.col("t").alias("t_lang"), bands)
    own = cells.where("gid = 0").select("lang", "band", F.col("n").alias("n_own"), F.col("t").alias("t_own"))
    across = cells.where(f"gid = 2 and n >= {ENOUGH}").select("band", F.col("t").alias("t_band"))
    everything = cells.where("gid = 3").select(F.col("t").alias("t_all"))
    rows = langs.join(own, ["lang", "band"], "left").join(F.broadcast(across), "band", "left").crossJoin(F.broadcast(everything))
    share = lambda n: F.least(F.coalesce(F.col(n), F.lit(0)) / ENOUGH, F.lit(1.0))
    mixed = lambda n, tight, loose: share(n) * F.coalesce(tight, F.lit(0.0)) + (1 - share(n)) * loose
    of_lang = mixed("n_lang", F.col("t_lang"), LOOSER * F.greatest("t_lang", F.coalesce("t_band", "t_all")))
    loose = F.greatest(of_lang, F.col("t_band"), F.col("t_own"))
    return rows.select("lang", "band", mixed("n_own", F.col("t_own"), loose).alias("threshold"))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """Every document with its perplexity, its threshold and whether it is kept.

    A document is trusted if a label row of its id says quality 1 and none says
    quality 0 or toxic 1.  Null and empty texts have no perplexity and are not
    kept.  A null language is a language of its own.  Without trusted text
    nothing can be judged and every document with text is kept; so are those of
    a language of which no trusted text was held out.  Repeated rows alike; a null id is never trusted; an empty table gives no rows; other
    columns are ignored.

    Returns doc_id, lang, perplexity, threshold, keep, and the hashes k1, k2 of language and text.
    """
    spark = ready(docs.sparkSession)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), text.alias("text")).withColumns(
        document_keys(F.col("text"), F.col("lang"))).withColumns(
        {"band": band_of(F.octet_length("text")), "trains": F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(2)) == 0})
    good = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select("doc_id")
    good = cut(good.where("doc_id is not null"))
    n_good = good.count()
    trusted = join_small(rows.where("text <> ''"), good, ["doc_id"], "left_semi", n_good)
    narrow = rows.select("doc_id", "lang", "k1", "k2", "band", (F.col("text") == "").alias("bare"))
    training = trusted.where("trains").select("text")
    if not n_good or training.isEmpty():
        none = F.lit(None).cast("double")
        return narrow.select("doc_id", "lang", none.alias("perplexity"), none.alias("threshold"), (~F.col("bare")).alias("keep"), "k1", "k2")
    found = cut(scores(rows.select("k1", "k2", "text"), model(training)))
    held = trusted.where("not trains").select("lang", "band", "k1", "k2").join(found, ["k1", "k2"])
    limits = cut(limits_of(held, quantile, margin))
    out = join_small(narrow.join(found, ["k1", "k2"], "left"), limits, ["lang", "band"], "left", limits.count())
    keep = ~F.col("bare") & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select("doc_id", "lang", "perplexity", "threshold", F.coalesce(keep, F.lit(False)).alias("keep"), "k1", "k2")


def kept(docs: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    decided = judged(docs, labels, text_col=text_col, lang_col=lang_col, **options)
    gone = cut(decided.where("not keep").select("k1", "k2").distinct())
    keys = document_keys(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(lang_col).cast("string"), F.lit("")))
    out = docs.withColumns({f"__{n}": c for n, c in keys.items()})
    return join_small(out, gone.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), ["__k1", "__k2"], "left_anti",
                      gone.count()).drop("__k1", "__k2")
