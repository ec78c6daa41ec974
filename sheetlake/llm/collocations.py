"""Phrases whose words occur together unusually often, by direct-address tiles over frequency-ranked ids.

Texts become chunks of word numbers, written once, with the chunk's words dealt
to buckets.  Words are added up bucket by bucket and get ids by falling
frequency; the ids go back to the chunks the same way.  Neighbouring ids are
counted chunk by chunk: ids are split into square tiles, a tile with many pairs
is counted by its cells' addresses with one ``bincount``, all sparse tiles
together as sorted coordinates.  The chunks' counts travel packed, dealt by a
hash of the pair, and are added up bucket by bucket; a pair has one count a
chunk, so no bucket is hot.  The frequent pairs then get ids by falling
frequency themselves and the same step counts neighbouring pairs, which are
three-word phrases, and once more for four: a phrase can only be frequent if
its beginning and its end are.

No list is held whole by a task or the driver: the lookups that renumber a
chunk come bucket by bucket, or by broadcast while they are counted to be short.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetlake.llm.common import BROADCAST_BYTES, cut, lean, partitions, ready
from sheetlake.llm.shingles import mixed, word_hashes
from sheetlake.operators.reshape import with_row_index

#: Occurrences of a phrase, its longest length, phrases reported a language.
LEAST, LONGEST, REPORTED = 30, 4, 2000
#: A longer candidate with at least this percentage of the occurrences stands for a phrase inside it.
COVERED = 80
#: Words of a chunk; ids of a side of a tile (2^9); pairs that make a tile dense.
CHUNK, TILE_BITS, DENSE = 1 << 18, 9, 1 << 14
#: Buckets that words are dealt to: the shuffle partitions, within these bounds.
LEAST_BUCKETS, MOST_BUCKETS = 64, 4096
#: Bytes of a text cut into words at a time.
STEP = 1 << 20
#: Bytes of a pair in a broadcast lookup, its sides and id and their sorted copies.
PAIR_BYTES = 48
#: Words of the corpus that a bucket of pairs is made for, about: a bucket's counts are added up in one piece.
BUCKET_WORDS = 1 << 20

#: Bytes that end a piece become line feeds, tabs blanks, capital letters small ones.
_PLAIN = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_END, _NOTHING = -1, -2


# -- chunks of words -------------------------------------------------------------


class _Buffer:
    """The words of one language that wait for their chunk; a phrase may begin in one chunk and end in the next."""

    def __init__(self):
        self.restart([])

    def restart(self, words: list[bytes | None]) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.numbers[b""], self.numbers[b"\n"] = _NOTHING, _END
        self.numbers.default_factory = count().__next__
        self.parts = [np.array([_END if w is None else self.numbers[w] for w in words], np.int32)]
        self.size = len(words)

    def add(self, plain: bytes) -> None:
        codes = np.fromiter(map(self.numbers.__getitem__, plain.replace(b"\n", b" \n ").split(b" ")), np.int32)
        codes = codes[codes != _NOTHING]
        self.parts.append(codes)
        self.size += len(codes)

    def end_text(self) -> None:
        self.parts.append(np.array([_END], np.int32))
        self.size += 1

    def taken(self, ahead: int) -> tuple[np.ndarray, int, list[bytes], np.ndarray]:
        """(codes, how many of them start phrases here, vocabulary, occurrences); the last ``ahead`` codes also start the next chunk."""
        codes = np.concatenate(self.parts)
        words = [w for w, c in self.numbers.items() if c >= 0]
        own = len(codes) - ahead
        times = np.bincount(codes[:own][codes[:own] >= 0], minlength=len(words))
        self.restart([None if c == _END else words[c] for c in codes[own:]])
        return codes, own, words, times


def steps(plain: bytes, size: int = STEP) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes that end where a word ends."""
    at = 0
    while at < len(plain):
        end = at + size
        if end < len(plain):
            found = [x for x in (plain.find(b" ", end), plain.find(b"\n", end)) if x >= 0]
            end = min(found) if found else len(plain)
        yield plain[at:end]
        at = end


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, in four bytes each where that is enough."""
    kind = np.int32 if not len(numbers) or -(1 << 31) <= numbers.min() <= numbers.max() < 1 << 31 else np.int64
    return (b"4" if kind is np.int32 else b"8") + numbers.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if raw[:1] == b"4" else np.int64, offset=1).astype(np.int64)


def _slices(key: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by key, and (key, from, to) of each key in it."""
    order = np.argsort(key, kind="stable")
    if not len(key):
        return order, []
    first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    return order, list(zip(key[order[first]].tolist(), first.tolist(), [*first[1:].tolist(), len(key)], strict=True))


#: A chunk (words null): language, starts, word occurrences, codes; or the words of a chunk that fall in a bucket: their codes,
#: themselves and their occurrences.
_TEXTS = "chunk long, lang string, own int, n long, codes binary, bucket int, code binary, words binary, times binary"


def _chunked(size: int, ahead: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, count()
        buffers: defaultdict[str, _Buffer] = defaultdict(_Buffer)

        def chunk(lang: str, keep: int) -> pa.RecordBatch:
            codes, own, words, times = buffers[lang].taken(keep)
            number = base + next(made)
            bucket = (word_hashes(b"\n".join(words))[1] % np.uint64(buckets)).astype(np.int64)
            order, parts = _slices(bucket)
            ordered = [words[i] for i in order]
            none = [None] * len(parts)
            columns = ([number] * (len(parts) + 1), [lang] * (len(parts) + 1), [own, *none], [int(times.sum()), *none], [_packed(codes), *none],
                       [None, *(p[0] for p in parts)], [None, *(_packed(order[f:e]) for _, f, e in parts)],
                       [None, *(b"\n".join(ordered[f:e]) for _, f, e in parts)], [None, *(_packed(times[order[f:e]]) for _, f, e in parts)])
            types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                              [f.split()[0] for f in _TEXTS.split(", ")])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for part in steps(text.as_py().encode().translate(_PLAIN)):
                    buffers[lang].add(part)
                    if buffers[lang].size >= size + ahead:
                        yield chunk(lang, ahead)
                buffers[lang].end_text()
                if sum(b.size for b in buffers.values()) >= 4 * size:  # many languages at once: the fullest goes
                    fullest = max(buffers, key=lambda x: buffers[x].size)
                    yield chunk(fullest, 0)
                    del buffers[fullest]
        for lang in list(buffers):
            yield chunk(lang, 0)

    return run


# -- words -----------------------------------------------------------------------


def _words_summed(least: int):
    """Buckets in order, each with its rows together: bucket, lang, word, n of the words with at least ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, defaultdict(lambda: defaultdict(int))

        def frequent() -> pa.RecordBatch:
            out = [(now, lang, word.decode(), n) for lang, words in seen.items() for word, n in words.items() if n >= least]
            columns = zip(*out, strict=True) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)],
                                              ["bucket", "lang", "phrase", "occurrences"])

        for batch in batches:
            for bucket, lang, words, times in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lang", "words", "times")), strict=True):
                if bucket != now:
                    if seen:
                        yield frequent()
                        seen.clear()
                    now = bucket
                own = seen[lang]
                for word, n in zip(words.split(b"\n"), _unpacked(times).tolist(), strict=True):
                    own[word] += n
        if seen:
            yield frequent()

    return run


def _words_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets in order, in each first its frequent words with their ids, then the words of chunks: chunk, codes and ids of the frequent ones."""
    now, ids = None, {}
    for batch in batches:
        out = []
        for bucket, chunk, lang, words, code, number in zip(
                *(batch.column(c).to_pylist() for c in ("bucket", "chunk", "lang", "words", "code", "id")), strict=True):
            if bucket != now:
                now, ids = bucket, {}
            if chunk is None:
                ids[lang, words] = number
                continue
            found = [ids.get((lang, w), -1) for w in words.split(b"\n")]
            found = np.array(found, np.int64)
            hit = found >= 0
            if hit.any():
                out.append((chunk, _packed(_unpacked(code)[hit]), _packed(found[hit])))
        columns = zip(*out, strict=True) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                         ["chunk", "code", "known"])


def _words_numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order, in each first the lists of codes and ids, then its own codes: the chunk with ids in place of codes."""
    now, codes, ids = None, [], []
    for batch in batches:
        for chunk, own, code, known, text in zip(*(batch.column(c).to_pylist() for c in ("chunk", "own", "code", "known", "codes")), strict=True):
            if chunk != now:
                now, codes, ids = chunk, [], []
            if text is None:
                codes.append(_unpacked(code)), ids.append(_unpacked(known))
                continue
            text = _unpacked(text)
            number = np.full(int(text.max(initial=-1)) + 2, -1, np.int64)  # the end's code is -1: the last entry, which stays -1
            if codes:
                number[np.concatenate(codes)] = np.concatenate(ids)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([own], pa.int32()), pa.array([_packed(number[text])], pa.binary())],
                                             ["chunk", "own", "ids"])


def _word_chunks(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Chunks of word ids: the parts of their vocabularies meet the frequent words bucket by bucket, what is found returns to the chunk."""
    tasks = partitions(texts.sparkSession)
    parts = texts.where("words is not null").select("bucket", "chunk", "lang", "words", "code", F.lit(None).cast("long").alias("id"))
    known = words.select("bucket", F.lit(None).cast("long").alias("chunk"), "lang", F.encode("phrase", "UTF-8").alias("words"),
                         F.lit(None).cast("binary").alias("code"), "id")
    met = parts.unionByName(known).repartition(tasks, "bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first())
    lists = met.mapInArrow(lean(_words_known), "chunk long, code binary, known binary").select(
        "chunk", F.lit(None).cast("int").alias("own"), "code", "known", F.lit(None).cast("binary").alias("codes"))
    whole = texts.where("words is null").select("chunk", "own", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("binary").alias("known"), "codes")
    both = lists.unionByName(whole).repartition(tasks, "chunk").sortWithinPartitions("chunk", F.col("own").asc_nulls_first())
    return cut(both.mapInArrow(lean(_words_numbered), _CHUNKS))


# -- pairs -----------------------------------------------------------------------


def pair_counts(ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, occurrences) of the neighbouring ids of a chunk; negative ids are gaps.

    Pairs that start at ``own`` or later belong to another chunk: they are
    listed, with 0 occurrences if they do not start here too.
    """
    values, local = np.unique(ids, return_inverse=True)
    gaps = int(np.searchsorted(values, 0))
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    a, b, here = local[at] - gaps, local[at + 1] - gaps, at < own
    values = values[gaps:]
    # local numbers keep the order of the ids: tiles at the start hold the most frequent ones
    side = len(values) // (1 << TILE_BITS) + 1
    tile = (a >> TILE_BITS) * side + (b >> TILE_BITS)
    tiles, of, filled = np.unique(tile, return_inverse=True, return_counts=True)
    dense = filled >= DENSE
    out = []
    for number in np.flatnonzero(dense):
        inside = of == number
        row, column = divmod(int(tiles[number]), side)
        row, column = row << TILE_BITS, column << TILE_BITS
        cell = ((a[inside] - row) << TILE_BITS) + (b[inside] - column)
        cells = 1 << 2 * TILE_BITS
        times = np.bincount(cell[here[inside]], minlength=cells)
        used = np.flatnonzero(np.bincount(cell, minlength=cells))
        out.append(((used >> TILE_BITS) + row, (used & ((1 << TILE_BITS) - 1)) + column, times[used]))
    sparse = ~dense[of]
    key = a[sparse].astype(np.int64) * len(values) + b[sparse]
    order = np.argsort(key)
    key, starts_here = key[order], here[sparse][order]
    if len(key):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out.append((key[first] // len(values), key[first] % len(values), np.add.reduceat(starts_here.astype(np.int64), first)))
    if not out:
        return (np.empty(0, np.int64),) * 3
    x, y, n = (np.concatenate(part) for part in zip(*out, strict=True))
    return values[x], values[y], n


class Lookup:
    """(first, second) -> id for a list of pairs, -1 for all others."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray):
        self.a, x = np.unique(a, return_inverse=True)
        self.b, y = np.unique(b, return_inverse=True)
        key = x * max(1, len(self.b)) + y
        order = np.argsort(key)
        self.key, self.ids = key[order], ids[order]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.key) or not len(a):
            return np.full(len(a), -1, np.int64)
        x, y = (np.minimum(np.searchsorted(side, part), len(side) - 1) for side, part in ((self.a, a), (self.b, b)))
        key = x * len(self.b) + y
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.a[x] == a) & (self.b[y] == b) & (self.key[at] == key), self.ids[at], -1)

    def next_ids(self, ids: np.ndarray) -> np.ndarray:
        """The id of the pair that starts at each place but the last."""
        return self.of(ids[:-1], ids[1:])


_CHUNKS = "chunk long, own int, ids binary"


def _added(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted coordinates, the counts of equal ones added up."""
    if not len(a):
        return a, b, n
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.add.reduceat(n[order], first)


_PAIRS = "bucket long, chunk long, a binary, b binary, n binary"


def _bucketed(buckets: int, all_listed: bool):
    """The pairs of a chunk, packed by a hash of the pair: one row a bucket with its coordinates and counts.

    Unless all are asked for, pairs that start in another chunk are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, n = pair_counts(_unpacked(batch.column("ids")[i].as_py()), batch.column("own")[i].as_py())
                some = slice(None) if all_listed else n > 0
                a, b, n = a[some], b[some], n[some]
                if not len(a):
                    continue
                order, parts = _slices((mixed(mixed(a.astype(np.uint64)) + b.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64))
                packed = [pa.array([_packed(x[order[f:e]]) for _, f, e in parts], pa.binary()) for x in (a, b, n)]
                chunk = pa.array([batch.column("chunk")[i].as_py()] * len(parts), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), chunk, *packed], ["bucket", "chunk", "a", "b", "n"])

    return run


def _summed(least: int):
    """Buckets in order, each with its rows together: the pairs with at least ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def total() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return _added(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def frequent() -> pa.RecordBatch:
            a, b, n = total()
            some = n >= least
            return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (np.full(len(a), now), a, b, n)], ["bucket", "a", "b", "n"])

        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != now and held:
                    yield frequent()
                    held, size = [], 0
                now = bucket
                held.append(tuple(_unpacked(batch.column(c)[i].as_py()) for c in ("a", "b", "n")))
                size += len(held[-1][0])
                if size >= 4 * BUCKET_WORDS and len(held) > 1:  # equal pairs of many chunks are one
                    held = [total()]
                    size = len(held[0][0]) // 2
        if held:
            yield frequent()

    return run


def _frequent_pairs(chunks: DataFrame, least: int, buckets: int) -> DataFrame:
    """bucket, a, b, n of the neighbouring ids with at least ``least`` occurrences in all chunks."""
    packed = chunks.mapInArrow(lean(_bucketed(buckets, False)), _PAIRS).drop("chunk")
    dealt = packed.repartition(partitions(chunks.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lean(_summed(least)), "bucket long, a long, b long, n long")


def _renumbered(known):
    """The chunks with the ids of the pairs in place of those of their parts, by a broadcast lookup."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = known.value.next_ids(_unpacked(batch.column("ids")[i].as_py()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("chunk").slice(i, 1), batch.column("own").slice(i, 1), pa.array([_packed(ids)], pa.binary())], ["chunk", "own", "ids"])

    return run


def _numbers(listed) -> np.ndarray:
    return listed.values.to_numpy(zero_copy_only=False)


def _pairs_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets in order, in each first its frequent pairs, then the packed pairs of chunks: the frequent ones of each chunk with their ids."""
    now, look = None, None
    for batch in batches:
        out = []
        for i, (bucket, chunk) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("chunk").to_pylist(), strict=True)):
            if chunk is None:
                now, look = bucket, Lookup(*(_numbers(batch.column(c)[i]) for c in ("x", "y", "id")))
            elif bucket == now:  # else none of the bucket's pairs is frequent
                a, b = (_unpacked(batch.column(c)[i].as_py()) for c in ("a", "b"))
                found = look.of(a, b)
                hit = found >= 0
                if hit.any():
                    out.append((chunk, _packed(a[hit]), _packed(b[hit]), _packed(found[hit])))
        columns = zip(*out, strict=True) if out else [[]] * 4
        types = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["chunk", "a", "b", "known"])


def _pairs_numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order, in each first its lists of pairs and ids, then its own ids: the chunk with the pairs' ids."""
    now, lists = None, []
    for batch in batches:
        for i, (chunk, own) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("own").to_pylist(), strict=True)):
            if chunk != now:
                now, lists = chunk, []
            if own is None:
                lists.append([_unpacked(batch.column(c)[i].as_py()) for c in ("a", "b", "known")])
                continue
            none = [np.empty(0, np.int64)]
            look = Lookup(*(np.concatenate([*none, *(x[c] for x in lists)]) for c in range(3)))
            ids = look.next_ids(_unpacked(batch.column("ids")[i].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([own], pa.int32()), pa.array([_packed(ids)], pa.binary())],
                                             ["chunk", "own", "ids"])


def _next_level(chunks: DataFrame, pairs: DataFrame, buckets: int, broadcast_bytes: int) -> DataFrame:
    """Chunks of pair ids: ``pairs`` holds bucket, a, b and id of the frequent ones.

    A short list is broadcast; else its pairs meet those of the chunks bucket by
    bucket, and what is found returns to the chunk, as the words do.
    """
    spark, tasks = chunks.sparkSession, partitions(chunks.sparkSession)
    if pairs.count() * PAIR_BYTES <= broadcast_bytes:
        table = pairs.select("a", "b", "id").toArrow()
        known = spark.sparkContext.broadcast(Lookup(*(table.column(c).to_numpy() for c in ("a", "b", "id"))))
        return cut(chunks.mapInArrow(lean(_renumbered(known)), _CHUNKS))
    nothing = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    parts = chunks.mapInArrow(lean(_bucketed(buckets, True)), _PAIRS).select(
        "bucket", "chunk", "a", "b", *nothing("array<long>", "x", "y", "id"))
    lists = pairs.groupBy("bucket").agg(F.collect_list(F.struct("a", "b", "id")).alias("p")).select(
        "bucket", *nothing("long", "chunk"), *nothing("binary", "a", "b"), F.col("p.a").alias("x"), F.col("p.b").alias("y"), F.col("p.id").alias("id"))
    met = parts.unionByName(lists).repartition(tasks, "bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first())
    found = met.mapInArrow(lean(_pairs_known), "chunk long, a binary, b binary, known binary").select(
        "chunk", *nothing("int", "own"), "a", "b", "known", *nothing("binary", "ids"))
    whole = chunks.select("chunk", "own", *nothing("binary", "a", "b", "known"), "ids")
    both = found.unionByName(whole).repartition(tasks, "chunk").sortWithinPartitions("chunk", F.col("own").asc_nulls_first())
    return cut(both.mapInArrow(lean(_pairs_numbered), _CHUNKS))


# -- phrases ---------------------------------------------------------------------


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, chunk: int = CHUNK, broadcast_bytes: int = BROADCAST_BYTES,
            text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """All phrases of one to ``longest`` words with at least ``least`` occurrences, and the words of each language.

    The first frame holds lang, words (how many), id (within that length),
    first and second (ids of the phrase without its last and without its first
    word), phrase, occurrences, and the occurrences of its beginnings (``heads``)
    and ends (``tails``) of 1, 2, .. words, itself included.  The second holds
    lang and n, all word occurrences.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tasks = partitions(docs.sparkSession)
    texts = cut(rows.mapInArrow(lean(_chunked(chunk, longest - 1, min(max(tasks, LEAST_BUCKETS), MOST_BUCKETS))), _TEXTS))
    totals = texts.where("words is null").groupBy("lang").agg(F.sum("n").alias("n"))
    n_words = texts.agg(F.sum("n")).head()[0] or 0
    buckets = 16 + n_words // BUCKET_WORDS
    dealt = texts.where("words is not null").select("bucket", "lang", "words", "times").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    frequent = dealt.mapInArrow(lean(_words_summed(least)), "bucket int, lang string, phrase string, occurrences long")
    numbered = cut(with_row_index(frequent, [F.desc("occurrences"), "lang", "phrase"], name="id"))
    level = numbered.select(
        "lang", F.lit(1).alias("words"), "id", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("second"), "phrase",
        "occurrences", F.array("occurrences").alias("heads"), F.array("occurrences").alias("tails"))
    every, chunks = level, _word_chunks(texts, numbered)
    for words in range(2, longest + 1):
        pairs = cut(with_row_index(_frequent_pairs(chunks, least, buckets), [F.desc("n"), "a", "b"], name="id"))
        if words < longest:
            chunks = _next_level(chunks, pairs, buckets, broadcast_bytes)
        head = level.select("lang", F.col("id").alias("a"), F.col("phrase").alias("start"), "heads")
        tail = level.select(F.col("id").alias("b"), F.substring_index("phrase", " ", -1).alias("end"), "tails")
        level = cut(pairs.join(head, "a").join(tail, "b").select(
            "lang", F.lit(words).alias("words"), "id", F.col("a").alias("first"), F.col("b").alias("second"),
            F.concat_ws(" ", "start", "end").alias("phrase"), F.col("n").alias("occurrences"),
            F.concat("heads", F.array("n")).alias("heads"), F.concat("tails", F.array("n")).alias("tails")))
        every = every.unionByName(level)
    return every, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, reported: int = REPORTED, covered: int = COVERED,
                 chunk: int = CHUNK, broadcast_bytes: int = BROADCAST_BYTES, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is its occurrences over the mean of those of its two
    parts, in millionths, at the cut where that is lowest.  Null texts are
    empty, a null language is ``und``; repeated rows count each; a language
    without frequent phrases has no row; other columns are ignored.
    """
    every, totals = phrases(docs, least, longest, chunk, broadcast_bytes, text_col, lang_col)
    candidates = every.where("words > 1")
    big = lambda c: F.col(c).cast("decimal(20,0)")
    longer = candidates.select((F.col("words") - 1).alias("words"), F.explode(F.array("first", "second")).alias("id"), "occurrences").groupBy(
        "words", "id").agg(F.max("occurrences").alias("longer"))
    # a four-word phrase around a pair has no more occurrences than a three-word phrase between them
    left = candidates.join(longer, ["words", "id"], "left").where(
        F.col("longer").isNull() | (100 * big("longer") < covered * big("occurrences")))
    cuts = F.expr("""array_min(transform(sequence(1, words - 1), k -> named_struct(
        'score', cast(2000000 as decimal(7,0)) * cast(occurrences as decimal(20,0)) div
                 (cast(heads[k - 1] as decimal(20,0)) + cast(tails[words - k - 1] as decimal(20,0))),
        'k', k, 'l', heads[k - 1], 'r', tails[words - k - 1])))""")
    scored = left.select("lang", "phrase", F.col("occurrences").alias("a"), cuts.alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= reported)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
