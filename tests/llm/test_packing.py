"""Bin completion against exhaustive search, and packed sequences against the tokenizer."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from sheetlake.llm import packing as P
from sheetlake.llm.queries import tokenizer_path


def fewest(sizes, length):
    """The optimum by trying every bin for every piece."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= sizes[i]:
                rest = list(bins)
                rest[rest.index(room)] -= sizes[i]
                put(i + 1, rest)
        put(i + 1, [*bins, length - sizes[i]])

    put(0, [])
    return best[0]


def counted(sizes, length):
    return np.bincount(sizes, minlength=length + 1)


def test_completion_is_optimal_on_small_cases():
    rng = random.Random(4)
    better = 0
    for _ in range(120):
        length = rng.choice([20, 37, 60])
        sizes = [rng.randrange(1, length + 1) for _ in range(rng.randrange(1, 12))]
        found = P.completed(counted(sizes, length), length)
        assert sorted(x for used, times in found for x in used * times) == sorted(sizes)
        assert all(sum(used) <= length for used, _ in found)
        n = sum(t for _, t in found)
        assert n == fewest(sizes, length)
        better += n < sum(t for _, t in P.best_fit(counted(sizes, length), length))
    found = P.completed(counted([12, 11, 11, 7, 7, 6, 6] + [4] * 5, 20), 20)
    assert sum(t for _, t in found) == fewest([12, 11, 11, 7, 7, 6, 6] + [4] * 5, 20)


def test_fillings_are_undominated():
    have = counted([5, 4, 3, 2, 2, 1], 20)
    assert P.fillings(have, 5) == [(5,)]
    for used in P.fillings(have, 7):
        left = have.copy()
        for x in used:
            left[x] -= 1
        assert sum(used) == 7 and (left >= 0).all()
    assert P.fillings(counted([9], 20), 5) == [()]


def test_large_histograms_meet_the_bound():
    rng = np.random.default_rng(5)
    have = np.bincount(np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, 2048), minlength=2049)
    n = sum(t for _, t in P.completed(have, 2048))
    assert n <= -(-int((have * np.arange(2049)).sum()) // 2048) + 2


def test_cut_points():
    assert P.cut_points(1, 10) == [(0, 1)] and P.cut_points(10, 10) == [(0, 10)]
    assert P.cut_points(11, 10) == [(0, 1), (1, 10)] and P.cut_points(30, 10) == [(0, 10), (10, 10), (20, 10)]


@pytest.mark.parametrize("frame", ["documents", "odd_documents"])
def test_sequences(frame, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(frame).select("doc_id", "text")
    whole = Tokenizer.from_file(tokenizer_path().removesuffix(".tiktoken") + ".json")
    rows = P.packed(docs, tokenizer_path()).toPandas()
    want = []
    for doc, text in docs.collect():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(P.cut_points(len(ids), 2048))]
    got = [(None if d != d else int(d), *map(int, r)) for d, *r in
           rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for _, one in rows.sort_values("offset").groupby("sequence_id"):
        assert one["offset"].tolist() == [0, *np.cumsum(one["length"])[:-1]] and one["length"].sum() <= 2048


def test_special_tokens_and_ranks_agree(no_documents):
    path = tokenizer_path()
    texts = ["a <|endoftext|> b", "It's 3.5 — naïve\n\n  x", "   ", "日本語 \U0001f600", "\x00\x01", "  leading", "a" * 500]
    assert P.encoder(path)(texts) == P.encoder(path.removesuffix(".tiktoken") + ".json")(texts)
    assert P.packed(no_documents, path).isEmpty()
