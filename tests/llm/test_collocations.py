"""Phrases against plain counting, with chunks and tiles of any size, odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from sheetlake.llm import collocations as C


def brute(rows: list[tuple], least: int, reported: int) -> set[tuple]:
    out = set()
    for lang in {("und" if x is None else x) for _, x in rows}:
        f: Counter = Counter()
        for text, x in rows:
            if ("und" if x is None else x) != lang:
                continue
            plain = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain):
                words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
                f.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
        n = sum(c for w, c in f.items() if len(w) == 1)
        found = [w for w, c in f.items() if c >= least and len(w) > 1]
        longest: dict = {}
        for w in found:
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    longest[w[i : i + k]] = max(longest.get(w[i : i + k], 0), f[w])
        scored = []
        for w in found:
            if 100 * longest.get(w, 0) >= 80 * f[w]:
                continue
            cuts = [(int(Fraction(2_000_000 * f[w], f[w[:k]] + f[w[k:]])), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored.append((-score, -f[w], " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        out |= {(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:reported], 1)}
    return out


def texts(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "city", "ice", "cream", "É", "\U0001f600x", "a-b", "\x00z", "l'eau"] + [f"w{i}" for i in range(30)]
    rows: list[tuple] = [(None, "en"), ("", "en"), (" \t ", None), ("...", "de"), ("one", "fr")]
    for _ in range(150):
        out = []
        for _ in range(rng.randrange(1, 60)):
            out.append(rng.choice(["New York city", "ice\tcream", "the  of", *words]) + rng.choice(["", "", "", ",", ".", "\n", "\x0b", "! "]))
        rows.append((" ".join(out), rng.choice(["en", "en", "de", None])))
    return rows + [("New York " * 400, "en")] * 2


@pytest.mark.parametrize("chunk,dense,broadcast", [(1 << 19, 1 << 14, 64 << 20), (50, 4, 0), (7, 1 << 14, 64 << 20)])
def test_phrases_against_counting(spark, monkeypatch, chunk, dense, broadcast):
    monkeypatch.setattr(C, "DENSE", dense)
    rows = texts()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, words int, phrase string").repartition(3)
    got = C.collocations(frame, least=8, reported=60, chunk=chunk, broadcast_bytes=broadcast)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == brute(rows, 8, 60)


def test_long_text_in_steps(spark, monkeypatch):
    monkeypatch.setattr(C, "STEP", 64)
    plain = b"aa bb\ncc " * 100 + b"x" * 300 + b" yy"
    assert b"".join(C.steps(plain, 64)) == plain and len(list(C.steps(plain, 64))) > 5
    assert all(p[:1] in (b" ", b"\n") for p in list(C.steps(plain, 64))[1:])
    rows = [("Aa bb. cc dd " * 700, "en")]
    got = C.collocations(spark.createDataFrame(rows, "text string, lang string"), least=5, chunk=100)
    assert {tuple(r) for r in got.collect()} == brute(rows, 5, 2000)


def test_lookup():
    rng = np.random.default_rng(2)
    a, b = np.divmod(rng.choice(400, 60, replace=False), 20)
    look = C.Lookup(a * 10**12, b - 0, np.arange(60))
    known = dict(zip(zip((a * 10**12).tolist(), b.tolist(), strict=True), range(60), strict=True))
    ids = rng.choice(np.concatenate([a * 10**12, b, [-1]]), 500)
    assert look.next_ids(ids).tolist() == [known.get(p, -1) for p in zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True)]
    assert C.Lookup(*(np.empty(0, np.int64),) * 3).next_ids(ids).tolist() == [-1] * 499


def test_scores_are_exact(spark):
    """Counts whose products pass 64 bits, through the same expressions."""
    rows = spark.createDataFrame([(2, 9_000_000_000_000_000, [9_000_000_000_000_001, 9_000_000_000_000_000], [9_000_000_000_000_002, 9_000_000_000_000_000])],
                                 "words int, occurrences long, heads array<long>, tails array<long>")
    score = rows.selectExpr("cast(2000000 as decimal(7,0)) * cast(occurrences as decimal(20,0)) div "
                            "(cast(heads[0] as decimal(20,0)) + cast(tails[0] as decimal(20,0))) AS s").head().s
    assert score == 2_000_000 * 9_000_000_000_000_000 // (9_000_000_000_000_001 + 9_000_000_000_000_002)


def test_odd_rows(spark, odd_documents, no_documents):
    assert C.collocations(no_documents).isEmpty()
    rows = [(r.text, r.lang) for r in odd_documents.collect()]
    assert {tuple(r) for r in C.collocations(odd_documents).collect()} == brute(rows, 30, 2000)
