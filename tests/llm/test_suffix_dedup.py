"""Linear grouping against sorting, anchors, and removal against every window of the corpus."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sheetlake.llm import suffix_dedup as D
from sheetlake.llm.suffix_array import suffix_array


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(1500):
        text = [rng.randrange(rng.randrange(1, 5)) for _ in range(rng.randrange(45))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(texts, length=D.LENGTH):
    windows = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if windows[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(80), prose(120)
    texts = [prose(60) + passage[: 150 + 15 * i] + prose(50) for i in range(12)]
    texts += [passage[i * 9 : i * 9 + 230] for i in range(6)] + [other, other, other[:199], other[1:], "x" + other]
    texts += [prose(300), "ab" * 300, "ab" * 301, "z" * 199, "z" * 200, "y" * 201, "und " * 90 + prose(20), prose(20) + "und " * 90]
    texts += [other[:250] + prose(5) + other[:250], "\0" * 230, prose(30) + "\0" * 200, "\0" * 100 + other[:220], "", "short"]
    return texts


@pytest.mark.parametrize(("batch", "group", "step"), [(2048, 2048, 4 << 20), (3, 2048, 300), (50, 2, 4 << 20), (4, 5, 4 << 20)])
def test_against_every_window(spark, monkeypatch, batch, group, step):
    monkeypatch.setattr(D, "GROUP", group)
    monkeypatch.setattr(D, "BATCH", batch)
    monkeypatch.setattr(D, "_STEP", step)
    texts = corpus()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.deduplicated(frame).collect()}
    assert [got[i] for i in range(len(texts))] == brute([t.encode() for t in texts])


def test_long_texts_have_the_same_anchors(monkeypatch):
    rng = random.Random(3)
    text = bytes(rng.randrange(97, 103) for _ in range(9000))
    whole = D.anchors(text)
    monkeypatch.setattr(D, "_STEP", 700)
    for a, b in zip(whole, D.anchors(text), strict=True):
        assert a.tolist() == b.tolist()


def test_odd_rows(odd_documents, no_documents):
    out = D.deduplicated(odd_documents)
    rows = out.collect()
    assert len(rows) == odd_documents.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_removed == by[1].n_bytes > 0 and by[11].n_removed == by[11].n_bytes and by[2].n_bytes == 0
    assert by[8].n_removed == 70_000 and by[9].n_spans == 1 and by[6].n_removed == 0
    assert D.deduplicated(no_documents).isEmpty()


def test_hashes_tell_structured_words_apart():
    """Words that a polynomial modulo a power of two cannot tell apart."""
    word = b"a"
    for _ in range(11):
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    other = word.translate(bytes.maketrans(b"ab", b"ba"))
    at = np.array([0]), np.array([len(word)])
    assert D.Hashes(word).of(*at) != D.Hashes(other).of(*at)
    rng = random.Random(6)
    text = bytes(rng.randrange(256) for _ in range(5000)) * 2
    first = np.arange(0, 4900)
    assert (D.Hashes(text).of(first, first + 64) == D.Hashes(text).of(first + 5000, first + 5064)).all()
    assert len(np.unique(D.Hashes(text).of(first, first + 64))) == len(first)
    x = np.array([0, 1, D._PRIME - 1, D._PRIME, D._PRIME + 1, 2**62 - 1], np.int64)
    assert D._reduced(x).tolist() == [int(v) % D._PRIME for v in x]


def test_hot_anchor(spark):
    """Many texts around one string: its contexts are split by what lies beside it, and nothing is lost."""
    rng = random.Random(7)
    letters = "abcdefgh"
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    core, sides = noise(64), [noise(70) for _ in range(4)]
    texts = [noise(140) + core + noise(140) for _ in range(60)]
    texts += [noise(100) + rng.choice(sides) + core + rng.choice(sides) + noise(100) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    contexts = spark.createDataFrame(
        [(5, i, t[max(0, t.index(core) - 136) : t.index(core)].encode(), t[t.index(core) : t.index(core) + 200].encode()) for i, t in enumerate(texts)],
        "gram long, context long, left binary, right binary")
    covered = lambda spans: {b for s in spans for b in range(s["from"], s["to"])}
    whole, split = ({r.context: covered(r.spans) for r in D.resolved(contexts, g).collect()} for g in (10_000, 7))
    assert whole == split and len(whole) > 20
    assert D._is_scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")) and not D._is_scan(frame)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.deduplicated(frame).collect()}
    assert [got[i] for i in range(len(texts))] == brute([t.encode() for t in texts])
