"""The join against all pairs, and the components against a search."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from sheetlake.llm import jaccard_join as J
from sheetlake.llm.components import components


def brute(rows, k, t):
    """doc -> (set size, smallest reachable id), over all pairs."""
    sets, near = [], defaultdict(set)
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= t * (len(a) + len(sets[j]) - both):
                near[i].add(j)
                near[j].add(i)
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10_000)}"
    return " ".join(words)


@pytest.mark.parametrize(("k", "t", "short"), [(3, 90, 32), (3, 90, 2), (5, 80, 3)])
def test_against_all_pairs(spark, monkeypatch, k, t, short):
    rng = random.Random(k)
    monkeypatch.setattr(J, "SHORT", short)
    texts = []
    for size in (4, 9, 30, 150):
        base = [f"b{rng.randrange(60)}" for _ in range(size)]
        texts += [edited(rng, base, rng.randrange(0, 1 + size // 25)) for _ in range(25)]
        texts += [" ".join(base[: rng.randrange(1, size + 1)]) for _ in range(8)] + [" ".join(base).upper()]
    texts += [None, "", " \n ", "one", "One", "one two", "ONE\ttwo", " ", "É é", "é É"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (7, texts[30]), (7, texts[30])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.linked(frame, k, t).collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=key) == sorted(brute(rows, k, t), key=key)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(900, i) for i in range(901, 990)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(len(edges)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: m for n, m in label.items() if n != m}


def test_representatives_and_odd_rows(odd_documents, no_documents):
    rows = J.linked(odd_documents)
    assert rows.count() == odd_documents.count()
    out = J.representatives(odd_documents)
    assert out.columns == odd_documents.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(1) == 1 and 11 not in ids and ids.count(10) == 2 and {2, 3, 4, 5, 6, 8} <= set(ids) and 9 not in ids
    assert J.linked(no_documents).isEmpty() and J.representatives(no_documents).isEmpty()


def test_structured_words_are_told_apart(spark):
    """Two words without an equal letter at any place, in a pattern that some hashes cannot tell apart."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word + " " + word), (4, word)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 1)}


def test_word_hashes_do_not_depend_on_the_place():
    from sheetlake.llm import shingles

    rng = random.Random(9)
    words = ["".join(rng.choice("abc\u00e9") for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    text = (" \t\n".join(words) + " ").encode()
    starts, hashes = shingles.word_hashes(text)
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))
    alone = [int(shingles.word_hashes(w.encode())[1][0]) for w in words]
    assert alone == hashes.tolist()
    old, shingles._STEP = shingles._STEP, 500
    try:
        again = shingles.word_hashes(text)
    finally:
        shingles._STEP = old
    assert again[0].tolist() == starts.tolist() and again[1].tolist() == hashes.tolist()


def test_components_of_stars_need_no_round_and_others_end_with_the_round_that_makes_them(spark, monkeypatch):
    from sheetlake.llm import components as module

    written, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda frame: written.append(cut(frame)) or written[-1])

    def labels(edges):
        written.clear()
        found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        return found, len(written)

    stars = [(1, 5), (6, 1), (1, 1), (5, 1), (2, 9)]
    assert labels(stars) == ({5: 1, 6: 1, 9: 2}, 1)
    assert labels([(7, 7)]) == ({}, 1)
    found, n = labels([(1, 2), (2, 3), (4, 3), (8, 9)])
    assert found == {2: 1, 3: 1, 4: 1, 9: 8} and n == 3


def test_labels_meet_classes_and_not_the_postings_of_long_lists(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"b{i}" for i in range(300)]
    rows = list(enumerate(edited(rng, base, rng.randrange(1, 5)) for _ in range(80)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    met, join = [], type(frame).join

    def counted(self, other, on=None, how=None):
        if isinstance(on, str) and on == "cid" and how == "left":
            met.append(self.count())
        return join(self, other, on, how)

    monkeypatch.setattr(type(frame), "join", counted)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.linked(frame, 5, 80).collect())
    assert got == sorted(brute(rows, 5, 80))
    assert len(met) > 1 and max(met) <= len(rows)


def test_the_driver_is_released_before_the_join_begins_after_its_profiles_and_before_what_stays_is_decided(spark, monkeypatch):
    seen = []
    for name in ("release_driver", "frequencies", "profiles", "whole_sets", "join_small"):
        kept = getattr(J, name)
        monkeypatch.setattr(J, name, lambda *a, name=name, kept=kept, **b: seen.append(name) or kept(*a, **b))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in J.representatives(docs).collect()) == [1, 3]
    assert seen[:4] == ["release_driver", "frequencies", "profiles", "release_driver"] and seen[4:].count("release_driver") >= 2
    assert seen[len(seen) - seen[::-1].index("release_driver") :] == ["join_small"]
