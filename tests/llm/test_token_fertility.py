"""Base counts, token measures and bands against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from sheetlake.llm import token_fertility as T
from sheetlake.llm.queries import PIECES, tokenizer_path

PATHS = (tokenizer_path(), tokenizer_path(PIECES))


def base(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def fences(rows: list) -> dict:
    """Bands by numpy over the rows of ``measured``."""
    cells: dict = {}
    for r in rows:
        if not (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words):
            key = (r.lang or "und", int(math.log2(max(r.n_tokens, 1)) // 2))
            cells.setdefault(key, set()).add((r.n_words, r.word_chars, r.n_tokens, r.chars_per_token, r.byte_share, r.entropy))
    out = {}
    for key, found in cells.items():
        values = np.array(sorted(found))[:, 3:]
        low, high = np.quantile(values, 0.25, axis=0), np.quantile(values, 0.75, axis=0)
        reach = np.maximum(3 * (high - low), [T.MARGIN[m] for m in ("chars_per_token", "byte_share", "entropy")])
        out[key] = (low - reach, high + reach)
    return out


def test_base_columns(spark, odd_documents, documents):
    for frame in (odd_documents, documents):
        rows = frame.collect()
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                      for r in T.judged(frame, *PATHS).collect())
        assert got == Counter((r.doc_id, *base(r.text)) for r in rows)


def test_bands_and_verdicts(spark, documents):
    measures = T.measured(documents, *PATHS).collect()
    bands = fences(measures)
    got = T.judged(documents, *PATHS).collect()
    assert len(got) == documents.count()
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed
        low, high = bands.get((r.lang or "und", int(math.log2(max(r.n_tokens, 1)) // 2)), (None, None))
        values = np.array([r.chars_per_token, r.byte_share, r.entropy])
        assert r.kept == (not failed and bool(((values >= low) & (values <= high)).all()))


def test_measures_of_known_texts():
    v = T.Vocabularies(*PATHS)
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    for text in ("plain", "\u6f22\u5b57 \u4eee\u540d", "\uff21\u00c5\ufb01 e\u0301", "\x00\x07 bell", "\U0001f600\U00012345 \u2028"):  # as many bytes as the segmentation spells
        left = v.covered.sub("", text)
        assert sum(pieces.is_byte(i) for i in pieces.encode(text)) == len(left.encode()), text
    n, chars, share, spread = v.measured("the cat sat on the mat and the dog sat on the rug")
    assert n == len(v.bytes.encode_ordinary("the cat sat on the mat and the dog sat on the rug")) and chars > 3000 and share == 0 and 500 < spread < 1000
    assert v.measured("") == (0, 0, 0, 1000) and v.measured("x" * 300_000)[0] > 0
    assert v.measured("\U00012345\U00012346" * 50)[2] > 800  # no piece for these: bytes
    assert v.measured("same words here " * 300)[3] < 300
    parts = T.slices("ab " * 100_000)
    assert "".join(parts) == "ab " * 100_000 and all(len(p) <= T.SLICE and p.endswith(" ") for p in parts[:-1]) and len(T.slices("y" * 250_000)) == 3


def test_blobs_and_broken_encodings_are_rejected(spark):
    """Texts that no vocabulary fits among clean documents of their language and length."""
    rng = np.random.default_rng(4)
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").orderBy("doc_id")
    clean = [r.text for r in more.collect() if base(r.text)[0] > 100]
    rows = [(i, t, "en") for i, t in enumerate(clean)]
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    for i in range(5):
        rows.append((1000 + i, " ".join("".join(rng.choice(letters, 40)) for _ in range(120)), "en"))
        rows.append((2000 + i, " ".join("".join(chr(c) for c in rng.integers(0x12000, 0x12300, 6)) for _ in range(120)), "en"))
    kept = {r.doc_id: r.kept for r in T.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), *PATHS).collect()}
    assert not any(kept[d] for d in kept if d >= 1000) and np.mean([kept[d] for d in kept if d < 1000]) > 0.8


def test_copies_do_not_set_the_band(spark, documents):
    clean = [r.text for r in documents.where("lang = 'en'").collect() if base(r.text)[0] > 100]
    one = T.bands(T.measured(spark.createDataFrame([(t, "en", 1) for t in clean], "text string, lang string, doc_id long"), *PATHS))
    many = T.bands(T.measured(spark.createDataFrame([(t, "en", 1) for t in clean + clean[:1] * 500], "text string, lang string, doc_id long"), *PATHS))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_empty(no_documents):
    assert T.judged(no_documents, *PATHS).isEmpty()


@pytest.mark.parametrize("words,want", [([], 0), (["a"] * 3, 0), (["a"] * 4, 4), (list("abcabc"), 6), (list("abcdabc"), 6), (list("abcxabd"), 0)])
def test_repeated_words(words, want):
    assert T.repeated_words(words) == want
