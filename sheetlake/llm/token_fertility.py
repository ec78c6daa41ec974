"""Quality rules by tokeniser fertility, beside a few base rules on words and lines.

Two public vocabularies read every whole text: a byte-level one gives the
characters a token and the entropy of the tokens, a piece vocabulary with byte
fallback the share of characters that it can only spell as bare bytes.  Texts that no vocabulary
fits (encoded blobs, broken encodings, character soup) take many tokens a
character or fall back to bytes; texts that say the same again and again have
little entropy for their length.  What is usual differs by language: rejection
bands are fences around the quartiles of each language and length class, over
all documents that pass the base rules.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.common import cut, join_small, lean, ready

#: Base rules: a text needs this many words; at most this percentage of them may stand in repeated three-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A fence lies this many quartile distances beyond the quartile, and at least a margin (thousandths of the measure).
REACH = 3.0
MARGIN = {"chars_per_token": 150, "byte_share": 20, "entropy": 60}
#: Texts are tokenised in slices of at most this many characters, cut after white space where there is some.
SLICE = 100_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = frozenset("#*$%&|<>")
_MEASURES = ("chars_per_token", "byte_share", "entropy")
_OUT = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "n_tokens long, chars_per_token long, byte_share long, entropy long")


def repeated_words(words: list[str]) -> int:
    """Words that lie in three-word windows which occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    number: defaultdict[str, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pairs, size = ids[:-2] * len(number) + ids[1:-1], len(number) ** 2
    if size * len(number) >= 1 << 63:  # numbers of pairs that occur, to stay exact
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * len(number) + ids[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(windows, twice)
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return len(lines) - len(set(lines))


def slices(text: str, size: int = SLICE) -> list[str]:
    """The text in pieces of at most ``size`` characters, cut after the last white space of a piece if it has some."""
    out, at = [], 0
    while len(text) - at > size:
        end = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size)) + 1
        end = end if end > at else at + size
        out.append(text[at:end])
        at = end
    out.append(text[at:])
    return out


class Vocabularies:
    """The byte-level vocabulary (ranks) and the piece vocabulary with byte fallback.

    Of the second only the alphabet is asked: a character that is no piece is
    spelt as its bytes wherever it stands, so which characters fall back needs
    no segmentation.  White space, of which line feeds are no pieces, is left out.
    """

    def __init__(self, ranks_path: str, pieces_path: str):
        import base64

        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes = tiktoken.Encoding(ranks_path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        alphabet = {p for p in map(pieces.id_to_piece, range(pieces.vocab_size())) if len(p) == 1}
        self.covered = re.compile(f"[{re.escape(''.join(sorted(alphabet)))}\\x09-\\x0D\\x20]+")

    def measured(self, text: str) -> tuple[int, int, int, int]:
        """(tokens, characters a token, share of characters that fall back to bytes, entropy over its maximum), from the second on in thousandths."""
        if not text:
            return 0, 0, 0, 1000
        tokens = np.concatenate([self.bytes.encode_to_numpy(p, disallowed_special=()) for p in slices(text)])
        n = len(tokens)
        times = np.unique(tokens, return_counts=True)[1]
        spread = float(np.log2(n) - (times * np.log2(times)).sum() / n) / float(np.log2(n)) if n > 1 else 1.0
        return n, round(1000 * len(text) / n), round(1000 * len(self.covered.sub("", text)) / len(text)), round(1000 * spread)


_LOADED: dict[tuple[str, str], Vocabularies] = {}


def measured(docs: DataFrame, ranks_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """Counts and token measures of every document (see ``_OUT``); a null text is empty, a null language stays null."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    types = [pa.int64(), pa.string()] + [pa.int64()] * 9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranks_path, pieces_path)
        vocabularies = _LOADED.get(key) or _LOADED.setdefault(key, Vocabularies(*key))
        for batch in batches:
            out = []
            for doc, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                words = _WORD.findall(text)
                out.append((doc, lang, len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)),
                            repeated_lines(text), repeated_words(words), *vocabularies.measured(text)))
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             [f.split()[0] for f in _OUT.split(", ")])

    return rows.mapInArrow(lean(run), _OUT)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bands(measures: DataFrame, reach: float = REACH, margin: dict[str, int] | None = None) -> DataFrame:
    """Per language (null: ``und``) and length class, the lowest and highest accepted value of each measure.

    Every document that passes the base rules counts; documents that agree in
    all measures and in length count once, so that copies of one text do not
    set a band.  Quartiles are exact: measures are whole thousandths, so their
    histogram is bounded.
    """
    margin = margin or MARGIN
    distinct = measures.where(~base_failed()).select(
        *_cell(), "n_words", "word_chars", "n_tokens", *_MEASURES).distinct()
    quartile = {m: F.percentile(m, F.array(F.lit(0.25), F.lit(0.75))).alias(m) for m in _MEASURES}
    cells = distinct.groupBy("band_lang", "band_length").agg(*quartile.values())
    reach_of = {m: F.greatest(reach * (F.col(m)[1] - F.col(m)[0]), F.lit(float(margin[m]))) for m in _MEASURES}
    return cells.select("band_lang", "band_length",
                        *[c for m in _MEASURES for c in ((F.col(m)[0] - reach_of[m]).alias(f"{m}_low"), (F.col(m)[1] + reach_of[m]).alias(f"{m}_high"))])


def _cell() -> list[Column]:
    # a length class spans a factor of four in tokens
    return [F.coalesce("lang", F.lit("und")).alias("band_lang"),
            F.floor(F.log2(F.greatest("n_tokens", F.lit(1)).cast("double")) / 2).cast("int").alias("band_length")]


def judged(docs: DataFrame, ranks_path: str, pieces_path: str, reach: float = REACH, margin: dict[str, int] | None = None,
           id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, measures, base_failed and kept of every document.

    A null text is empty and fails the base rules, as do empty and short ones.
    A document that passes them is kept when all three measures lie in the
    band of its language and length.  Repeated rows are judged alike; an empty
    table gives no rows; other columns are ignored.
    """
    measures = cut(measured(docs, ranks_path, pieces_path, id_col, text_col, lang_col))
    fences = cut(bands(measures, reach, margin))  # a row for each language and length class
    inside = F.lit(True)
    for m in _MEASURES:
        inside = inside & F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
    placed = measures.withColumns({"band_lang": _cell()[0], "band_length": _cell()[1]})
    joined = join_small(placed, fences, ["band_lang", "band_length"], "left", fences.count(), row_bytes=200)
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop(
        "band_lang", "band_length")
