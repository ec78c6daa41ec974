"""64-bit hashes of word shingles, for batches of whole texts, with numpy."""

from __future__ import annotations

import numpy as np

#: Bytes of a long text whose words are hashed at a time.
_STEP = 1 << 20
_rng = np.random.Generator(np.random.Philox(key=2_718_281_828))
#: Random values of a word's place in a shingle.
_PLACE = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _word_hashes(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = ends - starts
    # the sum of a random value for each byte at its place in the word: no byte's value depends on another's
    behind = np.cumsum(sizes)
    letters = data[~space]
    place = np.arange(len(letters)) - np.repeat(behind - sizes, sizes)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(((place.astype(np.uint64) << np.uint64(8)) | letters) * _ODD + _ODD))])
    return starts, mixed(total[behind] - total[behind - sizes] + sizes.astype(np.uint64) * _ODD)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of a text, a word being a run of anything but ASCII white space."""
    data = np.frombuffer(text, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    if len(data) <= _STEP:
        return _word_hashes(data, space)
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + _STEP, len(data))
        if end < len(data):  # on to the end of the word
            stop = np.flatnonzero(space[end:])
            end = end + int(stop[0]) if len(stop) else len(data)
        s, h = _word_hashes(data[at:end], space[at:end])
        starts.append(s + at), hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of each text, A-Z in lower case.

    A text of fewer words has its whole word sequence as one shingle; a text
    without words (or null) has none.
    """
    out: list[np.ndarray] = []
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= _STEP // 4):
            size += len(raw[end]) + 1
            end += 1
        starts, words = word_hashes(b"\n".join(raw[at:end]))
        bounds = np.cumsum([0] + [len(r) + 1 for r in raw[at:end]])
        first = np.searchsorted(starts, bounds)
        n = max(0, len(words) - k + 1)
        rolled = np.zeros(n, np.uint64)
        for i in range(k):
            rolled += words[i : i + n] * _PLACE[i]
        rolled = mixed(rolled)
        for i in range(end - at):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= k:
                out.append(np.unique(rolled[lo : hi - k + 1]))
            elif hi > lo:
                short = words[lo:hi] * _PLACE[: hi - lo]
                out.append(mixed(short.sum(dtype=np.uint64, keepdims=True) + _PLACE[15:] * np.uint64(hi - lo)))
            else:
                out.append(np.empty(0, np.uint64))
        at = end
    return out
