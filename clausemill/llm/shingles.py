"""Word shingles as 64-bit hashes, for whole batches of texts at once (numpy inside tasks).

A word is a run of bytes other than ASCII white space; A-Z count as a-z. A text with at least width
words has the shingles of width neighbouring words; one with fewer words has its whole sequence as
one shingle; one without words has none. Word hashes are polynomials over the bytes of the word with
one random number per byte value, mixed; shingle hashes are polynomials over the words, mixed.
Different shingles share a hash about once in 2**64 pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

U = np.uint64
_MIX1, _MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outputs look random."""
    x = x ^ (x >> U(30))
    x = x * _MIX1
    x = x ^ (x >> U(27))
    x = x * _MIX2
    return x ^ (x >> U(31))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    values = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
    fold = np.arange(256)
    fold[65:91] += 32
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    values = values[fold]
    values[white] = 0
    return values, white


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.full(size, U(b))) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text)."""
    values, white = _tables()
    joined = b" " + b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    blank = white[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power(len(raw))
    sums = np.cumsum(values[raw] * power[: len(raw)])
    hashes = mix((sums[ends - 1] - sums[starts - 1]) * inverse[starts])
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])
    counts = np.diff(np.searchsorted(starts, begin))
    return hashes, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, number of shingles of each text), repeats included."""
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    if not len(words):
        return np.zeros(0, U), n
    padded = np.concatenate([words, np.zeros(width, U)])
    total = np.zeros(len(words), U)
    for k in range(width):
        total = total * _STEP + padded[k : k + len(words)]
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = U(int(counts[i]))
        for w in words[first[i] : first[i] + counts[i]]:
            own = U((int(own) * int(_STEP) + int(w)) & 0xFFFFFFFFFFFFFFFF)
        total[first[i]] = own
    keep = np.repeat(first - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
    return mix(total[keep]), n


def in_blocks(texts: list[bytes], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of texts with about most bytes each; a longer text is a slice of its own."""
    at = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield slice(at, i)
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield slice(at, len(texts))


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for part in in_blocks(texts):
        hashes, n = shingle_hashes(*word_hashes(texts[part]), width)
        ends = np.cumsum(n)
        for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
            yield np.unique(hashes[a:b])


class Words:
    """The words of a block of texts, with their places.

    hashes, owner (text), starts and ends (characters from the beginning of the text), line and stop
    (whether a word is the first of its line, whether it ends a sentence), of every word; begin (first
    word of each text that has words) and text_end (the word after the last, of each text).
    """

    def __init__(self, texts: list[bytes]):
        self.hashes, counts = word_hashes(texts)
        _, white = _tables()
        raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        blank = white[raw]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        text_at = 1 + np.cumsum(lengths + 1) - lengths - 1
        self.owner = np.repeat(np.arange(len(texts)), counts)
        self.text_end = np.cumsum(counts)
        self.begin = (self.text_end - counts)[counts > 0]
        chars = np.cumsum((raw & 0xC0) != 0x80)  # characters up to each byte, it included
        before = chars[text_at - 1][self.owner] if len(self.owner) else np.zeros(0, np.int64)
        self.starts, self.ends = chars[starts - 1] - before, chars[ends - 1] - before
        breaks = np.cumsum(raw == 10)
        self.line = np.zeros(len(starts), bool)
        self.line[1:] = breaks[starts[1:]] > breaks[ends[:-1] - 1]
        self.line[self.begin] = True
        self.stop = np.isin(raw[ends - 1], np.frombuffer(b".!?", np.uint8))


def window_sums(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the words of each window [first, end): polynomials over word hashes, by prefix sums."""
    power, inverse = _power(len(hashes) + 1)
    out = []
    for seed in (0x2545F4914F6CDD1D, 0xDA942042E4DD58B5):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(hashes ^ U(seed)) * power[: len(hashes)])])
        out.append(mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(U)))
    return out
