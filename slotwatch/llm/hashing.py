"""Words and shingles of many texts at once, as numpy arrays of 64-bit hashes.

Works on UTF-8 bytes: ``bytes.lower`` changes A-Z alone, and words end at the ASCII white
space that no multi-byte character contains. Texts are taken in slices of ``SLICE``
bytes, so memory stays bounded whatever the batch. One longer text is a slice alone; its words
are hashed by runs of about ``SLICE`` bytes, so it takes some ten bytes a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

SLICE = 1 << 20
LONG_WORD = 1 << 14  # bytes above which a word is hashed as a whole
SHINGLE = 5
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def salts(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants from a seed."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTES = salts(256, 11)
_PLACES = salts(SHINGLE + 1, 12)


def slices(texts: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``SLICE`` bytes with the number of their first text."""
    run: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        if run and size + len(t) > SLICE:
            yield first, run
            run, first, size = [], i, 0
        run.append(t)
        size += len(t)
    if run:
        yield first, run


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, parted by line ends
    start: np.ndarray  # of each word in data
    end: np.ndarray
    doc: np.ndarray  # number of the text that holds the word

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        edge = np.flatnonzero(np.diff(SPACE[data]))
        start, end = edge[0::2] + 1, edge[1::2] + 1
        first = np.cumsum([1, *[len(t) + 1 for t in texts]])  # where each text starts
        return cls(data, start, end, np.searchsorted(first, start, side="right") - 1)

    def hashes(self) -> np.ndarray:
        """One hash a word: the sum of its bytes' constants times powers of an odd base."""
        size = self.end - self.start
        out = np.zeros(len(size), np.uint64)
        long = size > LONG_WORD
        for i in np.flatnonzero(long):
            digest = hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8).digest()
            out[i] = np.frombuffer(digest, np.uint64)[0]
        short = np.flatnonzero(~long)
        run = np.cumsum(size[short]) // SLICE
        for words in np.split(short, np.flatnonzero(np.diff(run)) + 1):
            if len(words):
                out[words] = self._summed(words, size[words])
        return out

    def _summed(self, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        powers = np.full(int(size.max()), 0x9FB21C651E98DF25, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        chars = self.data[np.repeat(self.start[words], size) + place]
        return mixed(np.add.reduceat(_BYTES[chars] * powers[place], at) + size.astype(np.uint64))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle are one, none give none."""
    w = Words.of(texts)
    h = w.hashes()
    bounds = np.searchsorted(w.doc, np.arange(len(texts) + 1))
    if len(h) >= SHINGLE:
        n = len(h) - SHINGLE + 1
        grams = mixed(sum(h[j : n + j] * _PLACES[j] for j in range(SHINGLE)))
    else:
        grams = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            parts = np.append(h[a:b] * _PLACES[: b - a], _PLACES[SHINGLE:] * np.uint64(b - a))
            out.append(mixed(parts.sum(keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
