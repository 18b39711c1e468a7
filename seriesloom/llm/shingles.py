"""Hashes of runs of words, for a whole Arrow batch of texts at once.

A word is a maximal run of characters other than ASCII white space (space, tab to carriage
return) of the lower-cased text. A run of words is hashed as the bytes from its first word to
its last, with one space between words: the value is a polynomial over 2**64 of a fixed
random number per byte, so any run is the difference of two prefix sums, and is then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = (9, 10, 11, 12, 13, 32)
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every bit of its input over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class WordRuns:
    """The words of a batch of texts and the hashes of runs of them."""

    def __init__(self, texts: pa.Array):
        """``texts`` is a string array; null counts as empty."""
        texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        _, offsets, data = texts.buffers()
        self.n = len(texts)
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        inner = ~_IS_SPACE[raw]
        # A word starts where the byte before is a space or belongs to the text before.
        before = np.empty_like(inner)
        before[1:] = inner[:-1]
        starts_of_texts = at[:-1][at[:-1] < len(raw)]
        before[starts_of_texts] = False
        starts = np.flatnonzero(inner & ~before)
        after = np.empty_like(inner)
        after[:-1] = inner[1:]
        ends_of_texts = at[1:][at[1:] > 0] - 1
        after[ends_of_texts] = False
        ends = np.flatnonzero(inner & ~after)
        self.first = np.searchsorted(starts, at)  # words of text i: first[i] to first[i + 1]
        lengths = ends - starts + 1
        # The words one after the other, each with one space behind it.
        place = np.concatenate([[0], np.cumsum(lengths + 1)])
        packed = np.full(place[-1], 32, np.uint8)
        keep = raw[inner]
        spot = np.ones(place[-1], bool)
        spot[place[1:] - 1] = False
        packed[spot] = keep
        prefix = np.zeros(len(packed) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[packed] * _powers(len(packed), BASE), out=prefix[1:])
        self._begin, self._end = prefix[place[:-1]], prefix[place[1:] - 1] if len(starts) else prefix[:0]
        # Dividing by the power of the place makes equal runs equal wherever they stand.
        self._shift = _powers(len(packed), BASE_INVERSE)[place[:-1]]

    def runs(self, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words, and for each text where its runs begin.

        With ``short`` a text of fewer words, but at least one, gives one run of all of them.
        """
        words = np.diff(self.first)
        counts = np.maximum(words - size + 1, 0)
        spans = np.full(len(counts), size)
        if short:
            few = (words > 0) & (words < size)
            counts[few], spans[few] = 1, words[few]
        edges = np.concatenate([[0], np.cumsum(counts)])
        begin = np.repeat(self.first[:-1] - edges[:-1], counts) + np.arange(edges[-1])
        end = begin + np.repeat(spans, counts) - 1
        return mix((self._end[end] - self._begin[begin]) * self._shift[begin]), edges


def distinct(hashes: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each text."""
    return [np.unique(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:])]


def chunks(texts: pa.Array, most_bytes: int = _CHUNK_BYTES):
    """Cut an array of texts into slices of at most ``most_bytes`` (one text may be longer)."""
    texts = texts.cast(pa.large_string())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most_bytes, side="right")) - 1)
        yield a, texts.slice(a, b - a)
        a = b
