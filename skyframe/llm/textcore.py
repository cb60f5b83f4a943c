"""Words, lines and their 64-bit hashes for a whole Arrow string column at once.

A word is a run of bytes other than space, tab, LF, VT, FF and CR, that is
``[^\\x20\\x09-\\x0D]+``.  Texts are never decoded: every rule here holds on
UTF-8 bytes because all white space meant is ASCII.  A null text counts as empty.

Hashes are polynomial sums modulo 2**64 over a table of random 64-bit letters,
taken from prefix sums, so the cost of a word does not depend on Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a longer document is taken whole, alone.
CHUNK_BYTES = 1 << 19

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, start: int = 1) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(start, start + n, dtype=_U) * _U(0x9E3779B97F4A7C15))


_LETTERS = seeds(256, 1000)
_BASE = int(seeds(1, 77)[0]) | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    """Of a base modulo 2**64, for the places of one block of bytes."""
    out = np.full(CHUNK_BYTES, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_PRIME = (1 << 31) - 1


def _residues(base: int) -> np.ndarray:
    """Powers modulo the prime, for the places of one block."""
    out = np.ones(CHUNK_BYTES, np.int64)
    size = 1
    while size < CHUNK_BYTES:
        out[size : 2 * size] = out[:size] * pow(base, size, _PRIME) % _PRIME
        size *= 2
    return out


_CHECK_LETTERS = (seeds(256, 3000) % _U(_PRIME)).astype(np.int64)
_CHECK_BASE = int(seeds(1, 78)[0]) % _PRIME
_CHECK_INVERSE = pow(_CHECK_BASE, -1, _PRIME)
_CHECK_UP, _CHECK_DOWN = _residues(_CHECK_BASE), _residues(_CHECK_INVERSE)

#: A longer text is hashed block by block, so these stay as they are.
_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


@dataclass
class Chunk:
    """Some consecutive texts of a batch. offsets: where each begins, and the end of the last."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def in_word(self) -> np.ndarray:
        return ~_SPACE[self.data]

    @cached_property
    def starts(self) -> np.ndarray:
        before = np.empty(len(self.data) + 1, bool)
        before[0] = False
        before[1:] = self.in_word
        before[self.offsets] = False
        return np.flatnonzero(self.in_word & ~before[:-1])

    @cached_property
    def ends(self) -> np.ndarray:
        after = np.empty(len(self.data) + 1, bool)
        after[:-1] = self.in_word
        after[-1] = False
        after[self.offsets] = False
        return np.flatnonzero(self.in_word & ~after[1:]) + 1

    @cached_property
    def doc(self) -> np.ndarray:
        """Of each word, the text it stands in."""
        return np.searchsorted(self.offsets, self.starts, "right") - 1

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Where each text's words begin among all words."""
        return np.searchsorted(self.starts, self.offsets, "left")

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    @cached_property
    def _sums(self) -> np.ndarray:
        out = np.zeros(len(self.data) + 1, _U)
        for lo in range(0, len(self.data), CHUNK_BYTES):
            block = _LETTERS[self.data[lo : lo + CHUNK_BYTES]]
            block *= _UP[: len(block)]
            if lo:
                block *= _U(pow(_BASE, lo, 1 << 64))
            np.cumsum(block, out=out[lo + 1 : lo + 1 + len(block)])
            if lo:
                out[lo + 1 : lo + 1 + len(block)] += out[lo]
        return out

    def _down(self, at: np.ndarray) -> np.ndarray:
        """Inverse powers for places."""
        if len(self.data) <= CHUNK_BYTES:
            return np.append(_DOWN, _U(0))[at] if len(at) and at.max() == CHUNK_BYTES else _DOWN[at]
        far = np.array([pow(_INVERSE, k * CHUNK_BYTES, 1 << 64) for k in range(len(self.data) // CHUNK_BYTES + 1)], _U)
        return _DOWN[at % CHUNK_BYTES] * far[at // CHUNK_BYTES]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the byte ranges [start, end)."""
        return mix64((self._sums[ends] - self._sums[starts]) * self._down(starts) + (ends - starts).astype(_U))

    @cached_property
    def _check_sums(self) -> np.ndarray:
        out = np.zeros(len(self.data) + 1, np.int64)
        for lo in range(0, len(self.data), CHUNK_BYTES):
            block = _CHECK_LETTERS[self.data[lo : lo + CHUNK_BYTES]]
            block *= _CHECK_UP[: len(block)]
            block %= _PRIME
            if lo:
                block = block * pow(_CHECK_BASE, lo, _PRIME) % _PRIME
            np.cumsum(block, out=out[lo + 1 : lo + 1 + len(block)])
            out[lo + 1 : lo + 1 + len(block)] += out[lo]
        return out

    def checks(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the byte ranges, length and a second hash of another family (modulo a prime), for those whose first hashes agree."""
        far = np.array([pow(_CHECK_INVERSE, k * CHUNK_BYTES, _PRIME) for k in range(len(self.data) // CHUNK_BYTES + 1)], np.int64)
        down = _CHECK_DOWN[starts % CHUNK_BYTES] * far[starts // CHUNK_BYTES] % _PRIME
        return (self._check_sums[ends] - self._check_sums[starts]) % _PRIME * down % _PRIME | np.minimum(ends - starts, (1 << 31) - 1) << 31

    @cached_property
    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def grams(self, size: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every run of ``size`` words inside one text."""
        w = self.words if words is None else words
        if len(w) < size:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        m = len(w) - size + 1
        at = np.flatnonzero(self.doc[:m] == self.doc[size - 1 :])
        total = np.zeros(m, _U)
        for k, a in enumerate(seeds(size, 40)):
            total += w[k : k + m] * (a | _U(1))
        return mix64(total[at]), at

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes, and their text: a text of fewer words has one shingle, all its words."""
        h, at = self.grams(size)
        d = self.doc[at]
        short = np.flatnonzero((self.n_words > 0) & (self.n_words < size))
        if len(short):
            first, last = self.word_offsets[short], self.word_offsets[short + 1] - 1
            extra = self.hashes(self.starts[first], self.starts[first])
            for k in range(size - 1):
                at = np.minimum(first + k, last)
                extra = np.where(first + k <= last, mix64(extra * _U(0x9E3779B97F4A7C15) + self.words[at]), extra)
            h, d = np.concatenate([h, extra]), np.concatenate([d, short])
            order = np.argsort(d, kind="stable")
            h, d = h[order], d[order]
        return h, d

    def per_doc(self, at_bytes: np.ndarray) -> np.ndarray:
        """How many of the marked bytes each text has."""
        sums = np.zeros(len(at_bytes) + 1, np.int64)
        np.cumsum(at_bytes, out=sums[1:])
        return np.diff(sums[self.offsets])


def chunks(texts: pa.Array, limit: int = 0) -> Iterator[tuple[int, int, Chunk]]:
    """Ranges of rows of about ``limit`` bytes of text, with their bytes."""
    limit = limit or CHUNK_BYTES
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    _, where, what = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, Chunk(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
