"""Token identifiers of whole texts by a public byte-level BPE vocabulary.

The tokenizers library encodes each distinct part of a text once; a text's
identifiers are those of its parts in order.  Parts end where a pre-token must
end: at a single space or line end between other characters, and between an
ASCII letter or digit and the marks that end a word.  Parts are found, and looked
up by 64-bit hash, on the UTF-8 bytes of many texts at once; length and a second
hash of another family must agree too.  Texts among which two parts differ in these
only, a text with any
other white space, and any text under a vocabulary of another kind, are encoded
by the library as they are.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

from .textcore import Chunk, chunks

VOCABULARY, END = "byte_bpe_50k.json", 2
#: Distinct parts that a worker remembers, at some 40 bytes each; and bytes of text at a time.
REMEMBERED, CHUNK = 2_000_000, 1 << 20
_MARKS = np.isin(np.arange(256), list(b".,;:!?"))
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_ODD = np.array([(b < 0x20 and b != 0x0A) or b == 0x7F for b in range(256)])
#: Lead bytes, and the bytes after them, of which some begin white space beyond ASCII.
_WIDE = np.zeros((256, 256), bool)
_WIDE[0xC2, [0x85, 0xA0]] = _WIDE[0xE1, 0x9A] = _WIDE[0xE2, [0x80, 0x81]] = _WIDE[0xE3, 0x80] = True


def _byte_letters() -> list[str]:
    """The vocabulary's letter for each byte: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Parts:
    """Known parts: sorted hashes with their places, in a large and a fresh table, and the identifiers at each place."""

    def __init__(self) -> None:
        self._tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.checks = np.zeros(1 << 14, np.int64)
        self.n = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of ascending hashes, -1 where unknown."""
        out = np.full(len(hashes), -1, np.int64)
        for known, places in self._tables:
            if len(known):
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                hit = known[at] == hashes
                out[hit] = places[at[hit]]
        return out

    def add(self, hashes: np.ndarray, checks: np.ndarray, parts: list[list[int]]) -> None:
        """hashes: ascending, none of them known."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begin, more = (int(self.ends[self.n - 1]) if self.n else 0), int(sizes.sum())
        while begin + more > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(parts) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.checks = np.concatenate([self.checks, np.zeros_like(self.checks)])
        self.ids[begin : begin + more] = np.fromiter(chain.from_iterable(parts), np.uint32, more)
        self.ends[self.n : self.n + len(parts)] = begin + np.cumsum(sizes)
        self.checks[self.n : self.n + len(parts)] = checks
        fresh = self._merged(self._tables[1], (hashes, np.arange(self.n, self.n + len(parts))))
        large = self._tables[0]
        if len(fresh[0]) > max(1 << 15, len(large[0]) // 8):
            large, fresh = self._merged(large, fresh), (fresh[0][:0], fresh[1][:0])
        self._tables = [large, fresh]
        self.n += len(parts)

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")  # two ascending runs: one merge
        return keys[order], np.concatenate([a[1], b[1]])[order]


class Encoder:
    def __init__(self, vocabulary: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self._plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec["model"].get("type") == "BPE"
        self._model = self._tokenizer.model
        self._letters = dict(enumerate(_byte_letters()))
        self._known = _Parts()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[bytes]) -> list[list[int]]:
        """Words of letters go to the model itself; what may be several pre-tokens goes through the whole library."""
        out: list = [None] * len(parts)
        rest = []
        for k, raw in enumerate(parts):
            text = raw.decode()
            if (text[1:] if raw[0] == 0x20 else text).isalpha():
                out[k] = [t.id for t in self._model.tokenize(raw.decode("latin-1").translate(self._letters))]
            else:
                rest.append(k)
        for k, ids in zip(rest, self.whole([parts[k].decode() for k in rest]), strict=True):
            out[k] = ids
        return out

    def _lookup(self, c: Chunk, h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Of each part its number among the distinct ones, and of those the identifiers: flat, with ends. None if parts with one hash differ."""
        code, distinct = pd.factorize(h, sort=True)
        if self._known.n > REMEMBERED:
            self._known = _Parts()
        known, checks = self._known, c.checks(begin, end)
        first = np.zeros(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        at = known.find(distinct)
        old = at >= 0
        if (checks != checks[first][code]).any() or (known.checks[at[old]] != checks[first[old]]).any():
            return None
        lost = np.flatnonzero(~old)
        if len(lost):
            raw, n = c.data.tobytes(), known.n
            known.add(distinct[lost], checks[first[lost]], self._learn([raw[a:z] for a, z in zip(begin[first[lost]].tolist(), end[first[lost]].tolist(), strict=True)]))
            at[lost] = np.arange(n, known.n)
        return code, np.where(at > 0, known.ends[at - 1], 0), known.ends[at]

    def _odd(self, c: Chunk) -> np.ndarray:
        """Texts that have other white space than single spaces and line ends between words."""
        d = c.data
        bad = _ODD[d]
        space = ~c.in_word
        bad[1:] |= space[1:] & space[:-1]
        bad[:-1] |= _WIDE[d[:-1], d[1:]]
        full = np.flatnonzero(np.diff(c.offsets))
        bad[c.offsets[:-1][full]] |= space[c.offsets[:-1][full]]
        bad[c.offsets[1:][full] - 1] |= space[c.offsets[1:][full] - 1]
        return c.per_doc(bad) > 0

    def chunk(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all texts of a chunk, and where each text's begin."""
        odd = self._odd(c) if self._plain else np.ones(c.n, bool)
        words = ~odd[c.doc]
        start, stop, doc = c.starts[words], c.ends[words], c.doc[words]
        inner = start > c.offsets[doc]
        line = inner.copy()
        line[inner] = c.data[start[inner] - 1] == 0x0A
        begin = start - (inner & ~line)
        # a word that ends in marks after a letter or digit is two parts
        core = stop.copy()
        marked = np.flatnonzero(_MARKS[c.data[stop - 1]])
        for _ in range(4):
            core[marked] -= 1
            marked = marked[core[marked] - 1 >= start[marked]]
            marked = marked[_MARKS[c.data[core[marked] - 1]]]
        cut = (core < stop) & (core > start)
        cut[cut] = _ALNUM[c.data[core[cut] - 1]]
        core = np.where(cut, core, stop)
        n, tails = len(start), np.flatnonzero(cut)
        # line ends, cores and tails, three places a word
        a = np.concatenate([begin, core[tails], start[line][:1] - 1])
        z = np.concatenate([core, stop[tails], start[line][:1]])
        if not n:
            flat, sizes = np.zeros(0, np.uint32), np.zeros(c.n, np.int64)
        else:
            found = self._lookup(c, c.hashes(a, z), a, z)
            if found is None:
                raw = c.data.tobytes()
                ids = self.whole([raw[x:y].decode() for x, y in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True)])
                return np.array(list(chain.from_iterable(ids)), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            code, lo, hi = found
            kind = np.full((n, 3), -1, np.int64)
            kind[:, 1] = code[:n]
            kind[tails, 2] = code[n : n + len(tails)]
            if line.any():
                kind[line, 0] = code[-1]
            kind = kind.ravel()
            where = np.flatnonzero(kind >= 0)
            kind = kind[where]
            size = (hi - lo)[kind]
            ends = np.cumsum(size)
            flat = self._known.ids[np.repeat(lo[kind] - ends + size, size) + np.arange(ends[-1])]
            sums = np.concatenate([[0], ends])
            bounds = np.searchsorted(where, 3 * np.searchsorted(doc, np.arange(c.n + 1)))
            sizes = np.diff(sums[bounds])
        if odd.any():
            at = np.flatnonzero(odd)
            raw = c.data.tobytes()
            slow = self.whole([raw[c.offsets[k] : c.offsets[k + 1]].decode() for k in at.tolist()])
            pieces = np.split(flat, np.cumsum(sizes)[:-1])
            for k, ids in zip(at.tolist(), slow, strict=True):
                pieces[k] = np.array(ids, np.uint32)
            sizes = np.array([len(x) for x in pieces])
            flat = np.concatenate(pieces)
        return flat, np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: pa.Array):
        """First row, and each text's identifiers, of slices of a string column. A null text has none."""
        for lo, hi, c in chunks(texts, CHUNK):
            flat, offsets = self.chunk(c)
            yield lo, [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


@lru_cache(2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One a worker process."""
    return Encoder(vocabulary)
