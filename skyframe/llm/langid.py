"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile is the ``size`` most frequent letter n-grams (1 to 3 letters, words
padded by a blank on each side) of a language, in order of frequency.  A
document's own most frequent n-grams are looked up in each profile; an n-gram's
distance is how many ranks it is out of place, or ``size`` if the profile lacks
it.  The language with the least sum wins, the first by code point on a tie.

Learning: counts over at most about ``bound`` labelled texts a language (a
documented parameter; the choice depends on the identifier only).  Scoring reads
every whole text.  Null texts and texts without a letter are ``und`` with score
0.  Score: 1 minus the distance over the greatest possible distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import folds

UNDETERMINED = "und"
PROFILE, BOUND = 300, 2000
_BITS, _BLANK = 21, 0x20
#: Characters counted at a time.
PART = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    """Of each code point: itself if it is a letter, else a blank."""
    out = np.full(0x110000, _BLANK, np.int64)
    at = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    out[at] = at
    return out


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, packed into integers, and their counts; none if it has no letter.

    A very long text is counted in parts that end between words.
    """
    if not text or len(text) <= PART:
        return _grams(text)
    found, lo = [], 0
    while lo < len(text):
        hi = min(lo + PART, len(text))
        while hi < len(text) and text[hi].isalpha():
            hi += 1
        found.append(_grams(text[lo:hi]))
        lo = hi
    packed, inverse = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return packed, np.bincount(inverse, np.concatenate([n for _, n in found]), len(packed)).astype(np.int64)


def _grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    if not text:
        return none, none
    code = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    code = np.concatenate([[_BLANK], code, [_BLANK]])
    code = code[np.concatenate([[True], (code[1:] != _BLANK) | (code[:-1] != _BLANK)])]
    if len(code) < 3:
        return none, none
    one = code[code != _BLANK]
    two = code[:-1] | code[1:] << _BITS
    three = (code[:-2] | code[1:-1] << _BITS | code[2:] << 2 * _BITS)[code[1:-1] != _BLANK]
    packed = np.sort(np.concatenate([one, two, three]))
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    return packed[first], np.diff(np.append(first, len(packed)))


def ranked(packed: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, the smaller code first among equals."""
    if len(counts) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        packed, counts = packed[keep], counts[keep]
    return packed[np.lexsort((packed, -counts))[:size]]


def learn(labelled: DataFrame, size: int = PROFILE, bound: int = BOUND) -> dict[str, list[int]]:
    """Profiles from rows of doc_id, text and lang. n-gram counts are summed on the executors; ``size`` a language come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, int]] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                own = sums.setdefault(lang, {})
                for g, n in zip(*(x.tolist() for x in grams(text)), strict=True):
                    own[g] = own.get(g, 0) + n
        for lang, own in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(own), pa.string()), "gram": pa.array(own.keys(), pa.int64()), "n": pa.array(own.values(), pa.int64())})

    rows = labelled.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    chosen = folds.bounded_sample(rows, "doc_id", bound, "lang").select("text", "lang")
    sums = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("place", place).where(F.col("place") <= size).orderBy("lang", "place")
    out: dict[str, list[int]] = {}
    for r in top.collect():  # ``size`` rows a language
        out.setdefault(r.lang, []).append(r.gram)
    return out


def _judge(profiles: dict[str, list[int]], size: int) -> Callable[[str | None], tuple[str, float]]:
    langs = sorted(profiles)
    known = np.array(sorted({g for x in profiles.values() for g in x}), np.int64)
    place = np.full((len(langs), len(known) + 1), -1, np.int64)
    for k, lang in enumerate(langs):
        place[k, np.searchsorted(known, profiles[lang])] = np.arange(len(profiles[lang]))

    def judge(text: str | None) -> tuple[str, float]:
        own = ranked(*grams(text), size)
        if not len(own) or not len(known):
            return UNDETERMINED, 0.0
        at = np.searchsorted(known, own)
        at[known[np.minimum(at, len(known) - 1)] != own] = len(known)
        ranks = place[:, at]
        distance = np.where(ranks < 0, size, np.abs(ranks - np.arange(len(own)))).sum(1)
        best = int(distance.argmin())
        return langs[best], 1.0 - float(distance[best]) / (size * len(own))

    return judge


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(profiles, size)
        for b in batches:
            out = [judge(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def recognised(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, least: float = 0.2) -> DataFrame:
    """The rows of docs whose text has a language, at a score of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(profiles, size)
        for b in batches:
            out = [judge(x.as_py()) for x in b.column("text")]
            yield b.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in out], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, size: int = PROFILE, bound: int = BOUND) -> DataFrame:
    """Learn from the documents that aren't held out, and predict all: doc_id, held_out, lang_pred, score."""
    profiles = learn(docs.where(~folds.held_out(F.col("doc_id"))), size, bound)
    return predict(docs, profiles, size).select("doc_id", folds.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
