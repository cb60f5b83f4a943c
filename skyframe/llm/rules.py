"""Quality rules: counted base features, and a hashed n-gram log-likelihood ratio.

Two smoothed multinomials over ``buckets`` hashed word uni- and bigrams: one of trusted target texts, one of the raw corpus, both counted over
all rows.  A text's score is its mean log-probability ratio a n-gram (the sum
over the number of n-grams, so length does not matter).  A text passes if its
score is at least ``threshold``; the same text always gets the same verdict.

Base rules fail a text of fewer than ``min_words`` words, or one in which over
half of the words stand in 3-word windows found twice or more.  A null text has
no words and fails.  Without trusted texts the ratio is 0 for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import Chunk, chunks, mix64

BUCKETS = 1 << 14
THRESHOLD = -0.055
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def buckets_of(c: Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each uni- and bigram. Letters' case and punctuation count as they are."""
    two, at = c.grams(2)
    return np.concatenate([c.words % np.uint64(buckets), two % np.uint64(buckets)]).astype(np.int64), np.concatenate([c.doc, c.doc[at]])


def count(docs: DataFrame, buckets: int = BUCKETS, trusted: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of all texts, and of those whose boolean column ``trusted`` holds. One array a task goes to the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for b in batches:
            marked = np.zeros(b.num_rows, bool) if trusted is None else np.array(b.column(1).fill_null(False), bool)
            for lo, hi, c in chunks(b.column(0)):
                bucket, doc = buckets_of(c, buckets)
                sums[0] += np.bincount(bucket, minlength=buckets)
                sums[1] += np.bincount(bucket[marked[lo:hi][doc]], minlength=buckets)
        which, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(which * buckets + bucket), pa.array(sums[which, bucket])], ["bucket", "n"])

    rows = docs.select("text", *([] if trusted is None else [trusted]))
    out = np.zeros(2 * buckets, np.int64)
    for r in rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # 2 * buckets rows at most
        out[r.bucket] = r.n
    return out[:buckets], out[buckets:]


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The target is smoothed towards the raw corpus: a bucket that few trusted texts could have shown stays near 0."""
    if not target.sum():
        return np.zeros(len(raw))
    p = (raw + 1) / (raw.sum() + len(raw))
    return np.log((target + len(raw) * p) / (target.sum() + len(raw))) - np.log(p)


def features(c: Chunk) -> dict[str, np.ndarray]:
    """The base features of each text of a chunk."""
    starts_char = (c.data & 0xC0) != 0x80
    out = {"n_words": c.n_words, "word_chars": c.per_doc(starts_char & c.in_word), "n_symbols": c.per_doc(_SYMBOLS[c.data])}
    # lines with a word, by hash; of each text's equal ones all but the first count
    cut = np.zeros(len(c.data) + 1, bool)
    cut[c.offsets[:-1]] = True
    cut[np.flatnonzero(c.data == 0x0A) + 1] = True
    cut[len(c.data)] = False
    at = np.flatnonzero(cut)
    ends = np.append(at[1:], len(c.data))
    words = np.searchsorted(c.starts, ends) - np.searchsorted(c.starts, at)
    at, ends = at[words > 0], ends[words > 0]
    ends = ends - ((ends > at) & (c.data[ends - 1] == 0x0A)) if len(at) else ends
    doc = np.searchsorted(c.offsets, at, "right") - 1
    line = mix64(c.hashes(at, ends) ^ mix64(doc.astype(np.uint64)))
    first = np.unique(line, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(doc, minlength=c.n) - np.bincount(doc[first], minlength=c.n)
    # words inside windows that are found twice or more in their text
    gram, at = c.grams(3)
    gram = mix64(gram ^ mix64(c.doc[at].astype(np.uint64)))
    _, inverse, times = np.unique(gram, return_inverse=True, return_counts=True)
    again = at[times[inverse] > 1] if len(at) else at
    covered = np.zeros(len(c.starts) + 2, bool)
    for k in range(3):
        covered[again + k] = True
    out["n_repeat_words"] = np.bincount(c.doc[covered[: len(c.doc)]], minlength=c.n)
    return out


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base features, base_failed, kept and score of every row of docs."""
    ratio, buckets = np.asarray(ratio, np.float64), len(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, c in chunks(b.column("text")):
                f = features(c)
                bucket, doc = buckets_of(c, buckets)
                score = np.bincount(doc, ratio[bucket], minlength=c.n) / np.maximum(np.bincount(doc, minlength=c.n), 1)
                failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])
                own = [pa.array(f[k].astype(np.int64)) for k in names]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *own, pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], ["doc_id", *names, "base_failed", "kept", "score"])

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{x} long' for x in names)}, base_failed boolean, kept boolean, score double")


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Trusted target: documents that ``labels`` mark as of good quality and not toxic."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("doc_id is not null and q = 1 and t = 0").select("doc_id", F.lit(True).alias("trusted"))
    marked = docs.select("doc_id", "text").join(good.hint("shuffle_hash"), "doc_id", "left")  # labels grow with the corpus: never broadcast
    return judge(docs, log_ratio(*count(marked, buckets, "trusted")), threshold)
