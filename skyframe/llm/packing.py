"""Best-fit packing of token sequences, by bin-completion branch and bound.

Documents of the same length are interchangeable, so the search works on how
many pieces of each length there are: at most ``capacity`` numbers, however many
documents.  Around the largest length left it enumerates, one by one as they are asked for, the
undominated fillings of the gap, least waste first, larger pieces first among
equals (a length that fits what is left exactly dominates all other ways to fill
that; a filling to which one more piece could be added is dominated).  Sums that
no pieces give are known beforehand from bit sets, so no step of the enumeration
leads nowhere.  Each filling is tried as often as its pieces last, then once.  A branch
is pruned where the bins used and a bound on the rest reach the incumbent; the
first incumbent is the best-fit solution.  Patterns with their slots are handed
out to the pieces by rank.

There is one search for any number of pieces.  Its only limit is ``nodes``, the
fillings that are tried in all (a documented parameter); beyond it the incumbent
holds, a valid packing that may not be the least.

A document is its tokens and an end token (a null or empty text: the end token
alone).  Only documents longer than the capacity are cut: into full pieces, of
which the first is the shorter one.  Full pieces fill a sequence each and take no part in
the search.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime, tokens

CAPACITY, NODES, GROUP = 1024, 4000, 1 << 16
Pattern = tuple[tuple[int, ...], int]


def fillings(gap: int, counts: dict[int, int], lengths: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of a gap, least waste first, larger pieces first among equals. lengths: ascending, those of counts that are left."""
    lengths = lengths[: bisect_right(lengths, gap)]
    mask, reach = (1 << gap + 1) - 1, [1]

    def sums(k: int) -> int:
        """Of the k least lengths, as bits."""
        while len(reach) <= k:
            x, bits = lengths[len(reach) - 1], reach[-1]
            left, step = min(counts[x], gap // x), 1
            while left > 0:
                take = min(step, left)
                bits |= bits << x * take & mask
                left, step = left - take, 2 * step
            reach.append(bits)
        return reach[k]

    def go(rest: int, k: int) -> Iterator[tuple[int, ...]]:
        """All ways to get the sum from the k least lengths, but for dominated ones."""
        if not rest:
            yield ()
            return
        k = bisect_right(lengths, rest, 0, k)
        if k and lengths[k - 1] == rest:
            yield (rest,)
            return
        for j in range(k - 1, -1, -1):
            x = lengths[j]
            for m in range(min(counts[x], rest // x), 0, -1):
                if sums(j) >> rest - m * x & 1:
                    for others in go(rest - m * x, j):
                        yield (x,) * m + others
            if not sums(j) >> rest & 1:
                return

    if gap and lengths and lengths[-1] == gap:
        yield (gap,)
        return
    for waste in range(gap + 1):
        if sums(len(lengths)) >> gap - waste & 1:
            for found in go(gap - waste, len(lengths)):
                if not any(counts[x] > found.count(x) for x in lengths[: bisect_right(lengths, waste)]):
                    yield found


def best_fit_one(gap: int, counts: dict[int, int], lengths: list[int]) -> tuple[int, ...]:
    """Again and again the piece that leaves the least room."""
    out: list[int] = []
    k = bisect_right(lengths, gap) - 1
    while k >= 0:
        x = lengths[k]
        if x <= gap and counts[x] > out.count(x):
            out.append(x)
            gap -= x
        else:
            k -= 1
    return tuple(out)


def _times(pattern: tuple[int, ...], counts: dict[int, int]) -> int:
    return min(counts[x] // pattern.count(x) for x in set(pattern))


def _apply(pattern: tuple[int, ...], times: int, counts: dict[int, int]) -> None:
    for x in pattern:
        counts[x] -= times


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    counts, out = dict(counts), []
    while lengths := sorted(x for x, n in counts.items() if n):
        top = lengths[-1]
        counts[top] -= 1
        pattern = (top, *best_fit_one(capacity - top, counts, lengths))
        counts[top] += 1
        times = _times(pattern, counts)
        _apply(pattern, times, counts)
        out.append((pattern, times))
    return out


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer: by volume, by the pieces of over half a bin, and by volume with lengths rounded to k-ths of a bin (what fits a bin still does)."""
    x, n = np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)
    k = np.arange(1, 16)[:, None]
    parts = (k + 1) * x
    rounded = (np.where(parts % capacity == 0, k * x, parts // capacity * capacity) * n).sum(1)
    bounds = -(-rounded // (capacity * k[:, 0]))
    return max(-(-int((x * n).sum()) // capacity), int(bounds.max()))


def solve(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Patterns of lengths, and how often each is used."""
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return []
    best = best_fit(counts, capacity)
    bins, floor = sum(n for _, n in best), least_bins(counts, capacity)

    def options() -> Iterator[Pattern]:
        # the search is back at these counts whenever the next option is asked for
        lengths = sorted(x for x, n in counts.items() if n)
        top = lengths[-1]
        around = {**counts, top: counts[top] - 1}
        for filling in fillings(capacity - top, around, [x for x in lengths if around[x]]):
            pattern = (top, *filling)
            times = _times(pattern, counts)
            yield pattern, times
            if times > 1:
                yield pattern, 1

    path: list[Pattern] = []
    used, stack, seen = 0, [options()], 0
    while stack and bins > floor and seen < nodes:
        seen += 1
        if len(path) == len(stack):  # leave the option taken before
            pattern, times = path.pop()
            _apply(pattern, -times, counts)
            used -= times
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            continue
        path.append(step)
        _apply(*step, counts)
        used += step[1]
        if not any(counts.values()):
            if used < bins:
                bins, best = used, list(path)
        elif used + least_bins(counts, capacity) < bins:
            stack.append(options())
    return best


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row of docs, and row, a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode
        made = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo, found in encode(b.column("text")):
                row, part, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(found):
                    ids = np.append(ids, np.uint32(tokens.END)).astype("<u4", copy=False)
                    n, at, piece = len(ids), 0, 0
                    while at < n:
                        size = min(n, capacity) if at or n <= capacity else n % capacity or capacity
                        row.append(lo + k), part.append(piece), start.append(at), length.append(size)
                        crc.append(zlib.crc32(ids[at : at + size]))
                        at, piece = at + size, piece + 1
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(part, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(made + np.arange(len(row)))], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])
                made += len(row)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, row long")


def slots(plan: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """length, first rank, end rank, first sequence, place of each slot of a plan."""
    out, given, sequence = [], {}, 0
    for pattern, times in plan:
        place = 0
        for x in pattern:
            first = given.get(x, 0)
            out.append((x, first, first + times, sequence, place))
            given[x], place = first + times, place + x
        sequence += times
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY, nodes: int = NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    parts = runtime.cut(pieces(docs, capacity, vocabulary))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    alone = parts.where(F.col("length") == capacity).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = parts.where(F.col("length") < capacity)
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # fewer than ``capacity`` rows
    plan = slots(solve(counts, capacity, nodes))
    # ranks among the pieces of a length: places in small groups, after the sizes of the groups before
    groups = spark.createDataFrame([(x, -(-n // GROUP)) for x, n in counts.items()], "length long, groups long")
    dealt = parts.join(F.broadcast(groups), "length").withColumn("group", F.expr("pmod(xxhash64(row), groups)")).drop("groups")
    sizes = dealt.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "group").orderBy("row")
    ranked = dealt.withColumn("place", F.row_number().over(own) - 1).join(bases, ["length", "group"]).withColumn("rank", F.col("base") + F.col("place"))
    table = spark.createDataFrame(plan, "slot_length long, first long, end long, sequence long, at long")  # a few slots a length, whatever the input
    fits = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    mixed = ranked.join(F.broadcast(table), fits).select(*columns, (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("at").alias("offset"))
    return alone.unionByName(mixed)
