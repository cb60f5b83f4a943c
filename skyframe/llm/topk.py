"""Exact top-k by inner product, in three phases with a uniform threshold.

A vector's dimensions are dealt to ``lists``; a list's score of a query and a
candidate is their inner product over its dimensions.  A list's scores are
worked out by tasks of its own, which hold nothing of the other lists.  A lift is
a score less the query's least score in that list.

1. Gather: each list gives, for each query, its ``heads`` best candidates.  Their scores in
   the other lists are looked up; the k-th best whole score is a safe cutoff: k
   candidates reach it.
2. Collect: the cutoff goes to the lists.  A candidate that reaches it has, in
   some list, an equal part of it, and also what the other lists' greatest lifts leave
   open.  Only such entries leave their list.
3. Resolve: with these entries the cutoff rises.  Candidates that can't reach it,
   even if the lists that kept silent were just below their thresholds, go; only
   the others' remaining scores are worked out, and compete for the k places, ties to the
   smaller identifier (null last).

Of equal vectors only the k + 1 least identifiers are candidates, as no other
can have a place.  Queries and candidates are dealt to groups of bounded size, and a
task has one group of each, streaming what it finds.  The number of groups of
queries times the candidates, and the other way round, is what moves.

Components become floor(256 * x); a vector that is null or holds a null or
non-finite component takes no part; a shorter vector counts as ending in zeros.
Scores are exact: in doubles where all sums stay below 2**53, else in Python integers;
a list's score stops at 2**61 / lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

K, SCALE, EVERY, LISTS, HEADS = 5, 256, 50, 2, 24
#: Bytes of one list's values in a group of candidates, and of queries. Rows that are worth a group of their own while cores are idle.
CANDIDATE_BYTES, QUERY_BYTES, WORTH = 32 << 20, 4 << 20, 4096
#: Queries and candidates in a block of scores.
BLOCK = (256, 16384)


def numbered(vectors: DataFrame, id_column: str, column: str, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), id, dims, size (bytes a component: 2, or 8 where a component needs it), values of each vector that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            lists = b.column(1).cast(pa.list_(pa.float64()))
            ends = np.asarray(lists.offsets)
            x = np.floor(scale * np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64))
            sums = np.zeros((2, len(x) + 1), np.int64)
            sums[0, 1:], sums[1, 1:] = np.cumsum(~np.isfinite(x)), np.cumsum(~(np.abs(x) < 1 << 15))
            bad, wide = np.diff(sums[:, ends])
            ok = np.flatnonzero(np.asarray(lists.is_valid()) & (bad == 0))
            kinds = np.where(wide[ok] > 0, 8, 2)
            dims = np.diff(ends)[ok]
            raw = [x[ends[k] : ends[k + 1]].astype("<f8" if size == 8 else "<i2").tobytes() for k, size in zip(ok.tolist(), kinds.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(ok))), b.column(0).take(pa.array(ok)), pa.array(dims, pa.int32()), pa.array(kinds, pa.int32()), pa.array(raw, pa.binary())], ["row", "id", "dims", "size", "values"])
            row += len(ok)

    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column)).mapInArrow(run, "row long, id long, dims int, size int, values binary")


def matrix(batches: list[pa.RecordBatch], width: int) -> np.ndarray:
    """The values of some rows, filled up with zeros."""
    total = sum(b.num_rows for b in batches)
    wide = any((np.asarray(b.column("size")) == 8).any() for b in batches)
    out, at = np.zeros((total, width), np.float64 if wide else np.int16), 0
    for b in batches:
        own = b.column("values")
        _, ends, data = own.buffers()
        ends = np.frombuffer(ends, np.int32)[own.offset : own.offset + len(own) + 1]
        if not wide and (np.diff(ends) == 2 * width).all():
            out[at : at + len(own)] = np.frombuffer(data, "<i2", len(own) * width, ends[0]).reshape(-1, width)
        else:
            for k, (raw, size) in enumerate(zip(own.to_pylist(), b.column("size").to_pylist(), strict=True)):
                x = np.frombuffer(raw, "<f8" if size == 8 else "<i2")
                out[at + k, : len(x)] = x
        at += len(own)
    return out


def scores(q: np.ndarray, c: np.ndarray, bound: int) -> np.ndarray:
    """Queries by candidates, exactly: doubles while these are exact, else 64-bit integers that stop at the bound."""
    a, b = np.asarray(q, np.float64), np.asarray(c, np.float64)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < 2.0**53:
        return a @ b.T
    a, b = (np.array([[int(y) for y in x] for x in m], object).reshape(m.shape) for m in (a, b))
    return np.clip(a @ b.T, -bound, bound).astype(np.int64)


def pairwise(q: np.ndarray, c: np.ndarray, bound: int) -> np.ndarray:
    """Of a row and its counterpart each."""
    a, b = np.asarray(q, np.float64), np.asarray(c, np.float64)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < 2.0**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.array([max(-bound, min(bound, sum(int(x) * int(y) for x, y in zip(p, r, strict=True)))) for p, r in zip(a, b, strict=True)], np.int64)


class Group:
    """One list of some queries (side 0) and candidates (side 1), and what follows them (side 2) in ``rest``. Batches come by side."""

    def __init__(self, batches: Iterator[pa.RecordBatch], width: int) -> None:
        parts: list[list[pa.RecordBatch]] = [[], []]
        last = None
        for b in batches:
            side = np.asarray(b.column("side"))
            for k in (0, 1):
                if (side == k).any():
                    parts[k].append(b.filter(pa.array(side == k)))
            if side[-1] == 2:
                last = b.filter(pa.array(side == 2))
                break
        self.list = (parts[0] or parts[1] or [last])[0].column("list")[0].as_py()
        self.q_rows, self.c_rows = (np.concatenate([np.asarray(b.column("row")) for b in p]) if p else np.zeros(0, np.int64) for p in parts)
        self.ids = pa.chunked_array([b.column("id") for b in parts[1]], pa.int64()).combine_chunks()
        self.q, self.c = matrix(parts[0], width), matrix(parts[1], width)
        self.rest = chain([] if last is None else [last], batches)


def gather(q: np.ndarray, c: np.ndarray, keep: int, bound: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some queries at a time: the first's place, places and scores of the ``keep`` best candidates, and the least score of any."""
    for lo in range(0, len(q), BLOCK[0]):
        at = own = least = None
        for a in range(0, len(c), BLOCK[1]):
            s = scores(q[lo : lo + BLOCK[0]], c[a : a + BLOCK[1]], bound)
            low = s.min(1)
            p = np.broadcast_to(np.arange(a, a + s.shape[1]), s.shape)
            if at is not None:
                low, p, s = np.minimum(low, least), np.hstack([at, p]), np.hstack([own, s])
            if s.shape[1] > keep:
                top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                p, s = np.take_along_axis(p, top, 1), np.take_along_axis(s, top, 1)
            at, own, least = p, s, low
        if at is not None:
            yield lo, at, own, least


def collect(q: np.ndarray, c: np.ndarray, cutoffs: np.ndarray, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries and candidates, and scores, of all entries that reach the query's cutoff."""
    for lo in range(0, len(q), BLOCK[0]):
        for a in range(0, len(c), BLOCK[1]):
            s = scores(q[lo : lo + BLOCK[0]], c[a : a + BLOCK[1]], bound)
            i, j = np.nonzero(s >= cutoffs[lo : lo + BLOCK[0], None])
            if len(i):
                yield lo + i, a + j, s[i, j]


@dataclass
class Phases:
    """What each phase gives: heads (gather), entries (collect), open (pairs that the cutoff leaves), placed."""

    heads: DataFrame
    entries: DataFrame
    open: DataFrame
    placed: DataFrame


def phases(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = K, scale: int = SCALE, every: int = EVERY, lists: int = LISTS, heads: int = HEADS) -> Phases:
    spark = vectors.sparkSession
    # numbers of rows are those of this table, so a row knows itself among the candidates
    flat = runtime.cut(numbered(vectors, id_column, column, scale))
    asked = flat.where(F.col("id") % every == 0)
    nth = F.row_number().over(Window.partitionBy("dims", "values").orderBy(F.asc_nulls_last("id"), "row"))
    others = runtime.cut(flat.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"))
    about = flat.agg(F.coalesce(F.max("dims"), F.lit(0)), F.max("size"), F.count_if(F.col("id") % every == 0)).collect()[0]
    n_others = others.count()
    keep = max(k + 1, heads)  # a query may be among its own
    width, bound = max(1, -(-about[0] // lists)), (1 << 61) // lists
    volume = width * (about[1] or 2)
    # as many groups of candidates as bounded memory or idle cores ask for
    c_groups = max(-(-n_others * volume // CANDIDATE_BYTES), min(runtime.partitions(spark), -(-n_others // WORTH)), 1)
    q_groups = max(-(-about[2] * volume // QUERY_BYTES), 1)
    c_group_of = lambda row: F.pmod(F.xxhash64(F.lit("c"), row), F.lit(c_groups)).cast("int")
    q_group_of = lambda row: F.pmod(F.xxhash64(F.lit("q"), row), F.lit(q_groups)).cast("int")
    c_group, q_group = c_group_of("row"), q_group_of("row")

    each = F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list")
    part = F.substring(F.col("values"), F.col("list") * F.col("size") * width + 1, F.col("size") * width).alias("values")
    split = lambda df: df.select("row", "id", "size", "values", each).select("row", "id", "size", "list", part)
    all_c, all_q = F.explode(F.sequence(F.lit(0), F.lit(c_groups - 1))).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1))).alias("q")
    candidates = split(others).select(F.lit(1).alias("side"), "list", c_group.alias("c"), all_q, "row", "id", "size", "values")
    queries = split(asked).select(F.lit(0).alias("side"), "list", all_c, q_group.alias("q"), "row", "id", "size", "values")
    sides = queries.unionByName(candidates)

    def gathering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Group(batches, width)
        for lo, at, s, least in gather(g.q, g.c, keep, bound):
            who, flat_at = np.repeat(np.arange(lo, lo + len(at)), at.shape[1]), at.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), g.list, np.int32)), pa.array(g.q_rows[who]), pa.array(g.c_rows[flat_at]), g.ids.take(pa.array(flat_at)), pa.array(s.ravel().astype(np.int64)), pa.array(np.repeat(least, at.shape[1]).astype(np.int64))], ["list", "q_row", "c_row", "vec_id", "score", "least"])

    def collecting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Group(batches, width)
        told = pa.Table.from_batches(g.rest, told_schema) if len(g.q) and len(g.c) else told_schema.empty_table()
        rows, least, threshold = (np.asarray(told.column(x).combine_chunks()) for x in ("row", "least", "threshold"))
        order = np.argsort(rows)
        rows, least, threshold = rows[order], least[order], threshold[order]
        # a query has no threshold only if it is alone
        asking = np.flatnonzero(np.isin(g.q_rows, rows))
        q_rows, at = g.q_rows[asking], np.searchsorted(rows, g.q_rows[asking])
        least, threshold = least[at], threshold[at]
        for i, j, s in collect(g.q[asking], g.c, least + threshold, bound):
            s = s.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), g.list, np.int32)), pa.array(q_rows[i]), pa.array(g.c_rows[j]), g.ids.take(pa.array(j)), pa.array(s), pa.array(s - least[i]), pa.array(threshold[i])], ["list", "q_row", "c_row", "vec_id", "score", "lift", "said"])

    def resolving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Group(batches, width)
        at_q, at_c = np.argsort(g.q_rows), np.argsort(g.c_rows)
        for b in g.rest:
            i = at_q[np.searchsorted(g.q_rows[at_q], np.asarray(b.column("row")))]
            j = at_c[np.searchsorted(g.c_rows[at_c], np.asarray(b.column("c_row")))]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("c_row"), g.ids.take(pa.array(j)), pa.array(pairwise(g.q[i], g.c[j], bound))], ["q_row", "c_row", "vec_id", "score"])

    def dealt(df: DataFrame):
        keys = ["list", "c", "q"]
        return df.repartition(lists * c_groups * q_groups, *keys).sortWithinPartitions(*keys, "side").groupBy(*keys)

    def resolve(lost: DataFrame) -> DataFrame:
        """q_row, c_row, vec_id, score in the list that each row of lost (q_row, c_row, list) names."""
        here = lost.select(F.lit(2).alias("side"), "list", c_group_of("c_row").alias("c"), q_group_of("q_row").alias("q"), F.col("q_row").alias("row"), "c_row")
        return dealt(sides.unionByName(here, allowMissingColumns=True)).applyInArrow(resolving, "q_row long, c_row long, vec_id long, score long")

    told_schema = pa.schema([("side", pa.int32()), ("list", pa.int32()), ("c", pa.int32()), ("q", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("size", pa.int32()), ("values", pa.binary()), ("least", pa.int64()), ("threshold", pa.int64())])
    named = runtime.cut(dealt(sides).applyInArrow(gathering, "list int, q_row long, c_row long, vec_id long, score long, least long"))
    best = runtime.cut(named.groupBy("q_row", "list").agg(F.min("least").alias("least"), (F.max("score") - F.min("least")).alias("peak")))
    bit = F.expr("shiftleft(1L, list)")
    silent = F.expr(f"explode(filter(sequence(0, {lists - 1}), x -> (lists & shiftleft(1L, x)) = 0)) as list")
    order = Window.partitionBy("q_row", "list").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "c_row")
    first = named.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).where("q_row != c_row")
    first = runtime.cut(first.groupBy("q_row", "c_row").agg(F.sum("score").alias("score"), F.sum(bit).alias("lists")))
    whole = first.drop("lists").unionByName(resolve(first.select("q_row", "c_row", silent)).select("q_row", "c_row", "score")).groupBy("q_row", "c_row").agg(F.sum("score").alias("score"))
    ranked = whole.withColumn("n", F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score")))).where(F.col("n") <= k)
    safe = ranked.groupBy("q_row").agg(F.when(F.count("*") == k, F.min("score")).alias("safe"))
    floors = best.groupBy("q_row").agg(F.sum("least").alias("floor"))
    safe = floors.join(safe, "q_row", "left").select("q_row", F.coalesce(F.col("safe") - F.col("floor"), F.lit(0)).alias("safe"))
    peaks = Window.partitionBy("q_row")
    equal = F.expr(f"safe div {lists} + if(safe % {lists} > 0, 1, 0)")
    threshold = F.greatest(equal, F.col("safe") - F.sum("peak").over(peaks) + F.col("peak"), F.lit(0))
    bounds = runtime.cut(best.join(safe, "q_row").select("q_row", "list", "least", threshold.alias("threshold")), (best, first))
    told = bounds.select(F.lit(2).alias("side"), "list", all_c, q_group_of("q_row").alias("q"), F.col("q_row").alias("row"), "least", "threshold")
    entries = runtime.cut(dealt(sides.unionByName(told, allowMissingColumns=True)).applyInArrow(collecting, "list int, q_row long, c_row long, vec_id long, score long, lift long, said long"))

    known = entries.where("q_row != c_row").groupBy("q_row", "c_row")
    known = known.agg(F.max("vec_id").alias("vec_id"), *(F.sum(x).alias(x) for x in ("score", "lift", "said")), F.sum(bit).alias("lists"))
    ranked = known.select("q_row", "lift").withColumn("n", F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("lift")))).where(F.col("n") <= k)
    cutoff = ranked.groupBy("q_row").agg(F.when(F.count("*") == k, F.min("lift")).otherwise(0).alias("cutoff"))
    cutoff = bounds.groupBy("q_row").agg(F.sum("threshold").alias("thresholds")).join(cutoff, "q_row")
    reach = F.col("lift") + F.col("thresholds") - F.col("said")
    survivors = known.join(cutoff, "q_row").where(reach >= F.col("cutoff")).select("q_row", "c_row", "vec_id", "score", "lists")
    survivors = runtime.cut(survivors)
    resolved = resolve(survivors.select("q_row", "c_row", silent))
    whole = survivors.drop("lists").unionByName(resolved).groupBy("q_row", "c_row").agg(F.max("vec_id").alias("vec_id"), F.sum("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "c_row"))
    placed = whole.withColumn("rank", place).where(F.col("rank") <= k)
    names = asked.select(F.col("row").alias("q_row"), F.col("id").alias("query_id"))
    placed = placed.join(names, "q_row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return Phases(named, entries, survivors, placed)


def top(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = K, scale: int = SCALE, every: int = EVERY, lists: int = LISTS, heads: int = HEADS) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose identifier is divisible by ``every``, its k best among all other rows."""
    return phases(vectors, id_column, column, k, scale, every, lists, heads).placed
