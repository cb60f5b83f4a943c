"""Connected components of an edge table, by alternating large and small stars.

Nothing is gathered: a round joins the edges with each node's least neighbour,
and its result is written to the shared folder.  Rounds grow with the logarithm
of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).collect()[0]
    return tuple(r)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its least node) of every node of an edge. Edges with a null end or of a node with itself don't count."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct()
    now = runtime.cut(now)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m"))
        # large star: each larger neighbour hangs on the node's least
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = runtime.cut(large)
        # small star: a node and its smaller neighbours hang on the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()
        now = runtime.cut(small, (now, large))
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
