"""Shapes, buckets and tiles of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared


def quantised(size: Column, base: int) -> Column:
    return (F.ceil(size / base) * base).cast("int")


def most_common(rows: DataFrame, shape: list[str], order: str, n: int) -> DataFrame:
    """The n most frequent shapes, the one seen first among equals."""
    return rows.groupBy(*shape).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), F.asc("first_seen")).limit(n)


def buckets(shapes: DataFrame, order: str, base: int = 32, most: int = 5, square: bool = True) -> DataFrame:
    """Candidate buckets (bh, bw): the most common quantised shapes, and the largest."""
    if square:
        side = quantised(F.greatest("h", "w"), base)
        sized = shapes.select(order, side.alias("bh"), side.alias("bw"))
        top = most_common(sized, ["bh", "bw"], order, most)
    else:
        sized = shapes.select(order, quantised(F.col("h"), base).alias("bh"), quantised(F.col("w"), base).alias("bw"))
        top = most_common(sized, ["bh", "bw"], order, most - 1)
    largest = sized.agg(F.max("bh").alias("bh"), F.max("bw").alias("bw"))
    return top.select("bh", "bw").unionByName(largest).distinct()


def assigned(shapes: DataFrame, key: str, candidates: DataFrame, base: int = 32) -> DataFrame:
    """Of each image the bucket of least area that holds it, else its own quantised shape. candidates: a handful of rows."""
    pairs = shapes.join(F.broadcast(candidates), (F.col("h") <= F.col("bh")) & (F.col("w") <= F.col("bw")), "left")
    best = F.min(F.when(F.col("bh").isNotNull(), F.struct((F.col("bh") * F.col("bw")).alias("area"), "bh", "bw"))).alias("_b")
    got = pairs.groupBy(key, "h", "w").agg(best)
    return got.select(key, "h", "w", F.coalesce("_b.bh", quantised(F.col("h"), base)).alias("bh"), F.coalesce("_b.bw", quantised(F.col("w"), base)).alias("bw"))


def tiled(pixels: DataFrame, size: int, halo: int, height: int, width: int) -> DataFrame:
    """A row for each tile that a pixel is in, by core or halo; core says which."""

    def keys(v: Column, extent: int) -> Column:
        last = (extent - 1) // size
        return F.sequence(F.greatest(F.lit(0), F.floor((v - halo) / size).cast("int")), F.least(F.lit(last), F.floor((v + halo) / size).cast("int")))

    out = pixels.withColumn("ty", F.explode(keys(F.col("y"), height))).withColumn("tx", F.explode(keys(F.col("x"), width)))
    core = (F.floor(F.col("y") / size) == F.col("ty")) & (F.floor(F.col("x") / size) == F.col("tx"))
    return out.withColumn("core", core)


def tile_extents(images: DataFrame, key: str, size: int, halo: int, full: bool = False) -> DataFrame:
    """Core and padded ranges (half open) of each image's tiles. Cores end at the image; full lets the last padded range keep its size."""
    def axis(extent: str, t: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.floor((F.col(extent) - 1) / size).cast("int"))).alias(t)

    tiles = images.select(key, "h", "w", axis("h", "ty")).select("*", axis("w", "tx"))

    def ranges(t: str, extent: str) -> list[Column]:
        lo = F.col(t) * size
        hi = F.least(lo + size, F.col(extent))
        end = lo + size + halo if full else hi + halo
        return [lo.alias(f"{t}_lo"), hi.alias(f"{t}_hi"), (lo - halo).alias(f"{t}_pad_lo"), end.alias(f"{t}_pad_hi")]

    return tiles.select(key, "ty", "tx", *ranges("ty", "h"), *ranges("tx", "w"))


def sliced(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """rows with slice: number of the run of ``size`` rows that each is in, by order.

    Rows are numbered inside ranges, of which only the sizes are summed up.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    placed = shared.cut(ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))  # a row a range
    return placed.join(F.broadcast(starts), "_range").withColumn("slice", F.floor((F.col("_start") + F.col("_place")) / size)).drop("_range", "_place", "_start")
