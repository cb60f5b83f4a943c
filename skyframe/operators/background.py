"""Meshed two-dimensional background.

Contract: masked pixels don't count; the median of each box; a box without a good
pixel takes the image's median; a 3 by 3 median filter over boxes; bilinear
interpolation between box centres, level beyond them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import photometry


def mesh(pixels: DataFrame, key: str, box: int) -> DataFrame:
    """key, by, bx, level: filtered box medians. pixels: key, y, x, data, bad."""
    median = F.median(F.when(~F.col("bad"), F.col("data")))
    boxes = pixels.groupBy(key, F.floor(F.col("y") / box).cast("int").alias("by"), F.floor(F.col("x") / box).cast("int").alias("bx")).agg(median.alias("m"))
    whole = pixels.groupBy(key).agg(median.alias("_m"))
    full = boxes.join(whole, key).select(key, "by", "bx", F.coalesce("m", "_m").alias("m"))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = full.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps)).select(key, (F.col("by") + F.col("_dy")).alias("by"), (F.col("bx") + F.col("_dx")).alias("bx"), "m")
    return near.join(full.select(key, "by", "bx"), [key, "by", "bx"]).groupBy(key, "by", "bx").agg(F.median("m").alias("level"))


def interpolated(pixels: DataFrame, levels: DataFrame, key: str, box: int) -> DataFrame:
    """pixels with column background. Boxes that are missing on one side count as the pixel's own.

    The boxes' levels are dealt to the four cells between centres that each touches, so a pixel meets one row.
    """
    sides = [(j, i) for j in (0, 1) for i in (0, 1)]
    corners = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j, i in sides)))
    spread = levels.withColumn("_c", corners).withColumn("_by", F.col("by") - F.col("_c.j")).withColumn("_bx", F.col("bx") - F.col("_c.i"))
    own = {(j, i): F.max(F.when((F.col("_c.j") == j) & (F.col("_c.i") == i), F.col("level"))) for j, i in sides}
    cells = spread.groupBy(key, "_by", "_bx").agg(*(v.alias(f"_l{j}{i}") for (j, i), v in own.items()))
    fy, fx = (F.col("y") + 0.5) / box - 0.5, (F.col("x") + 0.5) / box - 0.5
    got = pixels.withColumn("_by", F.floor(fy).cast("int")).withColumn("_bx", F.floor(fx).cast("int")).join(cells, [key, "_by", "_bx"], "left")
    top, total = F.lit(0.0), F.lit(0.0)
    for j, i in sides:
        level, weight = F.col(f"_l{j}{i}"), (1.0 - F.abs(fy - F.col("_by") - j)) * (1.0 - F.abs(fx - F.col("_bx") - i))
        top, total = top + F.coalesce(weight * level, F.lit(0.0)), total + F.when(level.isNotNull(), weight).otherwise(0.0)
    return got.withColumn("background", F.when(total > 0, top / total)).drop("_by", "_bx", *(f"_l{j}{i}" for j, i in sides))


def fit(pixels: DataFrame, key: str, kind: str = "mesh", box: int = 5) -> DataFrame:
    """pixels (key, y, x, data, bad, iv) with column background: by mesh, by a plane, or none (0)."""
    if kind == "none":
        return pixels.withColumn("background", F.lit(0.0))
    if kind == "plane":
        p = photometry.plane(pixels, key)
        level = F.coalesce(F.col("a") + F.col("b") * F.col("x") + F.col("c") * F.col("y"), F.lit(0.0))
        return pixels.join(p, key, "left").withColumn("background", level).drop("a", "b", "c")
    if kind != "mesh":
        raise ValueError(f"no background of kind {kind}")
    return interpolated(pixels, mesh(pixels, key, box), key, box)
