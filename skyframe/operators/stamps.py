"""Operators on long stamps (key, y, x, value): point-spread functions, patches, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mixtures import lanczos


def centroid(stamps: DataFrame, *keys: str) -> DataFrame:
    """Sum, flux-weighted centre (null if the sum is 0), and the peak (first pixel by y, x on a tie)."""
    v = F.col("value")
    peak = F.max(F.struct(v.alias("v"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x")))
    out = stamps.groupBy(*keys).agg(F.sum(v).alias("total"), F.try_divide(F.sum(F.col("y") * v), F.sum(v)).alias("cy"), F.try_divide(F.sum(F.col("x") * v), F.sum(v)).alias("cx"), peak.alias("_p"))
    return out.select(*keys, "total", "cy", "cx", F.col("_p.v").alias("peak"), (-F.col("_p.y")).alias("py"), (-F.col("_p.x")).alias("px"))


def block_sum(pixels: DataFrame, ky: int, kx: int, *keys: str, value: str = "value", height: int | None = None, width: int | None = None) -> DataFrame:
    """Sums over blocks of ky by kx; what doesn't fill a block at the far edge is cropped."""
    rows = pixels
    if height is not None:
        rows = rows.where((F.col("y") < height // ky * ky) & (F.col("x") < width // kx * kx))
    return rows.groupBy(*keys, F.floor(F.col("y") / ky).cast("int").alias("ry"), F.floor(F.col("x") / kx).cast("int").alias("rx")).agg(F.sum(value).alias("flux"), F.count("*").alias("n"))


def halve(stamps: DataFrame, key: str, size: int) -> DataFrame:
    """An odd stamp at half the sampling: the centre stays one pixel, its neighbours pair up outwards; the sum stays.

    An outermost pixel without a partner is left out.
    """
    c = size // 2

    def cell(v: Column) -> Column:
        d = v - c
        return F.when(d == 0, 0).when(d > 0, F.floor((d + 1) / 2)).otherwise(-F.floor((-d + 1) / 2)).cast("int")

    half = c // 2
    rows = stamps.withColumn("_y", cell(F.col("y"))).withColumn("_x", cell(F.col("x"))).where((F.abs("_y") <= half) & (F.abs("_x") <= half))
    small = rows.groupBy(key, (F.col("_y") + half).alias("y"), (F.col("_x") + half).alias("x")).agg(F.avg("value").alias("value"))
    total = stamps.groupBy(key).agg(F.sum("value").alias("_total"))
    own = F.sum("value").over(Window.partitionBy(key))
    return small.join(total, key).select(key, "y", "x", F.try_divide(F.col("value") * F.col("_total"), own).alias("value"))


def normalise(stamps: DataFrame, *keys: str) -> DataFrame:
    """Stamps of sum 1; one of sum 0 becomes null."""
    return stamps.withColumn("value", F.try_divide(F.col("value"), F.sum("value").over(Window.partitionBy(*keys))))


def encircled_radius(stamps: DataFrame, key: str, share: float, cy: float, cx: float) -> DataFrame:
    """Least radius within which a share of the flux lies; pixels of one radius in order of y and x."""
    r = F.sqrt((F.col("y") - cy) * (F.col("y") - cy) + (F.col("x") - cx) * (F.col("x") - cx))
    w = Window.partitionBy(key)
    run = w.orderBy("r", "y", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = stamps.withColumn("r", r).withColumn("_cum", F.sum("value").over(run)).withColumn("_all", F.sum("value").over(w))
    return rows.where(F.col("_cum") >= share * F.col("_all")).groupBy(key).agg(F.min("r").alias("r_eff"))


def gradients(pixels: DataFrame, key: str, value: str = "data") -> DataFrame:
    """Central differences along x and y; one-sided next to a gap or an edge."""
    across, along = Window.partitionBy(key, "y").orderBy("x"), Window.partitionBy(key, "x").orderBy("y")

    def slope(w: Window, at: str) -> Column:
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        left, right = F.lag(at).over(w), F.lead(at).over(w)
        return (F.coalesce(after, F.col(value)) - F.coalesce(before, F.col(value))) / F.nullif(F.coalesce(right, F.col(at)) - F.coalesce(left, F.col(at)), F.lit(0))

    return pixels.select(key, "y", "x", slope(across, "x").alias("dx"), slope(along, "y").alias("dy"))


def shift(stamps: DataFrame, key: str, dy: Column, dx: Column, height: int, width: int, order: int = 3) -> DataFrame:
    """Stamps moved by a part of a pixel, by a separable, normalised Lanczos kernel in two passes. What moves out of the stamp is lost."""

    def one(rows: DataFrame, axis: str, by: Column, size: int) -> DataFrame:
        steps = F.sequence(F.lit(-order), F.lit(order))
        weight = lambda k: lanczos(k.cast("double") + by, order)  # noqa: E731  value(p) takes stamp(p + k) with the kernel at k + shift
        norm = F.aggregate(steps, F.lit(0.0), lambda s, k: s + weight(k))
        spread = rows.select(*rows.columns, norm.alias("_n"), F.explode(steps).alias("_k"))
        moved = spread.withColumn(axis, F.col(axis) - F.col("_k")).withColumn("value", F.col("value") * weight(F.col("_k")) / F.col("_n")).where(F.col(axis).between(0, size - 1))
        return moved.groupBy(*(c for c in rows.columns if c != "value")).agg(F.sum("value").alias("value"))

    rows = stamps.select(key, "y", "x", "value", dy.alias("_dy"), dx.alias("_dx"))
    return one(one(rows, "x", F.col("_dx"), width), "y", F.col("_dy"), height).select(key, "y", "x", "value")


def resample(stamps: DataFrame, key: str, across: tuple[float, float, int], along: tuple[float, float, int], order: int = 3, normalised: bool = False) -> DataFrame:
    """To another grid: across (x) and along (y) give its start, step and size in pixels of the old one.

    Under a step above 1 the Lanczos kernel is widened by it and lowered by as much; weights add up to
    about 1, exactly so if they are normalised.
    """

    def one(rows: DataFrame, axis: str, grid: tuple[float, float, int]) -> DataFrame:
        start, step, size = grid
        wide = max(1.0, step)
        place = lambda q: start + q * step
        near = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda q: F.abs(place(q) - F.col(axis)) <= order * wide)
        spread = rows.withColumn("_q", F.explode(near)).withColumn("_w", lanczos((place(F.col("_q")) - F.col(axis)) / wide, order) / wide)
        names = [c for c in rows.columns if c not in ("value", axis)]
        value = F.sum(F.col("value") * F.col("_w"))
        return spread.groupBy(*names, "_q").agg((value / F.sum("_w") if normalised else value).alias("value")).withColumnRenamed("_q", axis)

    return one(one(stamps.select(key, "y", "x", "value"), "x", across), "y", along).select(key, "y", "x", "value")


def downsampled(stamps: DataFrame, key: str, shape: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """To fewer pixels (rows, columns) of the same field of view, keeping flux: block sums for whole factors, else a normalised resampling times the ratio of areas."""
    if shape[0] % target[0] == 0 and shape[1] % target[1] == 0:
        small = block_sum(stamps, shape[0] // target[0], shape[1] // target[1], key, height=shape[0], width=shape[1])
        return small.select(key, F.col("ry").alias("y"), F.col("rx").alias("x"), F.col("flux").alias("value"))
    grids = [(n / m / 2 - 0.5, n / m, m) for n, m in zip(shape, target, strict=True)]
    small = resample(stamps, key, grids[1], grids[0], normalised=True)
    return small.withColumn("value", F.col("value") * (shape[0] * shape[1] / (target[0] * target[1])))


def padded(pixels: DataFrame, images: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """Every pixel of a height by width grid of each image (key): its value, or 0 where there is none; what lies outside is cropped."""
    grid = images.select(key).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return grid.join(pixels.select(key, "y", "x", "value"), [key, "y", "x"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def correlated(signals: DataFrame, filters: DataFrame, key: str, axis: str, size: int, length: int, full: bool = False) -> DataFrame:
    """Correlation of each image's rows or columns with its own filter (key, k, weight): sum over k of value(p + k - c) * weight(k) with the filter's middle c = length // 2.

    Outside the image values are 0. full: all places that a filter touches, from
    -(length - 1 - c) on, counted from 0; else as many as the image has.
    """
    c = length // 2
    shift = length - 1 - c if full else 0
    last = size + length - 1 if full else size
    spread = signals.join(filters, key).withColumn(axis, F.col(axis) - F.col("k") + c + shift).where(F.col(axis).between(0, last - 1))
    return spread.groupBy(key, "y", "x").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def bilinear(points: DataFrame, stamps: DataFrame, key: str) -> DataFrame:
    """points: key, point, py, px. Values between four neighbours; a missing neighbour counts as 0."""
    y0, x0 = F.floor("py").cast("int"), F.floor("px").cast("int")
    corners = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (0, 1) for i in (0, 1)))
    spread = points.withColumn("_c", F.explode(corners)).withColumn("y", y0 + F.col("_c.j")).withColumn("x", x0 + F.col("_c.i"))
    weight = (1.0 - F.abs(F.col("py") - F.col("y"))) * (1.0 - F.abs(F.col("px") - F.col("x")))
    joined = spread.join(stamps.select(key, "y", "x", "value"), [key, "y", "x"], "left")
    return joined.groupBy(key, "point").agg(F.sum(weight * F.coalesce("value", F.lit(0.0))).alias("value"))


def combine(a: DataFrame, b: DataFrame, keys: list[str], sign: float = 1.0) -> DataFrame:
    """Sum (or difference) over the union of both extents."""
    return a.select(*keys, "value").unionByName(b.select(*keys, (sign * F.col("value")).alias("value"))).groupBy(*keys).agg(F.sum("value").alias("value"))


def trimmed(pixels: DataFrame, key: str) -> DataFrame:
    """Only what lies in the bounding box of the non-zero pixels."""
    box = pixels.where("value <> 0").groupBy(key).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    return pixels.join(box, key).where("x between _x0 and _x1 and y between _y0 and _y1").drop("_x0", "_x1", "_y0", "_y1")


def overlap(lo: Column, hi: Column, least: Column, most: Column) -> tuple[Column, Column, Column, Column]:
    """Of an inclusive range against bounds: the part inside (out_lo, out_hi) and the same from the range's own start (in_lo, in_hi)."""
    a, b = F.greatest(lo, least), F.least(hi, most)
    return a, b, a - lo, b - lo
