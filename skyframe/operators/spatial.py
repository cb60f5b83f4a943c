"""Joins by position: nearest rows, footprints, boxes, tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sky
from ..sources import shared


#: Rows that a dimension table may have to be broadcast.
FEW = 10_000


def nearest(left: DataFrame, right: DataFrame, key: str, other: str, at: tuple[str, str], to: tuple[str, str], cell: float) -> DataFrame:
    """key, other, distance: of each row of left the right row nearest in the plane, the smaller ``other`` on a tie. at, to: names of the positions.

    A table of up to FEW rows is broadcast, and each row meets all of it before anything is shuffled. A
    larger one is searched by cells, of which a row sees its own and the eight
    around it: whatever it finds within a cell's size is nearest, and what is left over is
    searched by cells of twice the size.  Rows without a position meet nothing.
    """
    left, right = (rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)) for rows, (x, y) in ((left, at), (right, to)))
    points = right.select(other, F.col(to[0]).alias("_px"), F.col(to[1]).alias("_py"))
    gap = F.hypot(F.col(at[0]) - F.col("_px"), F.col(at[1]) - F.col("_py"))
    best = F.min(F.struct(gap.alias("distance"), other)).alias("_best")
    found = [key, F.col(f"_best.{other}").alias(other), F.col("_best.distance").alias("distance")]
    few = points.limit(FEW + 1).collect()
    if len(few) <= FEW:
        return left.crossJoin(F.broadcast(left.sparkSession.createDataFrame(few, points.schema))).groupBy(key).agg(best).select(*found)
    out, rest = None, left.select(key, *at)
    near = lambda v, size: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col(v) / size) + k))
    while True:
        own = rest.withColumn("_cx", F.floor(F.col(at[0]) / cell)).withColumn("_cy", F.floor(F.col(at[1]) / cell))
        around = points.withColumn("_cx", near("_px", cell)).withColumn("_cy", near("_py", cell))
        new = own.join(around, ["_cx", "_cy"]).groupBy(key).agg(best).select(*found).where(F.col("distance") <= cell)
        new = shared.cut(new)
        out = new if out is None else out.unionByName(new)
        rest = shared.cut(rest.join(new.select(key), key, "left_anti"))
        if rest.isEmpty():
            return out
        cell *= 2


def cone(rows: DataFrame, ra: float, dec: float, radius: float) -> DataFrame:
    """Rows within a radius in degrees; a band of declination, which the scan can use, comes first."""
    inside = sky.separation(F.col("ra"), F.col("dec"), F.lit(ra), F.lit(dec)) <= radius
    return rows.where(F.col("dec").between(dec - radius, dec + radius) & inside)


def _ring(band: Column, radius: float) -> Column:
    """How many cells of right ascension a band of declination has, none narrower than what a circle around a neighbour can reach."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs((band - 1) * radius), F.abs((band + 2) * radius)))
    reach = F.sin(F.lit(math.radians(radius) / 2)) / F.greatest(F.lit(1e-12), F.cos(F.radians(edge)))
    return F.when(reach >= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360.0 / F.degrees(2 * F.asin(F.least(F.lit(1.0), reach)))))).cast("long")


def _cell(ra: Column, ring: Column) -> Column:
    return F.least(ring - 1, F.floor((ra - 360.0 * F.floor(ra / 360.0)) / 360.0 * ring).cast("long"))


def cones(rows: DataFrame, targets: DataFrame, radius: float, id_column: str) -> DataFrame:
    """Pairs of rows and targets (target, ra, dec) within a radius of up to 90 degrees.

    Both sides are dealt to bands of declination of the radius' height, and bands to
    cells of right ascension that narrow towards the poles; a target goes to its cell and its neighbours, so the join is by
    key.
    """
    band = F.floor(F.col("dec") / radius).cast("long")
    near = targets.select("target", F.col("ra").alias("_ra"), F.col("dec").alias("_dec"), F.explode(F.array(band - 1, band, band + 1)).alias("_band")).withColumn("_n", _ring(F.col("_band"), radius))
    around = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(_cell(F.col("_ra"), F.col("_n")) + k, F.col("_n"))))
    near = near.withColumn("_cell", F.explode(around)).drop("_n")
    own = rows.withColumn("_band", band).withColumn("_cell", _cell(F.col("ra"), _ring(band, radius)))
    gap = sky.separation(F.col("ra"), F.col("dec"), F.col("_ra"), F.col("_dec"))
    return own.join(near, ["_band", "_cell"]).where(gap <= radius).select(id_column, "target", gap.alias("separation"))


def nearest_on_sky(rows: DataFrame, targets: DataFrame, id_column: str, radius: float) -> DataFrame:
    """target, id_column, separation: the row nearest to each target (target, ra, dec), the smaller identifier on a tie; cones are doubled until each target has one."""
    out, rest = None, targets.select("target", "ra", "dec")
    while True:
        pairs = cones(rows, rest, min(radius, 90.0), id_column)
        if radius >= 180:  # the whole sky, only for targets that have nothing on their side of it
            gap = sky.separation(F.col("ra"), F.col("dec"), F.col("_ra"), F.col("_dec"))
            few = rest.limit(FEW + 1).select("target", F.col("ra").alias("_ra"), F.col("dec").alias("_dec"))
            pairs = rows.crossJoin(F.broadcast(few)).select(id_column, "target", gap.alias("separation"))
        best = pairs.groupBy("target").agg(F.min(F.struct("separation", id_column)).alias("b"))
        new = shared.cut(best.select("target", F.col(f"b.{id_column}").alias(id_column), "b.separation"))
        out = new if out is None else out.unionByName(new)
        rest = shared.cut(rest.join(new.select("target"), "target", "left_anti"))
        if rest.isEmpty() or radius >= 180:
            return out
        radius *= 2


def footprint(sources: DataFrame, pixels: DataFrame, radius: Column, cell: int = 32) -> DataFrame:
    """Each source with the pixels of its image inside the square of ``radius`` around it.

    Pixels belong to cells of their image, and a source goes to the cells that its
    square touches, so a crowded or large image is many small joins, not one.
    Sources without a position meet nothing.
    """

    def touched(v: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(v) - radius) / cell), F.floor((F.col(v) + radius) / cell)))

    placed = sources.where(~F.isnan("x0") & ~F.isnan("y0") & F.col("x0").isNotNull() & F.col("y0").isNotNull())
    spread = placed.withColumn("_cx", touched("x0")).withColumn("_cy", touched("y0"))
    cells = pixels.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    inside = F.col("x").between(F.col("x0") - radius, F.col("x0") + radius) & F.col("y").between(F.col("y0") - radius, F.col("y0") + radius)
    return spread.join(cells, ["image_id", "_cx", "_cy"]).where(inside).drop("_cx", "_cy")


def in_box(x: Column, y: Column, x0: Column, x1: Column, y0: Column, y1: Column, margin: float = 0.0) -> Column:
    """Half open; null and NaN positions are outside."""
    return F.coalesce((x >= x0 - margin) & (x < x1 + margin) & (y >= y0 - margin) & (y < y1 + margin) & ~F.isnan(x) & ~F.isnan(y), F.lit(False))


def tile_keys(x: Column, size: int, halo: float, tiles: int) -> Column:
    """Numbers of the tiles (along one axis) whose halo holds a coordinate."""
    first = F.greatest(F.lit(0), F.floor((x - halo) / size).cast("int"))
    last = F.least(F.lit(tiles - 1), F.floor((x + halo) / size).cast("int"))
    # the upper end of a halo is open: x < (k + 1) * size + halo
    first = F.when((x - halo) == F.floor((x - halo) / size) * size, F.greatest(F.lit(0), first)).otherwise(first)
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def assign_tiles(sources: DataFrame, size: int, halo: float, tiles_x: int, tiles_y: int) -> DataFrame:
    """A row for each tile whose core and halo hold the source; half open at the upper end."""
    spread = sources.withColumn("tx", F.explode(tile_keys(F.col("x0"), size, halo, tiles_x))).withColumn("ty", F.explode(tile_keys(F.col("y0"), size, halo, tiles_y)))
    inside = in_box(F.col("x0"), F.col("y0"), F.col("tx") * size, (F.col("tx") + 1) * size, F.col("ty") * size, (F.col("ty") + 1) * size, halo)
    core = in_box(F.col("x0"), F.col("y0"), F.col("tx") * size, (F.col("tx") + 1) * size, F.col("ty") * size, (F.col("ty") + 1) * size)
    return spread.where(inside).withColumn("core", core)


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Inside or on a convex polygon given counter-clockwise."""
    out = F.lit(True)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        out = out & ((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0)
    return out


def core_tile(x: Column, y: Column, size: float, tiles_x: int, tiles_y: int) -> Column:
    """Number (by rows) of the tile whose half-open core has a position, else of the tile with the nearest centre, the smaller number on a tie."""

    def inside(v: Column, n: int) -> Column:
        return (v >= 0) & (v < n * size)

    def nearest_to(v: Column, n: int) -> Column:
        return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.ceil(v / size) - 1))

    both = inside(x, tiles_x) & inside(y, tiles_y)
    tx, ty = (F.when(both, F.floor(v / size)).otherwise(nearest_to(v, n)) for v, n in ((x, tiles_x), (y, tiles_y)))
    return (ty * tiles_x + tx).cast("int")
