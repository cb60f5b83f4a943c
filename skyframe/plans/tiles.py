"""Tiles with halos, and fits inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grids, photometry, spatial
from .domain import Domain
from .registry import query
from .scalars import r


@query(
    "r34_tiles",
    """select image_id, cast(ty as int) ty, cast(tx as int) tx, count(*) n, cast(sum(case when y // 8 = ty and x // 8 = tx then 1 else 0 end) as bigint) core, round(sum("data"), 6) s
 from pix, range(0, 2) a(ty), range(0, 2) b(tx) where y between ty * 8 - 2 and ty * 8 + 9 and x between tx * 8 - 2 and tx * 8 + 9 group by 1, 2, 3""",
    "pix",
)
def r34(d: Domain) -> DataFrame:
    """Pixels of tiles of 8 with a halo of 2; halo pixels repeat."""
    t = grids.tiled(d.pixels, 8, 2, 16, 16)
    return t.groupBy("image_id", "ty", "tx").agg(F.count("*").alias("n"), F.count_if("core").alias("core"), r(F.sum("data"), "s"))


@query(
    "f9_tile_extents",
    """with i as (select image_id, 10 + zone % 9 h, 7 + zone % 12 w from frames) select image_id, cast(ty as int) ty, cast(tx as int) tx, cast(ty * 6 as int) ty_lo, cast(least(ty * 6 + 6, h) as int) ty_hi, cast(ty * 6 - 2 as int) ty_pad_lo, cast(least(ty * 6 + 6, h) + 2 as int) ty_pad_hi,
 cast(tx * 6 as int) tx_lo, cast(least(tx * 6 + 6, w) as int) tx_hi, cast(tx * 6 - 2 as int) tx_pad_lo, cast(least(tx * 6 + 6, w) + 2 as int) tx_pad_hi from i, range(0, 4) a(ty), range(0, 4) b(tx) where ty * 6 < h and tx * 6 < w""",
    "frames",
)
def f9(d: Domain) -> DataFrame:
    """Ranges of the tiles of images of several sizes; cores end at the image."""
    i = d.frames.select("image_id", (10 + F.col("zone") % 9).cast("int").alias("h"), (7 + F.col("zone") % 12).cast("int").alias("w"))
    return grids.tile_extents(i, "image_id", 6, 2)


@query(
    "r36_tiled_photometry",
    """with ts as (select src_id, image_id, x0, y0, sigma, tx, ty, x0 >= tx * 8 and x0 < tx * 8 + 8 and y0 >= ty * 8 and y0 < ty * 8 + 8 core from src, range(0, 2) a(tx), range(0, 2) b(ty) where x0 >= tx * 8 - 2 and x0 < tx * 8 + 10 and y0 >= ty * 8 - 2 and y0 < ty * 8 + 10),
 p as (select image_id, x, y, "data", iv, tx, ty from good, range(0, 2) a(tx), range(0, 2) b(ty) where y between ty * 8 - 2 and ty * 8 + 9 and x between tx * 8 - 2 and tx * 8 + 9),
 t as (select src_id, ts.image_id, "data", iv, exp(-5e-1 * ((x - x0) * (x - x0) + (y - y0) * (y - y0)) / (sigma * sigma)) / (2 * pi() * sigma * sigma) a from ts join p on ts.image_id = p.image_id and ts.tx = p.tx and ts.ty = p.ty and core and x between x0 - 5e0 * sigma and x0 + 5e0 * sigma and y between y0 - 5e0 * sigma and y0 + 5e0 * sigma),
 ne as (select src_id, image_id, sum(a * a * iv) aa, sum(a * iv) ab, sum(iv) bb, sum(a * "data" * iv) ad, sum("data" * iv) bd, count(*) npix from t group by 1, 2)
 select src_id, image_id, npix, round((bb * ad - ab * bd) / (aa * bb - ab * ab), 6) flux from ne where aa * bb - ab * ab > 1e-9""",
    "src good",
)
def r36(d: Domain) -> DataFrame:
    """Each source is fit in the tile whose core has it, on that tile's pixels only."""
    own = spatial.assign_tiles(d.sources, 8, 2.0, 2, 2).where("core")
    pixels = grids.tiled(d.good, 8, 2, 16, 16).select("image_id", "tx", "ty", "x", "y", "data", "iv")
    key = lambda df: df.withColumn("image_id", F.struct("image_id", "tx", "ty")).drop("tx", "ty")  # noqa: E731  a tile is an image of its own
    t = photometry.templates(key(own), key(pixels)).withColumn("image_id", F.col("image_id.image_id"))
    return photometry.fit_with_background(t, ["src_id", "image_id"]).select("src_id", "image_id", "npix", r(F.col("flux"), "flux"))
