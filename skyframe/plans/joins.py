"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import spatial
from ..operators.stamps import combine
from .domain import Domain
from .registry import query
from .scalars import r


@query("j1_equi", "select image_id, zone, n_name from frames join nation on zone = n_nationkey", "frames")
def j1(d: Domain) -> DataFrame:
    """Artifacts with their plane, by key."""
    return d.frames.join(d.table("nation"), F.col("zone") == F.col("n_nationkey")).select("image_id", "zone", "n_name")


@query("j2_in_footprint", "select src_id from src where (x0 - 2e0) * 2e0 - (y0 - 1e0) * -1e0 >= -1e9 and 12e0 * (y0 - 1e0) - 2e0 * (x0 - 1e0) >= 0 and -2e0 * (y0 - 3e0) - 1e1 * (x0 - 13e0) >= 0 and -1e1 * (y0 - 13e0) - -12e0 * (x0 - 11e0) >= 0", "src")
def j2(d: Domain) -> DataFrame:
    """Points in a convex footprint."""
    inside = spatial.in_polygon(F.col("x0"), F.col("y0"), [(1.0, 1.0), (13.0, 3.0), (11.0, 13.0)])
    return d.sources.where(inside).select("src_id")


@query("j3_cone", "select src_id, target, round(sep, 6) separation from (select src_id, zone_id target, degrees(acos(greatest(-1e0, least(1e0, sin(radians(\"dec\")) * sin(radians(zy * 4e0 - 3e1)) + cos(radians(\"dec\")) * cos(radians(zy * 4e0 - 3e1)) * cos(radians(ra - zx * 2e1)))))) sep from src, zones) t where sep <= 6e0", "src zones")
def j3(d: Domain) -> DataFrame:
    """Cone searches around many targets, by bands of declination."""
    targets = d.zones.select(F.col("zone_id").alias("target"), (F.col("zx") * 20.0).alias("ra"), (F.col("zy") * 4.0 - 30.0).alias("dec"))
    return spatial.cones(d.sources, targets, 6.0, "src_id").select("src_id", "target", r(F.col("separation"), "separation"))


@query("j3_cone_single", "select src_id from src where \"dec\" between 1e1 - 15e0 and 1e1 + 15e0 and degrees(acos(greatest(-1e0, least(1e0, sin(radians(\"dec\")) * sin(radians(1e1)) + cos(radians(\"dec\")) * cos(radians(1e1)) * cos(radians(ra - 1e2)))))) <= 15e0", "src")
def j3_single(d: Domain) -> DataFrame:
    """One cone with its projection list."""
    return spatial.cone(d.sources, 100.0, 10.0, 15.0).select("src_id")


@query("j4_source_by_image", "select s.src_id, f.image_id, round(s.x0 + f.sky, 6) x from src s join frames f on f.image_id between s.image_id and s.image_id + 2", "src frames")
def j4(d: Domain) -> DataFrame:
    """Every source on each of the images that see it. An image goes to the keys it covers, so the join is by key."""
    seen = d.frames.select(F.col("image_id").alias("on"), "sky", F.explode(F.sequence(F.col("image_id") - 2, F.col("image_id"))).alias("image_id"))
    return d.sources.join(seen, "image_id").select("src_id", F.col("on").alias("image_id"), r(F.col("x0") + F.col("sky"), "x"))


@query("j5_tile_assignment", "select src_id, cast(tx as int) tx, cast(ty as int) ty, x0 >= tx * 4 and x0 < tx * 4 + 4 and y0 >= ty * 4 and y0 < ty * 4 + 4 core from src, range(0, 4) a(tx), range(0, 4) b(ty) where x0 >= tx * 4 - 1 and x0 < tx * 4 + 5 and y0 >= ty * 4 - 1 and y0 < ty * 4 + 5", "src")
def j5(d: Domain) -> DataFrame:
    """Tiles whose core and halo hold a source."""
    return spatial.assign_tiles(d.sources, 4, 1.0, 4, 4).select("src_id", "tx", "ty", "core")


@query("j6_footprint", "select src_id, count(*) npix, round(sum(\"data\"), 6) s from src join pix using (image_id) where x between x0 - 3e0 and x0 + 3e0 and y between y0 - 3e0 and y0 + 3e0 group by 1", "src pix")
def j6(d: Domain) -> DataFrame:
    """The pixels around each source."""
    return spatial.footprint(d.sources, d.pixels, F.lit(3.0)).groupBy("src_id").agg(F.count("*").alias("npix"), r(F.sum("data"), "s"))


@query("j7_nearest_zone", "select src_id, zone_id, round(d2, 6) d2 from (select src_id, zone_id, (x0-zx)*(x0-zx)+(y0-zy)*(y0-zy) d2, row_number() over (partition by src_id order by (x0-zx)*(x0-zx)+(y0-zy)*(y0-zy), zone_id) rn from src, zones) t where rn = 1", "src zones")
def j7(d: Domain) -> DataFrame:
    """Each source's nearest zone; the smaller number on a tie."""
    got = spatial.nearest(d.sources.select("src_id", "x0", "y0"), d.zones, "src_id", "zone_id", ("x0", "y0"), ("zx", "zy"), 3.0)
    return got.select("src_id", "zone_id", r(F.col("distance") * F.col("distance"), "d2"))


@query("j7_nearest_source", "select src_id, o_id, round(d2, 6) d2 from (select a.src_id, b.src_id o_id, (a.x0-b.y0)*(a.x0-b.y0)+(a.y0-b.x0)*(a.y0-b.x0) d2, row_number() over (partition by a.src_id order by (a.x0-b.y0)*(a.x0-b.y0)+(a.y0-b.x0)*(a.y0-b.x0), b.src_id) rn from (select * from src where src_type = 'PSF') a, (select * from src where src_type = 'DEV') b) t where rn = 1", "src")
def j7_sources(d: Domain) -> DataFrame:
    """Nearest rows of a table of any size, here between two types of sources."""
    left, right = d.sources.where("src_type = 'PSF'").select("src_id", "x0", "y0"), d.sources.where("src_type = 'DEV'").select(F.col("src_id").alias("o_id"), F.col("y0").alias("px"), F.col("x0").alias("py"))
    got = spatial.nearest(left, right, "src_id", "o_id", ("x0", "y0"), ("px", "py"), 0.5)
    return got.select("src_id", "o_id", r(F.col("distance") * F.col("distance"), "d2"))


@query("j8_first_plane", "select zone_id, min(vec_id) plane from embeddings join zones on label = zone_id group by 1", "zones")
def j8(d: Domain) -> DataFrame:
    """A zone's plane is the first stamp of it."""
    e = d.table("embeddings").select("vec_id", F.col("label").alias("zone_id"))
    return e.join(d.zones, "zone_id").groupBy("zone_id").agg(F.min("vec_id").alias("plane"))


@query("j9_main_source", "select zone_id target, src_id, round(sep, 6) sep from (select *, row_number() over (partition by zone_id order by sep, src_id) rn from (select zone_id, src_id, degrees(acos(greatest(-1e0, least(1e0, sin(radians(zy * 4e0 - 3e1)) * sin(radians(\"dec\")) + cos(radians(zy * 4e0 - 3e1)) * cos(radians(\"dec\")) * cos(radians(zx * 2e1 - ra)))))) sep from src, zones) q) t where rn = 1", "src zones")
def j9(d: Domain) -> DataFrame:
    """The catalog source nearest to each target on the sphere."""
    t = d.zones.select(F.col("zone_id").alias("target"), (F.col("zx") * 20.0).alias("ra"), (F.col("zy") * 4.0 - 30.0).alias("dec"))
    return spatial.nearest_on_sky(d.sources.select("src_id", "ra", "dec"), t, "src_id", 2.0).select("target", "src_id", r(F.col("separation"), "sep"))


@query(
    "j10_core_tile",
    """with p as (select src_id, x0 * 125e-2 - 2e0 x, y0 * 125e-2 - 2e0 y from src), t as (select cast(i as int) tile, (i % 4) * 4e0 tx, (i // 4) * 4e0 ty from range(0, 16) u(i))
 select src_id, tile from (select src_id, tile, row_number() over (partition by src_id order by not (x >= tx and x < tx + 4e0 and y >= ty and y < ty + 4e0), (x - tx - 2e0) * (x - tx - 2e0) + (y - ty - 2e0) * (y - ty - 2e0), tile) rn from p, t) q where rn = 1""",
    "src",
)
def j10(d: Domain) -> DataFrame:
    """The tile whose core has the source; else, outside of all, the one of nearest centre."""
    return d.sources.select("src_id", spatial.core_tile(F.col("x0") * 1.25 - 2.0, F.col("y0") * 1.25 - 2.0, 4.0, 4, 4).alias("tile"))


@query("j11_flux_slots", "select src_id, image_id, row_number() over (partition by image_id order by src_id) - 1 slot from src where src_type <> 'DUP'", "src")
def j11(d: Domain) -> DataFrame:
    """Each source's place in its image's flux vector."""
    w = Window.partitionBy("image_id").orderBy("src_id")
    return d.sources.where("src_type <> 'DUP'").select("src_id", "image_id", (F.row_number().over(w) - 1).cast("long").alias("slot"))


@query("j13_aligned_patches", "select coalesce(a.x, b.x) x, coalesce(a.y, b.y) y, coalesce(a.image_id, b.image_id) image_id, round(coalesce(a.\"data\", 0e0) + coalesce(b.\"data\", 0e0), 6) v from (select * from pix where x < 9) a full join (select * from pix where x > 6 and y < 12) b on a.image_id = b.image_id and a.x = b.x and a.y = b.y", "pix")
def j13(d: Domain) -> DataFrame:
    """Two patches over the union of their extents."""
    p = d.pixels.select("image_id", "y", "x", F.col("data").alias("value"))
    return combine(p.where("x < 9"), p.where("x > 6 and y < 12"), ["image_id", "y", "x"]).select("x", "y", "image_id", r(F.col("value"), "v"))


@query("j14_scatter", "select image_id, x, y, round(\"data\" + coalesce(s, 0e0), 6) v from pix left join (select image_id, cast(floor(x0) as int) x, cast(floor(y0) as int) y, sum(flux) s from src group by 1, 2, 3) t using (image_id, x, y)", "pix src")
def j14(d: Domain) -> DataFrame:
    """Values added to an image where they fall in it."""
    adds = d.sources.groupBy("image_id", F.floor("x0").cast("int").alias("x"), F.floor("y0").cast("int").alias("y")).agg(F.sum("flux").alias("s"))
    return d.pixels.join(adds, ["image_id", "x", "y"], "left").select("image_id", "x", "y", r(F.col("data") + F.coalesce("s", F.lit(0.0)), "v"))


@query("j15_brightest_pixel_source", "with b as (select image_id, x, y from (select *, row_number() over (partition by image_id order by \"data\" desc, y, x) rn from pix) t where rn = 1) select image_id, src_id, round(d2, 6) d2 from (select image_id, src_id, (x0 - x) * (x0 - x) + (y0 - y) * (y0 - y) d2, row_number() over (partition by image_id order by (x0 - x) * (x0 - x) + (y0 - y) * (y0 - y), src_id) rn from b join src using (image_id)) t where rn = 1", "pix src")
def j15(d: Domain) -> DataFrame:
    """Each image's brightest pixel, and the source nearest to it."""
    top = d.pixels.groupBy("image_id").agg(F.max(F.struct("data", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("b")).select("image_id", (-F.col("b.x")).alias("x"), (-F.col("b.y")).alias("y"))
    dx, dy = F.col("x0") - F.col("x"), F.col("y0") - F.col("y")
    best = top.join(d.sources, "image_id").groupBy("image_id").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "src_id")).alias("b"))
    return best.select("image_id", "b.src_id", r(F.col("b.d2"), "d2"))


@query("j16_result_comparison", "select a.target, a.exposure_id, b.exposure_id other, round(a.flux - b.flux, 6) diff from exposures a join exposures b on a.target = b.target and a.wavelength = b.wavelength and a.detector = 'click' and b.detector = 'view'", "exposures")
def j16(d: Domain) -> DataFrame:
    """Two results compared by target and wavelength."""
    e = d.exposures
    b = e.where("detector = 'view'").select("target", "wavelength", F.col("exposure_id").alias("other"), F.col("flux").alias("f2"))
    return e.where("detector = 'click'").join(b, ["target", "wavelength"]).select("target", "exposure_id", "other", r(F.col("flux") - F.col("f2"), "diff"))


@query("j17_mask_lookup", "select src_id, coalesce(m.zone_id, -1) mask from src left join (select zone_id from zones where zone_id % 2 = 0) m on cast(src.image_id as int) = m.zone_id", "src zones")
def j17(d: Domain) -> DataFrame:
    """A mask where there is one, else null."""
    m = d.zones.where("zone_id % 2 = 0").select(F.col("zone_id").alias("mask"), F.col("zone_id").cast("long").alias("image_id"))
    return d.sources.join(m, "image_id", "left").select("src_id", F.coalesce("mask", F.lit(-1)).alias("mask"))


@query("u4_overlapping_ranges", "select src_id, greatest(xlo, 3) a, least(xhi, 11) b, greatest(xlo, 3) - xlo ia, least(xhi, 11) - xlo ib from (select src_id, cast(floor(x0) as int) - 2 xlo, cast(floor(x0) as int) + 2 xhi from src) t where greatest(xlo, 3) <= least(xhi, 11)", "src")
def u4(d: Domain) -> DataFrame:
    """The overlap of two ranges, from either's start."""
    from ..operators.stamps import overlap

    t = d.sources.select("src_id", (F.floor("x0").cast("int") - 2).alias("lo"), (F.floor("x0").cast("int") + 2).alias("hi"))
    a, b, ia, ib = overlap(F.col("lo"), F.col("hi"), F.lit(3), F.lit(11))
    return t.select("src_id", a.alias("a"), b.alias("b"), ia.alias("ia"), ib.alias("ib")).where("a <= b")


@query("u5_masked_nonzero", "select image_id, count(*) n from good where bad and \"data\" <> 0 group by 1", "good")
def u5(d: Domain) -> DataFrame:
    """Non-zero pixels that are masked."""
    return d.good.where("bad and data <> 0").groupBy("image_id").agg(F.count("*").alias("n"))


@query("u6_members", "select src_id from src where src_type = 'PSF' union all select src_id + 1000000 from src where src_type = 'EXP' and src_id not in (select src_id from src where re > 2)", "src")
def u6(d: Domain) -> DataFrame:
    """Members appended and removed."""
    s = d.sources
    more = s.where("src_type = 'EXP'").join(s.where("re > 2").select("src_id"), "src_id", "left_anti").select((F.col("src_id") + 1000000).alias("src_id"))
    return s.where("src_type = 'PSF'").select("src_id").unionByName(more)
