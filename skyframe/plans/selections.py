"""Filters and computed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ellipses
from ..operators import spatial
from .domain import MASK, SOURCE, Domain
from .registry import query
from .scalars import r


@query("p1_without_duplicates", "select src_id, src_type from src where src_type <> 'DUP'", "src")
def p1(d: Domain) -> DataFrame:
    """Rows of type DUP go."""
    return d.sources.where("src_type <> 'DUP'").select("src_id", "src_type")


@query("p2_manifest", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal > 5e3)")
def p2(d: Domain) -> DataFrame:
    """A status filter, then membership as a semi join."""
    ok = d.table("supplier").where("s_acctbal > 5000").select("s_suppkey")
    return d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(ok, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").drop("l_suppkey")


@query("p3_first_n", "select image_id, zone from frames order by image_id limit 10", "frames")
def p3(d: Domain) -> DataFrame:
    """The first n by index."""
    return d.frames.select("image_id", "zone").orderBy("image_id").limit(10)


@query("p4_mask_bits", "select image_id, x, y, flags, (flags & 675396) <> 0 bad, (flags & 2097152) <> 0 on_source from pix", "pix")
def p4(d: Domain) -> DataFrame:
    """Bits of the flags."""
    f = F.col("flags")
    return d.pixels.select("image_id", "x", "y", "flags", (f.bitwiseAND(F.lit(MASK)) != 0).alias("bad"), (f.bitwiseAND(F.lit(SOURCE)) != 0).alias("on_source"))


@query("p5_background_mask", "select image_id, x, y, (flags & (675396 | 2097152)) <> 0 or not (var > 2e-2) masked from pix", "pix")
def p5(d: Domain) -> DataFrame:
    """P5: bad, on a source, or without a usable variance (here: not above 0.02)."""
    usable = F.col("var").isNotNull() & ~F.isnan("var") & (F.col("var") > 0.02)
    return d.pixels.select("image_id", "x", "y", ((F.col("flags").bitwiseAND(F.lit(MASK | SOURCE)) != 0) | ~usable).alias("masked"))


@query("p6_inverse_variance", "select image_id, x, y, round(iv, 6) iv from good", "good")
def p6(d: Domain) -> DataFrame:
    """Inverse variance, 0 where masked."""
    return d.good.select("image_id", "x", "y", r(F.col("iv"), "iv"))


@query("p7_background_subtraction", "select image_id, x, y, round(coalesce(\"data\" - bkg, 0e0), 6) sub from pix", "pix")
def p7(d: Domain) -> DataFrame:
    """Data without background, 0 where that isn't a number."""
    return d.pixels.select("image_id", "x", "y", r(F.coalesce(F.nanvl(F.col("data") - F.col("bkg"), F.lit(0.0)), F.lit(0.0)), "sub"))


@query("p8_unit_scaling", "select image_id, x, y, round(\"data\" * 2e-9 * 1e9, 6) img, round(bkg * 2e-9 * 1e9, 9) bkg, round(var * 2e-9 * 2e-9 * 1e18, 9) var from pix", "pix")
def p8(d: Domain) -> DataFrame:
    """Surface brightness to flux with the pixel's area."""
    area = 2e-9
    return d.pixels.select("image_id", "x", "y", r(F.col("data") * area * 1e9, "img"), r(F.col("bkg") * area * 1e9, "bkg", 9), r(F.col("var") * area * area * 1e18, "var", 9))


@query("p9_inside_image", "select src_id, x0 > 0 and x0 < 16 and y0 > 0 and y0 < 16 strict, x0 > -5e-1 and x0 < 155e-1 and y0 > -5e-1 and y0 < 155e-1 margin from src", "src")
def p9(d: Domain) -> DataFrame:
    """Positions inside the image, strictly and with half a pixel's margin."""
    x, y = F.col("x0"), F.col("y0")
    return d.sources.select("src_id", ((x > 0) & (x < 16) & (y > 0) & (y < 16)).alias("strict"), ((x > -0.5) & (x < 15.5) & (y > -0.5) & (y < 15.5)).alias("margin"))


@query("p10_inside_halo", "select src_id from src where x0 - 8e0 > -3e0 and x0 - 8e0 < 4e0 + 3e0 and y0 - 8e0 > -3e0 and y0 - 8e0 < 4e0 + 3e0", "src")
def p10(d: Domain) -> DataFrame:
    """P10: sources inside a cutout and its halo."""
    x, y = F.col("x0") - 8.0, F.col("y0") - 8.0
    return d.sources.where((x > -3) & (x < 7) & (y > -3) & (y < 7)).select("src_id")


@query("p11_box_filter", "select src_id from src where x0 >= 4e0 - 1e0 and x0 < 8e0 + 1e0 and y0 >= 2e0 - 1e0 and y0 < 12e0 + 1e0", "src")
def p11(d: Domain) -> DataFrame:
    """A half-open box with a margin."""
    return d.sources.where(spatial.in_box(F.col("x0"), F.col("y0"), F.lit(4.0), F.lit(8.0), F.lit(2.0), F.lit(12.0), 1.0)).select("src_id")


@query("p12_point_or_galaxy", "select src_id, case when re = 0 then 'PS' else 'GAL' end kind, src_type in ('PSF', 'EXP', 'DEV') simple from src", "src")
def p12(d: Domain) -> DataFrame:
    """Points have no radius; types that the fit takes."""
    return d.sources.select("src_id", F.when(F.col("re") == 0, "PS").otherwise("GAL").alias("kind"), F.col("src_type").isin("PSF", "EXP", "DEV").alias("simple"))


@query("p14_outside", "select src_id from src where not (x0 - 4e0 + 12e0 < 8e0 or x0 - 4e0 - 3e0 > 16e0 or y0 + 3e0 < 2e0 or y0 - 3e0 > 14e0)", "src")
def p14(d: Domain) -> DataFrame:
    """A source whose box lies outside the image is dropped early."""
    out = (F.col("x0") - 4.0 + 12.0 < 8.0) | (F.col("x0") - 4.0 - 3.0 > 16.0) | (F.col("y0") + 3.0 < 2.0) | (F.col("y0") - 3.0 > 14.0)
    return d.sources.where(~out).select("src_id")


@query("p15_overlapping_boxes", "select a.src_id a, b.src_id b from src a join src b on a.image_id = b.image_id and a.src_id < b.src_id and abs(a.x0 - b.x0) < 2e0 and abs(a.y0 - b.y0) < 2e0", "src")
def p15(d: Domain) -> DataFrame:
    """Pairs of an image whose boxes of 2 by 2 overlap. A source goes to the cells that its box touches, so pairs meet by key."""
    side = lambda v: F.explode(F.sequence(F.floor((F.col(v) - 1) / 2), F.floor((F.col(v) + 1) / 2)))
    cells = d.sources.select("image_id", "src_id", "x0", "y0", side("x0").alias("cx")).withColumn("cy", side("y0"))
    b = cells.select("image_id", "cx", "cy", F.col("src_id").alias("b"), F.col("x0").alias("bx"), F.col("y0").alias("by"))
    pairs = cells.join(b, ["image_id", "cx", "cy"]).where("src_id < b and abs(x0 - bx) < 2 and abs(y0 - by) < 2")
    return pairs.select(F.col("src_id").alias("a"), "b").distinct()


@query("p16_nonzero_overlap", "select a.image_id a, b.image_id b from pix a join pix b on b.image_id = a.image_id + 1 and a.x = b.x and a.y = b.y group by 1, 2 having sum(a.bkg * b.bkg) > 0", "pix")
def p16(d: Domain) -> DataFrame:
    """Neighbouring patches whose product isn't zero everywhere."""
    b = d.pixels.select((F.col("image_id") - 1).alias("a"), F.col("image_id").alias("b"), "x", "y", F.col("bkg").alias("vb"))
    return d.pixels.withColumnRenamed("image_id", "a").join(b, ["a", "x", "y"]).groupBy("a", "b").agg(F.sum(F.col("bkg") * F.col("vb")).alias("s")).where("s > 0").select("a", "b")


@query("p17_clipped", "select image_id, x, y, x - 4 cx, y - 2 cy from pix where x >= 4 and x < 12 and y >= 2 and y < 9", "pix")
def p17(d: Domain) -> DataFrame:
    """Clipped to a region, with coordinates of its own."""
    return d.pixels.where("x >= 4 and x < 12 and y >= 2 and y < 9").select("image_id", "x", "y", (F.col("x") - 4).alias("cx"), (F.col("y") - 2).alias("cy"))


@query("p18_trimmed", "with v as (select image_id, x, y, case when \"data\" > 3e1 then \"data\" else 0e0 end \"value\" from pix), box as (select image_id, min(x) a, max(x) b, min(y) c, max(y) e from v where \"value\" <> 0 group by 1) select image_id, x, y, round(\"value\", 6) v from v join box using (image_id) where x between a and b and y between c and e", "pix")
def p18(d: Domain) -> DataFrame:
    """Trimmed to the box of the non-zero pixels."""
    from ..operators.stamps import trimmed

    v = d.pixels.select("image_id", "x", "y", F.when(F.col("data") > 30, F.col("data")).otherwise(0.0).alias("value"))
    return trimmed(v, "image_id").select("image_id", "x", "y", r(F.col("value"), "v"))


@query(
    "p20_regions",
    """with t as (select src_id, greatest(0, cast(round_even(x0 - 2 * sigma, 0) as int)) xa, least(16, cast(round_even(x0 + 2 * sigma, 0) as int)) xb, greatest(0, cast(round_even(y0 - 2 * sigma, 0) as int)) ya, least(16, cast(round_even(y0 + 2 * sigma, 0) as int)) yb from src)
  select * from t where xa < xb and ya < yb""",
    "src",
)
def p20(d: Domain) -> DataFrame:
    """P20: a region around a centre, clipped to the image; empty ones go."""
    low = lambda v: F.greatest(F.lit(0), F.rint(F.col(v) - 2 * F.col("sigma")).cast("int"))
    high = lambda v: F.least(F.lit(16), F.rint(F.col(v) + 2 * F.col("sigma")).cast("int"))
    return d.sources.select("src_id", low("x0").alias("xa"), high("x0").alias("xb"), low("y0").alias("ya"), high("y0").alias("yb")).where("xa < xb and ya < yb")


@query("p21_zone_window", "with z as (select image_id, min(zx) xa, max(zx) xb from (select image_id, zx from src join zones on abs(x0 - zx) <= 15e-1 and abs(y0 - zy) <= 15e-1) q group by 1) select image_id, zone_id from z join zones on zx between xa and xb", "src zones")
def p21(d: Domain) -> DataFrame:
    """The zones between the nearest ones of both corners."""
    z = F.broadcast(d.zones)  # one row a zone of a fixed grid
    near = d.sources.join(z, (F.abs(F.col("x0") - F.col("zx")) <= 1.5) & (F.abs(F.col("y0") - F.col("zy")) <= 1.5))
    box = near.groupBy("image_id").agg(F.min("zx").alias("xa"), F.max("zx").alias("xb"))
    return box.join(z, F.col("zx").between(F.col("xa"), F.col("xb"))).select("image_id", "zone_id")


@query("p22_result_cuts", "select exposure_id from exposures where flux < 15e0 and wavelength > 2e0 and wavelength < 35e-1", "exposures")
def p22(d: Domain) -> DataFrame:
    """Cuts on flux and wavelength."""
    return d.exposures.where("flux < 15 and wavelength > 2 and wavelength < 3.5").select("exposure_id")


@query("p23_without_missing", "select image_id, zone from frames where image_id in (select image_id from pix)", "frames pix")
def p23(d: Domain) -> DataFrame:
    """Images without any data go."""
    return d.frames.select("image_id", "zone").join(d.pixels.select("image_id"), "image_id", "left_semi")


@query("p24_legal", "select src_id, re >= 0 and sqrt(e1 * e1 + e2 * e2) < 1 shape_ok, sersic >= 29e-2 and sersic <= 63e-1 sersic_ok from src", "src")
def p24(d: Domain) -> DataFrame:
    """Legal shapes and profile indices."""
    return d.sources.select("src_id", ((F.col("re") >= 0) & (F.hypot("e1", "e2") < 1)).alias("shape_ok"), F.col("sersic").between(0.29, 6.3).alias("sersic_ok"))


@query("p26_shapes", "select src_id, round((1e0-sqrt(e1*e1+e2*e2))/(1e0+sqrt(e1*e1+e2*e2)),6) ab, round(case when 5e-1*degrees(atan2(e2,e1))<0e0 then 5e-1*degrees(atan2(e2,e1))+180e0 else 5e-1*degrees(atan2(e2,e1)) end,6) phi from src", "src")
def p26(d: Domain) -> DataFrame:
    """Axis ratio and position angle of ellipticity components."""
    return d.sources.select("src_id", r(ellipses.axis_ratio(F.col("e1"), F.col("e2")), "ab"), r(ellipses.position_angle(F.col("e1"), F.col("e2")), "phi"))
