"""Column functions over the derived tables: magnitudes, coordinates, ellipses, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ellipses, mixtures, photometry, sky
from .domain import Domain, wcs_columns
from .registry import query


def r(x: Column, name: str, digits: int = 6) -> Column:
    return F.round(x, digits).alias(name)


@query("m1_nanomaggies", "select src_id, round(-25e-1 * (log10(flux) - 9e0), 6) mag, round(pow(1e1, (-25e-1 * (log10(flux) - 9e0) - 225e-1) / -25e-1) , 4) flux_back from catalog where flux > 0", "catalog")
def m1(d: Domain) -> DataFrame:
    """M1: nanomaggies to magnitudes and back."""
    mag = photometry.nanomaggies_to_mag(F.col("flux"))
    return d.catalog.where("flux > 0").select("src_id", r(mag, "mag"), r(photometry.mag_to_nanomaggies(mag), "flux_back", 4))


@query("m2_zeropoints", "select image_id, round(pow(1e1, (zp - 225e-1) / 25e-1), 6) scale, round(225e-1 + 25e-1 * log10(pow(1e1, (zp - 225e-1) / 25e-1)), 6) zp_back from frames", "frames")
def m2(d: Domain) -> DataFrame:
    """M2: zeropoint to scale and back."""
    scale = photometry.zeropoint_to_scale(F.col("zp"))
    return d.frames.select("image_id", r(scale, "scale"), r(photometry.scale_to_zeropoint(scale), "zp_back"))


@query("m3_mag_errors", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(-25e-1*(log10(l_extendedprice)-9e0),6) mag, case when l_tax>0 then round(25e-1/ln(1e1)/sqrt(l_tax)/l_extendedprice,9) end dmag from lineitem where l_extendedprice>0")
def m3(d: Domain) -> DataFrame:
    """M3: flux and inverse variance to magnitude and its error."""
    f = F.col("l_extendedprice")
    return d.table("lineitem").where("l_extendedprice > 0").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(photometry.nanomaggies_to_mag(f), "mag"), r(photometry.mag_error(f, F.col("l_tax")), "dmag", 9))


@query("m4_magnitude_sums", "select p_partkey src_id, round(-25e-1 * log10(pow(1e1, (1e1 + p_size / 1e1) / -25e-1) + pow(1e1, (15e0 + p_size / 2e1) / -25e-1)), 6) mag, round(1e1 + p_size / 1e1 - 25e-1 * log10(abs(p_retailprice / 1e3)), 6) scaled from part")
def m4(d: Domain) -> DataFrame:
    """M4: magnitudes add in flux; scaling by a factor's size."""
    a, b = 10.0 + F.col("p_size") / 10.0, 15.0 + F.col("p_size") / 20.0
    return d.table("part").select(F.col("p_partkey").alias("src_id"), r(photometry.add_mags(a, b), "mag"), r(photometry.scale_mag(a, F.col("p_retailprice") / 1000.0), "scaled"))


@query("m5_band_fluxes", "select target, band, round(sum(flux), 4) flux, round(sum(flux) * 2e0, 4) doubled, count(*) n from catalog group by 1, 2", "catalog")
def m5(d: Domain) -> DataFrame:
    """M5: fluxes by band added and scaled, in long form."""
    return d.catalog.groupBy("target", "band").agg(r(F.sum("flux"), "flux", 4), r(F.sum("flux") * 2.0, "doubled", 4), F.count("*").alias("n"))


@query(
    "m6_counts",
    """select src_id, image_id, kind, round(case kind when 'mag' then case when flux / 1e1 - 7e1 > 50 then 0e0 else pow(1e1, (zp - (flux / 1e1 - 7e1)) / 25e-1) end
  when 'linear' then (flux / 1e1 - 7e1) * 15e-1 else flux / 1e1 - 7e1 end, 6) counts from src join frames using (image_id)""",
    "src frames",
)
def m6(d: Domain) -> DataFrame:
    """M6: brightness to counts under each kind of calibration."""
    rows = d.sources.join(d.frames, "image_id")
    return rows.select("src_id", "image_id", "kind", r(photometry.counts(F.col("kind"), F.col("flux") / 10.0 - 70.0, F.lit(1.5), F.col("zp")), "counts"))


@query("m7_millijansky", "select src_id, round(flux * 3.631e-3, 5) mjy, round(1e0 / sqrt(ivar) * 3.631e-3, 9) sigma from catalog", "catalog")
def m7(d: Domain) -> DataFrame:
    """M7: nanomaggies to millijansky, and the error from the inverse variance."""
    return d.catalog.select("src_id", r(photometry.to_millijansky(F.col("flux")), "mjy", 5), r(photometry.to_millijansky(photometry.sigma(F.col("ivar"))), "sigma", 9))


@query("m8_separation", "select src_id, round(degrees(acos(greatest(-1e0, least(1e0, sin(radians(\"dec\")) * sin(radians(5e0)) + cos(radians(\"dec\")) * cos(radians(5e0)) * cos(radians(ra - 12e1)))))), 6) sep from src", "src")
def m8(d: Domain) -> DataFrame:
    """M8: great-circle distance by the clipped arc cosine."""
    return d.sources.select("src_id", r(sky.separation(F.col("ra"), F.col("dec"), F.lit(120.0), F.lit(5.0)), "sep"))


_UV = """uv as (select src_id, frames.*, degrees(cos(radians(d)) * sin(radians(a - crval1))) u, degrees(sin(radians(d)) * cos(radians(crval2)) - cos(radians(d)) * sin(radians(crval2)) * cos(radians(a - crval1))) v
  from (select src_id, image_id, x0 / 1e2 - 8e-2 + crval1 a, y0 / 1e2 - 8e-2 + crval2 d from src join frames using (image_id)) s join frames using (image_id)),
 px as (select *, cd11 * cd22 - cd12 * cd21 det, crpix1 + (cd22 * u - cd12 * v) / (cd11 * cd22 - cd12 * cd21) x, crpix2 + (cd11 * v - cd21 * u) / (cd11 * cd22 - cd12 * cd21) y from uv)"""


def _projected(d: Domain) -> DataFrame:
    rows = d.sources.join(d.frames, "image_id")
    rows = rows.withColumn("a", F.col("x0") / 100.0 - 0.08 + F.col("crval1")).withColumn("d", F.col("y0") / 100.0 - 0.08 + F.col("crval2"))
    x, y = sky.affine_to_pixel(F.col("a"), F.col("d"), wcs_columns())
    return rows.withColumn("x", x).withColumn("y", y)


@query(
    "m9_affine_wcs",
    f"with {_UV} select src_id, round(x, 6) x, round(y, 6) y, round(crval1 + (cd11 * (x - crpix1) + cd12 * (y - crpix2)) / cos(radians(crval2 + cd21 * (x - crpix1) + cd22 * (y - crpix2))), 6) ra_back, round(crval2 + cd21 * (x - crpix1) + cd22 * (y - crpix2), 6) dec_back from px",
    "src frames",
)
def m9(d: Domain) -> DataFrame:
    """Catalog positions to pixels by an affine transform, and the approximate inverse."""
    a, b = sky.affine_to_sky(F.col("x"), F.col("y"), wcs_columns())
    return _projected(d).select("src_id", r(F.col("x"), "x"), r(F.col("y"), "y"), r(a, "ra_back"), r(b, "dec_back"))


@query(
    "m10_pixel_scale",
    "select image_id, round(3600e0 * sqrt(abs(cd11 * cd22 - cd12 * cd21)), 6) scale, round(crpix1 - 3e0, 6) shifted1, round((crpix2 - 5e-1) / 2e0 + 5e-1, 6) halved2, round(cd11 * 2e0, 9) halved11, round(crpix1 + 1e0, 6) fits1, (crval1 - 2e2) - 360e0 * floor((crval1 - 2e2) / 360e0) wrapped from frames",
    "frames",
)
def m10(d: Domain) -> DataFrame:
    """Pixel scale; a transform shifted, rescaled and counted from 1; a wrapped right ascension."""
    w = wcs_columns()
    moved, half, fits = sky.shifted(w, 3.0, 0.0), sky.rescaled(w, 2.0), sky.counted_from_one(w)
    return d.frames.select("image_id", r(sky.pixel_scale(w), "scale"), r(moved["crpix1"], "shifted1"), r(half["crpix2"], "halved2"), r(half["cd11"], "halved11", 9), r(fits["crpix1"], "fits1"), sky.wrapped(w["crval1"] - 200.0).alias("wrapped"))


@query(
    "m10_tangent_wcs",
    """with s as (select src_id, frames.*, x0 / 1e2 - 8e-2 + crval1 a, y0 / 1e2 - 8e-2 + crval2 d from src join frames using (image_id)),
 c as (select *, sin(radians(crval2)) * sin(radians(d)) + cos(radians(crval2)) * cos(radians(d)) * cos(radians(a - crval1)) c from s),
 uv as (select *, degrees(cos(radians(d)) * sin(radians(a - crval1)) / c) u, degrees((cos(radians(crval2)) * sin(radians(d)) - sin(radians(crval2)) * cos(radians(d)) * cos(radians(a - crval1))) / c) v from c)
 select src_id, round(crpix1 + (cd22 * u - cd12 * v) / (cd11 * cd22 - cd12 * cd21), 6) x, round(crpix2 + (cd11 * v - cd21 * u) / (cd11 * cd22 - cd12 * cd21), 6) y, round(cast(((a % 360e0) + 360e0) % 360e0 as double), 5) ra_back, round(d, 5) dec_back from uv""",
    "src frames",
)
def m10_tangent(d: Domain) -> DataFrame:
    """Gnomonic projection to pixels and back, under a small distortion that is taken out again."""
    rows, w = _projected(d), wcs_columns()
    x, y = sky.TRANSFORMS["tangent"][0](F.col("a"), F.col("d"), w)
    bend = ({(2, 0): 1e-4, (1, 1): -5e-5}, {(0, 2): 2e-4})
    bx, by = sky.distorted(F.col("tx"), F.col("ty"), w, *bend)
    rows = rows.withColumn("tx", x).withColumn("ty", y).withColumn("bx", bx).withColumn("by", by)
    ux, uy = sky.undistorted(F.col("bx"), F.col("by"), w, *bend)
    ra, dec = sky.TRANSFORMS["tangent"][1](ux, uy, w)
    return rows.select("src_id", r(F.col("tx"), "x"), r(F.col("ty"), "y"), r(ra, "ra_back", 5), r(dec, "dec_back", 5))


@query("m12_position_derivatives", "select src_id, round((sigma * cd22 - ab * cd21) / (cd11 * cd22 - cd12 * cd21), 6) dra, round((ab * cd11 - sigma * cd12) / (cd11 * cd22 - cd12 * cd21), 6) ddec from src join frames using (image_id)", "src frames")
def m12(d: Domain) -> DataFrame:
    """Derivatives by pixel to derivatives by position."""
    a, b = sky.pixel_to_position_derivatives(F.col("sigma"), F.col("ab"), wcs_columns())
    return d.sources.join(d.frames, "image_id").select("src_id", r(a, "dra"), r(b, "ddec"))


@query("m14_pixel_area", "select image_id, x, y, round(abs((lead(ra, 1, ra) over w - lag(ra, 1, ra) over w) * cd22) * 1e6, 6) area from (select image_id, x, y, cd22, crval1 + cd11 * (x - crpix1) + cd12 * (y - crpix2) ra from pix join frames using (image_id)) t window w as (partition by image_id, y order by x)", "pix frames")
def m14(d: Domain) -> DataFrame:
    """Pixel area from the differences of sky coordinates between neighbours."""
    from pyspark.sql import Window

    w = Window.partitionBy("image_id", "y").orderBy("x")
    ra = F.col("crval1") + F.col("cd11") * (F.col("x") - F.col("crpix1")) + F.col("cd12") * (F.col("y") - F.col("crpix2"))
    rows = d.pixels.join(d.frames, "image_id").withColumn("ra", ra)
    step = F.coalesce(F.lead("ra").over(w), F.col("ra")) - F.coalesce(F.lag("ra").over(w), F.col("ra"))
    return rows.select("image_id", "x", "y", r(F.abs(step * F.col("cd22")) * 1e6, "area"))


def _pixel(a: str, d: str) -> tuple[str, str]:
    """An affine transform of a position, in SQL."""
    u, v = f"degrees(cos(radians({d})) * sin(radians({a} - crval1)))", f"degrees(sin(radians({d})) * cos(radians(crval2)) - cos(radians({d})) * sin(radians(crval2)) * cos(radians({a} - crval1)))"
    return f"(cd22 * {u} - cd12 * {v}) / (cd11 * cd22 - cd12 * cd21)", f"(cd11 * {v} - cd21 * {u}) / (cd11 * cd22 - cd12 * cd21)"


_HERE, _EAST, _NORTH = _pixel("a", "d"), _pixel("(a + 1e0 / 36e2 / cos(radians(d)))", "d"), _pixel("a", "(d + 1e0 / 36e2)")


@query(
    "m15_pixel_position_angle",
    f"""with s as (select src_id, phi, frames.*, x0 / 1e2 - 8e-2 + crval1 a, y0 / 1e2 - 8e-2 + crval2 d from src join frames using (image_id)),
 p as (select src_id, phi, {_HERE[0]} hx, {_HERE[1]} hy, {_EAST[0]} ex, {_EAST[1]} ey, {_NORTH[0]} nx, {_NORTH[1]} ny from s)
 select src_id, round(degrees(atan2((ey - hy) * cos(radians(phi)) + (ny - hy) * sin(radians(phi)), (ex - hx) * cos(radians(phi)) + (nx - hx) * sin(radians(phi)))), 4) angle from p""",
    "src frames",
)
def m15(d: Domain) -> DataFrame:
    """An angle on the sky as an angle in the image, at each source's place."""
    return _projected(d).select("src_id", r(sky.pixel_position_angle(F.col("phi"), F.col("a"), F.col("d"), wcs_columns(), "affine"), "angle", 4))


@query(
    "m16_ellipses",
    """with q as (select *, least(sqrt(e1 * e1 + e2 * e2), 999999e-6) e, sigma + 1e0 vxx, e1 vxy, ab + 1e0 vyy, sqrt(25e-2 * (sigma - ab) * (sigma - ab) + e1 * e1) half from src),
 c as (select *, sqrt((vxx + vyy) / 2e0 + half) radius, sqrt(((vxx + vyy) / 2e0 - half) / ((vxx + vyy) / 2e0 + half)) ratio from q)
 select src_id, round((1e0 - ab) / (1e0 + ab) * cos(-2e0 * radians(phi)), 6) c1, round((1e0 - ab) / (1e0 + ab) * sin(-2e0 * radians(phi)), 6) c2,
  round(case when e = 0 then 0e0 else least(1e0 - exp(-sqrt(e1 * e1 + e2 * e2)), 999999e-6) * e1 / sqrt(e1 * e1 + e2 * e2) end, 6) h1, round(case when e = 0 then 0e0 else least(1e0 - exp(-sqrt(e1 * e1 + e2 * e2)), 999999e-6) * e2 / sqrt(e1 * e1 + e2 * e2) end, 6) h2,
  round(case when e = 0 then 0e0 else -ln(1e0 - e) * e1 / e end, 6) s1, round(case when e = 0 then 0e0 else -ln(1e0 - e) * e2 / e end, 6) s2,
  round(radius, 6) radius, round(case when half = 0 then 0e0 else (1e0 - ratio) / (1e0 + ratio) * (vyy - vxx) / 2e0 / half end, 6) v1, round(case when half = 0 then 0e0 else (1e0 - ratio) / (1e0 + ratio) * vxy / half end, 6) v2 from c""",
    "src",
)
def m16(d: Domain) -> DataFrame:
    """Components of an axis ratio and angle, of softened ones and the other way, and of a covariance, with its radius."""
    e1, e2, cov = F.col("e1"), F.col("e2"), (F.col("sigma") + 1.0, F.col("e1"), F.col("ab") + 1.0)
    pairs = {"c": ellipses.components(F.col("ab"), F.col("phi")), "h": ellipses.hardened(e1, e2), "s": ellipses.softened(e1, e2), "v": ellipses.covariance_components(*cov)}
    return d.sources.select("src_id", *(r(x, f"{k}{i}") for k, v in pairs.items() for i, x in enumerate(v, 1)), r(ellipses.covariance_radius(*cov), "radius"))


@query("m17_detector_coordinates", "select image_id, x, y, round(1e0 + (x - (crpix1 - 1024e0)), 6) dx, round(1e0 + (y - (crpix2 - 512e0)), 6) dy, y * 16 + x flat from pix join frames using (image_id)", "pix frames")
def m17(d: Domain) -> DataFrame:
    """Cutout to detector coordinates; a pixel's flat index."""
    rows = d.pixels.join(d.frames, "image_id")
    return rows.select("image_id", "x", "y", r(1.0 + (F.col("x") - (F.col("crpix1") - 1024.0)), "dx"), r(1.0 + (F.col("y") - (F.col("crpix2") - 512.0)), "dy"), (F.col("y") * 16 + F.col("x")).alias("flat"))


@query("m19_parameter_arithmetic", "select src_id, round(x0 + y0, 6) s, round(x0 - y0, 6) d, round(x0 * 3e0, 6) p, round(x0 / sigma, 6) q from src", "src")
def m19(d: Domain) -> DataFrame:
    """Element-wise and scalar arithmetic of parameters."""
    x, y = F.col("x0"), F.col("y0")
    return d.sources.select("src_id", r(x + y, "s"), r(x - y, "d"), r(x * 3.0, "p"), r(x / F.col("sigma"), "q"))


@query("m22_time_differences", "select exposure_id, target, coalesce(date_diff('microsecond', lag(ts) over (partition by target order by ts, exposure_id), ts), 0) micros from exposures", "exposures")
def m22(d: Domain) -> DataFrame:
    """Time between a target's exposures."""
    from pyspark.sql import Window

    w = Window.partitionBy("target").orderBy("ts", "exposure_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return d.exposures.select("exposure_id", "target", F.coalesce(t - F.lag(t).over(w), F.lit(0)).cast("long").alias("micros"))


@query("m23_shifted_calibration", "select src_id, round(x0 + 25e-1, 6) sx, round(y0 - 15e-1, 6) sy, round(flux * 2e0, 6) scaled, round(sky * 2e0, 6) sky from src join frames using (image_id)", "src frames")
def m23(d: Domain) -> DataFrame:
    """What is shifted or scaled with an image."""
    return d.sources.join(d.frames, "image_id").select("src_id", r(F.col("x0") + 2.5, "sx"), r(F.col("y0") - 1.5, "sy"), r(F.col("flux") * 2.0, "scaled"), r(F.col("sky") * 2.0, "sky"))


@query("r12_lanczos", "select p_partkey src_id, round(case when t = 0 then 1e0 when abs(t) >= 3 then 0e0 else 3e0 * sin(pi() * t) * sin(pi() * t / 3e0) / (pi() * t * pi() * t) end, 9) w from (select p_partkey, (p_partkey % 81 - 40) / 1e1 t from part) q")
def r12(d: Domain) -> DataFrame:
    """The Lanczos-3 kernel."""
    return d.table("part").select(F.col("p_partkey").alias("src_id"), r(mixtures.lanczos((F.col("p_partkey") % 81 - 40) / 10.0), "w", 9))


@query("r37_surfaces", "select image_id, x, y, round(exp(-sqrt((x - 8e0) * (x - 8e0) + (y - 8e0) * (y - 8e0)) / 3e0), 9) e, round(exp(-pow(sqrt((x - 8e0) * (x - 8e0) + (y - 8e0) * (y - 8e0)) / 3e0, 25e-2)), 9) v from pix", "pix")
def r37(d: Domain) -> DataFrame:
    """Analytic exponential and fourth-root surfaces."""
    x, y = F.col("x") - 8.0, F.col("y") - 8.0
    q = F.sqrt(x * x + y * y) / 3.0
    return d.pixels.select("image_id", "x", "y", r(F.exp(-q), "e", 9), r(F.exp(-F.pow(q, F.lit(0.25))), "v", 9))
