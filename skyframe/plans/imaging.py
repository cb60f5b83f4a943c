"""Stamps and patches: rebinning, shifting, resampling, gradients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stamps
from .domain import Domain
from .registry import query
from .scalars import r


@query("a23_rebin", "select image_id, cast(y // 3 as int) ry, cast(x // 5 as int) rx, round(sum(\"data\"), 6) flux, count(*) n from pix where y < 15 and x < 15 group by 1, 2, 3", "pix")
def a23(d: Domain) -> DataFrame:
    """Sums over blocks of 3 by 5, the rest cropped."""
    return stamps.block_sum(d.pixels, 3, 5, "image_id", value="data", height=16, width=16).select("image_id", "ry", "rx", r(F.col("flux"), "flux"), "n")


@query(
    "a24_half_sampling",
    """with c as (select psf_id, "value", case when y = 3 then 0 when y > 3 then (y - 2) // 2 else -((4 - y) // 2) end yy, case when x = 3 then 0 when x > 3 then (x - 2) // 2 else -((4 - x) // 2) end xx from stamps),
 s as (select psf_id, yy, xx, avg("value") v from c where abs(yy) <= 1 and abs(xx) <= 1 group by 1, 2, 3), n as (select psf_id, sum("value") tot from stamps group by 1)
 select psf_id, cast(yy + 1 as int) y, cast(xx + 1 as int) x, round(v * tot / sum(v) over (partition by psf_id), 6) v from s join n using (psf_id)""",
    "stamps",
)
def a24(d: Domain) -> DataFrame:
    """Odd stamps at half the sampling, their sum kept."""
    return stamps.halve(d.stamps, "psf_id", 7).select("psf_id", "y", "x", r(F.col("value"), "v"))


@query("a25_encircled_radius", "with q as (select psf_id, sqrt((y - 3) * (y - 3) + (x - 3) * (x - 3)) rad, sum(\"value\") over (partition by psf_id order by sqrt((y - 3) * (y - 3) + (x - 3) * (x - 3)), y, x rows between unbounded preceding and current row) cum, sum(\"value\") over (partition by psf_id) tot from stamps) select psf_id, round(min(rad), 6) r_eff from q where cum >= 9e-1 * tot group by 1", "stamps")
def a25(d: Domain) -> DataFrame:
    """Radius of 90 % of a stamp's flux."""
    return stamps.encircled_radius(d.stamps, "psf_id", 0.9, 3.0, 3.0).select("psf_id", r(F.col("r_eff"), "r_eff"))


_L = "(case when {t} = 0 then 1e0 when abs({t}) >= 3 then 0e0 else 3e0 * sin(pi() * ({t})) * sin(pi() * ({t}) / 3e0) / (pi() * ({t}) * pi() * ({t})) end)"


def _lanczos(t: str) -> str:
    return _L.format(t=t)


@query(
    "r13_lanczos_shift",
    f"""with k as (select i k from range(-3, 4) u(i)), p as (select psf_id, y, x, "value" v, (psf_id % 10) / 2e1 dx, -((psf_id % 7) / 14e0) dy from stamps),
 wx as (select psf_id, y, x - k x, dy, v * {_lanczos('k + dx')} / (select sum({_lanczos('j + dx')}) from range(-3, 4) s(j)) v from p, k),
 sx as (select psf_id, y, x, dy, sum(v) v from wx where x between 0 and 6 group by 1, 2, 3, 4),
 wy as (select psf_id, y - k y, x, v * {_lanczos('k + dy')} / (select sum({_lanczos('j + dy')}) from range(-3, 4) s(j)) v from sx, k)
 select psf_id, cast(y as int) y, cast(x as int) x, round(sum(v), 6) v from wy where y between 0 and 6 group by 1, 2, 3""",
    "stamps",
)
def r13(d: Domain) -> DataFrame:
    """Stamps moved by part of a pixel, in two passes of a Lanczos kernel."""
    return stamps.shift(d.stamps, "psf_id", -(F.col("psf_id") % 7 / 14.0), F.col("psf_id") % 10 / 20.0, 7, 7).select("psf_id", "y", "x", r(F.col("value"), "v"))


@query(
    "r16_lanczos_resample",
    f"""with p as (select psf_id, y, x, "value" v from stamps),
 sx as (select psf_id, y, q x, sum(v * {_lanczos('(25e-2 + q * 175e-2 - x) / 175e-2')} / 175e-2) v from p, range(0, 4) u(q) where abs(25e-2 + q * 175e-2 - x) <= 525e-2 group by 1, 2, 3),
 sy as (select psf_id, q y, x, sum(v * {_lanczos('q * 5e-1 - 5e-1 - y')}) v from sx, range(0, 9) u(q) where abs(q * 5e-1 - 5e-1 - y) <= 3e0 group by 1, 2, 3)
 select psf_id, cast(y as int) y, cast(x as int) x, round(v, 6) v from sy""",
    "stamps",
)
def r16(d: Domain) -> DataFrame:
    """Stamps on a grid of any start and step; fewer columns with a widened kernel, more rows with the kernel as it is."""
    return stamps.resample(d.stamps, "psf_id", (0.25, 1.75, 4), (-0.5, 0.5, 9)).select("psf_id", "y", "x", r(F.col("value"), "v"))


@query(
    "r17_downsampled",
    f"""with sx as (select psf_id, y, q x, sum("value" * {_lanczos('(375e-3 + q * 175e-2 - x) / 175e-2')}) / sum({_lanczos('(375e-3 + q * 175e-2 - x) / 175e-2')}) v from stamps, range(0, 4) u(q) where abs(375e-3 + q * 175e-2 - x) < 525e-2 group by 1, 2, 3),
 sy as (select psf_id, q y, x, sum(v * {_lanczos('(375e-3 + q * 175e-2 - y) / 175e-2')}) / sum({_lanczos('(375e-3 + q * 175e-2 - y) / 175e-2')}) v from sx, range(0, 4) u(q) where abs(375e-3 + q * 175e-2 - y) < 525e-2 group by 1, 2, 3)
 select psf_id, cast(y as int) y, cast(x as int) x, round(v * 30625e-4, 6) v from sy""",
    "stamps",
)
def r17(d: Domain) -> DataFrame:
    """Stamps of 7 by 7 on 4 by 4 pixels of the same field; flux stays, as the factor is no whole number by weights that add up to 1, times the area."""
    return stamps.downsampled(d.stamps, "psf_id", (7, 7), (4, 4)).select("psf_id", "y", "x", r(F.col("value"), "v"))


@query("r15_correlated", "select psf_id, y, x, round(sum(v), 6) v from (select psf_id, y, x - k + 1 x, \"value\" * ((psf_id + k) % 5) v from stamps, range(0, 3) u(k)) t where x between 0 and 6 group by 1, 2, 3", "stamps")
def r15(d: Domain) -> DataFrame:
    """Each stamp's rows correlated with a filter of its own."""
    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    filters = d.stamps.select("psf_id").distinct().withColumn("k", k).withColumn("weight", ((F.col("psf_id") + F.col("k")) % 5).cast("double"))
    return stamps.correlated(d.stamps.select("psf_id", "y", "x", "value"), filters, "psf_id", "x", 7, 3).select("psf_id", "y", "x", r(F.col("value"), "v"))


@query("r35_padded", "select s_suppkey image_id, cast(j as int) y, cast(i as int) x, round(coalesce(\"data\", 0e0), 6) v from supplier cross join range(0, 18) a(j) cross join range(0, 20) b(i) left join pix on image_id = s_suppkey and y = j and x = i", "pix")
def r35(d: Domain) -> DataFrame:
    """Images filled up with zeros to a larger shape."""
    images = d.table("supplier").select(F.col("s_suppkey").alias("image_id"))
    return stamps.padded(d.pixels.withColumnRenamed("data", "value"), images, "image_id", 18, 20).select("image_id", "y", "x", r(F.col("value"), "v"))


@query("r31_normalised_stamps", "select psf_id, y, x, round(\"value\" / sum(\"value\") over (partition by psf_id), 9) v from stamps", "stamps")
def r31(d: Domain) -> DataFrame:
    """Stamps of sum 1."""
    return stamps.normalise(d.stamps, "psf_id").select("psf_id", "y", "x", r(F.col("value"), "v", 9))


@query(
    "r33_bilinear",
    """with p as (select src_id point, src_id % 500 psf_id, x0 / 2e0 px, y0 / 2e0 py from src) select psf_id, point, round(sum((1e0 - abs(py - (floor(py) + j))) * (1e0 - abs(px - (floor(px) + i))) * coalesce("value", 0e0)), 6) v
 from p cross join range(0, 2) u(j) cross join range(0, 2) w(i) left join stamps s on s.psf_id = p.psf_id and s.y = floor(py) + j and s.x = floor(px) + i group by 1, 2""".replace("select psf_id, point", "select p.psf_id, point"),
    "src stamps",
)
def r33(d: Domain) -> DataFrame:
    """Bilinear samples of stamps."""
    p = d.sources.select(F.col("src_id").alias("point"), (F.col("src_id") % 500).alias("psf_id"), (F.col("x0") / 2.0).alias("px"), (F.col("y0") / 2.0).alias("py"))
    return stamps.bilinear(p, d.stamps, "psf_id").select("psf_id", "point", r(F.col("value"), "v"))


@query(
    "w4_gradients",
    """select image_id, y, x, round((coalesce(lead("data") over wx, "data") - coalesce(lag("data") over wx, "data")) / nullif(coalesce(lead(x) over wx, x) - coalesce(lag(x) over wx, x), 0), 6) dx,
 round((coalesce(lead("data") over wy, "data") - coalesce(lag("data") over wy, "data")) / nullif(coalesce(lead(y) over wy, y) - coalesce(lag(y) over wy, y), 0), 6) dy from pix window wx as (partition by image_id, y order by x), wy as (partition by image_id, x order by y)""",
    "pix",
)
def w4(d: Domain) -> DataFrame:
    """Central differences, one-sided at edges."""
    g = stamps.gradients(d.pixels, "image_id")
    return g.select("image_id", "y", "x", r(F.col("dx"), "dx"), r(F.col("dy"), "dy"))


@query("u2_patch_difference", "select image_id, y, x, round(sum(v), 6) v from (select image_id, y, x, \"data\" v from pix where x < 10 union all select image_id, y, x, -var v from pix where x > 4) t group by 1, 2, 3", "pix")
def u2(d: Domain) -> DataFrame:
    """A difference over the union of two extents."""
    a = d.pixels.where("x < 10").select("image_id", "y", "x", F.col("data").alias("value"))
    b = d.pixels.where("x > 4").select("image_id", "y", "x", F.col("var").alias("value"))
    return stamps.combine(a, b, ["image_id", "y", "x"], -1.0).select("image_id", "y", "x", r(F.col("value"), "v"))


@query("a32_patch_checks", "select image_id, round(sum(\"data\"), 4) total, bool_or(isnan(\"data\") or isinf(\"data\")) off, bool_and(\"data\" = 0) zero from pix group by 1", "pix")
def a32(d: Domain) -> DataFrame:
    """A patch's sum, and whether anything in it isn't finite or all is zero."""
    v = F.col("data")
    return d.pixels.groupBy("image_id").agg(r(F.sum(v), "total", 4), F.bool_or(F.isnan(v) | (F.abs(v) == float("inf"))).alias("off"), F.bool_and(v == 0).alias("zero"))
