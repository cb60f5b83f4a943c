"""Solves, statistics, top-n."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import background, grids, photometry, stamps
from .domain import Domain
from .registry import query
from .scalars import r

_T = "t as (select src_id, g.image_id, x, y, flux, \"data\", iv, exp(-5e-1 * ((x - x0) * (x - x0) + (y - y0) * (y - y0)) / (sigma * sigma)) / (2 * pi() * sigma * sigma) a from src join good g on src.image_id = g.image_id and x between x0 - 5e0 * sigma and x0 + 5e0 * sigma and y between y0 - 5e0 * sigma and y0 + 5e0 * sigma)"


def _templates(d: Domain) -> DataFrame:
    return photometry.templates(d.sources, d.good)


@query(
    "forced_photometry",
    f"""with {_T}, ne as (select src_id, image_id, sum(a * a * iv) aa, sum(a * iv) ab, sum(iv) bb, sum(a * "data" * iv) ad, sum("data" * iv) bd, count(*) npix from t group by 1, 2)
  select src_id, image_id, npix, round((bb * ad - ab * bd) / (aa * bb - ab * ab), 6) flux, round((aa * bd - ab * ad) / (aa * bb - ab * ab), 6) bkg, round(bb / (aa * bb - ab * ab), 6) fvar from ne where aa * bb - ab * ab > 1e-9""",
    "src good",
)
def forced_photometry(d: Domain) -> DataFrame:
    """Flux, background and variance of every source on its image."""
    got = photometry.fit_with_background(_templates(d), ["src_id", "image_id"])
    return got.select("src_id", "image_id", "npix", r(F.col("flux"), "flux"), r(F.col("bkg"), "bkg"), r(F.col("fvar"), "fvar"))


@query("a1_normal_equations", f"with {_T} select p.image_id, p.src_id i, q.src_id j, round(sum(p.a * q.a * p.iv), 6) f from t p join t q on p.image_id = q.image_id and p.x = q.x and p.y = q.y and p.src_id <= q.src_id group by 1, 2, 3", "src good")
def a1(d: Domain) -> DataFrame:
    """A1: the matrix of the joint fit of each image's sources."""
    return photometry.equations(_templates(d)).select("image_id", "i", "j", r(F.col("f"), "f"))


#: Gauss-Jordan elimination, a step an unknown: rows of each image's matrix, its right side and the unit matrix.
_SOLVED = """pr as (select p.image_id, p.src_id i, q.src_id j, sum(p.a * q.a * p.iv) f from t p join t q on p.image_id = q.image_id and p.x = q.x and p.y = q.y group by 1, 2, 3),
 rs as (select image_id, src_id i, sum(a * "data" * iv) r, sum(a * a * iv) d, count(*) npix from t group by 1, 2),
 wt as (select image_id, i, r, d, row_number() over (partition by image_id order by i) k, count(*) over (partition by image_id) n, sum(d) over (partition by image_id) / count(*) over (partition by image_id) * {ridge} more from rs where d > 0),
 fl as (select u.image_id, u.k, u.n, list(coalesce(f, 0e0) + case when u.k = v.k then u.more else 0e0 end order by v.k) own, list(case when u.k = v.k then 1e0 else 0e0 end order by v.k) unit, any_value(u.r) r from wt u join wt v on u.image_id = v.image_id left join pr on pr.image_id = u.image_id and pr.i = u.i and pr.j = v.i group by 1, 2, 3),
 m0 as (select image_id, any_value(n) n, list(list_concat(list_concat(own, [r]), unit) order by k) m from fl group by 1),
 el as (select image_id, n, 0 step, m from m0 union all
  select image_id, n, step + 1, list_transform(m, lambda w, k: case when k = step + 1 then list_transform(w, lambda v: v / m[step + 1][step + 1]) else list_transform(w, lambda v, c: v - w[step + 1] / m[step + 1][step + 1] * m[step + 1][c]) end) from el where step < n),
 sol as (select image_id, n, m from el where step = n)
 select rs.image_id, rs.i src_id"""
_JOINT = f"with recursive {_T}, {_SOLVED.format(ridge='1e-2')}, {{flux}}, round(case when rs.d > 0 then 1e0 / greatest(rs.d, 1e-12) end, 6) var_conditional, rs.npix from rs left join wt on wt.image_id = rs.image_id and wt.i = rs.i left join sol on sol.image_id = rs.image_id"


@query("a2_linear_solve")
def a2(d: Domain) -> DataFrame:
    """A2: all sources of an image at once, with a regularised solve. Some sources have the same template, so only the regularisation decides between them, beyond the digits of a twin."""
    got = photometry.solve(photometry.equations(_templates(d)))
    return got.select("image_id", "src_id", r(F.col("flux"), "flux"), r(F.col("var_marginal"), "var_marginal"), r(F.col("var_conditional"), "var_conditional"), "npix")


@query("a3_conjugate_gradients")
def a3(d: Domain) -> DataFrame:
    """A3: the same by preconditioned conjugate gradients."""
    got = photometry.solve(photometry.equations(_templates(d)), solver="cg")
    return got.select("image_id", "src_id", r(F.col("flux"), "flux", 3), r(F.col("var_conditional"), "var_conditional"), "npix")


@query("a2_ridge_solve", _JOINT.format(flux="round(m[k][sol.n + 1], 6) flux, round(m[k][sol.n + 1 + k], 6) var_marginal"), "src good")
def a2_ridge(d: Domain) -> DataFrame:
    """The joint solve under a regularisation that leaves one answer."""
    got = photometry.solve(photometry.equations(_templates(d)), rcond=1e-2)
    return got.select("image_id", "src_id", r(F.col("flux"), "flux"), r(F.col("var_marginal"), "var_marginal"), r(F.col("var_conditional"), "var_conditional"), "npix")


@query("a3_ridge_gradients", _JOINT.format(flux="round(m[k][sol.n + 1], 6) flux"), "src good")
def a3_ridge(d: Domain) -> DataFrame:
    """The same answer by conjugate gradients."""
    got = photometry.solve(photometry.equations(_templates(d)), solver="cg", rcond=1e-2, tol=1e-13)
    return got.select("image_id", "src_id", r(F.col("flux"), "flux"), r(F.col("var_conditional"), "var_conditional"), "npix")


@query("a4_fisher_diagonal", f"with {_T} select image_id, src_id, round(sum(a * a * iv), 6) f, round(sum(iv), 4) fb from t group by 1, 2", "src good")
def a4(d: Domain) -> DataFrame:
    """A4: the Fisher diagonal of each source and of a background."""
    return _templates(d).groupBy("image_id", "src_id").agg(r(F.sum(F.col("a") * F.col("a") * F.col("iv")), "f"), r(F.sum("iv"), "fb", 4))


_M = "m as (select image_id, y, x, sum(flux * a) model, any_value(\"data\") \"data\", any_value(iv) iv from t group by 1, 2, 3)"


@query("a5_model_image", f"with {_T}, {_M} select image_id, y, x, round(model + sky, 6) model from m join frames using (image_id)", "src good frames")
def a5(d: Domain) -> DataFrame:
    """Model images with sky."""
    m = photometry.model(_templates(d), F.col("flux")).join(d.frames.select("image_id", "sky"), "image_id")
    return m.select("image_id", "y", "x", r(F.col("model") + F.col("sky"), "model"))


@query("a7_design_matrix", f"with {_T} select image_id, src_id, y, x, round(a, 9) a from t", "src good")
def a7(d: Domain) -> DataFrame:
    """Templates as a long table."""
    return _templates(d).select("image_id", "src_id", "y", "x", r(F.col("a"), "a", 9))


@query("a8_chi_square", f"with {_T}, {_M} select image_id, round(sum((\"data\" - model) * (\"data\" - model) * iv), 2) chi2, cast(sum(case when iv > 0 then 1 else 0 end) as bigint) npix, round(-5e-1 * sum((\"data\" - model) * (\"data\" - model) * iv), 2) loglike from m group by 1", "src good")
def a8(d: Domain) -> DataFrame:
    """Chi-square, pixels and log-likelihood of each image."""
    got = photometry.chi_square(photometry.model(_templates(d), F.col("flux")), "image_id")
    return got.select("image_id", r(F.col("chi2"), "chi2", 2), "npix", r(F.col("loglike"), "loglike", 2))


@query("a9_log_posterior", f"with {_T}, {_M}, l as (select image_id, -5e-1 * sum((\"data\" - model) * (\"data\" - model) * iv) ll from m group by 1), p as (select image_id, -5e-1 * sum(((sigma - 15e-1) / 3e-1) * ((sigma - 15e-1) / 3e-1)) lp, max(ab) worst from src group by 1) select image_id, case when worst > 85e-2 and image_id % 2 = 0 then null else round(lp + ll, 2) end logprob from p join l using (image_id)", "src good")
def a9(d: Domain) -> DataFrame:
    """Prior and likelihood; an impossible prior needs no likelihood (null)."""
    like = photometry.chi_square(photometry.model(_templates(d), F.col("flux")), "image_id").select("image_id", "loglike")
    z = (F.col("sigma") - 1.5) / 0.3
    prior = d.sources.groupBy("image_id").agg((-0.5 * F.sum(z * z)).alias("lp"), F.max("ab").alias("worst"))
    out = F.when((F.col("worst") > 0.85) & (F.col("image_id") % 2 == 0), F.lit(None)).otherwise(F.round(F.col("lp") + F.col("loglike"), 2))
    return prior.join(like, "image_id").select("image_id", out.alias("logprob"))


@query("a11_forced_invvar", f"with {_T} select src_id, round(sum(a * 2e0 * sqrt(iv) * a * 2e0 * sqrt(iv)), 6) iv from t group by 1", "src good")
def a11(d: Domain) -> DataFrame:
    """Inverse variance of a flux that is forced alone."""
    v = F.col("a") * 2.0 * F.sqrt("iv")
    return _templates(d).groupBy("src_id").agg(r(F.sum(v * v), "iv"))


@query(
    "a13_profile_statistics",
    f"""with {_T}, {_M}, j as (select t.*, model, a <> 0 and t.iv > 0 ok from t join m using (image_id, y, x) where flux <> 0),
 e as (select src_id, image_id, sum(a * ("data" - model) * ("data" - model) * iv) filter (ok) prochi2, sum(a) filter (ok) pronpix, coalesce(sum(a) filter (iv = 0), 0e0) promasked, sum(abs(model / flux - a) * a) filter (ok) / sum(a * a) filter (ok) num,
  sum(a / abs(flux)) filter (ok) den, sum(abs(model - a * flux) * a) filter (ok) proflux, count(*) filter (ok) n, sum(a) ins, sum(a * "data") filter (ok) weighed from j group by 1, 2)
 select src_id, round(sum(prochi2), 2) prochi2, round(sum(pronpix), 6) pronpix, round(sum(promasked), 6) promasked, round(sum(num) / greatest(1e0, sum(den)), 6) profracflux, round(sum(ins) / count(*), 6) fracin, round(sum(proflux), 4) proflux,
  cast(sum(n) as bigint) npix, round(sum(weighed), 6) weighed from e where n > 0 group by 1""",
    "src good",
)
def a13(d: Domain) -> DataFrame:
    """Profile-weighted statistics of each source, with a plane of the user's."""
    t = _templates(d)
    m = photometry.model(t, F.col("flux")).select("image_id", "y", "x", "model")
    got = photometry.profile_statistics(t.join(m, ["image_id", "y", "x"]).withColumn("weighed", F.col("data")), "src_id", extras=("weighed",))
    return got.select("src_id", r(F.col("prochi2"), "prochi2", 2), *(r(F.col(c), c) for c in ("pronpix", "promasked", "profracflux", "fracin", "weighed")), r(F.col("proflux"), "proflux", 4), F.col("npix").cast("long").alias("npix"))


@query("a15_assembled_images", f"with {_T} select image_id, y, x, round(sum(greatest(flux - 94e1, 5e0) * a), 6) mod, round(any_value(sqrt(iv)), 6) ie from t group by 1, 2, 3", "src good")
def a15(d: Domain) -> DataFrame:
    """Model and error images with a floor for the fluxes."""
    floor = F.greatest(F.col("flux") - 940.0, F.lit(5.0))
    return _templates(d).groupBy("image_id", "y", "x").agg(r(F.sum(floor * F.col("a")), "mod"), r(F.first(F.sqrt("iv")), "ie"))


@query(
    "a16_plane",
    """with g as (select image_id, cast(x as double) x, cast(y as double) y, "data" z, iv w from good where iv > 0),
 m as (select image_id, sum(w) s0, sum(w*x) sx, sum(w*y) sy, sum(w*x*x) sxx, sum(w*x*y) sxy, sum(w*y*y) syy, sum(w*z) sz, sum(w*x*z) sxz, sum(w*y*z) syz from g group by 1),
 e as (select *, s0*(sxx*syy-sxy*sxy)-sx*(sx*syy-sxy*sy)+sy*(sx*sxy-sxx*sy) det from m)
 select image_id, round((sz*(sxx*syy-sxy*sxy)-sx*(sxz*syy-sxy*syz)+sy*(sxz*sxy-sxx*syz))/det,6) a, round((s0*(sxz*syy-sxy*syz)-sz*(sx*syy-sxy*sy)+sy*(sx*syz-sxz*sy))/det,6) b, round((s0*(sxx*syz-sxz*sxy)-sx*(sx*syz-sxz*sy)+sz*(sx*sxy-sxx*sy))/det,6) c from e where abs(det)>1e-9""",
    "good",
)
def a16(d: Domain) -> DataFrame:
    """A weighted plane through each image's good pixels."""
    return photometry.plane(d.good, "image_id").select("image_id", *(r(F.col(c), c) for c in "abc"))


@query(
    "a17_meshed_background",
    """with b as (select image_id, y // 5 by_, x // 5 bx, median(case when not bad then "data" end) m from good group by 1, 2, 3), w as (select image_id, median(case when not bad then "data" end) mm from good group by 1),
 f as (select image_id, by_, bx, coalesce(m, mm) m from b join w using (image_id)), l as (select p.image_id, p.by_, p.bx, median(q.m) lv from f p join f q on p.image_id = q.image_id and abs(p.by_ - q.by_) <= 1 and abs(p.bx - q.bx) <= 1 group by 1, 2, 3),
 c as (select image_id, y, x, (y + 5e-1) / 5 - 5e-1 fy, (x + 5e-1) / 5 - 5e-1 fx, j, i from good, range(0, 2) u(j), range(0, 2) v(i)),
 e as (select image_id, y, x, (1e0 - abs(fy - (floor(fy) + j))) * (1e0 - abs(fx - (floor(fx) + i))) w, lv from c left join l using (image_id) where l.by_ = floor(fy) + j and l.bx = floor(fx) + i)
 select image_id, y, x, round(sum(w * lv) / sum(w), 6) background from e group by 1, 2, 3""",
    "good",
)
def a17(d: Domain) -> DataFrame:
    """Meshed background, box 5, filter 3."""
    p = d.good.select("image_id", "y", "x", "data", "bad")
    got = background.interpolated(p, background.mesh(p, "image_id", 5), "image_id", 5)
    return got.select("image_id", "y", "x", r(F.col("background"), "background"))


@query(
    "a18_quality_metrics",
    """with v as (select *, "data" - bkg clean, abs("data" - bkg) * sqrt(iv) snr, not bad and iv > 0 ok from good) select image_id, count(*) npix, round(avg(case when bad then 1e0 else 0e0 end), 6) mask_fraction, round(avg(case when ok then 1e0 else 0e0 end), 6) valid_fraction,
 round(median(bkg), 6) bkg_median, round(avg(bkg), 6) bkg_mean, round(stddev_pop(bkg), 6) bkg_std, round(median(clean) filter (ok), 6) data_median, round(stddev_pop(clean) filter (ok), 6) data_std, round(median(snr) filter (ok), 6) snr_median, round(avg(snr) filter (ok), 6) snr_mean from v group by 1""",
    "good",
)
def a18(d: Domain) -> DataFrame:
    """Quality metrics of each cutout; deviations are of the population."""
    got = photometry.quality(d.good, "image_id")
    return got.select("image_id", "npix", *(r(F.col(c), c) for c in got.columns if c not in ("image_id", "npix")))


@query("a19_result_diagnostics", "select detector, cast(sum(case when flux < 2e0 then 1 else 0 end) as bigint) low, cast(sum(case when isnan(flux) then 1 else 0 end) as bigint) nans, cast(sum(case when isinf(flux) then 1 else 0 end) as bigint) infs, count(*) n from exposures group by 1", "exposures")
def a19(d: Domain) -> DataFrame:
    """How many results are off."""
    f = F.col("flux")
    return d.exposures.groupBy("detector").agg(F.count_if(f < 2.0).alias("low"), F.count_if(F.isnan(f)).alias("nans"), F.count_if(F.abs(f) == float("inf")).alias("infs"), F.count("*").alias("n"))


@query("a20_centroids", "select psf_id, round(sum(\"value\"), 6) total, round(sum(y * \"value\") / sum(\"value\"), 6) cy, round(sum(x * \"value\") / sum(\"value\"), 6) cx, round(max(\"value\"), 6) peak, arg_min(y, (-\"value\", y, x)) py, arg_min(x, (-\"value\", y, x)) px from stamps group by 1", "stamps")
def a20(d: Domain) -> DataFrame:
    """Sum, centroid and peak of stamps."""
    return stamps.centroid(d.stamps, "psf_id").select("psf_id", r(F.col("total"), "total"), r(F.col("cy"), "cy"), r(F.col("cx"), "cx"), r(F.col("peak"), "peak"), "py", "px")


@query("a21_image_differences", "select a.image_id, round(avg(abs(a.\"data\" - b.\"data\")), 6) l1, round(sqrt(avg((a.\"data\" - b.\"data\") * (a.\"data\" - b.\"data\"))), 6) l2, round(max(abs(a.\"data\" - b.\"data\")), 6) mx from pix a join pix b on b.image_id = a.image_id + 1 and a.x = b.x and a.y = b.y group by 1", "pix")
def a21(d: Domain) -> DataFrame:
    """Mean, root-mean-square and greatest difference of images."""
    b = d.pixels.select((F.col("image_id") - 1).alias("image_id"), "x", "y", F.col("data").alias("other"))
    e = F.col("data") - F.col("other")
    return d.pixels.join(b, ["image_id", "x", "y"]).groupBy("image_id").agg(r(F.avg(F.abs(e)), "l1"), r(F.sqrt(F.avg(e * e)), "l2"), r(F.max(F.abs(e)), "mx"))


@query("a22_effective_pixels", "select image_id, round(sum(\"data\" * \"data\" * iv), 4) chi2, round(sum(iv) * sum(iv) / sum(iv * iv), 6) neff, round(max(case when x between 2 and 13 and y between 2 and 13 then \"data\" end), 6) peak from good group by 1 having sum(iv) > 0", "good")
def a22(d: Domain) -> DataFrame:
    """Chi-square, effective pixels, and the peak of the valid crop."""
    w = F.col("iv")
    inner = F.when(F.col("x").between(2, 13) & F.col("y").between(2, 13), F.col("data"))
    got = d.good.groupBy("image_id").agg(r(F.sum(F.col("data") * F.col("data") * w), "chi2", 4), F.sum(w).alias("s"), F.sum(w * w).alias("q"), r(F.max(inner), "peak")).where("s > 0")
    return got.select("image_id", "chi2", r(F.col("s") * F.col("s") / F.col("q"), "neff"), "peak")


@query("a26_analytic_radius", "select src_id, round(sqrt(5e-1 * (sigma + ab) + sqrt(25e-2 * (sigma - ab) * (sigma - ab) + e1 * e1)) * sqrt(-2e0 * ln(1e0 - 999e-3)), 6) r_eff from src", "src")
def a26(d: Domain) -> DataFrame:
    """Radius of a Gaussian that holds 99.9 % of its flux."""
    from ..functions import ellipses, mixtures

    s = ellipses.covariance_radius(F.col("sigma"), F.col("e1"), F.col("ab"))
    return d.sources.select("src_id", r(mixtures.encircled_radius(s, 0.999), "r_eff"))


_SHAPES = "shapes as (select image_id, cast(count(*) as int) h, cast(count(distinct x) * 3 as int) w from pix group by 1)"


def _shapes(d: Domain) -> DataFrame:
    return d.pixels.groupBy("image_id").agg(F.count("*").cast("int").alias("h"), (F.count_distinct("x") * 3).cast("int").alias("w"))


@query("a27_grid_sizes", f"with {_SHAPES} select max(h) mh, max(w) mw, cast(max(ceil(h / 8e0) * 8) as int) pad, count(*) n from shapes", "pix")
def a27(d: Domain) -> DataFrame:
    """Maxima over a set of images."""
    return _shapes(d).agg(F.max("h").alias("mh"), F.max("w").alias("mw"), F.max(grids.quantised(F.col("h"), 8)).alias("pad"), F.count("*").alias("n"))


@query(
    "a29_buckets",
    f"""with {_SHAPES}, q as (select image_id, cast(ceil(greatest(h, w) / 4e0) * 4 as int) s from shapes), c as (select s from (select s, count(*) n, min(image_id) f from q group by 1 order by n desc, f limit 5) t union select max(s) from q)
  select image_id, h, w, min(s) bh, min(s) bw from shapes join c on s >= h and s >= w group by 1, 2, 3""",
    "pix",
)
def a29(d: Domain) -> DataFrame:
    """Square buckets; the smallest that fits."""
    s = _shapes(d)
    return grids.assigned(s, "image_id", grids.buckets(s, "image_id", base=4), base=4)


@query("t1_most_common", f"with {_SHAPES} select cast(ceil(h / 8e0) * 8 as int) s, count(*) n from shapes group by 1 order by n desc, min(image_id) limit 3", "pix")
def t1(d: Domain) -> DataFrame:
    """The most common shapes, by first sight among equals."""
    s = _shapes(d).select("image_id", grids.quantised(F.col("h"), 8).alias("s"))
    return grids.most_common(s, ["s"], "image_id", 3).select("s", "n")


@query("t3_sorted_bands", "select target, string_agg(band, ',' order by band, src_id) bands from catalog group by 1", "catalog")
def t3(d: Domain) -> DataFrame:
    """Bands in order."""
    pairs = F.sort_array(F.collect_list(F.struct("band", "src_id")))
    return d.catalog.groupBy("target").agg(F.array_join(F.transform(pairs, lambda p: p["band"]), ",").alias("bands"))


@query("t5_slices", "select cast(floor((rn - 1) / 500) as bigint) slice, count(*) n, min(exposure_id) lo, max(exposure_id) hi from (select exposure_id, row_number() over (order by ts, exposure_id) rn from exposures where exposure_id % 3 <> 1) t group by 1", "exposures")
def t5(d: Domain) -> DataFrame:
    """Slices of 500 frames, whatever their numbers."""
    rows = grids.sliced(d.exposures.where("exposure_id % 3 <> 1").select("ts", "exposure_id"), 500, "ts", "exposure_id")
    return rows.groupBy("slice").agg(F.count("*").alias("n"), F.min("exposure_id").alias("lo"), F.max("exposure_id").alias("hi"))


@query(
    "t7_line_search",
    f"""with {_T}, {_M}, g as (select k, pow(2e0, k - 10) alpha from range(0, 11) u(k)), l as (select image_id, k, alpha, -5e-1 * sum(("data" - alpha * model) * ("data" - alpha * model) * iv) ll from m, g group by 1, 2, 3)
  select image_id, round(arg_max(alpha, (ll, -k)), 9) alpha from l group by 1""",
    "src good",
)
def t7(d: Domain) -> DataFrame:
    """The step of best likelihood among powers of two."""
    m = photometry.model(_templates(d), F.col("flux"))
    # chi-square is quadratic in the step: three sums serve all steps
    s = m.groupBy("image_id").agg(F.sum(F.col("data") * F.col("data") * F.col("iv")).alias("dd"), F.sum(F.col("data") * F.col("model") * F.col("iv")).alias("dm"), F.sum(F.col("model") * F.col("model") * F.col("iv")).alias("mm"))
    steps = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("alpha", F.pow(F.lit(2.0), F.col("k") - 10))
    like = -0.5 * (F.col("dd") - 2.0 * F.col("alpha") * F.col("dm") + F.col("alpha") * F.col("alpha") * F.col("mm"))
    best = steps.groupBy("image_id").agg(F.max(F.struct(like.alias("ll"), (-F.col("k")).alias("k"), "alpha")).alias("b"))
    return best.select("image_id", r(F.col("b.alpha"), "alpha", 9))


@query("w1_cumulative_flux", "select psf_id, y, x, round(sum(\"value\") over (partition by psf_id order by sqrt((y - 3) * (y - 3) + (x - 3) * (x - 3)), y, x rows between unbounded preceding and current row), 6) cum from stamps", "stamps")
def w1(d: Domain) -> DataFrame:
    """Running flux over radius."""
    rad = F.sqrt(((F.col("y") - 3) * (F.col("y") - 3) + (F.col("x") - 3) * (F.col("x") - 3)).cast("double"))
    w = Window.partitionBy("psf_id").orderBy(rad, "y", "x").rowsBetween(Window.unboundedPreceding, 0)
    return d.stamps.select("psf_id", "y", "x", r(F.sum("value").over(w), "cum"))
