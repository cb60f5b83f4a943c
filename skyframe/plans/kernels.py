"""Profiles, mixtures and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ellipses, mixtures
from ..operators import kernels, photometry
from ..operators.spatial import footprint
from .domain import Domain
from .registry import query
from .scalars import r

_EXP = "exp0(k, a, v) as (values (0, 2.34853813e-03, 1.20078965e-03), (1, 3.07995260e-02, 8.84526493e-03), (2, 2.23364214e-01, 3.91463084e-02), (3, 1.17949102e+00, 1.39976817e-01), (4, 4.33873750e+00, 4.60962500e-01), (5, 5.99820770e+00, 1.50159566e+00)), ep as (select k, a / (select sum(a) from exp0) amp, v var from exp0)"
_DEV = "dev0(k, a, v) as (values (0, 4.26347652e-02, 2.23759216e-04), (1, 2.40127183e-01, 1.00220099e-03), (2, 6.85907632e-01, 4.18731126e-03), (3, 1.51937350e+00, 1.69432589e-02), (4, 2.83627243e+00, 6.84850479e-02), (5, 4.46467501e+00, 2.87207080e-01), (6, 5.72440830e+00, 1.33320254e+00), (7, 5.60989349e+00, 8.40215071e+00)), dp as (select k, a / (select sum(a) from dev0) * (1e0 - 10233e-6) amp, v var from dev0 union all select 8, 10233e-6, 0e0)"
_G = "g as (select src_id, image_id, x0, y0, src_type, re, flux, greatest(1e0 / 30e0, re) / 36e2 rr, cos(radians(9e1 - phi)) c, sin(radians(9e1 - phi)) s, ab, cd11, cd12, cd21, cd22 from src join frames using (image_id))"
_T = "tm as (select *, (cd22 * (rr * c) - cd12 * (-rr * s)) / (cd11 * cd22 - cd12 * cd21) t11, (cd22 * (rr * s * ab) - cd12 * (rr * c * ab)) / (cd11 * cd22 - cd12 * cd21) t12, (cd11 * (-rr * s) - cd21 * (rr * c)) / (cd11 * cd22 - cd12 * cd21) t21, (cd11 * (rr * c * ab) - cd21 * (rr * s * ab)) / (cd11 * cd22 - cd12 * cd21) t22 from g)"


def _shapes(d: Domain) -> DataFrame:
    """sources with t11..t22: the unit circle to the galaxy in pixels, magnified so that it spans some; and its covariance."""
    rows = d.sources.join(d.frames, "image_id")
    g = ellipses.shape_matrix(F.col("re"), F.col("ab"), F.col("phi"))
    t = ellipses.product(ellipses.inverse((F.col("cd11"), F.col("cd12"), F.col("cd21"), F.col("cd22"))), g)
    return rows.withColumns(dict(zip(("t11", "t12", "t21", "t22"), t, strict=True)))


@query("r1_shape_matrix", f"with {_G} select src_id, round(rr * c * 1e6, 6) g11, round(rr * s * ab * 1e6, 6) g12, round(-rr * s * 1e6, 6) g21, round(rr * c * ab * 1e6, 6) g22 from g", "src frames")
def r1(d: Domain) -> DataFrame:
    """The matrix of a galaxy's shape on the sky, in micro-degrees."""
    g = ellipses.shape_matrix(F.col("re"), F.col("ab"), F.col("phi"))
    return d.sources.select("src_id", *(r(v * 1e6, n) for v, n in zip(g, ("g11", "g12", "g21", "g22"), strict=True)))


@query("r2_shear_and_covariance", f"with {_G}, {_T} select src_id, round(t11, 6) t11, round(t22, 6) t22, round(t11 * t11 + t12 * t12, 6) vxx, round(t11 * t21 + t12 * t22, 6) vxy, round(t21 * t21 + t22 * t22, 6) vyy from tm", "src frames")
def r2(d: Domain) -> DataFrame:
    """The shape in pixels, and the covariance T T' of a unit circle."""
    s = _shapes(d)
    v = ellipses.transformed(tuple(F.col(n) for n in ("t11", "t12", "t21", "t22")), F.lit(1.0), F.lit(0.0), F.lit(1.0))
    return s.select("src_id", r(F.col("t11"), "t11"), r(F.col("t22"), "t22"), *(r(x, n) for x, n in zip(v, ("vxx", "vxy", "vyy"), strict=True)))


@query("r22_profiles", f"with {_EXP}, {_DEV} select 'exp' kind, k, round(amp, 9) amp, var from ep union all select 'dev', k, round(amp, 9), var from dp union all select 'gauss', 0, 1e0, 1e0")
def r22(d: Domain) -> DataFrame:
    """The profiles' components."""
    rows = [(kind, k, round(a, 9), v) for kind in ("exp", "dev", "gauss") for k, (a, v) in enumerate(mixtures.profile(kind))]
    return d.spark.createDataFrame(rows, "kind string, k int, amp double, var double")


_PSF = [(0.7, 0.0, 0.0, 1.0, 0.1, 1.2), (0.3, 0.2, -0.1, 4.0, -0.3, 3.5)]


def _psf() -> Column:
    return F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(p, ("amp", "mx", "my", "vxx", "vxy", "vyy"), strict=True))) for p in _PSF))


def _galaxy_mixture() -> Column:
    """Each source's profile under its own shape: array of components in pixels. Needs t11..t22 and src_type."""
    t = tuple(F.col(n) for n in ("t11", "t12", "t21", "t22"))
    v = ellipses.transformed(t, F.lit(1.0), F.lit(0.0), F.lit(1.0))
    zero = F.lit(0.0)
    shaped = lambda kind: F.transform(mixtures.literal(kind), lambda g: F.struct(g["amp"].alias("amp"), zero.alias("mx"), zero.alias("my"), *((x * g["var"]).alias(n) for x, n in zip(v, ("vxx", "vxy", "vyy"), strict=True))))
    return F.when(F.col("src_type") == "DEV", shaped("dev")).otherwise(shaped("exp"))


_SQL_PSF = "psf(pk, pa, pmx, pmy, pxx, pxy, pyy) as (values (0, 7e-1, 0e0, 0e0, 1e0, 1e-1, 12e-1), (1, 3e-1, 2e-1, -1e-1, 4e0, -3e-1, 35e-1))"
_CONV = f"{_EXP}, {_DEV}, {_G}, {_T}, {_SQL_PSF}, cv as (select src_id, image_id, x0, y0, flux, amp * pa amp, pmx mx, pmy my, (t11 * t11 + t12 * t12) * var + pxx vxx, (t11 * t21 + t12 * t22) * var + pxy vxy, (t21 * t21 + t22 * t22) * var + pyy vyy from tm, psf, (select 'DEV' pt, * from dp union all select 'EXP', * from ep) pr where pt = case when src_type = 'DEV' then 'DEV' else 'EXP' end)"


@query("r4_convolved_mixtures", f"with {_CONV} select src_id, count(*) n, round(sum(amp), 6) total, round(sum(amp * vxx), 6) vxx, round(sum(amp * vyy), 6) vyy, round(sum(amp * mx), 6) mx from cv group by 1", "src frames")
def r4(d: Domain) -> DataFrame:
    """Profile and point-spread mixture convolved; moments of the outcome."""
    rows = _shapes(d).select("src_id", F.explode(mixtures.convolve(_galaxy_mixture(), _psf())).alias("g"))
    a = F.col("g.amp")
    return rows.groupBy("src_id").agg(F.count("*").alias("n"), r(F.sum(a), "total"), r(F.sum(a * F.col("g.vxx")), "vxx"), r(F.sum(a * F.col("g.vyy")), "vyy"), r(F.sum(a * F.col("g.mx")), "mx"))


_DENS = "exp(-5e-1 * (vyy * ({x}) * ({x}) - 2e0 * vxy * ({x}) * ({y}) + vxx * ({y}) * ({y})) / (vxx * vyy - vxy * vxy)) / (2 * pi() * sqrt(vxx * vyy - vxy * vxy))"


@query("r5_mixture_density", f"with {_CONV} select src_id, round(sum(amp * {_DENS.format(x='15e-1 - mx', y='-5e-1 - my')}), 9) v from cv group by 1", "src frames")
def r5(d: Domain) -> DataFrame:
    """The convolved mixture's density at one offset, as an array function."""
    v = mixtures.evaluate(mixtures.convolve(_galaxy_mixture(), _psf()), F.lit(1.5), F.lit(-0.5))
    return _shapes(d).select("src_id", r(v, "v", 9))


@query("r9_galaxy_images", f"with {_CONV} select src_id, x, y, round(sum(amp * {_DENS.format(x='x - x0 - mx', y='y - y0 - my')}), 9) a from cv join pix using (image_id) where x between x0 - 3e0 and x0 + 3e0 and y between y0 - 3e0 and y0 + 3e0 group by 1, 2, 3", "src frames pix")
def r9(d: Domain) -> DataFrame:
    """Galaxies under a mixture point-spread function, on the pixels around them."""
    v = ellipses.transformed(tuple(F.col(n) for n in ("t11", "t12", "t21", "t22")), F.lit(1.0), F.lit(0.0), F.lit(1.0))
    made = lambda kind: mixtures.prepared(kind, _PSF, v, 9)  # noqa: E731  the longer profile has nine components
    # a source's numbers are made once, below the join; a pixel then takes one expression, no array function and no second grouping
    shaped = _shapes(d).select("src_id", "image_id", "x0", "y0", F.when(F.col("src_type") == "DEV", made("dev")).otherwise(made("exp")).alias("numbers"))
    pairs = footprint(shaped, d.pixels.select("image_id", "x", "y"), F.lit(3.0))
    value = mixtures.prepared_density(F.col("numbers"), _PSF, 9, F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))
    return pairs.select("src_id", "x", "y", r(value, "a", 9))


@query(
    "m18_changed_mixtures",
    f"""with {_SQL_PSF} select src_id, round(sum(pa * (pmx * ab + x0)), 6) mx, round(sum(pa * (pxx * ab * ab + sigma * sigma)), 6) vxx, round(sum(pa * pxy * ab * ab), 6) vxy, round(sum(pa * (pyy * ab * ab + sigma * sigma)), 6) vyy from src, psf group by 1""",
    "src",
)
def m18(d: Domain) -> DataFrame:
    """A point-spread mixture rescaled, shifted and blurred; its moments."""
    m = mixtures.blurred(mixtures.shifted(mixtures.scaled(_psf(), F.col("ab")), F.col("x0"), F.col("y0")), F.col("sigma"))
    g = d.sources.select("src_id", F.explode(m).alias("g"))
    a = F.col("g.amp")
    return g.groupBy("src_id").agg(r(F.sum(a * F.col("g.mx")), "mx"), *(r(F.sum(a * F.col(f"g.{n}")), n) for n in ("vxx", "vxy", "vyy")))


_SLOPE = "-amp * {d} * ({n}) / (vxx * vyy - vxy * vxy)"


@query(
    "r6_mixture_gradient",
    f"""with {_CONV} select src_id, round(sum({_SLOPE.format(d=_DENS.format(x='15e-1 - mx', y='-5e-1 - my'), n='vyy * (15e-1 - mx) - vxy * (-5e-1 - my)')}), 9) gx,
 round(sum({_SLOPE.format(d=_DENS.format(x='15e-1 - mx', y='-5e-1 - my'), n='vxx * (-5e-1 - my) - vxy * (15e-1 - mx)')}), 9) gy from cv group by 1""",
    "src frames",
)
def r6(d: Domain) -> DataFrame:
    """Derivatives of a convolved mixture's density."""
    gx, gy = mixtures.gradient(mixtures.convolve(_galaxy_mixture(), _psf()), F.lit(1.5), F.lit(-0.5))
    return _shapes(d).select("src_id", r(gx, "gx", 9), r(gy, "gy", 9))


@query("r7_fourier", "select src_id, round(ab * exp(-2e0 * pi() * pi() * sigma * (1e-2 + 4e-2)) * cos(-2e0 * pi() * (x0 * 1e-1 + y0 * 2e-1)), 6) re, round(ab * exp(-2e0 * pi() * pi() * sigma * (1e-2 + 4e-2)) * sin(-2e0 * pi() * (x0 * 1e-1 + y0 * 2e-1)), 6) im from src", "src")
def r7(d: Domain) -> DataFrame:
    """A component's Fourier transform at one frequency."""
    re, im = mixtures.fourier(F.col("ab"), F.col("sigma"), F.col("x0"), F.col("y0"), F.lit(0.1), F.lit(0.2))
    return d.sources.select("src_id", r(re, "re"), r(im, "im"))


@query("r25_composite_profiles", f"with {_EXP}, {_DEV} select src_id, round(sum(f * a * exp(-5e-1 * 4e-2 / (v + 1e-1)) / (2 * pi() * (v + 1e-1))), 9) mid, count(*) n from (select src_id, sersic / 1e1 f, amp a, var v from src, dp union all select src_id, 1e0 - sersic / 1e1, amp, var from src, ep) t group by 1", "src")
def r25(d: Domain) -> DataFrame:
    """A de Vaucouleurs and an exponential share; the density of the mix near its centre."""
    share = F.col("sersic") / 10.0
    part = lambda kind, f: F.transform(mixtures.literal(kind), lambda g: F.struct((g["amp"] * f).alias("a"), g["var"].alias("v")))
    rows = d.sources.select("src_id", F.explode(F.concat(part("dev", share), part("exp", 1.0 - share))).alias("g"))
    v = F.col("g.v") + 0.1
    return rows.groupBy("src_id").agg(r(F.sum(F.col("g.a") * mixtures.round_density(F.lit(0.2), F.lit(0.0), v)), "mid", 9), F.count("*").alias("n"))


@query("r26_counts_patch", "select src_id, x, y, round(9e-1 * counts, 6) v from (select src_id, image_id, x0, y0, flux - 95e1 counts from src) s join pix using (image_id) where counts <> 0 and x = cast(floor(x0) as int) and y = cast(floor(y0) as int)", "src pix")
def r26(d: Domain) -> DataFrame:
    """Unit flux to counts; nothing where there are none."""
    s = d.sources.select("src_id", "image_id", F.floor("x0").cast("int").alias("x"), F.floor("y0").cast("int").alias("y"), (F.col("flux") - 950.0).alias("counts")).where("counts <> 0 and not isnan(counts)")
    return s.join(d.pixels.select("image_id", "x", "y"), ["image_id", "x", "y"]).select("src_id", "x", "y", r(0.9 * F.col("counts"), "v"))


@query("r27_patch_sizes", "select src_id, cast(least(8e0, greatest(ceil(4e0 * re / (36e2 * sqrt(abs(cd11 * cd22 - cd12 * cd21)) / 1e1)), 3e0)) as int) half from src join frames using (image_id)", "src frames")
def r27(d: Domain) -> DataFrame:
    """Half sizes of patches from the radius, at least the point-spread's and at most half the image."""
    from ..functions import sky
    from .domain import wcs_columns

    scale = sky.pixel_scale(wcs_columns()) / 10.0
    half = F.least(F.lit(8.0), F.greatest(F.ceil(4.0 * F.col("re") / scale).cast("double"), F.lit(3.0)))
    return d.sources.join(d.frames, "image_id").select("src_id", half.cast("int").alias("half"))


@query("u1_joined_mixtures", f"with {_EXP}, {_DEV}, j as (select 0 o, k, amp, var from ep union all select 1, k, amp, var from dp) select o, k, round(amp / (select sum(amp) from j), 9) amp, var from j")
def u1(d: Domain) -> DataFrame:
    """Two mixtures' components together, normalised."""
    one = lambda kind, o: F.transform(mixtures.literal(kind), lambda g, k: F.struct(F.lit(o).alias("o"), k.alias("k"), g["amp"].alias("amp"), g["var"].alias("var")))
    rows = d.spark.range(1).select(F.concat(one("exp", 0), one("dev", 1)).alias("m"))
    rows = rows.withColumn("t", F.aggregate("m", F.lit(0.0), lambda s, g: s + g["amp"])).select(F.explode("m").alias("g"), "t")
    return rows.select("g.o", "g.k", r(F.col("g.amp") / F.col("t"), "amp", 9), "g.var")


def _with_stamps(d: Domain, sources: DataFrame) -> DataFrame:
    """sources with psf_id, the identifier modulo the number of stamps: all of them have some."""
    n = d.table("embeddings").agg(F.count_distinct("vec_id").alias("_n"))
    return sources.crossJoin(F.broadcast(n)).withColumn("psf_id", F.col("src_id") % F.col("_n")).drop("_n")


@query("r10_fourier_points")
def r10(d: Domain) -> DataFrame:
    """Point sources from stamps by a phase shift."""
    p = _with_stamps(d, d.sources).select("psf_id", "src_id", "x0", "y0", "flux")
    return kernels.rendered_points(p, d.stamps, "psf_id", 7, 16, 16).select("src_id", "y", "x", r(F.col("value"), "value"))


@query("r11_fourier_galaxies")
def r11(d: Domain) -> DataFrame:
    """Galaxies of any profile index, convolved with stamps in Fourier space."""
    v = ellipses.transformed(tuple(F.col(n) for n in ("t11", "t12", "t21", "t22")), F.lit(1.0), F.lit(0.0), F.lit(1.0))
    s = _with_stamps(d, _shapes(d).where("re > 0")).select("psf_id", "src_id", "x0", "y0", "flux", "sersic", *(x.alias(n) for x, n in zip(v, ("vxx", "vxy", "vyy"), strict=True)))
    return kernels.rendered_galaxies(s, d.stamps, "psf_id", 7, 16, 16).select("src_id", "y", "x", r(F.col("value"), "value"))


@query("r23_sersic_mixtures")
def r23(d: Domain) -> DataFrame:
    """The mixtures of all profile indices that occur, as a dimension table, with and without a share beyond."""
    return kernels.sersic_mixtures(d.sources.select(F.round("sersic", 3).alias("n")), {"plain": 0.0, "beyond": 0.02})


@query(
    "r21_hybrid_split",
    f"""with {_CONV}, s as (select *, 4e0 / greatest(1e-6, sqrt(vxx + vyy)) ns from cv), w as (select *, case when 16e0 < 16e0 * (vxx + vyy) then 1 end im, case when 16e0 > 9e0 * (vxx + vyy) then 1 end fm from s)
 select src_id, round(coalesce(sum(amp * least(1e0, 4e0 - ns)) filter (im = 1), 0e0), 9) mixture, round(coalesce(sum(amp * least(1e0, ns - 3e0)) filter (fm = 1), 0e0), 9) fourier, count(im) n_mixture, count(fm) n_fourier from w group by 1""",
    "src frames",
)
def r21(d: Domain) -> DataFrame:
    """Components that would wrap around are rendered as mixtures, compact ones by Fourier transform, with a ramp between."""
    m, f = mixtures.split(mixtures.convolve(_galaxy_mixture(), _psf()), F.lit(4.0))
    rows = _shapes(d).select("src_id", m.alias("m"), f.alias("f"))
    return rows.select("src_id", r(mixtures.total(F.col("m")), "mixture", 9), r(mixtures.total(F.col("f")), "fourier", 9), F.size("m").cast("long").alias("n_mixture"), F.size("f").cast("long").alias("n_fourier"))


@query("a31_longest_mixture", "select cast(max(case src_type when 'PSF' then 1 when 'DEV' then 9 when 'DUP' then 0 else 6 end) as int) k, count(*) n from src", "src")
def a31(d: Domain) -> DataFrame:
    """The most components that any source of the catalog has."""
    size = F.when(F.col("src_type") == "PSF", 1).when(F.col("src_type") == "DEV", F.size(mixtures.literal("dev"))).when(F.col("src_type") == "DUP", 0).otherwise(F.size(mixtures.literal("exp")))
    return d.sources.agg(F.max(size).cast("int").alias("k"), F.count("*").alias("n"))


@query("r32_fitted_mixtures")
def r32(d: Domain) -> DataFrame:
    """Mixtures fit to stamps by expectation maximisation."""
    return kernels.fitted_mixtures(d.stamps, "psf_id", 7, 2).select("psf_id", "k", *(r(F.col(c), c) for c in ("amp", "mx", "my", "vxx", "vxy", "vyy")))


@query("r8_mixture_photometry")
def r8(d: Domain) -> DataFrame:
    """Photometry with a mixture point-spread function, all sources of an image at once."""
    c = d.sources.select("src_id").crossJoin(d.spark.createDataFrame(_PSF, "amp double, mx double, my double, vxx double, vxy double, vyy double"))
    t = photometry.mixture_templates(d.sources.select("src_id", "image_id", "x0", "y0"), d.good.select("image_id", "x", "y", "data", "iv"), c, 5.0)
    return photometry.solve(photometry.equations(t)).select("image_id", "src_id", r(F.col("flux"), "flux"), r(F.col("var_marginal"), "var_marginal"), "npix")
