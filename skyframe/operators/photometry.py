"""Forced photometry: templates, normal equations and their solution, fit statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mixtures
from .spatial import footprint

RCOND = 1e-12


def templates(sources: DataFrame, pixels: DataFrame, reach: float = 5.0) -> DataFrame:
    """Unit-flux point sources with a round Gaussian of width sigma: column a of each (source, pixel) inside reach * sigma."""
    pairs = footprint(sources, pixels, reach * F.col("sigma"))
    return pairs.withColumn("a", mixtures.round_density(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), F.col("sigma") * F.col("sigma")))


def mixture_templates(sources: DataFrame, pixels: DataFrame, components: DataFrame, reach: float) -> DataFrame:
    """As templates, with components (key, amp, mx, my, vxx, vxy, vyy) of each source; the components' densities are summed."""
    pairs = footprint(sources, pixels, F.lit(reach))
    d = mixtures.density(F.col("x") - F.col("x0") - F.col("mx"), F.col("y") - F.col("y0") - F.col("my"), F.col("vxx"), F.col("vxy"), F.col("vyy"))
    keys = [c for c in pairs.columns]
    return pairs.join(components, "src_id").groupBy(*keys).agg(F.sum(F.col("amp") * d).alias("a"))


def fit_with_background(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Flux and constant background of each group: two unknowns, by Cramer's rule. rows: a, data, iv."""
    a, d, w = F.col("a"), F.col("data"), F.col("iv")
    m = rows.groupBy(*keys).agg(F.sum(a * a * w).alias("aa"), F.sum(a * w).alias("ab"), F.sum(w).alias("bb"), F.sum(a * d * w).alias("ad"), F.sum(d * w).alias("bd"), F.count("*").alias("npix"))
    m = m.withColumn("det", F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")).where("det > 1e-9")
    return m.select(*keys, "npix", ((F.col("bb") * F.col("ad") - F.col("ab") * F.col("bd")) / F.col("det")).alias("flux"), ((F.col("aa") * F.col("bd") - F.col("ab") * F.col("ad")) / F.col("det")).alias("bkg"), (F.col("bb") / F.col("det")).alias("fvar"))


def equations(rows: DataFrame) -> DataFrame:
    """rows: image_id, src_id, x, y, a, data, iv. The normal equations of each image: i, j (i <= j) and their f; where i = j the right side r and npix, else null.

    A pixel's sources are gathered once (as many as overlap there) and paired there, so templates are made and
    moved once.
    """
    pixel = rows.groupBy("image_id", "x", "y").agg(F.collect_list(F.struct(F.col("src_id").alias("i"), "a")).alias("s"), F.first("iv").alias("iv"), F.first("data").alias("data"))
    one = pixel.select("image_id", "iv", "data", "s", F.explode("s").alias("p"))
    two = one.select("image_id", "iv", "data", "p", F.explode("s").alias("q")).where("p.i <= q.i")
    own, w = F.col("p.i") == F.col("q.i"), F.col("p.a") * F.col("iv")
    sums = {"f": F.sum(w * F.col("q.a")), "r": F.sum(F.when(own, w * F.col("data"))), "npix": F.sum(F.when(own, 1))}
    return two.groupBy("image_id", F.col("p.i").alias("i"), F.col("q.i").alias("j")).agg(*(v.alias(k) for k, v in sums.items()))


def normal_equations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same as a matrix (image_id, i, j, f; i <= j) and a right side (image_id, i, r, npix)."""
    both = equations(rows)
    return both.select("image_id", "i", "j", "f"), both.where("i = j").select("image_id", "i", "r", "npix")


class Sparse:
    """A symmetric matrix by its entries (a, b, v) with a <= b."""

    def __init__(self, a: np.ndarray, b: np.ndarray, v: np.ndarray, n: int) -> None:
        own = a == b
        self.diagonal = np.bincount(a[own], v[own], n)
        self._a, self._b, self._v = a[~own], b[~own], v[~own]

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        return self.diagonal * x + np.bincount(self._a, self._v * x[self._b], n) + np.bincount(self._b, self._v * x[self._a], n)

    def parts(self) -> list[np.ndarray]:
        """Indices that hang together by entries."""
        label = np.arange(len(self.diagonal))
        while True:
            least = label.copy()
            np.minimum.at(least, self._a, label[self._b])
            np.minimum.at(least, self._b, label[self._a])
            least = least[least]
            if (least == label).all():
                break
            label = least
        order = np.argsort(label, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(order) else []

    def dense(self, at: np.ndarray) -> np.ndarray:
        place = np.full(len(self.diagonal), -1)
        place[at] = np.arange(len(at))
        inside = place[self._a] >= 0
        out, i, j = np.diag(self.diagonal[at]), place[self._a[inside]], place[self._b[inside]]
        out[i, j] = out[j, i] = self._v[inside]
        return out


def linear_solution(f: np.ndarray, r: np.ndarray, rcond: float = RCOND) -> tuple[np.ndarray, np.ndarray]:
    """Fluxes and marginal variances; a source without any weight gets NaN."""
    some = np.diag(f) > 0
    return regularised(f, r, rcond * np.trace(f) / max(1, some.sum()))


def regularised(f: np.ndarray, r: np.ndarray, more: float) -> tuple[np.ndarray, np.ndarray]:
    """With so much more on the diagonal."""
    some = np.diag(f) > 0
    flux, var = np.full(len(r), np.nan), np.full(len(r), np.nan)
    if some.any():
        own = f[np.ix_(some, some)]
        own = own + more * np.eye(len(own))
        flux[some], var[some] = np.linalg.solve(own, r[some]), np.diag(np.linalg.inv(own))
    return flux, var


def conjugate_gradients(f: np.ndarray | Sparse, r: np.ndarray, start: np.ndarray | None = None, limit: int = 500, tol: float = 1e-6) -> np.ndarray:
    """One Newton step by preconditioned conjugate gradients; a source without weight stays at its start."""
    x = np.zeros(len(r)) if start is None else start.astype(float).copy()
    diagonal = f.diagonal if isinstance(f, Sparse) else np.diag(f)
    diagonal = np.where(diagonal > 0, diagonal, 1.0)
    g = r - f @ x
    z = g / diagonal
    p, rz, stop = z.copy(), g @ z, tol * max(np.linalg.norm(r), 1e-300)
    for _ in range(limit):
        if np.linalg.norm(g) <= stop:
            break
        q = f @ p
        step = rz / (p @ q)
        x += step * p
        g -= step * q
        z = g / diagonal
        rz, before = g @ z, rz
        p = z + rz / before * p
    return x


def solve(both: DataFrame, solver: str = "linear", rcond: float = RCOND, tol: float = 1e-6) -> DataFrame:
    """image_id, src_id, flux, var_marginal, var_conditional, npix of each image's joint fit. both: as equations() gives them.

    Only an image's pairs of overlapping sources go to Python, and stay sparse: "linear"
    solves each group of sources that hang together by overlap as a dense system of
    its own; "cg" makes no dense matrix at all, and no marginal variances (null).  Fluxes without
    weight are null.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf[pdf.i == pdf.j].sort_values("i")
        ids, r = side.i.to_numpy(), side.r.to_numpy()
        f = Sparse(*(np.searchsorted(ids, pdf[x].to_numpy()) for x in "ij"), pdf.f.to_numpy(), len(ids))
        weighed = f.diagonal > 0
        flux, var = np.full(len(ids), np.nan), np.full(len(ids), np.nan)
        more, conditional = rcond * f.diagonal.sum() / max(1, weighed.sum()), np.where(weighed, 1 / np.maximum(f.diagonal, 1e-12), np.nan)
        if solver == "cg":
            f.diagonal = np.where(weighed, f.diagonal + more, 0.0)
            flux = np.where(weighed, conjugate_gradients(f, r, tol=tol), np.nan)
        else:
            for at in f.parts():
                flux[at], var[at] = regularised(f.dense(at), r[at], more)
        return pd.DataFrame({"image_id": pdf.image_id.iloc[0], "src_id": ids, "flux": flux, "var_marginal": var, "var_conditional": conditional, "npix": side.npix.to_numpy().astype(np.int64)})

    return both.groupBy("image_id").applyInPandas(run, "image_id long, src_id long, flux double, var_marginal double, var_conditional double, npix long")


def log_posterior(both: DataFrame, constant: float, mean: dict[int, float] | None = None, sigma: dict[int, float] | None = None):
    """A function of one image's fluxes (source to flux) that samplers can call: log-likelihood, less a constant that doesn't depend on them, and Gaussian log-prior; -inf unless finite.

    both: that image's equations(), of which a row a pair of overlapping sources comes to the driver; constant: its sum of data * data * iv.
    """
    rows = both.collect()  # one image's pairs
    mean, sigma = mean or {}, sigma or {}

    def value(fluxes: dict[int, float]) -> float:
        x = {r.i: fluxes.get(r.i, 0.0) for r in rows if r.i == r.j}
        if not all(map(np.isfinite, x.values())):
            return -np.inf
        square = sum((1 if r.i == r.j else 2) * r.f * x[r.i] * x[r.j] for r in rows)
        prior = sum(-0.5 * ((x.get(k, 0.0) - m) / sigma[k]) ** 2 for k, m in mean.items())
        return float(-0.5 * (constant - 2 * sum(r.r * x[r.i] for r in rows if r.i == r.j) + square) + prior)

    return value


def model(rows: DataFrame, flux: Column, sky: Column | None = None) -> DataFrame:
    """Model image: the templates times flux, summed a pixel; sky is added to each."""
    out = rows.groupBy("image_id", "y", "x").agg(F.sum(flux * F.col("a")).alias("model"), F.first("data").alias("data"), F.first("iv").alias("iv"))
    return out if sky is None else out.withColumn("model", F.col("model") + sky)


def chi_square(rows: DataFrame, *keys: str) -> DataFrame:
    """chi2, pixels of weight and log-likelihood of rows with data, model, iv."""
    chi = (F.col("data") - F.col("model")) * (F.col("data") - F.col("model")) * F.col("iv")
    return rows.groupBy(*keys).agg(F.sum(chi).alias("chi2"), F.count_if(F.col("iv") > 0).alias("npix"), (-0.5 * F.sum(chi)).alias("loglike"))


def profile_statistics(rows: DataFrame, key: str, image: str = "image_id", extras: tuple[str, ...] = ()) -> DataFrame:
    """Profile-weighted statistics of each source, summed over its images.

    rows: a (unit model), flux (counts of the source on that image), model (of all sources, without sky), data, iv, and the
    planes named in extras, whose weighted sums are added. Pixels count where the unit model isn't 0 and there is
    weight; images without such a pixel, or without counts, don't count at all.
    """
    a, c, iv = F.col("a"), F.col("flux"), F.col("iv")
    s, good = F.abs(a), (F.col("a") != 0) & (F.col("iv") > 0)
    chi2 = (F.col("data") - F.col("model")) * (F.col("data") - F.col("model")) * iv
    inside = lambda v: F.sum(F.when(good, v).otherwise(0.0))
    sums = {
        "prochi2": inside(s * chi2),
        "pronpix": inside(s),
        "promasked": F.sum(F.when(iv == 0, s).otherwise(0.0)),
        # everybody else's light over the source's own
        "_num": inside(F.abs(F.col("model") / c - a) * s) / inside(a * a),
        "_den": inside(s / F.abs(c)),
        "proflux": inside(F.abs(F.col("model") - a * c) * s),
        "npix": F.count_if(good),
        "_in": F.sum(s),
    } | {x: inside(s * F.col(x)) for x in extras}
    each = rows.where(c != 0).groupBy(key, image).agg(F.count_if(good).alias("_some"), *(v.alias(f"{k}") for k, v in ((k, F.when(F.count_if(good) > 0, v)) for k, v in sums.items()))).where("_some > 0")
    whole = each.groupBy(key).agg(*(F.sum(x).alias(x) for x in ("prochi2", "pronpix", "promasked", "proflux", "npix", "_num", "_den", "_in", *extras)), F.count("*").alias("_images"))
    return whole.select(key, "prochi2", "pronpix", "promasked", (F.col("_num") / F.greatest(F.lit(1.0), "_den")).alias("profracflux"), (F.col("_in") / F.greatest(F.lit(1), "_images")).alias("fracin"), "proflux", "npix", *extras)


def quality(pixels: DataFrame, key: str) -> DataFrame:
    """Quality metrics of each image. pixels: data, bkg, iv, bad. Data less background, and its size over the error, count where a pixel is valid: not bad, finite and of weight; background where it is a number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    valid = ~F.col("bad") & finite(F.col("data")) & finite(F.col("bkg")) & finite(F.col("iv")) & (F.col("iv") > 0)
    clean = F.when(valid, F.col("data") - F.col("bkg"))
    snr, sky = F.abs(clean) * F.sqrt(F.when(valid, F.col("iv"))), F.when(~F.isnan("bkg"), F.col("bkg"))
    return pixels.groupBy(key).agg(
        F.count("*").alias("npix"),
        F.avg(F.col("bad").cast("double")).alias("mask_fraction"),
        F.avg(valid.cast("double")).alias("valid_fraction"),
        F.median(sky).alias("bkg_median"),
        F.avg(sky).alias("bkg_mean"),
        F.stddev_pop(sky).alias("bkg_std"),
        F.median(clean).alias("data_median"),
        F.stddev_pop(clean).alias("data_std"),
        F.median(snr).alias("snr_median"),
        F.avg(snr).alias("snr_mean"),
    )


def plane(rows: DataFrame, *keys: str) -> DataFrame:
    """Weighted plane z = a + b x + c y of each group's unmasked pixels; groups without a unique plane are left out."""
    x, y, z, w = F.col("x").cast("double"), F.col("y").cast("double"), F.col("data"), F.col("iv")
    s = {"s0": w, "sx": w * x, "sy": w * y, "sxx": w * x * x, "sxy": w * x * y, "syy": w * y * y, "sz": w * z, "sxz": w * x * z, "syz": w * y * z}
    m = rows.where("iv > 0").groupBy(*keys).agg(*(F.sum(e).alias(n) for n, e in s.items()))
    c = {n: F.col(n) for n in s}

    def det(a: tuple[Column, ...], b: tuple[Column, ...], d: tuple[Column, ...]) -> Column:
        return a[0] * (b[1] * d[2] - b[2] * d[1]) - a[1] * (b[0] * d[2] - b[2] * d[0]) + a[2] * (b[0] * d[1] - b[1] * d[0])

    cols = [(c["s0"], c["sx"], c["sy"]), (c["sx"], c["sxx"], c["sxy"]), (c["sy"], c["sxy"], c["syy"])]
    side = (c["sz"], c["sxz"], c["syz"])
    whole = det(*cols)
    return m.withColumn("_det", whole).where(F.abs("_det") > 1e-9).select(*keys, (det(side, cols[1], cols[2]) / F.col("_det")).alias("a"), (det(cols[0], side, cols[2]) / F.col("_det")).alias("b"), (det(cols[0], cols[1], side) / F.col("_det")).alias("c"))



def step(rows: DataFrame, *keys: str) -> DataFrame:
    """One Gauss-Newton step of flux and position of lone sources. rows: as templates() gives them, with flux.

    The derivatives of flux * a by x0 and y0 follow from the Gaussian; the three
    unknowns' normal equations are nine sums and a 3 by 3 system a source.
    """
    s2 = F.col("sigma") * F.col("sigma")
    gx, gy = (F.col("flux") * F.col("a") * (F.col(p) - F.col(f"{p}0")) / s2 for p in ("x", "y"))
    w, d = F.col("iv"), F.col("data") - F.col("flux") * F.col("a")
    g = {"f": F.col("a"), "x": gx, "y": gy}
    sums = {f"{i}{j}": F.sum(g[i] * g[j] * w) for i, j in ("ff", "fx", "fy", "xx", "xy", "yy")} | {f"r{i}": F.sum(g[i] * d * w) for i in "fxy"}
    m = rows.groupBy(*keys, "x0", "y0", "flux").agg(*(v.alias(f"_{k}") for k, v in sums.items()))
    c = lambda k: F.col(f"_{k}")

    def det(p: list[Column], q: list[Column], t: list[Column]) -> Column:
        return p[0] * (q[1] * t[2] - q[2] * t[1]) - p[1] * (q[0] * t[2] - q[2] * t[0]) + p[2] * (q[0] * t[1] - q[1] * t[0])

    cols = [[c("ff"), c("fx"), c("fy")], [c("fx"), c("xx"), c("xy")], [c("fy"), c("xy"), c("yy")]]
    side = [c("rf"), c("rx"), c("ry")]
    whole = det(*cols)
    moves = [F.when(F.abs(whole) > 1e-12, det(*(side if k == i else cols[k] for k in range(3))) / whole).otherwise(0.0) for i in range(3)]
    return m.select(*keys, (F.col("flux") + moves[0]).alias("flux"), (F.col("x0") + moves[1]).alias("x0"), (F.col("y0") + moves[2]).alias("y0"), F.greatest(F.abs(moves[1]), F.abs(moves[2])).alias("moved"))


def refined(sources: DataFrame, pixels: DataFrame, reach: float = 5.0, tol: float = 1e-3, limit: int = 20) -> DataFrame:
    """src_id, image_id, flux, x0, y0 after steps until no source moves by more than tol. The loop is on the driver; its checkpoints need a checkpoint folder."""
    now = sources
    shape = sources.select("src_id", "image_id", "sigma")
    for _ in range(limit):
        moved = step(templates(now, pixels, reach), "src_id", "image_id").checkpoint()
        now = moved.join(shape, ["src_id", "image_id"]).select("src_id", "image_id", "x0", "y0", "sigma", "flux")
        if (moved.agg(F.max("moved")).collect()[0][0] or 0.0) <= tol:
            break
    return moved.select("src_id", "image_id", "flux", "x0", "y0")
