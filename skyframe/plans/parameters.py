"""Parameter tables: frozen and liquid parameters, bounds, priors, derivatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import parameters as ops
from .domain import Domain
from .registry import query
from .scalars import r

_P = """params as (select src_id, 'catalog.source' || src_id || '.' || name path, cast(src_id * 4 + k as bigint) ordinal, case k when 0 then x0 when 1 then y0 when 2 then flux else sigma end "value", true liquid, 1e-1 step, case k when 3 then 12e-1 when 2 then 9e2 end lower, case k when 3 then 18e-1 end upper
 from src, (values (0, 'pos.x'), (1, 'pos.y'), (2, 'brightness'), (3, 'shape')) n(k, name))"""
_PRIORS = "priors as (select 'catalog.source' || src_id || '.shape' path, 15e-1 mu, 2e-1 + ab / 1e1 sd from src)"


def params(d: Domain) -> DataFrame:
    """Sources as a long parameter table."""
    s = d.sources
    names = [("pos.x", "x0", None, None), ("pos.y", "y0", None, None), ("brightness", "flux", 900.0, None), ("shape", "sigma", 1.2, 1.8)]
    entries = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("name"), F.col(c).alias("value"), F.lit(lo).cast("double").alias("lower"), F.lit(hi).cast("double").alias("upper")) for k, (n, c, lo, hi) in enumerate(names)))
    e = s.select("src_id", F.explode(entries).alias("e"))
    return e.select("src_id", F.concat(F.lit("catalog.source"), F.col("src_id"), F.lit("."), F.col("e.name")).alias("path"), (F.col("src_id") * 4 + F.col("e.k")).alias("ordinal"), "e.value", F.lit(True).alias("liquid"), F.lit(0.1).alias("step"), "e.lower", "e.upper")


def priors(d: Domain) -> DataFrame:
    return d.sources.select(F.concat(F.lit("catalog.source"), F.col("src_id"), F.lit(".shape")).alias("path"), F.lit(1.5).alias("mu"), (0.2 + F.col("ab") / 10.0).alias("sd"))


@query("p25_frozen", f"with {_P} select path, ordinal, not (path like '%.pos.%') or src_id = 7 liquid from params", "src")
def p25(d: Domain) -> DataFrame:
    """P25: positions frozen by a wildcard, one source thawed again."""
    p = ops.thaw(ops.freeze(params(d), "catalog.*.pos"), "catalog.source7")
    return p.select("path", "ordinal", "liquid")


@query("p25_all_but", f"with {_P} select src_id, cast(sum(case when path like '%.brightness' then 1 else 0 end) as bigint) free from params group by 1", "src")
def p25_all_but(d: Domain) -> DataFrame:
    """P25: all frozen but brightness."""
    return ops.freeze_all_but(params(d), "catalog.*.brightness").groupBy("src_id").agg(F.count_if("liquid").alias("free"))


@query("w2_liquid_index", f"with {_P}, q as (select *, not (path like '%.pos.%') l from params) select path, cast(case when l then coalesce(sum(case when l then 1 else 0 end) over (partition by src_id order by ordinal rows between unbounded preceding and 1 preceding), 0) else -1 end as bigint) liquid_index from q", "src")
def w2(d: Domain) -> DataFrame:
    """Each liquid parameter's number."""
    return ops.numbered(ops.freeze(params(d), "catalog.*.pos"), "src_id").select("path", "liquid_index")


@query("w3_flux_offsets", "select src_id, cast(coalesce(sum(case src_type when 'PSF' then 1 else 4 end) over (partition by image_id order by src_id rows between unbounded preceding and 1 preceding), 0) as bigint) \"offset\" from src", "src")
def w3(d: Domain) -> DataFrame:
    """Prefix sums of the sources' numbers of parameters."""
    s = d.sources.withColumn("n", F.when(F.col("src_type") == "PSF", 1).otherwise(4))
    return ops.offsets(s, "src_id", "n", "image_id").select("src_id", "offset")


@query("a10_log_prior", f"with {_P}, {_PRIORS} select src_id, round(-5e-1 * sum(((\"value\" - mu) / sd) * ((\"value\" - mu) / sd)), 6) logprior from params join priors using (path) group by 1", "src")
def a10(d: Domain) -> DataFrame:
    """A10: Gaussian log-prior."""
    return ops.log_prior(params(d), priors(d), "src_id").select("src_id", r(F.col("logprior"), "logprior"))


@query("a10_prior_rows", f"with {_P}, {_PRIORS} select src_id, path, ordinal, round(1e0 / sd, 6) jacobian, round((mu - \"value\") / sd, 6) residual from params join priors using (path)", "src")
def a10_rows(d: Domain) -> DataFrame:
    """A10: the priors' sparse rows."""
    return ops.prior_rows(params(d), priors(d), "src_id").select("src_id", "path", "ordinal", r(F.col("jacobian"), "jacobian"), r(F.col("residual"), "residual"))


@query("m21_bounded_update", f"with {_P} select path, round(case when upper is not null then least(greatest(\"value\" + 2e-1, lower), upper) when lower is not null then greatest(\"value\" + 2e-1, lower) else \"value\" + 2e-1 end, 6) v from params", "src")
def m21(d: Domain) -> DataFrame:
    """A step on every parameter, held to the bounds."""
    moved = params(d).withColumn("value", F.col("value") + 2.0 * F.col("step"))
    return ops.clipped(moved).select("path", r(F.col("value"), "v"))


@query(
    "r28_parameter_derivatives",
    """with t as (select src_id, x, y, x0, y0, sigma from src join pix using (image_id) where x between x0 - 3e0 and x0 + 3e0 and y between y0 - 3e0 and y0 + 3e0)
 select src_id, x, y, round((exp(-5e-1 * ((x - x0 - 1e-1) * (x - x0 - 1e-1) + (y - y0) * (y - y0)) / (sigma * sigma)) - exp(-5e-1 * ((x - x0) * (x - x0) + (y - y0) * (y - y0)) / (sigma * sigma))) / (2 * pi() * sigma * sigma) / 1e-1, 6) dx,
 round((exp(-5e-1 * ((x - x0) * (x - x0) + (y - y0) * (y - y0)) / ((sigma + 1e-2) * (sigma + 1e-2))) / (2 * pi() * (sigma + 1e-2) * (sigma + 1e-2)) - exp(-5e-1 * ((x - x0) * (x - x0) + (y - y0) * (y - y0)) / (sigma * sigma)) / (2 * pi() * sigma * sigma)) / 1e-2, 6) ds from t""",
    "src pix",
)
def r28(d: Domain) -> DataFrame:
    """Derivative images of a position and a width, by finite steps."""
    from ..functions.mixtures import round_density
    from ..operators.spatial import footprint

    t = footprint(d.sources, d.pixels, F.lit(3.0))
    dx, dy, s = F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), F.col("sigma")
    base = round_density(dx, dy, s * s)
    moved, wider = round_density(dx - 0.1, dy, s * s), round_density(dx, dy, (s + 0.01) * (s + 0.01))
    return t.select("src_id", "x", "y", r((moved - base) / 0.1, "dx"), r((wider - base) / 0.01, "ds"))
