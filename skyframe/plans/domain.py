"""The driver's tables read as images, sources and calibrations.

Integer keys decide everything, so the same rows come out in any engine: suppliers
are images of 16 by 16 pixels, line items their pixels, parts sources, nations
point-spread zones, embeddings stamps of 7 by 7, orders catalog fluxes and events
exposures.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the pixel flags that mask a pixel, and the bit of a pixel under a known source.
MASK_BITS = (2, 6, 9, 10, 11, 14, 17, 19)
MASK = sum(1 << b for b in MASK_BITS)
SOURCE = 1 << 21
SIZE = 16


class Domain:
    """Lazy tables over a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def pixels(self) -> DataFrame:
        """image_id, x, y, data, var, bkg, flags."""
        bit = F.when(F.col("l_returnflag") == "R", F.expr("shiftleft(1, cast(l_linenumber as int) * 3)")).otherwise(0)
        return (
            self.table("lineitem")
            .groupBy(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % SIZE).cast("int").alias("x"), (F.col("l_orderkey") % SIZE).cast("int").alias("y"))
            .agg(F.avg("l_quantity").alias("data"), (0.01 + F.avg("l_tax")).alias("var"), F.avg("l_discount").alias("bkg"), F.bit_or(bit).alias("flags"))
        )

    @cached_property
    def good(self) -> DataFrame:
        """pixels with bad (mask bits) and iv, which is 0 where bad."""
        bad = F.col("flags").bitwiseAND(F.lit(MASK)) != 0
        return self.pixels.withColumn("bad", bad).withColumn("iv", F.when(bad | (F.col("var") <= 0), 0.0).otherwise(1.0 / F.col("var")))

    @cached_property
    def frames(self) -> DataFrame:
        """image_id, zone, sky, zp, kind, crpix1, crpix2, crval1, crval2, cd11, cd12, cd21, cd22."""
        k = F.col("s_nationkey")
        return self.table("supplier").select(
            F.col("s_suppkey").alias("image_id"),
            k.alias("zone"),
            (F.col("s_acctbal") / 1e4).alias("sky"),
            (22.5 + (k % 5) * 0.1).alias("zp"),
            F.when(k % 4 == 0, "null").when(k % 4 == 1, "linear").when(k % 4 == 2, "mag").otherwise("flux").alias("kind"),
            F.lit(8.0).alias("crpix1"),
            F.lit(8.0).alias("crpix2"),
            (k * 14.0).alias("crval1"),
            (k * 5.0 - 60.0).alias("crval2"),
            (-0.01 - (k % 3) * 0.001).alias("cd11"),
            ((k % 5) * 0.0005).alias("cd12"),
            ((k % 7) * 0.0003).alias("cd21"),
            (0.01 + (k % 2) * 0.001).alias("cd22"),
        )

    def images(self) -> Column:
        """How many images there are, one a supplier, as a scalar that the plan works out."""
        return self.table("supplier").agg(F.count("*")).scalar()

    @cached_property
    def sources(self) -> DataFrame:
        """src_id, image_id, src_type, x0, y0, sigma, re, ab, phi, e1, e2, sersic, flux, ra, dec."""
        p, n = F.col("p_partkey"), self.images()
        size = F.col("p_size")
        return self.table("part").select(
            p.alias("src_id"),
            (p % n).alias("image_id"),
            F.when(size % 5 == 0, "PSF").when(size % 5 == 1, "EXP").when(size % 5 == 2, "DEV").when(size % 5 == 3, "SER").otherwise("DUP").alias("src_type"),
            ((p * 7) % 160 / 10.0).alias("x0"),
            ((p * 13) % 160 / 10.0).alias("y0"),
            (1.0 + size / 50.0).alias("sigma"),
            F.when(size % 5 == 0, 0.0).otherwise(size / 20.0).alias("re"),
            (0.2 + (p % 8) / 10.0).alias("ab"),
            ((p * 37) % 180).cast("double").alias("phi"),
            ((size - 25) / 60.0).alias("e1"),
            ((p % 41 - 20) / 50.0).alias("e2"),
            (0.3 + (size % 50) / 8.0).alias("sersic"),
            F.col("p_retailprice").alias("flux"),
            ((p * 17) % 3600 / 10.0).alias("ra"),
            ((p * 11) % 1600 / 10.0 - 80.0).alias("dec"),
        )

    @cached_property
    def zones(self) -> DataFrame:
        """zone_id, zx, zy: a grid of 5 by 5."""
        k = F.col("n_nationkey")
        return self.table("nation").select(k.cast("int").alias("zone_id"), ((k % 5) * 3.0 + 1.0).alias("zx"), (F.floor(k / 5).cast("double") * 3.0 + 1.0).alias("zy"))

    @cached_property
    def stamps(self) -> DataFrame:
        """psf_id, zone_id, y, x, value: stamps of 7 by 7, long."""
        long = self.table("embeddings").select(F.col("vec_id").alias("psf_id"), F.col("label").alias("zone_id"), F.posexplode(F.slice("embedding", 1, 49)).alias("pos", "v"))
        return long.select("psf_id", "zone_id", F.floor(F.col("pos") / 7).cast("int").alias("y"), (F.col("pos") % 7).cast("int").alias("x"), F.abs(F.col("v").cast("double")).alias("value"))

    @cached_property
    def catalog(self) -> DataFrame:
        """src_id, band, flux, ivar, target."""
        o, c = self.table("orders"), self.table("customer")
        return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("src_id"), F.substring("o_orderpriority", 1, 1).alias("band"), F.col("o_totalprice").alias("flux"), (1.0 / (1.0 + F.abs("c_acctbal"))).alias("ivar"), F.col("o_custkey").alias("target"))

    @cached_property
    def exposures(self) -> DataFrame:
        """exposure_id, ts, target, detector, flux, wavelength."""
        return self.table("events").select(F.col("event_id").alias("exposure_id"), "ts", F.col("user_id").alias("target"), F.col("event_type").alias("detector"), F.col("value").alias("flux"), (F.get_json_object("props", "$.k").cast("double") / 20.0).alias("wavelength"))


def wcs_columns(prefix: str = "") -> dict[str, Column]:
    return {x: F.col(f"{prefix}{x}") for x in ("crpix1", "crpix2", "crval1", "crval2", "cd11", "cd12", "cd21", "cd22")}


#: The same tables in DuckDB's SQL.
SQL = {
    "pix": """select l_suppkey image_id, cast(l_partkey % 16 as int) x, cast(l_orderkey % 16 as int) y, avg(l_quantity) "data", 1e-2 + avg(l_tax) var, avg(l_discount) bkg,
  cast(bit_or(case when l_returnflag = 'R' then 1 << (l_linenumber * 3) else 0 end) as int) flags from lineitem group by 1, 2, 3""",
    "good": 'select *, (flags & 675396) <> 0 bad, case when (flags & 675396) <> 0 or var <= 0 then 0e0 else 1e0 / var end iv from pix',
    "frames": """select s_suppkey image_id, s_nationkey zone, s_acctbal / 1e4 sky, 225e-1 + (s_nationkey % 5) * 1e-1 zp,
  case s_nationkey % 4 when 0 then 'null' when 1 then 'linear' when 2 then 'mag' else 'flux' end kind, 8e0 crpix1, 8e0 crpix2, s_nationkey * 14e0 crval1, s_nationkey * 5e0 - 60e0 crval2,
  -1e-2 - (s_nationkey % 3) * 1e-3 cd11, (s_nationkey % 5) * 5e-4 cd12, (s_nationkey % 7) * 3e-4 cd21, 1e-2 + (s_nationkey % 2) * 1e-3 cd22 from supplier""",
    "src": """select p_partkey src_id, cast(p_partkey % (select count(*) from supplier) as bigint) image_id,
  case p_size % 5 when 0 then 'PSF' when 1 then 'EXP' when 2 then 'DEV' when 3 then 'SER' else 'DUP' end src_type, ((p_partkey * 7) % 160) / 1e1 x0, ((p_partkey * 13) % 160) / 1e1 y0, 1e0 + p_size / 5e1 sigma,
  case when p_size % 5 = 0 then 0e0 else p_size / 2e1 end re, 2e-1 + (p_partkey % 8) / 1e1 ab, cast((p_partkey * 37) % 180 as double) phi, (p_size - 25) / 6e1 e1, (p_partkey % 41 - 20) / 5e1 e2, 3e-1 + (p_size % 50) / 8e0 sersic,
  p_retailprice flux, ((p_partkey * 17) % 3600) / 1e1 ra, ((p_partkey * 11) % 1600) / 1e1 - 8e1 "dec" from part""",
    "zones": "select cast(n_nationkey as int) zone_id, (n_nationkey % 5) * 3e0 + 1e0 zx, cast(n_nationkey // 5 as double) * 3e0 + 1e0 zy from nation",
    "stamps": "select vec_id psf_id, label zone_id, cast((i - 1) // 7 as int) y, cast((i - 1) % 7 as int) x, abs(cast(embedding[i] as double)) \"value\" from embeddings, range(1, 50) g(i)",
    "catalog": "select o_orderkey src_id, substr(o_orderpriority, 1, 1) band, o_totalprice flux, 1e0 / (1e0 + abs(c_acctbal)) ivar, o_custkey target from orders join customer on o_custkey = c_custkey",
    "exposures": "select event_id exposure_id, ts, user_id target, event_type detector, \"value\" flux, cast(json_extract_string(props, '$.k') as double) / 2e1 wavelength from events",
}
_NEEDS = {"good": ["pix"]}


def with_(tables: str, sql: str) -> str:
    """sql under the common tables named, in order."""
    names: list[str] = []
    for t in tables.split():
        names += [x for x in (*_NEEDS.get(t, []), t) if x not in names]
    if not names:
        return sql
    head = ", ".join(f"{t} as ({SQL[t]})" for t in names)
    if sql.startswith("with recursive "):
        return f"with recursive {head}, {sql[15:]}"
    return f"with {head}, {sql[5:]}" if sql.startswith("with ") else f"with {head} {sql}"
