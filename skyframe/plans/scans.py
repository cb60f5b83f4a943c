"""Sources and sinks, as far as the driver's tables can show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import parameters
from ..sources import fits, shared, tables
from ..streaming import cutouts
from .domain import Domain
from .registry import query
from .scalars import r


@query("s1_catalog_scan", "select p_partkey ls_id, p_type \"type\", p_retailprice flux from part where p_size > 10")
def s1(d: Domain) -> DataFrame:
    """A scan with the filter and the columns pushed into Parquet."""
    return d.table("part").where("p_size > 10").select(F.col("p_partkey").alias("ls_id"), F.col("p_type").alias("type"), F.col("p_retailprice").alias("flux"))


@query("s2_csv_photometry", "select exposure_id, round(wavelength, 6) wavelength, round(flux / 1e3, 6) flux from exposures", "exposures")
def s2(d: Domain) -> DataFrame:
    """Photometry in files of CSV, scanned with a schema."""
    at = shared.fresh(d.spark, "csv")
    d.exposures.select("exposure_id", "wavelength", "flux", F.lit(1.0).alias("flux_err")).write.csv(at, header=True)
    back = tables.photometry(d.spark, at, "exposure_id long, wavelength double, flux double, flux_err double")
    return back.select("exposure_id", r(F.col("wavelength"), "wavelength"), r(F.col("flux"), "flux"))


@query("s3_manifest", "select cast(s_suppkey as int) cutout_index, 'ok' status from supplier where s_suppkey % 5 <> 2")
def s3(d: Domain) -> DataFrame:
    """Manifests with comment lines, scanned, and their good entries."""
    at = shared.fresh(d.spark, "ecsv")
    status = F.when(F.col("s_suppkey") % 5 == 2, "failed").otherwise("ok")
    d.table("supplier").select(F.col("s_suppkey").alias("cutout_index"), status.alias("status")).write.csv(at, header=True, sep=" ")
    d.spark.createDataFrame([("# %ECSV 1.0\n# ---\ncutout_index status",)], "value string").write.mode("append").text(at)
    return tables.manifest(d.spark, at).where("status = 'ok'")


def _files(d: Domain) -> DataFrame:
    """path and content of each image's file."""
    return fits.encoded(d.pixels, "image_id", 16, 16)


def _index(path: str = "path") -> Column:
    return F.regexp_extract(path, fits.CUTOUT, 1).cast("long")


def _rounded(got: DataFrame, own: Column) -> DataFrame:
    return got.where("data is not null and not isnan(data)").select(own.alias("image_id"), "x", "y", r(F.col("data"), "data"), "flags", r(F.col("var"), "var"), r(F.col("bkg"), "bkg"))


@query("s4_cutout_files", "select image_id, x, y, round(\"data\", 6) \"data\", flags, round(var, 6) var, round(bkg, 6) bkg from pix", "pix")
def s4(d: Domain) -> DataFrame:
    """Images written as FITS bytes and decoded again."""
    return _rounded(fits.pixels(_files(d)).where("error is null"), _index())


@query("s4_monolithic", "select image_id, x, y, round(\"data\", 6) \"data\", flags, round(var, 6) var, round(bkg, 6) bkg from pix", "pix")
def s4_monolithic(d: Domain) -> DataFrame:
    """One file of all images, read by numbered blocks, some to a partition."""
    uri = f"{shared.fresh(d.spark, 'fits')}/all.fits"
    files = _files(d).withColumn("image_id", _index())
    fits.joined(files, "image_id", uri)
    # a block's number is its image's place among those written
    place = files.select("image_id").withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("image_id")) - 1)  # a row an image
    return _rounded(fits.monolith(d.spark, uri).join(place, F.col("cutout_index") == F.col("_k")), F.col("image_id"))


@query("s5_named_blocks", "select image_id, count(*) n, round(sum(\"data\"), 4) total from pix where image_id % 7 <> 3 group by 1", "pix")
def s5_named(d: Domain) -> DataFrame:
    """Blocks looked up by the names of their HDUs."""
    uri = f"{shared.fresh(d.spark, 'fits')}/some.fits"
    fits.joined(_files(d).withColumn("image_id", _index()).where("image_id % 7 <> 3"), "image_id", uri)
    got = fits.monolith(d.spark, uri, named="true", blocks_a_partition="16").where("data is not null and not isnan(data)")
    return got.groupBy(F.col("cutout_index").cast("long").alias("image_id")).agg(F.count("*").alias("n"), r(F.sum("data"), "total", 4))


@query("s5_missing_blocks", "select s_suppkey image_id from supplier where s_suppkey % 7 = 3 or s_suppkey not in (select l_suppkey from lineitem)")
def s5(d: Domain) -> DataFrame:
    """Manifest entries whose named HDU is missing."""
    uri = f"{shared.fresh(d.spark, 'fits')}/some.fits"
    fits.joined(_files(d).withColumn("image_id", _index()).where("image_id % 7 <> 3"), "image_id", uri)
    names = d.spark.createDataFrame([(u.name,) for u in fits.units(uri)], "name string")  # of one file
    found = names.select(F.regexp_extract("name", r"^IMAGE(\d+)$", 1).alias("k")).where("k <> ''").select(F.col("k").cast("long").alias("image_id"))
    return d.table("supplier").select(F.col("s_suppkey").alias("image_id")).join(found, "image_id", "left_anti")


def _named_files(d: Domain) -> DataFrame:
    """Small files, of which some have names of another kind."""
    k = F.col("s_suppkey")
    name = F.when(k % 7 == 3, F.format_string("other_%d.fits", k)).otherwise(F.format_string("cutout_%04d_obs%d_D%d.fits", k, k, k % 6 + 1))
    return d.table("supplier").select(name.alias("path"), F.to_binary(F.concat(F.lit("content "), k.cast("string")), F.lit("utf-8")).alias("content"))


@query("s7_discovered_files", "select cast(s_suppkey as int) cutout_index, 'obs' || s_suppkey obs_id, cast(s_suppkey % 6 + 1 as int) detector from supplier where s_suppkey % 7 <> 3")
def s7(d: Domain) -> DataFrame:
    """A folder listed, and names that fit the pattern with their captured parts."""
    at = shared.fresh(d.spark, "folder")
    fits.stored(_named_files(d), at)
    return fits.discover(d.spark, at).select("cutout_index", "obs_id", "detector")


@query("s11_downloaded", "select cast(s_suppkey as bigint) image_id, s_suppkey % 9 = 4 missing, case when s_suppkey % 9 <> 4 then 'content ' || s_suppkey end content from supplier where s_suppkey % 7 <> 3")
def s11(d: Domain) -> DataFrame:
    """Files fetched by tasks of many threads; one that isn't there is kept as an error of its row."""
    uris = fits.stored(_named_files(d), shared.fresh(d.spark, "folder")).where("uri like '%cutout%'").withColumn("image_id", _index("uri"))
    gone = F.when(F.col("image_id") % 9 == 4, F.concat("uri", F.lit(".gone"))).otherwise(F.col("uri"))
    got = tables.downloaded(uris.select(gone.alias("uri")), tables.fetched, 4)
    return got.select(_index("uri").alias("image_id"), F.col("error").isNotNull().alias("missing"), F.decode("content", "utf-8").alias("content"))


@query("s10_polled_job", "select src_id, cast(cast(ra as float) as double) ra from src where \"dec\" > 0", "src")
def s10_polled(d: Domain) -> DataFrame:
    """A remote job is asked until it is done; then what it left is read, and narrowed."""
    at = shared.fresh(d.spark, "job")
    steps = iter(["QUEUED", "EXECUTING", "COMPLETED"])

    def status() -> str:
        now = next(steps)
        if now == "EXECUTING":
            d.sources.where("dec > 0").select("src_id", "ra").write.parquet(at)
        return now

    tables.finished(status, poll=0.0)
    return tables.narrowed(d.spark.read.parquet(at), "src_id").select("src_id", F.col("ra").cast("double").alias("ra"))


@query("s16_array_dump", "select image_id, x, y, round(\"data\" - 3e0 * bkg, 6) residual from pix", "pix")
def s16(d: Domain) -> DataFrame:
    """Data, model and residual as arrays of each image, written and read again."""
    at = shared.fresh(d.spark, "arrays")
    p = d.pixels.select("image_id", "y", "x", "data", (3.0 * F.col("bkg")).alias("model")).withColumn("residual", F.col("data") - F.col("model"))
    tables.write_results(tables.dumped(p, "image_id", "data", "model", "residual"), at)
    back = d.spark.read.parquet(at).select("image_id", "width", F.explode(F.arrays_zip("place", "residual")).alias("c"))
    return back.select("image_id", (F.col("c.place") % F.col("width")).cast("int").alias("x"), F.floor(F.col("c.place") / F.col("width")).cast("int").alias("y"), r(F.col("c.residual"), "residual"))


@query("f7_serialised", "select src_id, round(x0, 6) x0, round(re, 6) re, src_type kind from src", "src")
def f7(d: Domain) -> DataFrame:
    """nested parameters as text and back."""
    text = tables.to_json(F.struct(F.struct("x0", "y0").alias("pos"), F.struct("re", "ab", "phi").alias("shape"), "src_type"))
    back = tables.from_json(F.col("text"), "pos struct<x0: double, y0: double>, shape struct<re: double, ab: double, phi: double>, src_type string")
    rows = d.sources.select("src_id", text.alias("text")).select("src_id", back.alias("p"))
    return rows.select("src_id", r(F.col("p.pos.x0"), "x0"), r(F.col("p.shape.re"), "re"), F.col("p.src_type").alias("kind"))


@query("m24_kinds", "select * from (values ('src_id', 'long', 0), ('pos', 'struct', 0), ('pos.x0', 'double', 1), ('pos.y0', 'double', 1), ('fluxes', 'array', 0), ('fluxes[]', 'double', 1)) t(path, kind, depth)")
def m24(d: Domain) -> DataFrame:
    """What a source's columns consist of."""
    return parameters.kinds(d.sources.select("src_id", F.struct("x0", "y0").alias("pos"), F.array("flux").alias("fluxes")))


@query("s8_archive_metadata", "select exposure_id, 'https://archive/' || detector || '/' || exposure_id access_url from exposures join (select cast(c_custkey as bigint) target from customer where c_nationkey < 12) c using (target) where wavelength > 2 order by ts, exposure_id", "exposures")
def s8(d: Domain) -> DataFrame:
    """Planes and artifacts joined, addresses put together, in order of time."""
    c = d.table("customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("target"))
    rows = d.exposures.join(c, "target").where("wavelength > 2").orderBy("ts", "exposure_id")
    return rows.select("exposure_id", F.concat(F.lit("https://archive/"), "detector", F.lit("/"), F.col("exposure_id")).alias("access_url"))


@query("s10_narrowed", "select src_id, cast(cast(ra as float) as double) ra from src", "src")
def s10(d: Domain) -> DataFrame:
    """Doubles narrowed to floats on the way in."""
    return tables.narrowed(d.sources.select("src_id", "ra")).select("src_id", F.col("ra").cast("double").alias("ra"))


@query("s13_cutout_info", "select cast(exposure_id + 1 as int) cutout_index, detector, wavelength central_wavelength, cast('nan' as double) flux_err from exposures", "exposures")
def s13(d: Domain) -> DataFrame:
    """The table of cutouts, renamed and typed; errors to be filled."""
    return d.exposures.select((F.col("exposure_id") + 1).cast("int").alias("cutout_index"), "detector", F.col("wavelength").alias("central_wavelength"), F.lit(float("nan")).alias("flux_err"))


@query("s18_header_parameters", "select image_id, cast(3 as int) n, round(sky, 6) p0, round(crval2, 6) p2 from frames", "frames")
def s18(d: Domain) -> DataFrame:
    """Parameters into a header and out of it, up to the first missing key."""
    header = tables.parameter_header(F.array("sky", "crval1", "crval2"), "P")
    rows = d.frames.select("image_id", F.map_concat(header, F.map_from_arrays(F.array(F.lit("P4")), F.array(F.lit(9.0)))).alias("h"))
    rows = rows.withColumn("p", tables.header_parameters(F.col("h"), "P"))
    return rows.select("image_id", F.size("p").alias("n"), r(F.col("p")[0], "p0"), r(F.col("p")[2], "p2"))


@query("s20_zone_headers", "select zone_id, zx x, zy y from zones", "zones")
def s20(d: Domain) -> DataFrame:
    """Zones from header keys XCTR_n and YCTR_n."""
    pairs = d.zones.select(F.explode(F.array(F.struct(F.concat(F.lit("XCTR_"), "zone_id").alias("key"), F.col("zx").cast("string").alias("value")), F.struct(F.concat(F.lit("YCTR_"), "zone_id").alias("key"), F.col("zy").cast("string").alias("value")))).alias("e"))
    header = pairs.agg(F.map_from_entries(F.collect_list("e")).alias("header"), F.lit("psf.fits").alias("path"))  # as many keys as zones
    return fits.zones(header).select("zone_id", "x", "y")


@query("x1_windowed_fluxes", "select detector, cast(date_trunc('hour', ts) as varchar) \"hour\", count(*) n, round(avg(flux), 6) flux from exposures group by 1, 2", "exposures")
def x1(d: Domain) -> DataFrame:
    """The streaming aggregate's batch form, by hour."""
    return d.exposures.groupBy("detector", F.date_trunc("hour", "ts").cast("string").alias("hour")).agg(F.count("*").alias("n"), r(F.avg("flux"), "flux"))


@query("x1_streamed_fluxes", "select detector, cast(date_trunc('hour', ts) as varchar) \"hour\", count(*) n, round(avg(flux), 6) flux from exposures group by 1, 2", "exposures")
def x1_streamed(d: Domain) -> DataFrame:
    """The same as a stream over files, some a batch; each batch's state of the windows replaces the one before."""
    at, out, marks = (shared.fresh(d.spark, x) for x in ("arriving", "fluxes", "marks"))
    d.exposures.select("ts", "detector", "flux").repartition(6).write.parquet(at)
    stream = d.spark.readStream.schema("ts timestamp, detector string, flux double").option("maxFilesPerTrigger", 2).parquet(at)

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    state = cutouts.windowed_fluxes(stream).select("detector", F.col("window.start").alias("start"), "n", "flux")
    query_ = state.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query_.awaitTermination()
    last = d.spark.read.parquet(out)
    last = last.join(F.broadcast(last.agg(F.max("batch").alias("batch"))), "batch")
    return last.select("detector", F.col("start").cast("string").alias("hour"), "n", r(F.col("flux"), "flux"))
