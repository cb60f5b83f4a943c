"""Files in and out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.sources import fits, tables
from skyframe.streaming import cutouts


def cutout(k: int) -> bytes:
    rng = np.random.default_rng(k)
    planes = [fits.Hdu("IMAGE", {}, rng.random((5, 4))), fits.Hdu("FLAGS", {}, rng.integers(0, 9, (5, 4)).astype(np.int32)), fits.Hdu("VARIANCE", {}, rng.random((5, 4)).astype(np.float32)), fits.Hdu("ZODI", {}, rng.random((5, 4)))]
    zones = np.array([(1, 2.5, 3.5), (2, 8.0, 9.0)], [("zone_id", "i4"), ("x", "f8"), ("y", "f8")])
    return fits.encode([fits.Hdu("PRIMARY", {"DETECTOR": 3, "OBSID": f"it's {k}", "XCTR_1": 1.5, "YCTR_1": 2.5}), *planes, fits.Hdu("PSF_ZONES", {}, zones)])


def test_fits_round_trip():
    raw = cutout(1)
    assert len(raw) % fits.BLOCK == 0
    back = {h.name: h for h in fits.decode(raw)}
    rng = np.random.default_rng(1)
    assert np.array_equal(back["IMAGE"].data, rng.random((5, 4)))
    assert back["PRIMARY"].header["DETECTOR"] == 3 and back["PRIMARY"].header["OBSID"] == "it's 1"
    assert back["PSF_ZONES"].data["x"].tolist() == [2.5, 8.0]
    with pytest.raises(ValueError):
        fits.decode(raw[: len(raw) - 2900])


@pytest.fixture
def folder(tmp_path):
    for k in (7, 3, 12):
        (tmp_path / f"cutout_{k:04d}_obs{k}_D2.fits").write_bytes(cutout(k))
    (tmp_path / "cutout_0009_obs9_D1.fits").write_bytes(b"not a file of this kind".ljust(2880))
    (tmp_path / "notes.txt").write_text("x")
    return str(tmp_path)


def test_discovery_and_isolated_failures(spark, folder):
    assert sorted(r.cutout_index for r in fits.discover(spark, folder).collect()) == [3, 7, 9, 12]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fits").load(folder)
    got = fits.pixels(files)
    assert got.where("error is null").count() == 60
    assert [r.path.rsplit("/", 1)[1] for r in got.where("error is not null").collect()] == ["cutout_0009_obs9_D1.fits"]


def test_numbered_blocks_and_zone_headers(spark, folder):
    files = spark.read.format("binaryFile").load(f"{folder}/cutout_0003_obs3_D2.fits")
    assert fits.blocks(files, [0, 1, 2], first=1, step=4).groupBy("cutout_index").count().collect()[0]["count"] == 20
    assert [(r.zone_id, r.x, r.y) for r in fits.zones(fits.headers(files)).collect()] == [(1, 1.5, 2.5)]


def test_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text("lambda,flux,flux_err\n1.5,2000,10\n2.5,3000,\n")
    assert [(r["lambda"], r.flux, r.flux_err) for r in tables.photometry(spark, str(tmp_path / "p.csv")).collect()] == [(1.5, 2.0, 0.01), (2.5, 3.0, None)]
    (tmp_path / "s.ecsv").write_text("# %ECSV 1.0\n# ---\ncutout_index status\n1 ok\n2 failed\n")
    assert [r.cutout_index for r in tables.manifest(spark, str(tmp_path / "s.ecsv")).where("status = 'ok'").collect()] == [1]
    out = str(tmp_path / "out")
    for n in (3, 2):
        tables.write_results(spark.range(n), out)
    assert spark.read.parquet(out).count() == 2


def test_downloads_keep_failures(spark):
    def fetch(uri: str) -> bytes:
        if uri == "b":
            raise OSError("gone")
        return uri.encode()

    got = {r.uri: (r.content, r.error) for r in tables.downloaded(spark.createDataFrame([("a",), ("b",)], "uri string"), fetch, 2).collect()}
    assert bytes(got["a"][0]) == b"a" and got["b"] == (None, "OSError: gone")


def test_remote_jobs():
    states = iter(["QUEUED", "EXECUTING", "COMPLETED"])
    assert tables.finished(lambda: next(states), sleep=lambda s: None) == "COMPLETED"
    with pytest.raises(RuntimeError):
        tables.finished(lambda: "ERROR")
    clock = iter(range(0, 10_000, 1000))
    with pytest.raises(TimeoutError):
        tables.finished(lambda: "QUEUED", clock=lambda: next(clock), sleep=lambda s: None)


def test_stream_appends_results(spark, folder, tmp_path):
    out = str(tmp_path / "results")

    def process(batch):
        return fits.pixels(batch).groupBy("path").agg(F.sum("data").alias("s"), F.max("error").alias("error"))

    cutouts.append_results(cutouts.arriving(spark, folder, 2), process, out, str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 4 and got.where("error is not null").count() == 1
    assert got.select("batch").distinct().count() == 2


def test_units_of_a_monolith_are_found_without_its_data(spark, tmp_path):
    files = spark.createDataFrame([(k, bytearray(cutout(k))) for k in (12, 3, 7)], "k long, content binary")
    uri = f"file://{tmp_path}/deep/all.fits"
    assert [r.n for r in fits.joined(files, "k", uri).collect()] == [3]
    found = fits.units(uri)
    assert len(found) == 20 and [u.name for u in found[2:8]] == ["IMAGE3", "FLAGS3", "VARIANCE3", "ZODI3", "PSF3", "ZONE_LOOKUP3"]
    assert found[-1].end == (tmp_path / "deep" / "all.fits").stat().st_size
    raw = (tmp_path / "deep" / "all.fits").read_bytes()
    assert [h.name for h in fits.decode(raw)] == [u.name for u in found]
    got = fits.monolith(spark, uri, blocks_a_partition="2")
    assert got.rdd.getNumPartitions() == 2
    rng = np.random.default_rng(7)
    assert np.allclose(got.where("cutout_index = 1").orderBy("y", "x").toPandas().data, rng.random((5, 4)).ravel())
    named = fits.monolith(spark, uri, named="true")
    assert sorted(r.cutout_index for r in named.select("cutout_index").distinct().collect()) == [3, 7, 12]
    long = fits.encode([fits.Hdu("PRIMARY", {f"K{i}": i for i in range(90)}), fits.Hdu("X", {}, np.zeros((3, 3)))])
    (tmp_path / "long.fits").write_bytes(long)
    assert [u.name for u in fits.units(f"file://{tmp_path}/long.fits")] == ["PRIMARY", "X"]
    (tmp_path / "bad.fits").write_bytes(b"SIMPLE  =".ljust(2880))
    with pytest.raises(ValueError):
        fits.units(f"file://{tmp_path}/bad.fits")


def test_names_of_five_digits_are_kept(spark, tmp_path):
    from pyspark.sql import functions as F

    files = fits.encoded(spark.createDataFrame([(123456, 0, 0, 1.0, 0, 1.0, 0.0)], "image_id long, y int, x int, data double, flags int, var double, bkg double"), "image_id", 2, 2)
    assert [int(r.k) for r in files.select(F.regexp_extract("path", fits.CUTOUT, 1).alias("k")).collect()] == [123456]
    fits.stored(files, f"file://{tmp_path}/f")
    assert [(r.cutout_index, r.detector) for r in fits.discover(spark, f"{tmp_path}/f").collect()] == [(123456, 1)]


def test_downloads_run_in_threads(spark):
    import time

    def slow(uri: str) -> bytes:
        time.sleep(0.2)
        if uri == "5":
            raise OSError("gone")
        return uri.encode()

    began = time.monotonic()
    got = tables.downloaded(spark.createDataFrame([(str(k),) for k in range(100)], "uri string"), slow, 1).collect()
    assert time.monotonic() - began < 10 and len(got) == 100
    assert [(r.uri, r.error) for r in got if r.error] == [("5", "OSError: gone")]


def test_kept_tables_leave_oldest_first(spark):
    from skyframe.operators.cache import Kept

    kept = Kept(2)
    made = []
    make = lambda k: lambda: (made.append(k), spark.range(k))[1]
    for k in (1, 2, 1, 3, 2):
        assert kept.get(k, make(k)).count() == k
    assert made == [1, 2, 3, 2] and len(kept) == 2 and (kept.hits, kept.misses) == (1, 4)
    first = kept.get(3, make(3))
    assert first.storageLevel.useMemory
    kept.clear()
    assert not first.storageLevel.useMemory and len(kept) == 0
