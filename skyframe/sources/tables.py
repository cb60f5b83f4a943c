"""Readers and writers of catalogs, manifests and results."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = "ls_id long, type string, ra double, dec double, sersic double, shape_r double, shape_e1 double, shape_e2 double"
MANIFEST = "cutout_index int, status string"


def catalog(spark: SparkSession, path: str, schema: str = CATALOG) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def photometry(spark: SparkSession, path: str, schema: str = "lambda double, flux double, flux_err double") -> DataFrame:
    """A CSV file of photometry in microjansky, as millijansky."""
    return spark.read.csv(path, header=True, schema=schema).withColumns({c: F.col(c) / 1000.0 for c in ("flux", "flux_err")})


def manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """An ECSV manifest: comment lines, then a header, blanks between columns."""
    return spark.read.csv(path, header=True, schema=schema, comment="#", sep=" ")


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def narrowed(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles as floats, but for the columns to keep."""
    return df.select(*(F.col(c).cast("float").alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


def header_parameters(header: Column, prefix: str, most: int = 100) -> Column:
    """The values of keys prefix0, prefix1, ... up to the first that is missing."""
    n = F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), F.lit(0), lambda s, i: F.when((s == i) & F.map_contains_key(header, F.concat(F.lit(prefix), i.cast("string"))), s + 1).otherwise(s))
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: i < n), lambda i: F.element_at(header, F.concat(F.lit(prefix), i.cast("string"))))


def parameter_header(values: Column, prefix: str) -> Column:
    """The other way: a map from an array."""
    return F.map_from_entries(F.transform(values, lambda v, i: F.struct(F.concat(F.lit(prefix), i.cast("string")).alias("key"), v.alias("value"))))


def downloaded(uris: DataFrame, fetch: Callable[[str], bytes], workers: int, threads: int = 50) -> DataFrame:
    """uri, content, error of each row of uris, fetched by so many tasks of so many threads each; a failure is kept as its error."""

    def one(uri: str) -> tuple[str, bytes | None, str | None]:
        try:
            return uri, fetch(uri), None
        except Exception as e:  # noqa: BLE001  whatever a client raises belongs to its row
            return uri, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for k in range(0, len(batch), threads):
                    yield pd.DataFrame(list(pool.map(one, batch.uri[k : k + threads])), columns=["uri", "content", "error"])

    return uris.select("uri").repartition(workers).mapInPandas(run, "uri string, content binary, error string")


def finished(status: Callable[[], str], poll: float = 5.0, timeout: float = 1800.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> str:
    """Ask a remote job until it is COMPLETED; raises if it fails or takes too long."""
    began = clock()
    while (now := status()) != "COMPLETED":
        if now in ("ERROR", "ABORTED"):
            raise RuntimeError(f"the job ended as {now}")
        if clock() - began > timeout:
            raise TimeoutError("the job took too long")
        sleep(poll)
    return now


def fetched(uri: str) -> bytes:
    """A file's bytes, by Arrow's file systems."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def dumped(pixels: DataFrame, key: str, *values: str) -> DataFrame:
    """A row an image: its size, and of each named plane one array in order of y and x; what Parquet keeps in place of array files."""
    cells = F.sort_array(F.collect_list(F.struct("y", "x", *values)))
    rows = pixels.groupBy(key).agg(cells.alias("_c"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    place = lambda c: c["y"] * F.col("width") + c["x"]
    return rows.select(key, "height", "width", F.transform("_c", place).alias("place"), *(F.col(f"_c.{v}").alias(v) for v in values))


def to_json(row: Column) -> Column:
    """Any struct of parameters as text."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def from_json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)
