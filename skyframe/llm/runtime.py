"""Where shared files go, and how the executors get this package."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only where it is unset and all runs in one process, as in tests, an own one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (at or "file://" + os.path.join(tempfile.gettempdir(), "skyframe-shared")).rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder there. All of an application's lie under its identifier, and may go once its results are read."""
    return f"{_home(spark)}/{what}-{uuid.uuid4().hex}"


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/skyframe-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and lost executors don't cost them. spent: such tables that nothing reads any more; they go."""
    at = fresh_dir(df.sparkSession, "table")
    df.write.parquet(at)
    for old in spent:
        _remove(df.sparkSession, old._skyframe_at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._skyframe_at = at
    return out


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written in here go as soon as it is written, not when the driver happens to collect its garbage (which listeners that lag behind put off)."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before) if before is not None else spark.conf.unset(_TIDY)


def _remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Remove all tables of this application from the shared folder; its results must have been read or written elsewhere."""
    _remove(spark, _home(spark))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SHIPPED: set[str] = set()
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they can import what the functions refer to.

    Texts are long: where an Arrow batch holds Spark's own 10,000 rows, it holds 1,000 from here on in this session, as
    plans are made when results are read. Any other number is left as it is.
    """
    sc = spark.sparkContext
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, "1000")
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    at = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    at.write_bytes(buffer.getvalue())
    sc.addPyFile(str(at))
    _SHIPPED.add(sc.applicationId)
