"""Cutouts as they arrive: each micro-batch is fit, and its results appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_at_once: int = 500) -> DataFrame:
    """Files of a folder, so many a batch."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.fits").option("maxFilesPerTrigger", files_at_once).load(folder)


def append_results(files: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """process turns a batch of files into results, with failures as rows. A batch that is tried again replaces its own results only."""

    def each(batch: DataFrame, number: int) -> None:
        process(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_fluxes(exposures: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Mean flux by detector in tumbling windows of a stream (ts, detector, flux)."""
    return exposures.withWatermark("ts", late).groupBy(F.window("ts", width), "detector").agg(F.count("*").alias("n"), F.avg("flux").alias("flux"))
