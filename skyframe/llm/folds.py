"""Which documents a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Values of a column, each with its number of rows, that fit in a broadcast.
FEW = 5000


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the identifier's text leaves no remainder. A row without an identifier isn't held out, nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def bounded_sample(df: DataFrame, key: str, bound: int, by: str | None = None) -> DataFrame:
    """About ``bound`` rows (for each value of ``by``, if given), all if there are fewer: those whose identifier hashes low.

    The choice depends on the identifier alone, so reruns agree.
    """
    share = F.xxhash64(F.lit("sample"), F.col(key)) / F.lit(2.0**64) + 0.5
    if by is None:
        return df.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n")))).where(share * F.col("_n") < bound).drop("_n")
    counts = df.select(by).groupBy(by).agg(F.count("*").alias("_n"))
    few = counts.limit(FEW + 1).collect()
    if len(few) <= FEW:  # so few values may be broadcast
        counts = F.broadcast(df.sparkSession.createDataFrame(few, counts.schema))
    return df.join(counts, by).where(share * F.col("_n") < bound).drop("_n")
