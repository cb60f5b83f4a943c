"""Parameter tables: path, ordinal, value, liquid, step, lower, upper."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pattern(path: str) -> str:
    """A path with ``*`` for any one name, as a regular expression that also takes what lies below."""
    return "^" + r"\.".join("[^.]+" if p == "*" else re.escape(p) for p in path.split(".")) + r"(\..*)?$"


def thaw(params: DataFrame, *paths: str, liquid: bool = True) -> DataFrame:
    hit = F.lit(False)
    for p in paths:
        hit = hit | F.col("path").rlike(pattern(p))
    return params.withColumn("liquid", F.when(hit, F.lit(liquid)).otherwise(F.col("liquid")))


def freeze(params: DataFrame, *paths: str) -> DataFrame:
    return thaw(params, *paths, liquid=False)


def freeze_all_but(params: DataFrame, *paths: str) -> DataFrame:
    return thaw(params.withColumn("liquid", F.lit(False)), *paths)


def numbered(params: DataFrame, *keys: str) -> DataFrame:
    """liquid_index: how many liquid parameters come before; -1 if frozen."""
    before = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum(F.col("liquid").cast("long")).over(before), F.lit(0).cast("long"))
    return params.withColumn("liquid_index", F.when(F.col("liquid"), n).otherwise(F.lit(-1).cast("long")))


def offsets(members: DataFrame, order: str, size: str, *keys: str) -> DataFrame:
    """offset: the prefix sum of the members' sizes."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return members.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")))


def clipped(params: DataFrame, value: str = "value") -> DataFrame:
    """Values held to their bounds; a null bound doesn't hold."""
    v = F.col(value)
    v = F.when(F.col("lower").isNotNull(), F.greatest(v, F.col("lower"))).otherwise(v)
    return params.withColumn(value, F.when(F.col("upper").isNotNull(), F.least(v, F.col("upper"))).otherwise(v))


def log_prior(params: DataFrame, priors: DataFrame, *keys: str) -> DataFrame:
    """Gaussian log-prior of each group, without constants. priors: path, mu, sd."""
    z = (F.col("value") - F.col("mu")) / F.col("sd")
    return params.join(priors, "path").groupBy(*keys).agg((-0.5 * F.sum(z * z)).alias("logprior"))


def prior_rows(params: DataFrame, priors: DataFrame, *keys: str) -> DataFrame:
    """A sparse row for each prior: place, 1/sd, and the residual that a step would close."""
    return params.join(priors, "path").select(*keys, "path", "ordinal", (1.0 / F.col("sd")).alias("jacobian"), ((F.col("mu") - F.col("value")) / F.col("sd")).alias("residual"))


def kinds(df: DataFrame) -> DataFrame:
    """path, kind, depth of every column and of all that is inside it."""
    from pyspark.sql.types import ArrayType, DataType, MapType, StructType

    rows: list[tuple[str, str, int]] = []

    def walk(path: str, kind: DataType, depth: int) -> None:
        rows.append((path, kind.typeName(), depth))
        if isinstance(kind, StructType):
            for f in kind.fields:
                walk(f"{path}.{f.name}", f.dataType, depth + 1)
        elif isinstance(kind, ArrayType):
            walk(f"{path}[]", kind.elementType, depth + 1)
        elif isinstance(kind, MapType):
            walk(f"{path}[]", kind.valueType, depth + 1)

    for f in df.schema.fields:
        walk(f.name, f.dataType, 0)
    return df.sparkSession.createDataFrame(rows, "path string, kind string, depth int")
