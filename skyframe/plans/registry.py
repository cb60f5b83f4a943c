"""Queries by name, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .domain import Domain, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: str = "") -> Callable:
    """Register a function of a Domain. sql: its twin, over the common tables named in ``tables``."""

    def register(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Domain(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_(tables, sql)
        return f

    return register
