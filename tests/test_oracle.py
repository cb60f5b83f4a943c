"""Every query with a SQL twin gives the twin's rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from skyframe.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> Counter:
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v is pd.NA or v != v else 0.0 if v == 0 else v
    return Counter(tuple(clean(v) for v in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, duck, name):
    ours, twin = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(twin.columns)
    assert rows(ours) == rows(twin)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_partitions_do_not_matter(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    one = QUERIES["forced_photometry"](spark, DATA).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    two = QUERIES["forced_photometry"](spark, DATA).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows(one) == rows(two)
