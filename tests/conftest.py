"""The session's Spark, and the comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, os.environ.get("PYTHONPATH", "")) if x)
DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value that compares the same from either engine."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """A function that holds the query's rows against the rows of its SQL."""

    def check(query, sql: str, sf: str = "sf0.01") -> int:
        with duckdb.connect() as con:
            con.execute("SET TimeZone = 'UTC'")
            for t in TABLES:
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{sf}/{t}.parquet')")
            cur = con.execute(sql)
            names = [d[0] for d in cur.description]
            expected = rows_of(names, cur.fetchall())
        df = query(spark, f"{DATA}/{sf}")
        assert sorted(df.columns) == sorted(names)
        found = rows_of(df.columns, [tuple(r) for r in df.collect()])
        assert len(found) == len(expected)
        for a, b in zip(found, expected, strict=True):
            assert a == b
        return len(found)

    return check
