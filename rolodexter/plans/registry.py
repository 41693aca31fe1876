"""The catalogue of queries: each a function of the tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of (read) under its name; read(name) is a table."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
