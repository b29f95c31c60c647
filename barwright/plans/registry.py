"""Queries by name, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None, doubles: str = "", places: int = 6) -> Callable[[Query], Query]:
    """Registers a query. doubles: its columns that hold sums of floats, which both sides round, as their last digits depend on order."""

    scale = 10.0**places

    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.floor(F.col(c) * scale + 0.5) / scale for c in doubles.split()}) if doubles else df

        QUERIES[name] = run
        if sql is not None:
            rounded = ", ".join(f"floor({c} * 1e{places} + 0.5) / 1e{places} AS {c}" for c in doubles.split())
            SQL[name] = f"SELECT * REPLACE ({rounded}) FROM ({sql.strip().rstrip(';')}) AS q" if doubles else sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
