"""Price bars from trades. A trade is a line item: its supplier is the symbol, its unit price the price, its quantity the volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month")


def trades(lineitem: DataFrame) -> DataFrame:
    """symbol, ts, price, volume and the columns that order trades of one time."""
    return lineitem.select(
        F.col("l_suppkey").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.col("l_quantity").alias("volume"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("place"),
    )


def bars(trades: DataFrame, grain: str = "day") -> DataFrame:
    """symbol, date, fOpen, fHigh, fLow, fClose, fVolume: one aggregation with partial results on the map side."""
    if grain not in GRAINS:
        raise ValueError(f"grain is one of {GRAINS}")
    date = F.to_date(F.date_trunc(grain, "ts"))
    return trades.groupBy("symbol", date.alias("date")).agg(
        F.min_by("price", "place").alias("fOpen"), F.max("price").alias("fHigh"), F.min("price").alias("fLow"), F.max_by("price", "place").alias("fClose"), F.sum("volume").alias("fVolume")
    )


def bars_sql(grain: str) -> str:
    """The common table expressions `trades` and `bars` for the same rows."""
    return f"""trades AS (SELECT l_suppkey AS symbol, CAST(date_trunc('{grain}', l_shipdate) AS DATE) AS date, l_extendedprice / nullif(l_quantity, 0) AS price, l_quantity AS volume,
  row(l_shipdate, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem),
bars AS (SELECT symbol, date, arg_min(price, place) AS fOpen, max(price) AS fHigh, min(price) AS fLow, arg_max(price, place) AS fClose, sum(volume) AS fVolume FROM trades GROUP BY 1, 2)"""
