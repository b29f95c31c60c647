"""Intraday bars: resampling, sessions, deduplication within the session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resample(ticks: DataFrame, keys: Sequence[str], width: str, price: str, tie: str) -> DataFrame:
    """keys, bucket, o, h, l, c, total, trades, average: bars of `width` from ticks (ts, price). tie orders ticks of one time.

    One aggregation with partial results; buckets without ticks have no row.
    """
    place = F.struct("ts", tie)
    bucket = F.window("ts", width)
    return (
        ticks.groupBy(*keys, bucket.alias("_w"))
        .agg(F.min_by(price, place).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, place).alias("c"), F.sum(price).alias("total"), F.count("*").alias("trades"))
        .select(*keys, F.col("_w.start").alias("bucket"), "o", "h", "l", "c", "total", "trades", (F.col("total") / F.col("trades")).alias("average"))
    )


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def session(ts: Column, opens: int = 9 * 60 + 30, closes: int = 16 * 60) -> Column:
    """Whether a time lies in the session, both ends included."""
    return minute_of_day(ts).between(opens, closes)


def dedup_session(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Within the session one row for each key (the earliest); rows outside all stay."""
    inside = session(F.col(ts))
    w = Window.partitionBy(*keys, inside).orderBy(ts, tie)
    return df.withColumn("_rn", F.row_number().over(w)).where(~inside | (F.col("_rn") == 1)).drop("_rn")


def clean_minutes(df: DataFrame, date: str, minute: str, value: str) -> DataFrame:
    """dtime from text dates and minutes; rows without a value go; the value as a 32-bit float."""
    when = F.try_to_timestamp(F.concat_ws(" ", date, minute), F.lit("yyyy-MM-dd HH:mm"))
    return df.where(F.col(value).isNotNull()).withColumns({"dtime": when, value: F.col(value).cast("float")})


def time_ordinals(df: DataFrame, ts: str, name: str = "ordinal") -> DataFrame:
    """df with the number, from 0, of a time's minute of the day among those that occur (at most 1,440, so the table of them is broadcast)."""
    minute = minute_of_day(F.col(ts))
    times = df.select(minute.alias("_m")).where("_m IS NOT NULL").distinct()
    numbers = times.select("_m", (F.row_number().over(Window.orderBy("_m")) - 1).alias(name))
    return df.withColumn("_m", minute).join(F.broadcast(numbers), "_m", "left").drop("_m")
