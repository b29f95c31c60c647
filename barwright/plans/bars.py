"""Bars, and the shared input of the queries over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators import studies as S
from barwright.plans.registry import query, table
from barwright.sources.bars import bars, bars_sql, trades


def load(spark: SparkSession, d: str, grain: str) -> DataFrame:
    return bars(trades(table(spark, d, "lineitem")), grain)


#: Trades of a part at most, on average, of bars that are dealt by symbol.
PART = 250_000


def dealt(spark: SparkSession, d: str, grain: str) -> DataFrame:
    """The bars of `load`, of trades dealt by symbol: one exchange and one sort serve the bars and all windows over a symbol's rows. Parts grow in number with the table, not in size."""
    from barwright.functions.parts import parts

    rows = trades(table(spark, d, "lineitem"))
    return bars(rows.repartition(parts(rows, PART), "symbol"), grain)


def over(grain: str, sql: str) -> str:
    return f"WITH {bars_sql(grain)}\n{sql.lstrip()}"


for _grain, _name in (("day", "bars_daily"), ("week", "bars_weekly"), ("month", "bars_monthly")):
    query(_name, over(_grain, "SELECT * FROM bars"))(lambda spark, d, grain=_grain: load(spark, d, grain))


@query(
    "clean_basic",
    over(
        "week",
        """SELECT symbol, date, fHigh - fLow AS fRange, fVolume / 1000000 AS vol_mil, lag(fClose) OVER (PARTITION BY symbol ORDER BY date) AS prev_close
FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE n > 1""",
    ),
    "vol_mil",
)
def clean_basic(spark: SparkSession, d: str) -> DataFrame:
    doubled = load(spark, d, "week")
    return S.clean(doubled.unionByName(doubled)).select("symbol", "date", "fRange", F.col("vol/mil").alias("vol_mil"), "prev_close")


@query(
    "resample_hourly",
    """SELECT event_type, date_trunc('hour', ts) AS bucket, arg_min(value, row(ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, row(ts, event_id)) AS c, count(*) AS trades, avg(value) AS average
FROM events GROUP BY 1, 2""",
    "average",
)
def resample_hourly(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.intraday import resample

    return resample(table(spark, d, "events").select(F.col("event_type"), "ts", "event_id", "value"), ["event_type"], "1 hour", "value", "event_id").drop("total")


@query(
    "resample_5min",
    """SELECT user_id, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, arg_min(value, row(ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, row(ts, event_id)) AS c, sum(value) AS total, count(*) AS trades, avg(value) AS average
FROM events GROUP BY 1, 2""",
    "total average",
)
def resample_5min(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.intraday import resample

    return resample(table(spark, d, "events"), ["user_id"], "5 minutes", "value", "event_id")


@query(
    "session_flag",
    """SELECT event_id, (hour(ts) * 60 + minute(ts) BETWEEN 570 AND 960)::INT AS in_session, hour(ts) * 60 + minute(ts) AS minute_of_day FROM events""",
)
def session_flag(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.intraday import minute_of_day, session

    m = minute_of_day(F.col("ts"))
    return table(spark, d, "events").select("event_id", session(F.col("ts")).cast("int").alias("in_session"), m.cast("long").alias("minute_of_day"))


@query(
    "dedup_in_session",
    """SELECT event_id FROM (SELECT *, hour(ts) * 60 + minute(ts) BETWEEN 570 AND 960 AS s, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts), hour(ts) * 60 + minute(ts) BETWEEN 570 AND 960 ORDER BY ts, event_id) AS rn FROM events) WHERE NOT s OR rn = 1""",
)
def dedup_in_session(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.intraday import dedup_session

    hourly = table(spark, d, "events").withColumn("slot", F.date_trunc("hour", "ts"))
    return dedup_session(hourly, ["user_id", "slot"], "ts", "event_id").select("event_id")


@query(
    "sector_performance",
    over(
        "month",
        """SELECT n_regionkey AS sector, date, sum(fClose * fVolume) / sum(fVolume) AS level FROM bars JOIN supplier ON symbol = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
    ),
    "level",
)
def sector_performance(spark: SparkSession, d: str) -> DataFrame:
    sectors = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("symbol"), F.col("n_regionkey").alias("sector"))
    level = F.sum(F.col("fClose") * F.col("fVolume")) / F.sum("fVolume")
    return load(spark, d, "month").join(sectors, "symbol").groupBy("sector", "date").agg(level.alias("level"))
