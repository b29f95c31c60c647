"""Queries of window operators over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.operators import relational as R
from barwright.plans.bars import load, over
from barwright.plans.registry import query, table


@query("lag_lead_diff", "SELECT event_id, lag(value) OVER w AS prev, lead(value, 2) OVER w AS next2, value - lag(value) OVER w AS diff1, value - lead(value) OVER w AS diff_back FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_lead_diff(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.lag(v).over(w).alias("prev"), F.lead(v, 2).over(w).alias("next2"), (v - F.lag(v).over(w)).alias("diff1"), (v - F.lead(v).over(w)).alias("diff_back"))


@query("pct_change_forward", over("week", "SELECT symbol, date, " + ", ".join(f"-(fClose / lead(fClose, {n}) OVER (PARTITION BY symbol ORDER BY date) - 1) AS c_{n}" for n in (1, 2, 3, 5, 7)) + " FROM bars"), "c_1 c_2 c_3 c_5 c_7")
def pct_change_forward(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.options import forward_returns

    return forward_returns(load(spark, d, "week")).select("symbol", "date", *[f"c_{n}" for n in (1, 2, 3, 5, 7)])


@query("rank_pct", "SELECT o_orderkey, (rank() OVER (PARTITION BY o_orderpriority ORDER BY v) + (count(*) OVER (PARTITION BY o_orderpriority, v) - 1) / 2) / count(v) OVER (PARTITION BY o_orderpriority) AS pct FROM (SELECT *, floor(o_totalprice / 1000) AS v FROM orders)", "pct", 9)
def rank_pct(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.floor(F.col("o_totalprice") / 1000).alias("v"))
    return R.pct_rank(orders, ["o_orderpriority"], "v").select("o_orderkey", "pct")


@query("nlargest_members", over("week", "SELECT symbol, date, fVolume FROM (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY fVolume DESC) AS r FROM bars) WHERE r <= 10"))
def nlargest_members(spark: SparkSession, d: str) -> DataFrame:
    return R.nlargest_members(load(spark, d, "week"), ["symbol"], "fVolume", 10).select("symbol", "date", "fVolume")


@query("topk_per_day", "SELECT l_orderkey, l_linenumber, l_partkey, day FROM (SELECT *, l_shipdate::DATE AS day, row_number() OVER (PARTITION BY l_shipdate::DATE ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 5")
def topk_per_day(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.to_date("l_shipdate").alias("day"))
    w = Window.partitionBy("day").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return lines.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("l_orderkey", "l_linenumber", "l_partkey", "day")


@query("running_totals", "SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS running, o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS of_high FROM orders", "running of_high", 5)
def running_totals(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_orderkey", F.sum("o_totalprice").over(w).alias("running"), (F.col("o_totalprice") / F.max("o_totalprice").over(w)).alias("of_high"))


@query("next_date", "SELECT o_orderkey, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_date FROM orders")
def next_date(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lead("o_orderdate").over(w).alias("next_date"))


@query(
    "rising_runs",
    over(
        "week",
        """, c AS (SELECT symbol, date, fClose, (fClose > lag(fClose) OVER w)::INT AS up FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
g AS (SELECT *, sum(1 - coalesce(up, 0)) OVER (PARTITION BY symbol ORDER BY date) AS island FROM c)
SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM g WHERE up = 1 GROUP BY symbol, island HAVING count(*) >= 4""",
    ),
)
def rising_runs(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.patterns import rising_runs

    return rising_runs(load(spark, d, "week"), 4)
