"""Queries of data quality and of preparation for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import dates as D
from barwright.operators import quality as Q
from barwright.operators import studies as S
from barwright.plans.bars import load, over
from barwright.plans.registry import query, table

_CAL = "cal AS (SELECT d::DATE AS date FROM generate_series(DATE '1995-01-01', DATE '2002-12-31', INTERVAL 1 DAY) AS t(d) WHERE isodow(d) < 6)"
_MISSING = f", {_CAL}, r AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM bars GROUP BY 1), missing AS (SELECT symbol, date FROM r JOIN cal ON date BETWEEN lo AND hi EXCEPT SELECT symbol, date FROM bars)"


def _missing(spark: SparkSession, d: str) -> DataFrame:
    return Q.missing_counted(load(spark, d, "day"), D.calendar(spark, "1995-01-01", "2002-12-31"))


@query("missing_dates", over("day", f"{_MISSING} SELECT * FROM missing"))
def missing_dates(spark: SparkSession, d: str) -> DataFrame:
    return _missing(spark, d).drop("n")


@query("missing_few", over("day", f"{_MISSING}, n AS (SELECT symbol, date, count(*) OVER (PARTITION BY symbol) AS n FROM missing) SELECT * FROM n WHERE n < 1390"))
def missing_few(spark: SparkSession, d: str) -> DataFrame:
    return _missing(spark, d).where("n < 1390")


@query("gap_fill", over("week", "SELECT symbol, date, fClose FROM bars WHERE symbol % 2 = 0 UNION ALL SELECT symbol, date, -fClose FROM bars WHERE symbol % 2 <> 0"))
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    bars = load(spark, d, "week").select("symbol", "date", "fClose")
    return Q.gap_fill(bars.where("symbol % 2 = 0"), bars.withColumn("fClose", -F.col("fClose")), ["symbol", "date"])


@query("upsert_keep_first", over("month", "SELECT symbol, date, CASE WHEN symbol % 3 = 0 THEN fClose ELSE fClose + 1 END AS fClose FROM bars"))
def upsert_keep_first(spark: SparkSession, d: str) -> DataFrame:
    bars = load(spark, d, "month").select("symbol", "date", "fClose")
    new = bars.withColumn("fClose", F.col("fClose") + 1)
    return Q.upsert(bars.where("symbol % 3 = 0"), new.unionByName(new), ["symbol", "date"], [F.col("fClose")])


@query("freshness", "SELECT 'orders' AS name, max(o_orderdate)::DATE AS newest, count(*) AS n FROM orders UNION ALL SELECT 'events', max(ts)::DATE, count(*) FROM events")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return Q.freshness({"orders": (table(spark, d, "orders"), "o_orderdate"), "events": (table(spark, d, "events"), "ts")})


@query("form_flags", "SELECT o_custkey, o_orderdate::DATE AS date, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS q10, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS k10 FROM orders GROUP BY 1, 2 HAVING q10 > 0 OR k10 > 0")
def form_flags(spark: SparkSession, d: str) -> DataFrame:
    return Q.flags_by_day(table(spark, d, "orders"), "o_custkey", F.to_date("o_orderdate"), "o_orderpriority", {"q10": "1-URGENT", "k10": "2-HIGH"})


@query("scale_global", "SELECT doc_id, (n_chars - avg(n_chars) OVER ()) / stddev_pop(n_chars) OVER () AS n_chars FROM documents", "n_chars")
def scale_global(spark: SparkSession, d: str) -> DataFrame:
    return Q.standard_scale(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars")), ["n_chars"])


@query("scale_by_symbol", over("month", "SELECT symbol, date, coalesce((fClose - avg(fClose) OVER w) / nullif(stddev_pop(fClose) OVER w, 0), 0) AS fClose FROM bars WINDOW w AS (PARTITION BY symbol)"), "fClose")
def scale_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    return Q.standard_scale(load(spark, d, "month").select("symbol", "date", "fClose"), ["fClose"], ["symbol"])


@query(
    "ts_split",
    over("month", "SELECT symbol, date, CASE WHEN rn <= n - 3 * s THEN 'train' WHEN rn <= n - 2 * s THEN 'test' ELSE 'later' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, count(*) OVER (PARTITION BY symbol) AS n, floor(count(*) OVER (PARTITION BY symbol) * 0.2::DOUBLE) AS s FROM bars)"),
)
def ts_split(spark: SparkSession, d: str) -> DataFrame:
    return Q.time_split(load(spark, d, "month"), ["symbol"], ["date"]).select("symbol", "date", "split")


@query("regression_metrics", over("month", ", p AS (SELECT fClose AS a, lag(fClose) OVER (PARTITION BY symbol ORDER BY date) AS p FROM bars) SELECT sqrt(avg((a - p) ** 2)) AS rmse, 1 - sum((a - p) ** 2) / (var_pop(a) * count(a)) AS r2, avg((sign(a) = sign(p))::INT) AS sign_accuracy FROM p WHERE p IS NOT NULL"), "rmse r2 sign_accuracy", 4)
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    naive = load(spark, d, "month").withColumn("p", F.lag("fClose").over(S.W())).where("p IS NOT NULL")
    return Q.regression_metrics(naive, "fClose", "p")


@query("order_validation", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus' END, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'o_orderpriority' END], lambda x: x IS NOT NULL), ',') AS problems FROM orders")
def order_validation(spark: SparkSession, d: str) -> DataFrame:
    checked = Q.domain_check(table(spark, d, "orders"), {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"]})
    return checked.select("o_orderkey", F.array_join("problems", ",").alias("problems"))


@query("microstructure_ratios", over("month", "SELECT symbol, date, (fHigh - fLow) / fClose AS range_share, fVolume / nullif(fHigh - fLow, 0) AS vol_per_range FROM bars"), "range_share vol_per_range")
def microstructure_ratios(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("fHigh") - F.col("fLow")
    return load(spark, d, "month").select("symbol", "date", F.try_divide(r, F.col("fClose")).alias("range_share"), F.try_divide(F.col("fVolume"), r).alias("vol_per_range"))


@query(
    "symbol_meta_days",
    "SELECT s_suppkey, n_name, r_name, (5 * ((nxt - DATE '1970-01-05') // 7) + least((nxt - DATE '1970-01-05') % 7, 5)) - (5 * ((DATE '2000-01-03' - DATE '1970-01-05') // 7) + least((DATE '2000-01-03' - DATE '1970-01-05') % 7, 5)) AS days_until FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN (SELECT l_suppkey, min(l_shipdate)::DATE AS nxt FROM lineitem WHERE l_shipdate >= DATE '2000-01-03' GROUP BY 1) ON l_suppkey = s_suppkey",
)
def symbol_meta_days(spark: SparkSession, d: str) -> DataFrame:
    start = F.lit("2000-01-03").cast("date")
    nxt = table(spark, d, "lineitem").where("l_shipdate >= '2000-01-03'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.to_date(F.min("l_shipdate")).alias("nxt"))
    meta = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return meta.join(nxt, "s_suppkey").select("s_suppkey", "n_name", "r_name", D.weekdays_between(start, F.col("nxt")).cast("long").alias("days_until"))


@query(
    "training_set",
    over(
        "month",
        """, c AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE (fClose - lag(fClose) OVER w) / lag(fClose) OVER w END AS chg FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, chg, CASE WHEN count(*) OVER w10 >= 10 THEN avg(fClose) OVER w10 END AS sma_10, (n_regionkey = 0)::INT AS sector_0, (n_regionkey = 1)::INT AS sector_1 FROM c JOIN supplier ON s_suppkey = symbol JOIN nation ON s_nationkey = n_nationkey WINDOW w10 AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING)""",
    ),
    "chg sma_10",
)
def training_set(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.relational import one_hot

    sectors = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("symbol"), F.col("n_regionkey").alias("sector"))
    df = S.sma(S.change_pct(load(spark, d, "month"), "chg"), (10,)).join(sectors, "symbol")
    return one_hot(df, "sector", ["0", "1"], "sector_").select("symbol", "date", "chg", "sma_10", "sector_0", "sector_1")


@query("embedding_norms", "SELECT vec_id, label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings", "norm", 5)
def embedding_norms(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", "label", F.sqrt(total).alias("norm"))
