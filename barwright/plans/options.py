"""Queries of option flow, over a chain made from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.functions import options as O
from barwright.operators import options as P
from barwright.operators import patterns as A
from barwright.operators import studies as S
from barwright.plans.bars import load, over
from barwright.plans.registry import query, table
from barwright.plans.studies import CHANGED, RN, W, last

CHAIN = """chain AS (SELECT l_suppkey AS underlying, date_trunc('quarter', l_shipdate)::DATE AS expires, floor(l_extendedprice / 20000)::BIGINT * 20000 AS strike,
 CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'R' THEN 'P' END AS side, date_trunc('month', l_shipdate)::DATE AS date, sum(l_quantity) AS volume, count(*) AS oi,
 max(l_extendedprice / nullif(l_quantity, 0)) AS ask, min(l_extendedprice / nullif(l_quantity, 0)) AS bid
FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2, 3, 4, 5)"""


def _chain(spark: SparkSession, d: str) -> DataFrame:
    return P.chain(table(spark, d, "lineitem"))


def with_chain(sql: str) -> str:
    return f"WITH {CHAIN} {sql}"


_SIDES = ", ".join(f"coalesce(sum({c}) FILTER (WHERE side = '{s}'), 0) AS {c}_{s}" for c in ("volume", "oi") for s in "PC")


@query("put_call", with_chain(f", s AS (SELECT underlying, expires, strike, {_SIDES} FROM chain GROUP BY 1, 2, 3) SELECT underlying, expires, strike, coalesce(volume_P / nullif(volume_C, 0), 0) AS pc_ratio, coalesce(oi_P / nullif(oi_C, 0), 0) AS oi_ratio FROM s"), "pc_ratio oi_ratio")
def put_call(spark: SparkSession, d: str) -> DataFrame:
    return P.put_call(_chain(spark, d), ["underlying", "expires", "strike"])


@query("pc_summary", with_chain(f", s AS (SELECT underlying, {_SIDES} FROM chain GROUP BY 1) SELECT underlying, coalesce(volume_P / nullif(volume_C, 0), 0) AS pc_ratio, coalesce(oi_P / nullif(oi_C, 0), 0) AS oi_ratio FROM s"), "pc_ratio oi_ratio")
def pc_summary(spark: SparkSession, d: str) -> DataFrame:
    return P.put_call(_chain(spark, d), ["underlying"])


_RANK = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count(*) OVER ()"


@query(
    "bull_bear",
    with_chain(
        f", s AS (SELECT underlying, {_SIDES} FROM chain GROUP BY 1), q AS (SELECT underlying, coalesce(volume_P / nullif(volume_C, 0), 0) AS a, coalesce(oi_P / nullif(oi_C, 0), 0) AS b FROM s), r AS (SELECT underlying, {_RANK('a')} AS ra, {_RANK('b')} AS rb FROM q) SELECT underlying, CASE WHEN greatest(ra, rb) < 0.25 THEN 'bull' ELSE 'bear' END AS mood FROM r WHERE greatest(ra, rb) < 0.25 OR least(ra, rb) > 0.75"
    ),
)
def bull_bear(spark: SparkSession, d: str) -> DataFrame:
    return P.bull_bear(P.put_call(_chain(spark, d), ["underlying"]), "underlying", ["pc_ratio", "oi_ratio"], 0.25, 0.75)


@query("unusual_volume", with_chain("SELECT underlying, expires, strike, side, date, volume / CASE WHEN oi = 0 THEN 1 ELSE oi END AS v_oi, ask - bid AS spread FROM chain WHERE volume / CASE WHEN oi = 0 THEN 1 ELSE oi END > 0.25 AND volume > 50"), "v_oi")
def unusual_volume(spark: SparkSession, d: str) -> DataFrame:
    return P.unusual_volume(_chain(spark, d)).select("underlying", "expires", "strike", "side", "date", "v_oi", "spread")


@query(
    "mmo_top",
    with_chain(
        ", days AS (SELECT date, expires, underlying, side, sum(abs(volume)) AS tot_vol FROM chain WHERE underlying NOT IN (1, 2, 3) GROUP BY 1, 2, 3, 4), a AS (SELECT *, tot_vol / avg(tot_vol) OVER (PARTITION BY underlying, side) AS vol_avg FROM days) SELECT date, expires, underlying, side, tot_vol, vol_avg FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY vol_avg DESC, tot_vol DESC, expires, underlying, side) AS rn FROM a) WHERE rn <= 15"
    ),
    "vol_avg",
)
def mmo_top(spark: SparkSession, d: str) -> DataFrame:
    return P.top_volume_over_average(_chain(spark, d), 15, (1, 2, 3))


@query("mmo_new_vs_prev", with_chain("SELECT DISTINCT underlying, side FROM chain WHERE date = DATE '1996-02-01' AND (underlying, side, strike) NOT IN (SELECT (underlying, side, strike) FROM chain WHERE date = DATE '1996-01-01')"))
def mmo_new_vs_prev(spark: SparkSession, d: str) -> DataFrame:
    day = lambda x: F.lit(x).cast("date")
    return P.new_since(_chain(spark, d), ["underlying", "side", "strike"], day("1996-02-01"), day("1996-01-01")).select("underlying", "side").distinct()


@query("horizon_buckets", "SELECT CASE WHEN n < 45 THEN 'short' WHEN n > 45 AND n < 180 THEN 'med' WHEN n > 180 THEN 'long' END AS bucket, count(*) AS k, sum(q) AS volume FROM (SELECT l_shipdate::DATE - o_orderdate::DATE AS n, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1")
def horizon_buckets(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return lines.groupBy(P.horizon(F.datediff("l_shipdate", "o_orderdate")).alias("bucket")).agg(F.count("*").alias("k"), F.sum("l_quantity").alias("volume"))


@query("vol_oi_group_share", with_chain("SELECT underlying, expires, strike, side, date, volume / sum(volume) OVER w AS vol_share, oi / sum(oi) OVER w AS oi_share FROM chain WINDOW w AS (PARTITION BY underlying, date, expires, side)"), "vol_share oi_share")
def vol_oi_group_share(spark: SparkSession, d: str) -> DataFrame:
    return P.group_share(_chain(spark, d), ["underlying", "date", "expires", "side"]).select("underlying", "expires", "strike", "side", "date", "vol_share", "oi_share")


@query("clean_chain", with_chain("SELECT underlying, expires, strike, side, date, true AS mid_close, volume / greatest(oi, 1) AS v_oi FROM chain"), "v_oi")
def clean_chain(spark: SparkSession, d: str) -> DataFrame:
    close = F.abs(F.col("mid") - (F.col("bid") + F.col("ask")) / 2) <= 0.000501  # mid is rounded to 3 decimals, on which the engines differ at ties
    return P.clean_chain(_chain(spark, d)).select("underlying", "expires", "strike", "side", "date", close.alias("mid_close"), "v_oi")


@query(
    "latest_interest",
    with_chain(
        ", v AS (SELECT underlying, side, sum(volume) AS volume FROM chain GROUP BY 1, 2), i AS (SELECT underlying, side, date, sum(oi)::BIGINT AS oi FROM chain GROUP BY 1, 2, 3), r AS (SELECT underlying, side, arg_max(oi, date) AS last_oi FROM i WHERE date >= (SELECT max(date) FROM i) - 100 GROUP BY 1, 2) SELECT underlying, side, volume, last_oi, volume / CASE WHEN last_oi > 0 THEN last_oi END AS v_oi FROM v LEFT JOIN r USING (underlying, side)"
    ),
    "v_oi",
)
def latest_interest(spark: SparkSession, d: str) -> DataFrame:
    c = _chain(spark, d)
    keys = ["underlying", "side"]
    return P.latest_interest(c.groupBy(*keys).agg(F.sum("volume").alias("volume")), c.groupBy(*keys, "date").agg(F.sum("oi").alias("oi")), keys, 100)


@query(
    "clean_trades",
    """SELECT event_id, time_no, premium FROM (SELECT *, row_number() OVER (PARTITION BY symbol, day, time_no ORDER BY volume DESC, price DESC) AS rn, floor(volume * price) * 100 AS premium FROM
 (SELECT *, dense_rank() OVER (PARTITION BY day ORDER BY ts) - 1 AS time_no FROM (SELECT event_id, user_id AS symbol, ts, ts::DATE AS day, value AS volume, 10.0 AS price FROM events) WHERE volume > 1 AND hour(ts) > 9)) WHERE rn = 1 AND premium > 10000""",
)
def clean_trades(spark: SparkSession, d: str) -> DataFrame:
    trades = table(spark, d, "events").select("event_id", F.col("user_id").alias("symbol"), "ts", F.col("value").alias("volume"), F.lit(10.0).alias("price"))
    return P.clean_trades(trades).select("event_id", F.col("time_no").cast("long").alias("time_no"), F.col("premium").cast("double").alias("premium"))


_DAY = "date_add(DATE '2020-01-01', (o_orderkey % 900)::INT)"


@query(
    "contract_symbol",
    "SELECT o_orderkey, rpad('S' || (o_custkey % 100), 6, ' ') || strftime(d, '%y%m%d') || CASE WHEN o_orderstatus = 'F' THEN 'C' ELSE 'P' END || lpad((k * 1000)::BIGINT::VARCHAR, 8, '0') AS osi FROM (SELECT *, (DATE '2020-01-01' + (o_orderkey % 900)::INT) AS d, 5 + (o_orderkey % 400) / 2 AS k FROM orders)",
)
def contract_symbol(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d).select("o_orderkey", "osi")


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("o_orderkey") % 900).cast("int"))
    strike = 5 + (F.col("o_orderkey") % 400) / 2
    side = F.when(F.col("o_orderstatus") == "F", "C").otherwise("P")
    osi = O.build_symbol(F.concat(F.lit("S"), (F.col("o_custkey") % 100).cast("string")), day, side, strike)
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", osi.alias("osi"))


@query(
    "osi_parse",
    "SELECT o_orderkey, 'S' || (o_custkey % 100) AS root, DATE '2020-01-01' + (o_orderkey % 900)::INT AS expires, CASE WHEN o_orderstatus = 'F' THEN 'C' ELSE 'P' END AS side, 5 + (o_orderkey % 400) / 2 AS strike FROM orders",
)
def osi_parse(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d).select("o_orderkey", *[c.alias(n) for n, c in O.parse_symbol(F.col("osi")).items()])


@query("missing_expiries", with_chain(", w AS (SELECT u.underlying AS symbol, e.expires FROM (SELECT DISTINCT underlying FROM chain) u CROSS JOIN (SELECT DISTINCT expires FROM chain) e) SELECT symbol, array_to_string(list_sort(list(expires)), ',') AS expires FROM w WHERE (symbol, expires) NOT IN (SELECT (underlying, expires) FROM chain WHERE side = 'C') GROUP BY 1"))
def missing_expiries(spark: SparkSession, d: str) -> DataFrame:
    c = _chain(spark, d).withColumnRenamed("underlying", "symbol")
    all_expiries = c.select("expires").distinct().agg(F.collect_list("expires").alias("e"))
    wanted = c.select("symbol").distinct().crossJoin(F.broadcast(all_expiries)).select("symbol", F.explode("e").alias("expires"))
    return P.missing_expiries(wanted, c.where("side = 'C'")).select("symbol", F.array_join(F.transform("expires", lambda x: x.cast("string")), ",").alias("expires"))


@query("iv_term_pivot", with_chain("SELECT underlying, " + ", ".join(f"max(ask) FILTER (WHERE year(expires) = {y}) AS y{y}" for y in range(1995, 2002)) + " FROM chain GROUP BY 1"))
def iv_term_pivot(spark: SparkSession, d: str) -> DataFrame:
    years = list(range(1995, 2002))
    wide = _chain(spark, d).withColumn("y", F.concat(F.lit("y"), F.year("expires"))).groupBy("underlying").pivot("y", [f"y{y}" for y in years]).agg(F.max("ask"))
    return wide


_T = "(0.25 + (p_partkey % 8) / 8)"
_N = lambda x: f"CASE WHEN {x} >= 0 THEN 1 - t_{x} ELSE t_{x} END"


def _tail(x: str) -> str:
    k = f"(1 / (1 + 0.2316419::DOUBLE * abs({x})))"
    b = [f"{v}::DOUBLE" for v in O._B]
    poly = f"((((({b[4]}) * {k} + ({b[3]})) * {k} + ({b[2]})) * {k} + ({b[1]})) * {k} + ({b[0]})) * {k}"
    return f"exp(-abs({x}) * abs({x}) / 2) * 0.3989422804014327::DOUBLE * {poly} AS t_{x}"


@query(
    "bs_price",
    f"""WITH i AS (SELECT p_partkey, p_retailprice AS s, p_retailprice * (0.8::DOUBLE + (p_partkey % 5) * 0.1::DOUBLE) AS k, {_T} AS t, 0.03::DOUBLE AS r, 0.1::DOUBLE + (p_size / 100) AS v FROM part),
x AS (SELECT *, (ln(s / k) + (r + v * v / 2) * t) / (v * sqrt(t)) AS d1 FROM i), y AS (SELECT *, d1 - v * sqrt(t) AS d2 FROM x), z AS (SELECT *, {_tail('d1')}, {_tail('d2')} FROM y)
SELECT p_partkey, s * ({_N('d1')}) - k * exp(-r * t) * ({_N('d2')}) AS call, k * exp(-r * t) - s + s * ({_N('d1')}) - k * exp(-r * t) * ({_N('d2')}) AS put, s * exp(-d1 * d1 / 2) * 0.3989422804014327::DOUBLE * sqrt(t) AS vega FROM z""",
    "call put vega",
)
def bs_price(spark: SparkSession, d: str) -> DataFrame:
    args = _bs_inputs()
    return table(spark, d, "part").select("p_partkey", O.bs_call(*args).alias("call"), O.bs_put(*args).alias("put"), O.bs_vega(*args).alias("vega"))


def _bs_inputs():
    s = F.col("p_retailprice")
    return s, s * (0.8 + (F.col("p_partkey") % 5) * 0.1), 0.25 + (F.col("p_partkey") % 8) / 8, F.lit(0.03), 0.1 + F.col("p_size") / 100


@query("implied_vol", "SELECT p_partkey, 0.1::DOUBLE + p_size / 100 AS vol FROM part", "vol", 4)
def implied_vol(spark: SparkSession, d: str) -> DataFrame:
    s, k, t, r, v = _bs_inputs()
    return table(spark, d, "part").select("p_partkey", O.implied_vol(O.bs_call(s, k, t, r, v), s, k, t, r).alias("vol"))


_CP5 = f"{CHANGED}, f AS (SELECT *, CASE WHEN {RN} = 1 THEN 0 ELSE sum(fChangeP) OVER {last(5)} END AS fCP5 FROM changed)"


@query("bull_flag", over("day", f", {_CP5}, x AS (SELECT symbol, date, fCP5, lag(fCP5, 5) OVER {W} AS b, lead(fCP5, 5) OVER {W} AS a FROM f) SELECT symbol, date, fCP5 FROM x WHERE fCP5 BETWEEN 0.1 AND 0.25 AND b BETWEEN -0.05 AND 0.05 AND a BETWEEN -0.025 AND 0.025"), "fCP5")
def bull_flag(spark: SparkSession, d: str) -> DataFrame:
    return A.bull_flags(S.rolling_sum(S.change_pct(load(spark, d, "day")), "fChangeP", 5, "fCP5")).select("symbol", "date", "fCP5")


@query(
    "gap_recovery",
    over("week", f", p AS (SELECT *, lag(fClose) OVER {W} AS pc FROM bars), g AS (SELECT symbol, date, pc AS level FROM p WHERE fOpen < 0.975::DOUBLE * pc AND round(fOpen / pc - 1, 3) <= -0.05) SELECT g.symbol, g.date, min(b.date) AS recovered FROM g LEFT JOIN bars b ON b.symbol = g.symbol AND b.date > g.date AND b.fHigh >= g.level GROUP BY 1, 2"),
)
def gap_recovery(spark: SparkSession, d: str) -> DataFrame:
    return A.gap_recovery(S.gap(load(spark, d, "week")))


@query(
    "vol_no_move",
    over("week", f", {CHANGED}, n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS k FROM changed) SELECT symbol, date, fVolume FROM n WHERE k >= 150 AND fVolume / 100 > 0.3::DOUBLE AND fChangeP > -0.05::DOUBLE AND fChangeP < 0.05::DOUBLE"),
)
def vol_no_move(spark: SparkSession, d: str) -> DataFrame:
    return A.volume_without_move(S.change_pct(load(spark, d, "week")).withColumn("shares", F.lit(100.0))).select("symbol", "date", "fVolume")


@query("topk_volume", "SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1 ORDER BY q DESC, l_suppkey LIMIT 50")
def topk_volume(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q")).orderBy(F.desc("q"), "l_suppkey").limit(50)


@query("call_vol_avg_scan", with_chain(", d AS (SELECT underlying, date, sum(volume) AS v FROM chain WHERE side = 'C' GROUP BY 1, 2), a AS (SELECT *, round(v / avg(v) OVER (PARTITION BY underlying) * 100) AS x FROM d) SELECT underlying, date, x FROM a ORDER BY x DESC, underlying, date LIMIT 50"))
def call_vol_avg_scan(spark: SparkSession, d: str) -> DataFrame:
    days = _chain(spark, d).where("side = 'C'").groupBy("underlying", "date").agg(F.sum("volume").alias("v"))
    x = F.round(F.col("v") / F.avg("v").over(Window.partitionBy("underlying")) * 100)
    return days.withColumn("x", x).select("underlying", "date", "x").orderBy(F.desc("x"), "underlying", "date").limit(50)
