"""Queries of the Fibonacci pipeline, over weekly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.operators import fib as B
from barwright.operators import studies as S
from barwright.plans.bars import dealt, load, over
from barwright.plans.registry import query
from barwright.plans.streams import checkpointed
from barwright.plans.studies import CHANGED, RN, W


def _input(spark: SparkSession, d: str) -> DataFrame:
    """Numbered bars. All steps of the pipeline start from them, so they are kept, dealt by symbol and in order: what follows shuffles only what it picks out."""
    return checkpointed(B.numbered(S.running_high(S.gap(S.change_pct(dealt(spark, d, "week"))))))


_PER = "PARTITION BY symbol"
_BASE = f"""{CHANGED}, g AS (SELECT *, lag(fClose) OVER {W} AS pc, {RN} AS rn, count(*) OVER ({_PER}) AS k, fHigh - fLow AS fRange,
 CASE WHEN fHigh > coalesce(max(fHigh) OVER ({_PER} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN fHigh END AS fHighMax FROM changed),
n AS (SELECT *, CASE WHEN pc IS NULL THEN 1 WHEN fOpen > (1 + 0.025::DOUBLE) * pc OR fOpen < (1 - 0.025::DOUBLE) * pc THEN round(fOpen / pc - 1, 3) ELSE 0 END AS gap FROM g WHERE k >= 15)"""
_CAND = f"""{_BASE}, near AS (SELECT *, lead(fChangeP) OVER {W} AS next_chg, lead(fClose) OVER {W} AS next_c, lead(fHigh) OVER {W} AS next_h, lag(fChangeP) OVER {W} AS prev_chg, lag(fHigh) OVER {W} AS prev_h,
 rank() OVER ({_PER} ORDER BY fVolume DESC) AS vr FROM n),
chosen AS (SELECT *, rank() OVER ({_PER} ORDER BY fChangeP DESC) AS chg_rank FROM near WHERE vr <= 10 AND fChangeP > 0),
cand AS (SELECT *, CASE WHEN prev_chg IS NOT NULL AND next_chg IS NOT NULL AND fRange <> 0 THEN
 (chg_rank <= 5 AND fHighMax IS NOT NULL AND fClose - fOpen > 0.5::DOUBLE * fRange) OR (prev_chg > 0 AND next_chg < 1 AND next_c < fHigh AND prev_h < fHigh) OR (prev_chg > 0 AND next_chg < fChangeP AND next_h < fHigh) END AS hit FROM chosen)"""
_MAX = f"""{_CAND}, c2 AS (SELECT *, count(*) FILTER (WHERE hit) OVER ({_PER}) AS hits, min(rn) FILTER (WHERE hit) OVER ({_PER}) AS f, max(rn) FILTER (WHERE hit) OVER ({_PER}) AS l FROM cand),
i AS (SELECT * FROM c2 WHERE hits > 1 AND rn BETWEEN f AND l),
i2 AS (SELECT a.*, (SELECT count(*) FROM i b WHERE b.symbol = a.symbol AND b.fRange > a.fRange) AS wider, (SELECT count(*) FROM i b WHERE b.symbol = a.symbol AND b.fChangeP > a.fChangeP) AS stronger,
 (SELECT count(*) FROM i b WHERE b.symbol = a.symbol AND b.gap > a.gap) AS gappier, (SELECT count(*) FROM i b WHERE b.symbol = a.symbol AND b.rn < a.rn) AS earlier FROM i a),
i3 AS (SELECT symbol, list(rn) FILTER (WHERE wider < 2 AND stronger < 2 AND earlier < 3) AS s1, list(rn) FILTER (WHERE stronger < 2 AND earlier < 3) AS s2, list(rn) FILTER (WHERE stronger < 5 AND gappier < 3) AS s3,
 min(rn) AS early, arg_min(rn, row(-fRange, rn)) AS wide FROM i2 GROUP BY 1),
i4 AS (SELECT *, coalesce(s1, s2, s3, []) AS rest, CASE WHEN s1 IS NOT NULL THEN 'sort1' WHEN s2 IS NOT NULL THEN 'sort2' ELSE 'sort3' END AS rule FROM i3),
max_row AS (SELECT symbol, CASE WHEN len(rest) = 1 THEN rest[1] WHEN len(rest) BETWEEN 2 AND 5 THEN early ELSE wide END AS m, CASE WHEN len(rest) = 1 THEN rule WHEN len(rest) BETWEEN 2 AND 5 THEN 'sort4' ELSE 'sort5' END AS how FROM i4
 UNION ALL SELECT symbol, rn, '1' FROM c2 WHERE hits = 1 AND hit UNION ALL SELECT symbol, arg_min(rn, row(-fChangeP, rn)), 'else' FROM c2 WHERE hits = 0 GROUP BY 1)"""
_RUN = f"""{_MAX}, mrow AS (SELECT n.symbol, m, fOpen AS m_o, fHigh AS m_h, fLow AS m_l, fClose AS m_c FROM n JOIN max_row r ON n.symbol = r.symbol AND n.rn = r.m),
walk AS (SELECT n.*, m, m_o, m_h, m_l, m_c, p_h, p_l FROM (SELECT *, lead(fHigh) OVER {W} AS p_h, lead(fLow) OVER {W} AS p_l FROM n) n JOIN mrow USING (symbol) WHERE abs(rn - m) <= 50),
steps AS (SELECT *, coalesce((fChangeP > -0.005::DOUBLE AND fHigh > m_h) OR (abs(fChangeP) < 0.0035::DOUBLE AND fHigh > m_l), false) AS gf,
 coalesce((fChangeP >= -0.005::DOUBLE AND fClose < m_c AND fClose > fOpen) OR (abs(fChangeP) < 0.0035::DOUBLE AND 0.995::DOUBLE * fHigh < m_l AND fHigh > p_h AND fLow > p_l) OR (m_l > fLow AND m_c > fHigh AND fHigh > p_h AND fLow > p_l), false) AS gb,
 coalesce((m_l > fLow AND m_h < fOpen) OR m_l - fHigh > 0.5, false) AS keep FROM walk),
stops AS (SELECT symbol, m, any_value(k) AS k, min(rn) FILTER (WHERE rn > m AND NOT gf) AS f, max(rn) FILTER (WHERE rn < m AND NOT gb) AS b, arg_max(keep, rn) FILTER (WHERE rn < m AND NOT gb) AS bk, max(rn) AS top, min(rn) AS bottom FROM steps GROUP BY 1, 2),
run AS (SELECT symbol, m, (CASE WHEN b IS NOT NULL THEN CASE WHEN bk THEN b ELSE b + 1 END WHEN m - bottom >= 50 THEN m ELSE 1 END)::INT AS "begin", (CASE WHEN f IS NOT NULL THEN f - 1 WHEN top - m >= 50 THEN m ELSE k END)::INT AS "end" FROM stops)"""
_RET = ", ".join(f"round(high - range * {p}::DOUBLE, 3) AS {B.level_name('ret', p)}" for p in B.LEVELS)
_EXT = ", ".join(f"round(ext_end + range * {p}::DOUBLE, 3) AS {B.level_name('ext', p)}" for p in B.LEVELS)
_NAMES = [B.level_name(k, p) for k in ("ret", "ext") for p in B.LEVELS]
_LEVELS = f"""{_RUN}, spans AS (SELECT n.symbol, m, min(fLow) AS start, max(fHigh) AS high, min(date) AS first_date, max(date) AS last_date FROM n JOIN run r ON n.symbol = r.symbol AND n.rn BETWEEN r."begin" AND r."end" GROUP BY 1, 2),
j AS (SELECT s.*, high - start AS range, a.fLow AS ml, a.date AS mdate, b.fLow AS nl, b.date AS ndate, coalesce(b.fLow < a.fLow, false) AS goes_on FROM spans s JOIN n a ON a.symbol = s.symbol AND a.rn = s.m LEFT JOIN n b ON b.symbol = s.symbol AND b.rn = s.m + 1),
j2 AS (SELECT *, CASE WHEN goes_on AND range > start THEN high - (start + 0.5::DOUBLE * range) ELSE (high - 0.382::DOUBLE * range) * 0.618::DOUBLE END AS e FROM j),
j3 AS (SELECT *, CASE WHEN e < start THEN CASE WHEN goes_on THEN nl ELSE ml END ELSE e END AS ext_end, CASE WHEN e < start THEN CASE WHEN goes_on THEN 'nextLow' ELSE 'maxLow' END WHEN goes_on AND range > start THEN 'range' ELSE 'fib618' END AS cond,
 CASE WHEN goes_on THEN ndate ELSE mdate END AS ext_date FROM j2),
lv AS (SELECT symbol, m, start, high, range, range / start AS perc_range, first_date, last_date, ext_end, ext_date, cond, {_RET}, {_EXT} FROM j3)"""


@query("fib_candidates", over("week", f", {_CAND} SELECT symbol, date, rn, chg_rank, hit FROM cand"))
def fib_candidates(spark: SparkSession, d: str) -> DataFrame:
    return B.candidates(_input(spark, d)).select("symbol", "date", F.col("rn").cast("long").alias("rn"), F.col("chg_rank").cast("long").alias("chg_rank"), "hit")


@query("fib_max_rows", over("week", f", {_MAX} SELECT symbol, m, how FROM max_row"))
def fib_max_rows(spark: SparkSession, d: str) -> DataFrame:
    return B.max_rows(_input(spark, d)).withColumn("m", F.col("m").cast("long"))


@query("fib_runs", over("week", f', {_RUN} SELECT symbol, m, "begin", "end" FROM run'))
def fib_runs(spark: SparkSession, d: str) -> DataFrame:
    n = _input(spark, d)
    return B.runs(n, B.max_rows(n)).withColumn("m", F.col("m").cast("long"))


@query("fib_levels", over("week", f", {_LEVELS} SELECT * FROM lv"))
def fib_levels(spark: SparkSession, d: str) -> DataFrame:
    return B.pipeline(_input(spark, d))[0].withColumn("m", F.col("m").cast("long"))


@query(
    "fib_confirm",
    over(
        "week",
        f""", {_LEVELS}, p AS (SELECT n.symbol, date, unnest(['fOpen', 'fHigh', 'fLow', 'fClose']) AS price, unnest([fOpen, fHigh, fLow, fClose]) AS v FROM n JOIN run r ON n.symbol = r.symbol AND n.rn BETWEEN r."begin" AND r."end"),
u AS (SELECT symbol, unnest([{", ".join(f"'{x}'" for x in _NAMES)}]) AS level, unnest([{", ".join(_NAMES)}]) AS level_value FROM lv)
SELECT symbol, level, date, price, round((v - level_value) / level_value, 2) AS diff, level_value FROM p JOIN u USING (symbol) WHERE abs((v - level_value) / nullif(level_value, 0)) < 0.025::DOUBLE""",
    ),
)
def fib_confirm(spark: SparkSession, d: str) -> DataFrame:
    return B.pipeline(_input(spark, d))[1]


def _least(x: str) -> str:
    return "list_min([" + ", ".join(f"{{'d': abs({x} - {n}), 'n': '{n}', 'v': {n}}}" for n in _NAMES) + "])"


@query(
    "fib_nearest",
    over(
        "week",
        f""", {_LEVELS}, a AS (SELECT n.symbol, date, {_least('fHigh')} AS h, {_least('fLow')} AS l FROM n JOIN lv USING (symbol))
SELECT symbol, date, h.n AS h_level, h.v AS h_value, l.n AS l_level, l.v AS l_value, h.d / nullif(h.v, 0) AS h_pct, l.d / nullif(l.v, 0) AS l_pct FROM a""",
    ),
    "h_pct l_pct",
)
def fib_nearest(spark: SparkSession, d: str) -> DataFrame:
    n = _input(spark, d)
    return B.nearest(n, B.pipeline(n)[0])


_OUT = [B.level_name("ext", p) for p in B.LEVELS if p >= 1]


@query(
    "fib_cross_days",
    over(
        "week",
        f""", {_LEVELS}, u AS (SELECT symbol, last_date, unnest([{", ".join(f"'{x}'" for x in _OUT)}]) AS level, unnest([{", ".join(_OUT)}]) AS v FROM lv),
x AS (SELECT symbol, level, last_date, min(date) FILTER (WHERE fHigh >= v) AS first_cross, count(*) FILTER (WHERE fHigh >= v) / count(*) AS share_past FROM n JOIN u USING (symbol) WHERE date > last_date GROUP BY 1, 2, 3)
SELECT symbol, level, first_cross, (first_cross - last_date)::INT AS days_to, share_past FROM x""",
    ),
    "share_past",
)
def fib_cross_days(spark: SparkSession, d: str) -> DataFrame:
    n = _input(spark, d)
    return B.crossings(n, B.pipeline(n)[0])


@query(
    "fib_hits",
    over("week", f", {_LEVELS} SELECT symbol, " + ", ".join(f"count(*) FILTER (WHERE fHigh > 0.98::DOUBLE * {B.level_name('ext', p)}) AS {B.level_name('hit', p)}" for p in (1.618, 2.618, 4.236)) + " FROM n JOIN lv USING (symbol) WHERE date > last_date GROUP BY 1"),
)
def fib_hits(spark: SparkSession, d: str) -> DataFrame:
    n = _input(spark, d)
    return B.hits(n, B.pipeline(n)[0])


@query(
    "fib_level_summary",
    over(
        "week",
        f""", {_LEVELS}, a AS (SELECT n.symbol, {_least('fHigh')} AS h FROM n JOIN lv USING (symbol)), c AS (SELECT h.n AS level, h.d / nullif(h.v, 0) AS pct FROM a),
t AS (SELECT unnest([0.01, 0.05, 0.1])::DOUBLE AS cutoff) SELECT level, cutoff, count(*) AS n, avg(pct) AS mean_pct FROM c JOIN t ON abs(pct) < cutoff GROUP BY 1, 2""",
    ),
    "mean_pct",
)
def fib_level_summary(spark: SparkSession, d: str) -> DataFrame:
    n = _input(spark, d)
    near = B.nearest(n, B.pipeline(n)[0])
    cut = near.select(F.col("h_level").alias("level"), F.col("h_pct").alias("pct"), F.explode(F.array(*map(F.lit, (0.01, 0.05, 0.1)))).alias("cutoff"))
    return cut.where("abs(pct) < cutoff").groupBy("level", "cutoff").agg(F.count("*").alias("n"), F.avg("pct").alias("mean_pct"))


@query(
    "days_until_event",
    over(
        "week",
        f"""SELECT symbol, date, next_date, (epoch(next_date) / 86400 - epoch(date) / 86400)::BIGINT / 7 * 5 AS days_until FROM (SELECT symbol, date, min(CASE WHEN fVolume > 100 THEN date END) OVER ({_PER} ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_date FROM bars)""",
    ),
)
def days_until_event(spark: SparkSession, d: str) -> DataFrame:
    df = B.days_until(load(spark, d, "week"), F.col("fVolume") > 100)
    return df.select("symbol", "date", "next_date", F.col("days_until").cast("double").alias("days_until"))
