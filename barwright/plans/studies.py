"""Queries of the technical studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.operators import studies as S
from barwright.plans.bars import load, over
from barwright.plans.registry import query

W = "(PARTITION BY symbol ORDER BY date)"
RN = f"row_number() OVER {W}"


def last(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def sma(n: int, column: str = "fClose") -> str:
    return f"CASE WHEN count({column}) OVER {last(n)} >= {n} THEN avg({column}) OVER {last(n)} END"


CHANGED = f"changed AS (SELECT *, CASE WHEN {RN} = 1 THEN 0 ELSE (fClose - lag(fClose) OVER {W}) / lag(fClose) OVER {W} END AS fChangeP FROM bars)"
CUM = f"{CHANGED}, cum AS (SELECT *, CASE WHEN {RN} > 1 THEN sum(fChangeP) OVER {W} END AS cumPerc FROM changed)"


@query("change_pct", over("day", f", {CHANGED} SELECT symbol, date, fChangeP FROM changed"), "fChangeP")
def change_pct(spark: SparkSession, d: str) -> DataFrame:
    return S.change_pct(load(spark, d, "day")).select("symbol", "date", "fChangeP")


@query(
    "change_pct_grid",
    over(
        "month",
        f""", grid AS (SELECT s.symbol, c.date, coalesce(b.fClose, lead(b.fClose) OVER (PARTITION BY s.symbol ORDER BY c.date)) AS x
 FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT DISTINCT date FROM bars) c LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = c.date),
moved AS (SELECT symbol, date, x / lag(x) OVER {W} - 1 AS fChangeP FROM grid)
SELECT b.symbol, b.date, m.fChangeP FROM bars b LEFT JOIN moved m ON b.symbol = m.symbol AND b.date = m.date""",
    ),
    "fChangeP",
)
def change_pct_grid(spark: SparkSession, d: str) -> DataFrame:
    return S.change_pct_grid(load(spark, d, "month")).select("symbol", "date", "fChangeP")


@query(
    "gap",
    over(
        "day",
        f"""SELECT symbol, date, CASE WHEN pc IS NULL THEN 1 WHEN fOpen > (1 + 0.025::DOUBLE) * pc OR fOpen < (1 - 0.025::DOUBLE) * pc THEN round(fOpen / pc - 1, 3) ELSE 0 END AS gap
FROM (SELECT *, lag(fClose) OVER {W} AS pc FROM bars)""",
    ),
)
def gap(spark: SparkSession, d: str) -> DataFrame:
    return S.gap(load(spark, d, "day")).select("symbol", "date", "gap")


@query("gap_range", over("week", f"SELECT symbol, date, CASE WHEN pc < fLow THEN fHigh - pc ELSE fHigh - fLow END AS gRange FROM (SELECT *, lag(fClose) OVER {W} AS pc FROM bars)"))
def gap_range(spark: SparkSession, d: str) -> DataFrame:
    return S.gap_range(load(spark, d, "week")).select("symbol", "date", "gRange")


@query("cum_pct", over("day", f", {CUM} SELECT symbol, date, cumPerc FROM cum"), "cumPerc")
def cum_pct(spark: SparkSession, d: str) -> DataFrame:
    return S.cum_pct(S.change_pct(load(spark, d, "day"))).select("symbol", "date", "cumPerc")


_FORWARD = ", ".join(f"lead(cumPerc, {k}) OVER {W} - cumPerc AS perc{k}" if k == 5 else f"abs(lead(cumPerc, {k}) OVER {W}) - abs(cumPerc) AS perc{k}" for k in (1, 2, 3, 5, 10, 20))


@query("forward_pct", over("week", f", {CUM} SELECT symbol, date, {_FORWARD} FROM cum"), "perc1 perc2 perc3 perc5 perc10 perc20")
def forward_pct(spark: SparkSession, d: str) -> DataFrame:
    df = S.forward_pct(S.cum_pct(S.change_pct(load(spark, d, "week"))))
    return df.select("symbol", "date", *[f"perc{k}" for k in (1, 2, 3, 5, 10, 20)])


@query("high_low_pct", over("week", "SELECT symbol, date, " + ", ".join(f"(lead(fHigh, {k}) OVER {W} - fLow) / fLow AS hl_perc{k}" for k in (1, 2, 3)) + " FROM bars"), "hl_perc1 hl_perc2 hl_perc3")
def high_low_pct(spark: SparkSession, d: str) -> DataFrame:
    return S.high_low_pct(load(spark, d, "week")).select("symbol", "date", "hl_perc1", "hl_perc2", "hl_perc3")


@query("two_row_pct", over("week", f", {CHANGED} SELECT symbol, date, fChangeP + lead(fChangeP, 10) OVER {W} AS perc_2weeks, fChangeP + lead(fChangeP, 30) OVER {W} AS perc_1month FROM changed"), "perc_2weeks perc_1month")
def two_row_pct(spark: SparkSession, d: str) -> DataFrame:
    return S.two_row_pct(S.change_pct(load(spark, d, "week"))).select("symbol", "date", "perc_2weeks", "perc_1month")


_SMAS = ", ".join(f"{sma(n)} AS sma_{n}" for n in S.SPANS)
_DIFFS = lambda p: ", ".join(f"{p}{a} - {p}{b} AS {p}{a}_{b}" for a, b in S.PAIRS)


@query("sma_10_20_50_200", over("day", f"SELECT symbol, date, {_SMAS} FROM bars"), "sma_10 sma_20 sma_50 sma_200")
def sma_10_20_50_200(spark: SparkSession, d: str) -> DataFrame:
    return S.sma(load(spark, d, "day")).select("symbol", "date", *[f"sma_{n}" for n in S.SPANS])


@query("sma_diffs", over("day", f", m AS (SELECT symbol, date, {_SMAS} FROM bars) SELECT symbol, date, {_DIFFS('sma_')} FROM m"), " ".join(f"sma_{a}_{b}" for a, b in S.PAIRS))
def sma_diffs(spark: SparkSession, d: str) -> DataFrame:
    return S.ma_diffs(S.sma(load(spark, d, "day"))).select("symbol", "date", *[f"sma_{a}_{b}" for a, b in S.PAIRS])


def ema_sql(source: str, spans=S.SPANS, keep: str = "", prefix: str = "") -> str:
    """The recursion itself, row by row: another method than the operator's window sums."""
    cols = ", ".join(f"fClose AS e{n}" for n in spans)
    step = ", ".join(f"e.e{n} * (1 - 2.0 / {n + 1}) + r.fClose * (2.0 / {n + 1})" for n in spans)
    out = ", ".join(f"CASE WHEN rn >= {n} THEN e{n} END AS ema_{n}" for n in spans)
    return f"""{prefix}numbered AS (SELECT *, {RN} AS rn FROM {source}),
{prefix}e AS (SELECT symbol, date, rn{keep}, {cols} FROM {prefix}numbered WHERE rn = 1 UNION ALL SELECT r.symbol, r.date, r.rn{keep.replace('f', 'r.f')}, {step} FROM {prefix}e AS e JOIN {prefix}numbered r ON r.symbol = e.symbol AND r.rn = e.rn + 1),
emas AS (SELECT symbol, date{keep}, {out} FROM {prefix}e)"""


def recursive(grain: str, sql: str) -> str:
    return over(grain, sql).replace("WITH ", "WITH RECURSIVE ", 1)


@query("ema_10_20_50_200", recursive("week", f", {ema_sql('bars')} SELECT symbol, date, {', '.join(f'ema_{n}' for n in S.SPANS)} FROM emas"), " ".join(f"ema_{n}" for n in S.SPANS))
def ema_10_20_50_200(spark: SparkSession, d: str) -> DataFrame:
    return S.ema(load(spark, d, "week")).select("symbol", "date", *[f"ema_{n}" for n in S.SPANS])


@query("ema_diffs", recursive("month", f", {ema_sql('bars')} SELECT symbol, date, {_DIFFS('ema_')} FROM emas"), " ".join(f"ema_{a}_{b}" for a, b in S.PAIRS))
def ema_diffs(spark: SparkSession, d: str) -> DataFrame:
    return S.ma_diffs(S.ema(load(spark, d, "month")), "ema_").select("symbol", "date", *[f"ema_{a}_{b}" for a, b in S.PAIRS])


_PRICE = [(p, m, n) for p in ("fClose", "fHigh", "fLow") for m in ("sma_", "ema_") for n in S.SPANS]


@query(
    "price_ma_diffs",
    recursive(
        "month",
        f", {ema_sql('bars', keep=', fClose, fHigh, fLow')}, both_ma AS (SELECT *, {_SMAS} FROM emas) SELECT symbol, date, {', '.join(f'{p} - {m}{n} AS {p}_{m}{n}' for p, m, n in _PRICE)} FROM both_ma",
    ),
    " ".join(f"{p}_{m}{n}" for p, m, n in _PRICE),
)
def price_ma_diffs(spark: SparkSession, d: str) -> DataFrame:
    return S.price_ma_diffs(S.sma(S.ema(load(spark, d, "month")))).select("symbol", "date", *[f"{p}_{m}{n}" for p, m, n in _PRICE])


def _cross(a: int, b: int) -> str:
    d, later = f"sma_{a}_{b}", f"lead(sma_{a}_{b}) OVER {W}"
    return f"CASE WHEN {d} <> 0 AND sign({d}) < sign({later}) THEN 1 WHEN {d} <> 0 AND sign({d}) > sign({later}) THEN -1 ELSE 0 END AS cross_{a}_{b}"


@query(
    "ma_cross_lookahead",
    over("day", f", m AS (SELECT symbol, date, {_SMAS} FROM bars), s AS (SELECT *, {_DIFFS('sma_')} FROM m) SELECT symbol, date, sma_10, sma_20, {', '.join(_cross(a, b) for a, b in S.PAIRS)} FROM s"),
    "sma_10 sma_20",
)
def ma_cross_lookahead(spark: SparkSession, d: str) -> DataFrame:
    df = S.ma_cross_ahead(S.ma_diffs(S.sma(load(spark, d, "day"))))
    return df.select("symbol", "date", "sma_10", "sma_20", *[f"cross_{a}_{b}" for a, b in S.PAIRS])


@query(
    "ema_cross_lookback",
    recursive(
        "week",
        f""", {ema_sql('bars', (10, 20))}, x AS (SELECT symbol, date, ema_10 - ema_20 AS cross_diff FROM emas)
SELECT symbol, date, cross_diff, CASE WHEN cross_diff < 0 AND lag(cross_diff) OVER {W} > 0 THEN -1 WHEN cross_diff > 0 AND lag(cross_diff) OVER {W} < 0 THEN 1 ELSE 0 END AS "cross" FROM x""",
    ),
    "cross_diff",
)
def ema_cross_lookback(spark: SparkSession, d: str) -> DataFrame:
    return S.ema_cross_back(S.ema(load(spark, d, "week"), (10, 20)), "ema_10", "ema_20", "cross").select("symbol", "date", "cross_diff", "cross")


@query(
    "ema_seeded",
    over(
        "month",
        f""", n AS (SELECT *, {RN} - 1 AS rn, avg(fClose) OVER {last(10)} AS m FROM bars),
x AS (SELECT *, CASE WHEN rn < 9 THEN 0 WHEN rn = 9 THEN m ELSE fClose * (2.0 / 11) END * power(1 - 2.0 / 11, -rn) AS w FROM n)
SELECT symbol, date, CASE WHEN rn >= 9 THEN power(1 - 2.0 / 11, rn) * sum(w) OVER {W} END AS ema_10 FROM x""",
    ),
    "ema_10",
)
def ema_seeded(spark: SparkSession, d: str) -> DataFrame:
    return S.ema(load(spark, d, "month"), (10,), seeded=True).select("symbol", "date", "ema_10")


@query(
    "sma_trend_flags",
    over("week", f", m AS (SELECT symbol, date, {sma(50)} AS sma_50, {sma(200)} AS sma_200 FROM bars) SELECT symbol, date, " + ", ".join(f"CASE WHEN sma_{n} > lag(sma_{n}) OVER {W} THEN 1 ELSE -1 END AS up{n}" for n in (50, 200)) + " FROM m"),
)
def sma_trend_flags(spark: SparkSession, d: str) -> DataFrame:
    return S.trend_flags(S.sma(load(spark, d, "week"), (50, 200))).select("symbol", "date", "up50", "up200")


@query("running_high", over("day", "SELECT symbol, date, CASE WHEN fHigh > coalesce(max(fHigh) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN fHigh END AS fHighMax FROM bars"))
def running_high(spark: SparkSession, d: str) -> DataFrame:
    return S.running_high(load(spark, d, "day")).select("symbol", "date", "fHighMax")


@query("vol_avg_60", over("day", f"SELECT symbol, date, {sma(60, 'fVolume')} AS vol_avg_2m, {sma(21, 'fVolume')} AS vol_avg_21 FROM bars"), "vol_avg_2m vol_avg_21")
def vol_avg_60(spark: SparkSession, d: str) -> DataFrame:
    df = S.sma(load(spark, d, "day"), (60, 21), "fVolume", "v_")
    return df.select("symbol", "date", F.col("v_60").alias("vol_avg_2m"), F.col("v_21").alias("vol_avg_21"))


@query("sum5", over("week", f", {CHANGED} SELECT symbol, date, CASE WHEN {RN} = 1 THEN 0 ELSE sum(fChangeP) OVER {last(5)} END AS fCP5 FROM changed"), "fCP5")
def sum5(spark: SparkSession, d: str) -> DataFrame:
    return S.rolling_sum(S.change_pct(load(spark, d, "week")), "fChangeP", 5, "fCP5").select("symbol", "date", "fCP5")


def _wilder(side: str) -> str:
    return f"CASE WHEN rn < 14 THEN 0 WHEN rn = 14 THEN avg({side}) OVER {last(14)} ELSE {side} / 14 END * power(13.0 / 14, -rn) AS {side}_w"


@query(
    "rsi_14",
    over(
        "week",
        f""", c AS (SELECT *, {RN} - 1 AS rn, fClose - lag(fClose) OVER {W} AS ch FROM bars), g AS (SELECT *, greatest(ch, 0) AS gain, greatest(-ch, 0) AS loss FROM c),
w AS (SELECT *, {_wilder('gain')}, {_wilder('loss')} FROM g), s AS (SELECT symbol, date, rn, sum(gain_w) OVER {W} AS sg, sum(loss_w) OVER {W} AS sl FROM w),
r AS (SELECT symbol, date, CASE WHEN rn >= 14 THEN coalesce(100 * sg / nullif(sg + sl, 0), 0) END AS rsi FROM s)
SELECT symbol, date, rsi, CASE WHEN rsi > 70 THEN 1 ELSE 0 END AS rsi_ob, CASE WHEN rsi < 30 THEN 1 ELSE 0 END AS rsi_os FROM r""",
    ),
    "rsi",
    5,
)
def rsi_14(spark: SparkSession, d: str) -> DataFrame:
    return S.rsi(load(spark, d, "week")).select("symbol", "date", "rsi", "rsi_ob", "rsi_os")


@query("obv", over("week", f", v AS (SELECT symbol, date, CASE WHEN lag(fClose) OVER {W} IS NULL THEN 0 WHEN fClose > lag(fClose) OVER {W} THEN fVolume ELSE -fVolume END AS x FROM bars) SELECT symbol, date, sum(x) OVER {W} AS obv FROM v"))
def obv(spark: SparkSession, d: str) -> DataFrame:
    return S.obv(load(spark, d, "week")).select("symbol", "date", "obv")


@query("accum_dist", over("week", f", a AS (SELECT symbol, date, coalesce(((fClose - fLow) - (fHigh - fClose)) / nullif(fHigh - fLow, 0) * fVolume, 0) AS ad FROM bars) SELECT symbol, date, ad, sum(ad) OVER {W} AS ad_line FROM a"), "ad ad_line")
def accum_dist(spark: SparkSession, d: str) -> DataFrame:
    return S.accumulation(load(spark, d, "week")).select("symbol", "date", "ad", "ad_line")


@query("ttm_trend", over("week", f"SELECT symbol, date, CASE WHEN count(*) OVER {last(6)} >= 6 THEN CASE WHEN fClose > avg((fHigh + fLow) / 2) OVER {last(6)} THEN 1 ELSE -1 END END AS ttm FROM bars"))
def ttm_trend(spark: SparkSession, d: str) -> DataFrame:
    return S.ttm_trend(load(spark, d, "week")).select("symbol", "date", "ttm")


def _near(k: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"


@query(
    "local_extrema_k",
    over("week", "SELECT symbol, date, " + ", ".join(f"CASE WHEN fClose = min(fClose) OVER {_near(k)} THEN fClose END AS min_{k}, CASE WHEN fClose = max(fClose) OVER {_near(k)} THEN fClose END AS max_{k}" for k in (5, 10, 20, 50, 200)) + " FROM bars"),
)
def local_extrema_k(spark: SparkSession, d: str) -> DataFrame:
    return S.local_extrema(load(spark, d, "week")).select("symbol", "date", *[f"{m}_{k}" for k in (5, 10, 20, 50, 200) for m in ("min", "max")])


@query("peaks", over("month", f"SELECT symbol, date, CASE WHEN fClose > lag(fClose) OVER {W} AND fClose > lead(fClose) OVER {W} THEN 1 ELSE 0 END AS peak FROM bars"))
def peaks(spark: SparkSession, d: str) -> DataFrame:
    return S.peaks(load(spark, d, "month")).select("symbol", "date", "peak")


@query("second_derivative", over("week", f"SELECT symbol, date, (lead(fClose) OVER {W} - lag(fClose) OVER {W}) / 2 AS d1, lead(fClose) OVER {W} - 2 * fClose + lag(fClose) OVER {W} AS d2 FROM bars"))
def second_derivative(spark: SparkSession, d: str) -> DataFrame:
    return S.derivatives(load(spark, d, "week")).select("symbol", "date", "d1", "d2")


@query(
    "trend_fit",
    over("month", f", f AS (SELECT symbol, fClose, {RN} - 1 AS rn, fClose = max(fClose) OVER {_near(5)} AS hit FROM bars) SELECT symbol, regr_slope(fClose, rn) AS slope, regr_intercept(fClose, rn) AS intercept, count(*) AS n FROM f WHERE hit GROUP BY 1"),
    "slope intercept",
    3,
)
def trend_fit(spark: SparkSession, d: str) -> DataFrame:
    df = S.local_extrema(load(spark, d, "month"), (5,))
    return S.trend_fit(df, F.col("max_5").isNotNull())


@query(
    "stock_eod_pipeline",
    over(
        "week",
        f""", n AS (SELECT *, lag(fClose) OVER {W} AS pc FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS k FROM bars) WHERE k > 1),
m AS (SELECT *, {sma(50)} AS sma_50 FROM n)
SELECT symbol, date, CASE WHEN pc IS NULL THEN 0 ELSE (fClose - pc) / pc END AS fChangeP, sma_50, CASE WHEN sma_50 > lag(sma_50) OVER {W} THEN 1 ELSE -1 END AS up50,
CASE WHEN fHigh > coalesce(max(fHigh) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN fHigh END AS fHighMax FROM m""",
    ),
    "fChangeP sma_50",
)
def stock_eod_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return S.stock_eod(load(spark, d, "week")).select("symbol", "date", "fChangeP", "sma_50", "up50", "fHighMax")


# across symbols


@query(
    "std_annualised",
    over("month", f", {CHANGED} SELECT symbol, stddev_pop(fChangeP) AS std, stddev_pop(fChangeP) * sqrt(252.0) AS std_ann FROM changed WHERE fChangeP <> 0 GROUP BY 1"),
    "std std_ann",
)
def std_annualised(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.correlation import std_annualised

    return std_annualised(S.change_pct(load(spark, d, "month")).where("fChangeP <> 0"))


_MARKET = f"{CHANGED}, market AS (SELECT date, avg(fClose) AS m_close, avg(fChangeP) AS m_change FROM changed GROUP BY 1)"


@query(
    "beta_vs_market",
    over("month", f", {_MARKET} SELECT symbol, corr(fClose, m_close) * stddev_samp(fChangeP) / stddev_samp(m_change) AS beta, covar_samp(fChangeP, m_change) / var_samp(m_change) AS beta_returns FROM changed JOIN market USING (date) GROUP BY 1"),
    "beta beta_returns",
    5,
)
def beta_vs_market(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.correlation import beta

    return beta(S.change_pct(load(spark, d, "month")))


@query(
    "corr_peers",
    over("month", f", {CHANGED} SELECT a.symbol AS key, b.symbol, corr(a.fChangeP, b.fChangeP) AS corr, count(*) AS n FROM changed a JOIN changed b ON a.date = b.date AND a.symbol <> b.symbol GROUP BY 1, 2"),
    "corr",
    5,
)
def corr_peers(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.correlation import peers

    return peers(S.change_pct(load(spark, d, "month")))


@query(
    "corr_extreme",
    over("month", f", {CHANGED}, big AS (SELECT * FROM changed WHERE abs(fChangeP) > 0.05) SELECT a.symbol AS key, b.symbol, corr(a.fChangeP, b.fChangeP) AS corr, count(*) AS n FROM big a JOIN big b ON a.date = b.date AND a.symbol <> b.symbol GROUP BY 1, 2"),
    "corr",
    5,
)
def corr_extreme(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.correlation import peers

    return peers(S.change_pct(load(spark, d, "month")), least_move=0.05)


_LEVELS_OF = [f"{m}{n}" for m in ("sma_", "ema_") for n in S.SPANS]
_DIFFS_OF = [f"{m}{a}_{b}" for m in ("sma_", "ema_") for a, b in S.PAIRS]
_PRICES_OF = [f"{p}_{m}{n}" for p, m, n in _PRICE]


def _crossing(prefix: str, a: int, b: int) -> str:
    d, later = f"{prefix}{a}_{b}", f"lead({prefix}{a}_{b}) OVER {W}"
    return f"CASE WHEN {d} <> 0 AND sign({d}) < sign({later}) THEN 1 WHEN {d} <> 0 AND sign({d}) > sign({later}) THEN -1 ELSE 0 END AS {prefix}cross_{a}_{b}"


@query(
    "moving_averages_all",
    recursive(
        "month",
        f""", {ema_sql('bars', keep=', fClose, fHigh, fLow')}, both_ma AS (SELECT *, {_SMAS} FROM emas), d AS (SELECT *, {_DIFFS('sma_')}, {_DIFFS('ema_')} FROM both_ma)
SELECT symbol, date, fHigh - fLow AS fRange, {', '.join(_LEVELS_OF + _DIFFS_OF)}, {', '.join(f'{p} - {m}{n} AS {p}_{m}{n}' for p, m, n in _PRICE)}, {', '.join(_crossing(m, a, b) for m in ('sma_', 'ema_') for a, b in S.PAIRS)} FROM d""",
    ),
    " ".join(_LEVELS_OF + _DIFFS_OF + _PRICES_OF),
)
def moving_averages_all(spark: SparkSession, d: str) -> DataFrame:
    crosses = [f"{m}cross_{a}_{b}" for m in ("sma_", "ema_") for a, b in S.PAIRS]
    return S.moving_averages(load(spark, d, "month")).select("symbol", "date", "fRange", *_LEVELS_OF, *_DIFFS_OF, *_PRICES_OF, *crosses)


@query(
    "regular_studies_all",
    recursive(
        "month",
        f""", n AS (SELECT *, {RN} - 1 AS rn, lag(fClose) OVER {W} AS pc FROM bars), g AS (SELECT *, fClose - pc AS change, CASE WHEN fClose < pc THEN 0 ELSE fClose - pc END AS gain, CASE WHEN fClose > pc THEN 0 ELSE pc - fClose END AS loss FROM n),
seed AS (SELECT symbol, avg(gain) AS ag, avg(loss) AS al FROM g WHERE rn BETWEEN 1 AND 14 GROUP BY 1),
r AS (SELECT g.symbol, rn, ag, al FROM g JOIN seed USING (symbol) WHERE rn = 14 UNION ALL SELECT g.symbol, g.rn, (13 * ag + gain) / 14, (13 * al + loss) / 14 FROM r JOIN g ON g.symbol = r.symbol AND g.rn = r.rn + 1),
v AS (SELECT *, CASE WHEN pc IS NULL THEN 0 WHEN fClose > pc THEN fVolume ELSE -fVolume END AS x, coalesce(((fClose - fLow) - (fHigh - fClose)) / nullif(fHigh - fLow, 0) * fVolume, 0) AS ad FROM g)
SELECT v.symbol, date, change, ag AS avg_gain, al AS avg_loss, CASE WHEN al <> 0 THEN 100 - 100 / (1 + ag / al) WHEN ag > 0 THEN 100 END AS rsi_14, sum(x) OVER w AS obv, ad, sum(ad) OVER w AS ad_line
FROM v LEFT JOIN r ON r.symbol = v.symbol AND r.rn = v.rn WINDOW w AS (PARTITION BY v.symbol ORDER BY date)""",
    ),
    "change avg_gain avg_loss rsi_14 ad ad_line",
    5,
)
def regular_studies_all(spark: SparkSession, d: str) -> DataFrame:
    return S.regular(load(spark, d, "month")).select("symbol", "date", "change", "avg_gain", "avg_loss", "rsi_14", "obv", "ad", "ad_line")
