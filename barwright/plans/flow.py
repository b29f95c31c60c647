"""Queries of analyst ratings, option reports, peaks near Fibonacci levels, smoothing filters and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators import fib as B
from barwright.operators import intraday as I
from barwright.operators import options as P
from barwright.operators import quality as Q
from barwright.operators import ratings as T
from barwright.operators import studies as S
from barwright.operators import candles as K
from barwright.plans.bars import dealt, load, over
from barwright.plans.candles import _named, _sign
from barwright.plans.fib import _LEVELS, _input, _least
from barwright.plans.options import _chain, with_chain
from barwright.plans.quality import _MISSING, _missing
from barwright.plans.registry import query, table
from barwright.plans.streams import checkpointed, folder
from barwright.plans.studies import RN, W, ema_sql, recursive

# analyst ratings: orders stand for ratings

_COMPANIES = {"1-URGENT": "Upgrades", "2-HIGH": "Downgrades", "3-MEDIUM": "Initiates Coverage On", "4-NOT SPECIFIED": "Maintains", "5-LOW": "Reiterates"}
_RATINGS = ("Strong Buy", "Equal-Weight", "Underperform", "Hold", "Sell", "In-Line", "B", "Mixed", "")


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    company = F.lit(None).cast("string")
    for priority, name in _COMPANIES.items():
        company = F.when(F.col("o_orderpriority") == priority, name).otherwise(company)
    action = F.when(k % 5 == 1, "Raises").when(k % 5 == 2, "Lowers").when(k % 5 == 3, "Maintains").when(k % 5 == 4, "other")
    return table(spark, d, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") % 100).alias("symbol"),
        F.to_date("o_orderdate").alias("date"),
        F.timestamp_seconds((k % 24) * 3600).alias("time"),
        company.alias("action_company"),
        action.alias("action_pt"),
        F.when(k % 7 == 0, "").otherwise((k % 200 + 1).cast("string")).alias("pt_prior"),
        F.when(k % 11 == 0, "").otherwise((F.col("o_custkey") % 150 + 1).cast("string")).alias("pt_current"),
        F.element_at(F.array(*map(F.lit, _RATINGS)), (k % len(_RATINGS) + 1).cast("int")).alias("rating"),
    )


_RATED = f"""raw AS (SELECT o_orderkey, o_orderkey AS k, o_custkey % 100 AS symbol, o_orderdate::DATE AS date,
 CASE o_orderpriority {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _COMPANIES.items())} END AS company,
 CASE o_orderkey % 5 WHEN 1 THEN 'Raises' WHEN 2 THEN 'Lowers' WHEN 3 THEN 'Maintains' WHEN 4 THEN 'other' END AS a,
 CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 200 + 1)::DOUBLE END AS pt_prior, CASE WHEN o_orderkey % 11 <> 0 THEN (o_custkey % 150 + 1)::DOUBLE END AS pt_current FROM orders),
rated AS (SELECT o_orderkey, symbol, date, company, pt_prior, pt_current, (pt_current - pt_prior) / pt_prior AS pt_perc_change, (k % 24 < 12)::INT AS morning, (k % 24 > 12)::INT AS night,
 CASE WHEN a IN ('Raises', 'Lowers', 'Maintains') THEN a WHEN company = 'Upgrades' THEN 'Raises' WHEN company = 'Downgrades' THEN 'Lowers' WHEN company LIKE 'Initiates%' THEN 'Announces' ELSE a END AS action_pt FROM raw)"""


@query("analyst_cleaned", f"WITH {_RATED} SELECT o_orderkey, action_pt, pt_prior, pt_current, pt_perc_change, morning, night FROM rated", "pt_perc_change")
def analyst_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return T.cleaned(_ratings(spark, d)).select("o_orderkey", "action_pt", "pt_prior", "pt_current", "pt_perc_change", "morning", "night")


_BY_DAY = """days AS (SELECT symbol, date, count(*) FILTER (WHERE company = 'Maintains') AS acc_main, count(*) FILTER (WHERE company LIKE 'Init%') AS acc_init, count(*) FILTER (WHERE company = 'Upgrades') AS acc_upgr,
 count(*) FILTER (WHERE company = 'Downgrades') AS acc_down, count(*) FILTER (WHERE action_pt = 'Raises') AS acp_upgr, count(*) FILTER (WHERE action_pt = 'Announces') AS acp_init, count(*) FILTER (WHERE action_pt = 'Lowers') AS acp_down,
 sum(morning)::BIGINT AS morning, sum(night)::BIGINT AS night, avg(pt_prior) AS p, avg(pt_current) AS c, avg(pt_perc_change) AS x
 FROM rated WHERE action_pt IN ('Raises', 'Announces', 'Lowers') AND company <> 'Reiterates' GROUP BY 1, 2)"""


@query("analyst_by_day", f"WITH {_RATED}, {_BY_DAY} SELECT * EXCLUDE (p, c, x), CASE WHEN p + c + x IS NOT NULL THEN p END AS pt_prior, CASE WHEN p + c + x IS NOT NULL THEN c END AS pt_current, CASE WHEN p + c + x IS NOT NULL THEN x END AS pt_perc_change FROM days", "pt_prior pt_current pt_perc_change")
def analyst_by_day(spark: SparkSession, d: str) -> DataFrame:
    return T.by_day(T.cleaned(_ratings(spark, d)))


def _any(*words: str) -> str:
    return "(" + " OR ".join(f"contains(rating, '{w}') OR contains('{w}', rating)" for w in words) + ")::INT"


@query(
    "rating_classes",
    f"""WITH r AS (SELECT o_orderkey, ['Strong Buy', 'Equal-Weight', 'Underperform', 'Hold', 'Sell', 'In-Line', 'B', 'Mixed', ''][(o_orderkey % 9 + 1)::INT] AS rating FROM orders)
SELECT o_orderkey, {_any('Accumulate', 'Buy', 'Outperform', 'Overweight', 'Positive', 'Strong')} AS pos, {_any('Equal', 'Hold', 'In-Line', 'Mixed', 'Neutral', 'Perform', 'Weight')} AS neut, {_any('Below', 'Negative', 'Reduce', 'Sell', 'Under')} AS neg FROM r""",
)
def rating_classes(spark: SparkSession, d: str) -> DataFrame:
    return _ratings(spark, d).select("o_orderkey", *[T.rating_class(F.col("rating"), k).alias(k) for k in ("pos", "neut", "neg")])


# option reports


@query(
    "pc_ratio_table",
    with_chain(", s AS (SELECT underlying, sum(volume) FILTER (WHERE side = 'C') AS c, sum(volume) FILTER (WHERE side = 'P') AS p FROM chain GROUP BY 1), o AS (SELECT underlying, CASE WHEN c = 0 THEN 1 ELSE c END AS c, CASE WHEN p = 0 THEN 1 ELSE p END AS p FROM s) SELECT underlying, c AS volumeC, p AS volumeP, p / c AS pc FROM o WHERE c > 3700 OR p > 3700"),
    "pc",
)
def pc_ratio_table(spark: SparkSession, d: str) -> DataFrame:
    return P.pc_table(_chain(spark, d), "volume", "pc", 3700)


@query(
    "flex_clean",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '2' END AS STYLE, 'S' || (o_custkey % 100) AS SYMBOL, strftime(o_orderdate, '%Y%m%d') AS expirationDate, CASE o_orderstatus WHEN 'F' THEN 'C' ELSE 'P' END AS SIDE
FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderstatus IN ('F', 'O')""",
)
def flex_clean(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = lambda f: F.date_format("o_orderdate", f)
    lines = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(k % 50 == 0, "SYMBOL").otherwise(F.concat(F.when(k % 2 == 0, "1").otherwise("2"), F.lit("S"), (F.col("o_custkey") % 100).cast("string"))).alias("SYMBOL"),
        F.when(F.col("o_orderstatus") == "F", "C").when(F.col("o_orderstatus") == "O", "P").otherwise("SIDE").alias("SIDE"),
        day("yyyy").alias("YR"),
        day("MM").alias("MO"),
        day("dd").alias("DAY"),
    )
    return P.clean_flex(lines).select("o_orderkey", "STYLE", "SYMBOL", "expirationDate", "SIDE")


@query("trade_volume_clean", "SELECT l_orderkey, l_linenumber, l_suppkey AS exId, l_returnflag AS exName, l_quantity::BIGINT AS fQuant, CASE WHEN l_linenumber <> 1 THEN l_partkey END AS cQuant, NULL::BIGINT AS mQuant FROM lineitem")
def trade_volume_clean(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.col(c).cast("bigint").cast("string")
    raw = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("exchangeId"), F.col("l_returnflag").alias("exchangeName"), text("l_quantity").alias("firmQuantity"), F.when(F.col("l_linenumber") == 1, "n/a").otherwise(text("l_partkey")).alias("customerQuantity"), F.lit("").alias("marketQuantity"))
    return P.clean_trade_volume(raw)


# studies, times, correlation, missing dates


@query(
    "rsi_parts",
    recursive(
        "month",
        f""", n AS (SELECT symbol, date, {RN} - 1 AS rn, fClose - lag(fClose) OVER {W} AS ch FROM bars), g AS (SELECT *, CASE WHEN ch < 0 THEN 0 ELSE ch END AS gain, CASE WHEN ch > 0 THEN 0 ELSE -ch END AS loss FROM n),
seed AS (SELECT symbol, avg(gain) AS ag, avg(loss) AS al FROM g WHERE rn BETWEEN 1 AND 14 GROUP BY 1),
r AS (SELECT g.symbol, rn, ag, al FROM g JOIN seed USING (symbol) WHERE rn = 14 UNION ALL SELECT g.symbol, g.rn, (13 * ag + gain) / 14, (13 * al + loss) / 14 FROM r JOIN g ON g.symbol = r.symbol AND g.rn = r.rn + 1)
SELECT g.symbol, date, ag AS avg_gain, al AS avg_loss, CASE WHEN al <> 0 THEN 100 - 100 / (1 + ag / al) WHEN ag > 0 THEN 100 END AS rsi_14 FROM g LEFT JOIN r ON r.symbol = g.symbol AND r.rn = g.rn""",
    ),
    "avg_gain avg_loss rsi_14",
    5,
)
def rsi_parts(spark: SparkSession, d: str) -> DataFrame:
    return S.rsi_parts(load(spark, d, "month")).select("symbol", "date", "avg_gain", "avg_loss", "rsi_14")


@query("time_ordinals", "SELECT event_id, dense_rank() OVER (ORDER BY strftime(ts, '%H:%M')) - 1 AS ordinal FROM events")
def time_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return I.time_ordinals(table(spark, d, "events").select("event_id", "ts"), "ts").select("event_id", F.col("ordinal").cast("long").alias("ordinal"))


@query("corr_by_group", "SELECT l_suppkey, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY 1", "r")
def corr_by_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.count("*").alias("n"))


@query("missing_singles_multiples", over("day", f"{_MISSING} SELECT symbol, date, CASE WHEN count(*) OVER (PARTITION BY symbol) = 1 THEN 'single' ELSE 'multiple' END AS kind FROM missing"))
def missing_singles_multiples(spark: SparkSession, d: str) -> DataFrame:
    one, more = Q.singles_and_multiples(_missing(spark, d))
    return one.withColumn("kind", F.lit("single")).unionByName(more.withColumn("kind", F.lit("multiple")))


# peaks: islands of equal values, then how far each stands out


def peaks_sql(name: str, source: str, value: str) -> str:
    """Tables {name}_p (symbol, rn, x) of the peaks of a value and {name} (symbol, rn, prominence), from source (symbol, rn, ...)."""
    return f"""{name}_v AS (SELECT symbol, rn, {value} AS x FROM {source}),
{name}_i AS (SELECT *, sum(step) OVER (PARTITION BY symbol ORDER BY rn) AS g FROM (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY symbol ORDER BY rn) THEN 0 ELSE 1 END AS step FROM {name}_v)),
{name}_g AS (SELECT symbol, g, min(rn) AS lo, max(rn) AS hi, max(x) AS x FROM {name}_i GROUP BY 1, 2),
{name}_p AS (SELECT symbol, (lo + hi) // 2 AS rn, x FROM (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS f FROM {name}_g WINDOW w AS (PARTITION BY symbol ORDER BY g)) WHERE x > b AND x > f),
{name}_b AS (SELECT p.symbol, p.rn, p.x, max(v.rn) FILTER (WHERE v.rn < p.rn AND v.x > p.x) AS l, min(v.rn) FILTER (WHERE v.rn > p.rn AND v.x > p.x) AS r FROM {name}_p p JOIN {name}_v v USING (symbol) GROUP BY 1, 2, 3),
{name} AS (SELECT b.symbol, b.rn, any_value(b.x) - greatest(min(v.x) FILTER (WHERE v.rn <= b.rn AND v.rn >= coalesce(b.l, 0)), min(v.x) FILTER (WHERE v.rn >= b.rn AND v.rn <= coalesce(b.r, 1000000))) AS prominence FROM {name}_b b JOIN {name}_v v USING (symbol) GROUP BY 1, 2)"""


_NUMBERED = f", s AS (SELECT *, {RN} AS rn FROM bars)"


@query("peak_prominence", over("month", f"{_NUMBERED}, {peaks_sql('m', 's', 'fClose')} SELECT symbol, date, prominence FROM m JOIN s USING (symbol, rn)"))
def peak_prominence(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.smoothing import prominences

    return prominences(load(spark, d, "month"), "fClose")


@query(
    "distant_peaks",
    recursive(
        "month",
        f"""{_NUMBERED}, {peaks_sql('m', 's', 'fClose')}, o AS (SELECT symbol, rn, row_number() OVER (PARTITION BY symbol ORDER BY x DESC, rn DESC) AS i FROM m_p),
k AS (SELECT symbol, i, [rn] AS kept FROM o WHERE i = 1 UNION ALL SELECT o.symbol, o.i, CASE WHEN len(list_filter(kept, lambda y: abs(y - rn) < 15)) > 0 THEN kept ELSE list_append(kept, rn) END FROM k JOIN o ON o.symbol = k.symbol AND o.i = k.i + 1),
chosen AS (SELECT symbol, unnest(arg_max(kept, i)) AS rn FROM k GROUP BY 1) SELECT symbol, date FROM chosen JOIN s USING (symbol, rn)""",
    ),
)
def distant_peaks(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.smoothing import distant_peaks

    return distant_peaks(load(spark, d, "month"), "fClose", 15)


@query(
    "kalman_level",
    recursive(
        "month",
        f"""{_NUMBERED}, k AS (SELECT symbol, date, rn, fClose AS level, 1.01::DOUBLE * (1 - 1.01::DOUBLE / 2.01::DOUBLE) AS spread FROM s WHERE rn = 1
 UNION ALL SELECT s.symbol, s.date, s.rn, level + (spread + 0.01::DOUBLE) / (spread + 1.01::DOUBLE) * (fClose - level), (spread + 0.01::DOUBLE) * (1 - (spread + 0.01::DOUBLE) / (spread + 1.01::DOUBLE)) FROM k JOIN s ON s.symbol = k.symbol AND s.rn = k.rn + 1)
SELECT symbol, date, level FROM k""",
    ),
    "level",
)
def kalman_level(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.smoothing import kalman

    return kalman(load(spark, d, "month"), "fClose")


def wavelet_sql(source: str, share: float, levels: int) -> str:
    """Tables up to smoothed (symbol, k, x), from source (symbol, rn, x): the periodic transform with sums over taps, step by step, and its transpose."""
    from barwright.operators.smoothing import _bank

    low, high = (f"[{', '.join(f'{x!r}::DOUBLE' for x in taps)}]" for taps in _bank(6))
    parts = [f"a0 AS (SELECT symbol, rn - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n, {share}::DOUBLE * max(x) OVER (PARTITION BY symbol) AS t, x FROM {source})"]
    for i in range(levels):
        parts.append(f"e{i} AS (SELECT symbol, k, n + n % 2 AS n, t, x FROM a{i} UNION ALL SELECT symbol, n, n + 1, t, x FROM a{i} WHERE n % 2 = 1 AND k = n - 1)")
        parts.append(f"m{i} AS (SELECT DISTINCT symbol, n, t FROM e{i})")
        parts.append(f"c{i} AS (SELECT m.symbol, o, m.n // 2 AS n, m.t, sum({low}[j + 1] * e.x) AS x, sum({high}[j + 1] * e.x) AS d FROM m{i} m, unnest(range(m.n // 2)) AS u(o), unnest(range(12)) AS v(j), e{i} e WHERE e.symbol = m.symbol AND e.k = (2 * o + 6 - j + 12 * m.n) % m.n GROUP BY 1, 2, 3, 4)")
        parts.append(f"a{i + 1} AS (SELECT symbol, o AS k, n, t, x FROM c{i})")
    now = f"a{levels}"
    for i in reversed(range(levels)):
        parts.append(f"r{i} AS (SELECT c.symbol, (2 * c.o + 6 - j + 24 * c.n) % (2 * c.n) AS k, sum({low}[j + 1] * b.x + {high}[j + 1] * sign(c.d) * greatest(abs(c.d) - c.t, 0)) AS x FROM c{i} c JOIN {now} b ON b.symbol = c.symbol AND b.k = c.o, unnest(range(12)) AS v(j) GROUP BY 1, 2)")
        now = f"r{i}"
    return ", ".join([*parts, f"smoothed AS (SELECT * FROM {now})"])


@query("wavelet_denoised", over("week", f"{_NUMBERED}, w AS (SELECT symbol, date, rn, fClose AS x FROM s), {wavelet_sql('w', 0.02, 3)} SELECT w.symbol, date, smoothed.x AS smooth FROM w JOIN smoothed ON smoothed.symbol = w.symbol AND smoothed.k = rn - 1"), "smooth")
def wavelet_denoised(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.smoothing import wavelet_denoised

    return wavelet_denoised(checkpointed(dealt(spark, d, "week").select("symbol", "date", "fClose")), "fClose", 0.02, levels=3)


_DAYS = "(5 * (({0} - DATE '1970-01-05') // 7) + least(({0} - DATE '1970-01-05') % 7, 5))"


@query(
    "gap_islands_merged",
    over(
        "week",
        f""", c AS (SELECT symbol, date, CASE WHEN fClose > lag(fClose) OVER {W} THEN 1 ELSE 0 END AS up FROM bars), i AS (SELECT *, sum(1 - up) OVER {W} AS island FROM c),
runs AS (SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM i WHERE up = 1 GROUP BY symbol, island HAVING count(*) >= 2),
j AS (SELECT *, CASE WHEN {_DAYS.format('first_date')} - {_DAYS.format('lag(last_date) OVER w')} <= 10 THEN 0 ELSE 1 END AS step FROM runs WINDOW w AS (PARTITION BY symbol ORDER BY first_date)),
m AS (SELECT *, sum(step) OVER (PARTITION BY symbol ORDER BY first_date) AS g FROM j)
SELECT symbol, min(first_date) AS first_date, max(last_date) AS last_date, sum(n)::BIGINT AS n, count(*) AS runs FROM m GROUP BY symbol, g""",
    ),
)
def gap_islands_merged(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.patterns import merge_near, rising_runs

    return merge_near(rising_runs(load(spark, d, "week"), 2), 10)


@query("option_tree", with_chain("SELECT underlying, side, expires::VARCHAR AS expires, strike, arg_min(volume, row(volume, oi, bid, ask)) AS volume, arg_min(oi, row(volume, oi, bid, ask)) AS oi, arg_min(bid, row(volume, oi, bid, ask)) AS bid, arg_min(ask, row(volume, oi, bid, ask)) AS ask FROM chain GROUP BY 1, 2, 3, 4"))
def option_tree(spark: SparkSession, d: str) -> DataFrame:
    contracts = F.struct("volume", "oi", "bid", "ask")
    by_strike = _chain(spark, d).groupBy("underlying", "side", "expires", "strike").agg(F.array_sort(F.collect_list(contracts)).alias("l"))
    by_expiry = by_strike.groupBy("underlying", "side", "expires").agg(F.map_from_entries(F.collect_list(F.struct("strike", "l"))).alias("m"))
    tree = by_expiry.groupBy("underlying", "side").agg(F.map_from_entries(F.collect_list(F.struct(F.col("expires").cast("string"), "m"))).alias("tree"))
    return P.flatten_tree(tree, "tree")


# peaks near Fibonacci levels

_MOVES = ", ".join([f"CASE WHEN rn > 1 THEN abs(lead(cum, {k}) OVER {W}) - abs(cum) END AS perc_{k}" for k in (1, 2, 3, 10, 20)] + [f"CASE WHEN rn > 1 THEN lead(cum, 5) OVER {W} - cum END AS perc_5"] + [f"CASE WHEN rn > 1 THEN (lead(fHigh, {k}) OVER {W} - fLow) / fLow END AS hl_perc_{k}" for k in (1, 2, 3)])
_NEAR = f""", {_LEVELS}, s AS (SELECT symbol, date, rn, fHigh, fLow, sum(fChangeP) OVER {W} AS cum FROM n), {peaks_sql('hi', 's', 'fHigh')}, {peaks_sql('lo', 's', '-fLow')},
mv AS (SELECT *, {_MOVES} FROM s), att AS (SELECT mv.*, {_least('fHigh')} AS h, {_least('fLow')} AS l FROM mv JOIN lv USING (symbol)),
d AS (SELECT att.*, abs(fHigh - h.v) / fHigh AS high_diff, abs(fLow - l.v) / fLow AS low_diff, hi.prominence AS ph, lo.prominence AS pl, hi.rn AS hr, lo.rn AS lr
 FROM att LEFT JOIN hi ON hi.symbol = att.symbol AND hi.rn = att.rn LEFT JOIN lo ON lo.symbol = att.symbol AND lo.rn = att.rn),
nearby AS (SELECT symbol, date, CASE WHEN lr IS NOT NULL THEN 'trough' WHEN hr IS NOT NULL THEN 'peak' END AS kind, CASE WHEN high_diff < low_diff THEN 'high' ELSE 'low' END AS code,
 CASE WHEN high_diff < low_diff THEN h.n ELSE l.n END AS level, CASE WHEN high_diff < low_diff THEN high_diff ELSE low_diff END AS close_val, coalesce(CASE WHEN high_diff < low_diff THEN ph ELSE pl END, 0) AS prominence,
 high_diff, low_diff, h.n AS h_level, l.n AS l_level, {', '.join(f'perc_{k}' for k in (1, 2, 3, 10, 20, 5))}, {', '.join(f'hl_perc_{k}' for k in (1, 2, 3))} FROM d)"""
_MOVED = " ".join([f"perc_{k}" for k in (1, 2, 3, 5, 10, 20)] + [f"hl_perc_{k}" for k in (1, 2, 3)])


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = _input(spark, d)
    lv = checkpointed(B.pipeline(n)[0])
    return B.peaks_near_levels(n, lv), lv


@query("fib_peaks", over("week", f"{_NEAR} SELECT * FROM nearby"), f"close_val high_diff low_diff prominence {_MOVED}")
def fib_peaks(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d)[0]


@query("fib_closeness", over("week", f"{_NEAR} SELECT symbol, count(*) AS n, sum(close_val) AS total, avg(close_val) AS mean_close FROM nearby WHERE kind IS NOT NULL GROUP BY 1 HAVING sum(close_val) > 0"), "total mean_close")
def fib_closeness(spark: SparkSession, d: str) -> DataFrame:
    return B.closeness_by_symbol(_near(spark, d)[0])


@query(
    "fib_troughs_over_peaks",
    over("week", f"{_NEAR}, a AS (SELECT nearby.* FROM nearby JOIN lv USING (symbol) WHERE date > last_date AND high_diff < 0.05::DOUBLE AND low_diff < 0.05::DOUBLE AND kind IS NOT NULL) SELECT level, sum((kind = 'peak')::INT)::BIGINT AS peaks, sum((kind = 'trough')::INT)::BIGINT AS troughs, sum((kind = 'trough')::INT) / nullif(sum((kind = 'peak')::INT), 0) AS t_p FROM a GROUP BY 1"),
    "t_p",
)
def fib_troughs_over_peaks(spark: SparkSession, d: str) -> DataFrame:
    return B.troughs_over_peaks(*_near(spark, d))


@query(
    "fib_bounces",
    over("week", f"{_NEAR}, a AS (SELECT nearby.* FROM nearby JOIN lv USING (symbol) WHERE date > ext_date AND close_val < 0.05::DOUBLE), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY symbol, h_level ORDER BY date) = 1) SELECT symbol, date, level, code, close_val FROM b QUALIFY row_number() OVER (PARTITION BY symbol, l_level ORDER BY date) = 1"),
    "close_val",
)
def fib_bounces(spark: SparkSession, d: str) -> DataFrame:
    return B.bounces(*_near(spark, d)).select("symbol", "date", "level", "code", "close_val")


# the training set: levels, sectors, studies, filings, ratings


_SPANS = (10, 20, 50)
_BULL, _BEAR = (" + ".join(f"({_sign(p.name)} = {side})::INT" for p in K.PATTERNS) for side in (1, -1))


def _wilder(side: str) -> str:
    return f"CASE WHEN rn < 14 THEN 0 WHEN rn = 14 THEN avg({side}) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) ELSE {side} / 14 END * power(13.0 / 14, -rn) AS {side}_w"


@query(
    "training_set_full",
    recursive(
        "week",
        f"""{_NEAR}, {_RATED}, {_BY_DAY}, weekly AS (SELECT symbol, date_trunc('week', date)::DATE AS date, sum(acp_upgr)::BIGINT AS raised, sum(acp_down)::BIGINT AS lowered FROM days GROUP BY 1, 2),
forms AS (SELECT o_custkey % 100 AS symbol, date_trunc('week', o_orderdate)::DATE AS date, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS q10, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS k10 FROM orders GROUP BY 1, 2),
{ema_sql('(SELECT symbol, date, fClose FROM n)', _SPANS, prefix='ema_')},
rsi_c AS (SELECT symbol, date, {RN} - 1 AS rn, fClose - lag(fClose) OVER {W} AS ch FROM n), rsi_g AS (SELECT *, greatest(ch, 0) AS gain, greatest(-ch, 0) AS loss FROM rsi_c), rsi_w AS (SELECT *, {_wilder('gain')}, {_wilder('loss')} FROM rsi_g),
rsi_s AS (SELECT symbol, date, rn, sum(gain_w) OVER {W} AS sg, sum(loss_w) OVER {W} AS sl FROM rsi_w), rsis AS (SELECT symbol, date, CASE WHEN rn >= 14 THEN coalesce(100 * sg / nullif(sg + sl, 0), 0) END AS rsi FROM rsi_s),
{_named('n')}, candles AS (SELECT symbol, date, {_BULL} AS bullish, {_BEAR} AS bearish FROM named),
q AS (SELECT n.symbol, n.date, fChangeP, gap, CASE WHEN count(*) OVER w50 >= 50 THEN avg(fClose) OVER w50 END AS sma_50, sum(fVolume) OVER w4 AS volume_4, min(CASE WHEN fVolume > 100 THEN date END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM n WINDOW w50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING), w4 AS (PARTITION BY symbol ORDER BY date ROWS 3 PRECEDING))
SELECT q.symbol, q.date, fChangeP, gap, sma_50, volume_4, {', '.join(f'ema_{k}' for k in _SPANS)}, ema_10 - ema_20 AS ema_10_20, rsi, bullish, bearish, kind, code, level, close_val, prominence, perc_5, n_regionkey AS sector, s_nationkey AS nation, (nxt - q.date) // 7 * 5 AS days_until_earnings,
 coalesce(q10, 0) AS q10, coalesce(k10, 0) AS k10, coalesce(raised, 0) AS raised, coalesce(lowered, 0) AS lowered
FROM q JOIN nearby ON nearby.symbol = q.symbol AND nearby.date = q.date JOIN emas ON emas.symbol = q.symbol AND emas.date = q.date JOIN rsis ON rsis.symbol = q.symbol AND rsis.date = q.date JOIN candles ON candles.symbol = q.symbol AND candles.date = q.date
JOIN supplier ON s_suppkey = q.symbol JOIN nation ON s_nationkey = n_nationkey LEFT JOIN weekly ON weekly.symbol = q.symbol AND weekly.date = q.date LEFT JOIN forms ON forms.symbol = q.symbol AND forms.date = q.date""",
    ),
    "fChangeP sma_50 ema_10 ema_20 ema_50 ema_10_20 rsi close_val prominence perc_5",
    5,
)
def training_set_full(spark: SparkSession, d: str) -> DataFrame:
    """All five blocks: Fibonacci levels and peaks, symbol meta, studies and candles, filings and earnings, analysts. All that goes by symbol happens where a symbol's rows are; the counts by symbol and week come last."""
    from barwright.operators.smoothing import longest_series

    n = _input(spark, d)
    lv, longest = checkpointed(B.pipeline(n)[0]), longest_series(n)
    meta = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("symbol"), F.col("n_regionkey").alias("sector"), F.col("s_nationkey").alias("nation"))
    # as a list, which is opened at the end: a supplier that is there twice must not double rows that windows look at
    meta = meta.groupBy("symbol").agg(F.collect_list(F.struct("sector", "nation")).alias("meta"))
    week = F.trunc("date", "week").alias("date")
    rated = T.by_day(T.cleaned(_ratings(spark, d))).select("symbol", week, F.col("acp_upgr").alias("raised"), F.col("acp_down").alias("lowered"))
    filed = Q.flags_by_day(table(spark, d, "orders").withColumn("symbol", F.col("o_custkey") % 100), "symbol", F.to_date("o_orderdate"), "o_orderpriority", {"q10": "1-URGENT", "k10": "2-HIGH"}).select("symbol", week, "q10", "k10")
    counts = ["q10", "k10", "raised", "lowered"]
    weekly = rated.unionByName(filed, allowMissingColumns=True).groupBy("symbol", "date").agg(*[F.sum(c).alias(c) for c in counts])
    studied = S.rsi(S.ema(S.sma(n.join(meta, "symbol"), (50,)), _SPANS)).withColumns({"volume_4": F.sum("fVolume").over(S.rows(-3, 0)), "ema_10_20": F.col("ema_10") - F.col("ema_20")})
    count = lambda side: sum((F.expr(K.pattern_sql(p)) == side).cast("int") for p in K.PATTERNS)
    signed = K.with_names(studied).withColumns({"bullish": count(1), "bearish": count(-1)})
    own = ["fChangeP", "gap", "sma_50", "volume_4", *[f"ema_{k}" for k in _SPANS], "ema_10_20", "rsi", "bullish", "bearish"]
    all_own = B.days_until(signed, F.col("fVolume") > 100).withColumn("days_until_earnings", F.col("days_until").cast("long"))
    near = B.peaks_near_levels(all_own, lv, [*own, "days_until_earnings", "meta"], longest)
    # ratings and filings are of 100 symbols (customers modulo 100) however many there are, so their weeks fit every task
    joined = near.join(F.broadcast(weekly), ["symbol", "date"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    out = ["symbol", "date", *own, "days_until_earnings", "kind", "code", "level", "close_val", "prominence", "perc_5", "sector", "nation", "raised", "lowered", "q10", "k10"]
    return joined.select("*", F.inline("meta")).select(*out)


# logs and pages


@query("call_log_budget", "SELECT event_type AS service, date_trunc('hour', ts) AS begin, count(*) AS n, greatest(5 - count(*), 0) AS \"left\" FROM events GROUP BY 1, 2")
def call_log_budget(spark: SparkSession, d: str) -> DataFrame:
    from barwright.sources.sinks import call_budget, log_calls

    at = folder(spark)
    calls = table(spark, d, "events").select(F.col("event_type").alias("service"), "ts", "event_id")
    log_calls(calls.where("event_type = 'view'"), at)
    log = log_calls(calls.where("event_type <> 'view'"), at)
    return call_budget(log.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", 5).withColumn("begin", F.col("begin").cast("timestamp_ntz"))
