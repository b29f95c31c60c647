"""Queries of the candlestick patterns, over monthly bars (where bars have a range)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators import candles as K
from barwright.operators import studies as S
from barwright.plans.bars import load, over
from barwright.plans.registry import query
from barwright.plans.studies import CHANGED, W


#: Each pattern's condition in SQL, written from its definition and not from the operator's table.
HOLDS: dict[str, str] = {
    "marubozu": "L BETWEEN O * 0.9 AND O AND H BETWEEN C * 0.9 AND C AND L <> 0 AND H <> 0",
    "doji": "abs_in(C, O, R * 0.01) AND H > O + R * 0.25 AND L < O - R * 0.25 AND H <> 0 AND L <> 0",
    "spinning_top": "abs_in(C, O, R * 0.2) AND C > O AND H > O + R * 0.4 AND L < O - R * 0.4 AND H <> 0 AND L <> 0",
    "dragonfly_doji": "abs_in(C, O, R * 0.05) AND H < O + R * 0.15 AND L < O - R * 0.5 AND H <> 0 AND L <> 0",
    "inverted_hammer": "C > O AND C <= O + R * 0.25 AND H > O + R * 0.75 AND L > O - R * 0.05 AND H <> 0 AND L <> 0",
    "hammer": "C > O AND C <= O + R * 0.25 AND H < O + R * 0.1 AND L < O - R * 0.75 AND H <> 0 AND L <> 0",
    "kicker": "G < -0.005 AND C BETWEEN L AND O - R * 0.4 AND H < O + R * 0.2 AND L > C - R * 0.2 AND G1 > 0.005 AND C1 >= O + R * 0.5 AND O1 > O - R * 0.9",
    "engulfing": "G < -0.005 AND C BETWEEN L + R * 0.3 AND L + R * 0.8 AND C - L <= R * 0.33 AND G1 > 0.005 AND C > O1 - R1 * 0.33 AND C1 > O AND L1 - O1 <= R1 * 33",
    "harami": "G < -0.005 AND C BETWEEN L + R * 0.1 AND L + R * 0.45 AND C - L <= R * 0.33 AND G1 > 0.01 AND C < O1 + R1 * 0.15 AND C1 < O AND C1 >= O - R * 0.15 AND H1 - C1 <= R1 * 0.25 AND L1 - O1 <= R1 * 0.25",
    "piercing_line": "G < -0.005 AND C BETWEEN L + R * 0.1 AND L + R * 0.6 AND C - L <= R * 0.5 AND H - O <= C - L AND abs_in(C, (C1 - O1) / 2, R1 * 0.33) AND G1 > 0.005 AND O1 < L AND C1 > C + R * 0.1",
    "tweezer_bottom": "G < -0.005 AND C BETWEEN L + R * 0.05 AND L + R * 0.4 AND C - L <= R * 0.2 AND L1 <= C AND C <= C1 AND G1 > 0.005 AND C < O1 AND O > H1 AND H1 - C1 <= O1 - L1",
    "morning_star": "G < -0.005 AND C BETWEEN L + R * 0.05 AND L + R * 0.4 AND R > 0 AND O - C > R * 0.5 AND abs(G1) <= 0.025 AND greatest(O1, H1) < L AND G2 > 0.005 AND C2 > O2 AND O2 > L1 + R1 * 0.2 AND C2 > C + R1 * 0.5 AND C2 > H1",
    "abandoned_baby": "G < -0.005 AND R > 0 AND O - C > R * 0.5 AND C2 > C AND G1 < -0.01 AND C1 > O1 AND H1 < L AND G2 > 0.015 AND C2 > O2 AND L2 > H1",
    "three_white_soldiers": "least(G, G1, G2) > 0.0025 AND C < C1 AND C1 < C2 AND O2 < C1 AND greatest(O - L, H - C) < R * 0.3 AND greatest(O1 - L1, H1 - C1) < R1 * 0.3 AND greatest(O2 - L2, H2 - C2) < R2 * 0.3 AND G1 IS NOT NULL AND G2 IS NOT NULL AND G IS NOT NULL",
    "three_line_strike": "G < -0.0025 AND G1 < -0.0025 AND G2 < -0.0025 AND O > O1 AND O1 > O2 AND O > C AND O1 > C1 AND O2 > C2 AND C > C1 AND C1 > C2 AND G3 > 0.01 AND C3 > O3 AND O3 < C2 AND C3 > O AND R3 > 0 AND H3 - C3 < R3 * 0.2 AND O3 - L3 < R3 * 0.2",
    "morning_star_doji": "G < -0.005 AND C < H1 AND R > 0 AND abs(O - C) > R * 0.67 AND abs(G1) <= 0.0033 AND least(O1 - L1, H1 - C1) > R1 * 0.3 AND R1 > 0 AND H1 < O AND H1 < C2 AND abs(O1 - C1) < R1 * 0.5 AND G2 > 0.005 AND C2 > O2 AND C2 < O AND R2 > 0 AND abs(O2 - C2) > R2 * 0.67",
    "three_outside_up": "G BETWEEN -0.05 AND -0.0025 AND O > C AND C - L > H - O AND L > L1 AND L > O1 AND G1 > 0.005 AND H1 > H AND C1 > O1 AND C1 > O AND O1 < C AND H1 - C1 < (H1 - L1) * 0.2 AND O1 - L1 < (H1 - L1) * 0.2 AND G2 > 0.0033 AND C2 > O2 AND C2 > C1 AND O2 < C1 AND L2 > L1 AND H2 - C2 < (H2 - L2) * 0.33 AND O2 - L2 < (H2 - L2) * 0.33",
    "three_inside_up": "G < -0.005 AND C - L > H - O AND G1 > 0.0025 AND O1 BETWEEN C AND O AND C1 BETWEEN C AND O AND C1 - H1 < O1 - L1 AND O1 - L1 < H1 - O1 AND H1 < O AND G2 > 0.005 AND C2 > O2 AND O2 > O1 AND C2 > O AND H2 - C2 < (H2 - L2) * 0.2 AND O2 - L2 < (H2 - L2) * 0.2",
    "bear_spinning_top": "abs_in(C, O, R * 0.2) AND C < O AND H > O + R * 0.4 AND L < O - R * 0.4 AND H <> 0 AND L <> 0",
    "bear_dragonfly_doji": "abs_in(C, O, R * 0.05) AND H > O + R * 0.3 AND L > O - R * 0.15 AND H <> 0 AND L <> 0",
    "hanging_man": "C <= O AND C >= O - R * 0.2 AND H < O + R * 0.05 AND L < O - R * 0.75 AND H <> 0 AND L <> 0",
    "shooting_star": "C <= O AND C >= O - R * 0.25 AND H > O + R * 0.5 AND L > O - R * 0.05 AND H <> 0 AND L <> 0",
    "gravestone": "C <= O AND C >= O - R * 0.25 AND H > O + R * 0.5 AND L > O - R * 0.05 AND H <> 0 AND L <> 0 AND GB > 0.0025 AND CB > CBB AND G1 < -0.0025 AND O1 > O2",
    "bear_kicker": "G > 0.005 AND H < O + R * 0.2 AND L > C - R * 0.2 AND G1 < -0.005 AND H1 < L + R * 0.2 AND H1 - O1 < R1 * 0.2 AND C1 - L1 <= R1 * 0.2",
    "bear_engulfing": "G > 0.005 AND C BETWEEN L + R * 0.3 AND L + R * 0.8 AND C - L <= R * 0.33 AND G1 < -0.005 AND C < O1 AND O > C1 AND C1 - L1 <= R1 * 0.33",
    "bear_harami": "G > 0.005 AND C BETWEEN H - R * 0.45 AND H - R * 0.05 AND O - L <= R * 0.33 AND G1 < -0.0025 AND O1 BETWEEN O + R * 0.0025 AND C - R * 0.0025 AND C1 BETWEEN O + R * 0.0025 AND C - R * 0.0025 AND H1 - O1 <= R1 * 0.25 AND C1 - L1 <= R1 * 0.25",
    "dark_cloud_cover": "G > 0.005 AND C BETWEEN H - R * 0.2 AND H - R * 0.05 AND O - L <= R * 0.33 AND G1 < -0.005 AND O1 > C + R * 0.05 AND C1 BETWEEN O + R * 0.15 AND C - R * 0.15",
    "tweezer_top": "G > 0.005 AND C BETWEEN H - R * 0.4 AND H - R * 0.05 AND H - C <= R * 0.2 AND G1 < -0.0025 AND O1 BETWEEN C - R * 0.2 AND C + R * 0.05 AND R1 BETWEEN R * 0.5 AND R * 0.9 AND C1 > O + R * 0.05 AND H1 - O1 <= R1 * 0.33 AND C1 - L1 <= R1 * 0.33",
    "bear_abandoned_baby": "G > 0.0033 AND least(H - C, O - L) > R * 0.2 AND G1 BETWEEN -0.004 AND -0.0001 AND least(O1, C1) > H AND least(O1, C1) > H2 AND G2 < -0.005 AND O2 < C",
    "three_black_crows": "G < -0.0025 AND G1 < -0.0025 AND G2 < -0.0025 AND C > C1 AND C1 > C2 AND O2 < O1 AND O2 > C1 AND greatest(C - L, H - O) < R * 0.4 AND greatest(C1 - L1, H1 - O1) < R1 * 0.4 AND greatest(C2 - L2, H2 - O2) < R2 * 0.4",
    "evening_doji_star": "G > 0.005 AND C < H1 AND G1 BETWEEN -0.0015 AND -0.0001 AND least(C1 - L1, H1 - O1) > R1 * 0.05 AND G2 < -0.005 AND O2 < H1 AND C2 > O",
    "evening_star": "G > 0.005 AND H < L1 AND G1 BETWEEN -0.005 AND -0.0015 AND H1 - O1 < C1 - L1 AND G2 < -0.005 AND C2 > O",
}
_BEARISH = {"bear_spinning_top", "bear_dragonfly_doji", "hanging_man", "shooting_star", "gravestone", "bear_kicker", "bear_engulfing", "bear_harami", "dark_cloud_cover", "tweezer_top", "bear_abandoned_baby", "three_black_crows", "evening_doji_star", "evening_star"}


def _in_duckdb(text: str) -> str:
    """text in doubles, with abs_in(x, y, z) as x between y - z and y + z."""
    text = re.sub(r"abs_in\((\w+), (\(.*?\) / 2|\w+), (.*?)\)", r"\1 BETWEEN \2 - \3 AND \2 + \3", text)
    return re.sub(r"\b\d+(\.\d+)?\b", r"\g<0>::DOUBLE", text)


def _sign(name: str) -> str:
    return f"CASE WHEN {_in_duckdb(HOLDS[name])} THEN {-1 if name in _BEARISH else 1} ELSE 0 END"


def _named(source: str) -> str:
    later = ", ".join(f"lead({x}, {k}) OVER {W} AS {x}{k}" for x in "OHLCRG" for k in (1, 2, 3))
    return f"base AS (SELECT symbol, date, fOpen AS O, fHigh AS H, fLow AS L, fClose AS C, fHigh - fLow AS R, fChangeP AS G FROM {source}), named AS (SELECT *, {later}, lag(G) OVER {W} AS GB, lag(C) OVER {W} AS CB, lag(C, 2) OVER {W} AS CBB FROM base)"


def _input(spark: SparkSession, d: str) -> DataFrame:
    return S.change_pct(load(spark, d, "month"))


def _register(pattern: K.Pattern) -> None:
    sql = over("month", f", {CHANGED}, {_named('changed')} SELECT symbol, date, {_sign(pattern.name)} AS {pattern.name} FROM named")

    @query(f"candle_{pattern.name}", sql)
    def one(spark: SparkSession, d: str) -> DataFrame:
        return K.patterns(_input(spark, d), (pattern.name,))


for _pattern in K.PATTERNS:
    _register(_pattern)

_ALL = ", ".join(f"{_sign(p.name)} AS {p.name}" for p in K.PATTERNS)


@query("candle_counts", over("month", f", {CHANGED}, {_named('changed')}, p AS (SELECT {_ALL} FROM named) SELECT " + ", ".join(f"sum(abs({p.name}))::BIGINT AS {p.name}" for p in K.PATTERNS) + " FROM p"))
def candle_counts(spark: SparkSession, d: str) -> DataFrame:
    return K.patterns(_input(spark, d)).agg(*[F.sum(F.abs(p.name)).alias(p.name) for p in K.PATTERNS])


@query("candle_scan_filtered", over("month", f", {CHANGED}, kept AS (SELECT * FROM changed WHERE fClose > 1.5 AND fVolume > 150), {_named('kept')} SELECT symbol, date, {_ALL} FROM named"))
def candle_scan_filtered(spark: SparkSession, d: str) -> DataFrame:
    return K.scan(_input(spark, d), 1.5, 150)
