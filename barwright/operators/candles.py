"""Candlestick patterns as data: each pattern is a list of conditions over a bar and the bars near it, all of which must hold.

A condition is written once and read two ways: as a column (null counts as not met), and as SQL text. `x`, `x1`, `x2`, `x3` are
a value now and one to three rows later, `x_1`, `x_2` one and two rows before; O H L C R are open, high, low, close, range; G is
the change of the close as a share.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.operators.studies import W


@dataclass(frozen=True)
class Pattern:
    name: str
    sign: int
    conditions: tuple[str, ...]


def _p(name: str, sign: int, text: str) -> Pattern:
    return Pattern(name, sign, tuple(c.strip() for c in text.split("&")))


#: The patterns' thresholds. `a in b..c` includes both ends.
PATTERNS: tuple[Pattern, ...] = (
    # bullish
    _p("marubozu", 1, "L in 0.9*O..O & H in 0.9*C..C & L != 0 & H != 0"),
    _p("doji", 1, "C in O-0.01*R..O+0.01*R & H > O+0.25*R & L < O-0.25*R & H != 0 & L != 0"),
    _p("spinning_top", 1, "C in O-0.2*R..O+0.2*R & C > O & H > O+0.4*R & L < O-0.4*R & H != 0 & L != 0"),
    _p("dragonfly_doji", 1, "C in O-0.05*R..O+0.05*R & H < O+0.15*R & L < O-0.5*R & H != 0 & L != 0"),
    _p("inverted_hammer", 1, "C in O..O+0.25*R & C > O & H > O+0.75*R & L > O-0.05*R & H != 0 & L != 0"),
    _p("hammer", 1, "C in O..O+0.25*R & C > O & H < O+0.1*R & L < O-0.75*R & H != 0 & L != 0"),
    _p("kicker", 1, "G < -0.005 & C in L..O-0.4*R & H < O+0.2*R & L > C-0.2*R & G1 > 0.005 & C1 >= O+0.5*R & O1 > O-0.9*R"),
    _p("engulfing", 1, "G < -0.005 & C in L+0.3*R..L+0.8*R & C-L <= 0.33*R & G1 > 0.005 & O1-0.33*R1 < C & C1 > O & L1-O1 <= 33*R1"),
    _p("harami", 1, "G < -0.005 & C in L+0.1*R..L+0.45*R & C-L <= 0.33*R & G1 > 0.01 & O1+0.15*R1 > C & C1 < O & C1 in O-0.15*R..O & H1-C1 <= 0.25*R1 & L1-O1 <= 0.25*R1"),
    _p("piercing_line", 1, "G < -0.005 & C in L+0.1*R..L+0.6*R & C-L <= 0.5*R & C-L >= H-O & C in (C1-O1)/2-0.33*R1..(C1-O1)/2+0.33*R1 & G1 > 0.005 & O1 < L & C1 > C+0.1*R"),
    _p("tweezer_bottom", 1, "G < -0.005 & C in L+0.05*R..L+0.4*R & C-L <= 0.2*R & C in L1..C1 & G1 > 0.005 & O1 > C & H1 < O & H1-C1 <= O1-L1"),
    _p("morning_star", 1, "G < -0.005 & C in L+0.05*R..L+0.4*R & O-C > 0.5*R & R > 0 & G1 in -0.025..0.025 & O1 < L & H1 < L & G2 > 0.005 & C2 > O2 & O2 > L1+0.2*R1 & C2 > C+0.5*R1 & C2 > H1"),
    _p("abandoned_baby", 1, "G < -0.005 & C < O & O-C > 0.5*R & R > 0 & C < C2 & G1 < -0.01 & C1 > O1 & H1 < L & G2 > 0.015 & C2 > O2 & L2 > H1 & C2 > C"),
    _p("three_white_soldiers", 1, "G > 0.0025 & C < C1 & O-L < 0.3*R & H-C < 0.3*R & G1 > 0.0025 & C1 < C2 & O1-L1 < 0.3*R1 & H1-C1 < 0.3*R1 & G2 > 0.0025 & O2 < C1 & O2-L2 < 0.3*R2 & H2-C2 < 0.3*R2"),
    _p("three_line_strike", 1, "G < -0.0025 & C < O & O > O1 & G1 < -0.0025 & C1 < O1 & O1 > O2 & C1 < C & G2 < -0.0025 & C2 < O2 & C2 < C1 & G3 > 0.01 & C3 > O3 & O3 < C2 & C3 > O & H3-C3 < 0.2*R3 & O3-L3 < 0.2*R3 & R3 > 0"),
    _p("morning_star_doji", 1, "G < -0.005 & C < H1 & abs(O-C) > 0.67*R & R > 0 & G1 in -0.0033..0.0033 & O1-L1 > 0.3*R1 & H1-C1 > 0.3*R1 & H1 < O & H1 < C2 & abs(O1-C1) < 0.5*R1 & R1 > 0 & G2 > 0.005 & C2 > O2 & C2 < O & abs(O2-C2) > 0.67*R2 & R2 > 0"),
    _p(
        "three_outside_up",
        1,
        "G in -0.05..-0.0025 & O > C & C-L > H-O & L > L1 & L > O1 & G1 > 0.005 & H1 > H & C1 > O1 & C1 > O & O1 < C & H1-C1 < 0.2*R1 & O1-L1 < 0.2*R1 & G2 > 0.0033 & C2 > O2 & C2 > C1 & O2 < C1 & L2 > L1 & H2-C2 < 0.33*R2 & O2-L2 < 0.33*R2",
    ),
    _p("three_inside_up", 1, "G < -0.005 & C-L > H-O & G1 > 0.0025 & O1 in C..O & C1 in C..O & C1-H1 < O1-L1 & O1-L1 < H1-O1 & H1 < O & G2 > 0.005 & C2 > O2 & O2 > O1 & C2 > O & H2-C2 < 0.2*R2 & O2-L2 < 0.2*R2"),
    # bearish
    _p("bear_spinning_top", -1, "C in O-0.2*R..O+0.2*R & C < O & H > O+0.4*R & L < O-0.4*R & H != 0 & L != 0"),
    _p("bear_dragonfly_doji", -1, "C in O-0.05*R..O+0.05*R & H > O+0.3*R & L > O-0.15*R & H != 0 & L != 0"),
    _p("hanging_man", -1, "C in O-0.2*R..O & H < O+0.05*R & L < O-0.75*R & H != 0 & L != 0"),
    _p("shooting_star", -1, "C in O-0.25*R..O & H > O+0.5*R & L > O-0.05*R & H != 0 & L != 0"),
    _p("gravestone", -1, "C in O-0.25*R..O & H > O+0.5*R & L > O-0.05*R & H != 0 & L != 0 & G_1 > 0.0025 & C_1 > C_2 & G1 < -0.0025 & O1 > O2"),
    _p("bear_kicker", -1, "G > 0.005 & H < O+0.2*R & L > C-0.2*R & G1 < -0.005 & H1 < L+0.2*R & H1-O1 < 0.2*R1 & C1-L1 <= 0.2*R1"),
    _p("bear_engulfing", -1, "G > 0.005 & C in L+0.3*R..L+0.8*R & C-L <= 0.33*R & G1 < -0.005 & O1 > C & C1 < O & C1-L1 <= 0.33*R1"),
    _p("bear_harami", -1, "G > 0.005 & C in H-0.45*R..H-0.05*R & O-L <= 0.33*R & G1 < -0.0025 & O1 in O+0.0025*R..C-0.0025*R & C1 in O+0.0025*R..C-0.0025*R & H1-O1 <= 0.25*R1 & C1-L1 <= 0.25*R1"),
    _p("dark_cloud_cover", -1, "G > 0.005 & C in H-0.2*R..H-0.05*R & O-L <= 0.33*R & G1 < -0.005 & O1 > C+0.05*R & C1 in O+0.15*R..C-0.15*R"),
    _p("tweezer_top", -1, "G > 0.005 & C in H-0.4*R..H-0.05*R & H-C <= 0.2*R & G1 < -0.0025 & O1 in C-0.2*R..C+0.05*R & R1 in 0.5*R..0.9*R & C1 > O+0.05*R & H1-O1 <= 0.33*R1 & C1-L1 <= 0.33*R1"),
    _p("bear_abandoned_baby", -1, "G > 0.0033 & H-C > 0.2*R & O-L > 0.2*R & G1 in -0.004..-0.0001 & O1 > H & O1 > H2 & C1 > H & C1 > H2 & G2 < -0.005 & O2 < C"),
    _p("three_black_crows", -1, "G < -0.0025 & C > C1 & C-L < 0.4*R & H-O < 0.4*R & G1 < -0.0025 & C1 > C2 & C1-L1 < 0.4*R1 & H1-O1 < 0.4*R1 & G2 < -0.0025 & O2 < O1 & O2 > C1 & C2-L2 < 0.4*R2 & H2-O2 < 0.4*R2"),
    _p("evening_doji_star", -1, "G > 0.005 & C < H1 & G1 in -0.0015..-0.0001 & C1-L1 > 0.05*R1 & H1-O1 > 0.05*R1 & G2 < -0.005 & O2 < H1 & C2 > O"),
    _p("evening_star", -1, "G > 0.005 & H < L1 & G1 in -0.005..-0.0015 & H1-O1 < C1-L1 & G2 < -0.005 & C2 > O"),
)

_NAME = re.compile(r"\b([OHLCRG])(_?[1-3])?\b")


def _sql(condition: str) -> str:
    """A condition as SQL over columns named as in the condition, in doubles throughout."""
    text = re.sub(r"(?<![\w.])(\d+\.\d+|\d+)(?![\w.]|\.\.)", lambda m: f"CAST({m[1]} AS DOUBLE)", condition.replace("..", " .. "))
    if " in " in text:
        x, bounds = text.split(" in ")
        low, high = bounds.split(" .. ")
        return f"({x} >= {low.strip()} AND {x} <= {high.strip()})"
    return text.replace("!=", "<>")


def names(pattern: Pattern) -> list[str]:
    """The values that a pattern looks at."""
    return sorted({m[1] + (m[2] or "") for c in pattern.conditions for m in _NAME.finditer(c)})


def pattern_sql(pattern: Pattern) -> str:
    """The pattern as an SQL expression over its names: its sign or 0."""
    return f"CASE WHEN {' AND '.join(_sql(c) for c in pattern.conditions)} THEN {pattern.sign} ELSE 0 END"


def with_names(df: DataFrame) -> DataFrame:
    """df and all values that the patterns look at, from fOpen, fHigh, fLow, fClose and fChangeP; all leads and lags share one window."""
    base = {"O": F.col("fOpen"), "H": F.col("fHigh"), "L": F.col("fLow"), "C": F.col("fClose"), "R": F.col("fHigh") - F.col("fLow"), "G": F.col("fChangeP")}
    df = df.withColumns(base)
    used = sorted({n for p in PATTERNS for n in names(p)} - set(base))
    return df.withColumns({n: (F.lag(n[0], int(n[-1])) if "_" in n else F.lead(n[0], int(n[-1]))).over(W()) for n in used})


def patterns(df: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """symbol, date and a column for each pattern: its sign where it holds, else 0. Rows near a symbol's ends have no pattern that looks beyond them.

    The lead after a filter skips the rows that the filter dropped, as everywhere in windows.
    """
    chosen = [p for p in PATTERNS if wanted is None or p.name in wanted]
    return with_names(df).select("symbol", "date", *[F.expr(pattern_sql(p)).alias(p.name) for p in chosen])


def scan(df: DataFrame, least_price: float = 1.5, least_volume: float = 500_000) -> DataFrame:
    """patterns of rows above a price and volume (filtered first)."""
    return patterns(df.where((F.col("fClose") > least_price) & (F.col("fVolume") > least_volume)))
