"""Option symbols and prices as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the rational approximation of the normal distribution (Abramowitz and Stegun 26.2.17).
_P, _B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def build_symbol(root: Column, expires: Column, side: Column, strike: Column) -> Column:
    """Root (six characters), yymmdd, C or P, and the strike in thousandths with eight digits."""
    return F.concat(F.rpad(root, 6, " "), F.date_format(expires, "yyMMdd"), side, F.lpad(F.round(strike * 1000).cast("long").cast("string"), 8, "0"))


def parse_symbol(symbol: Column) -> dict[str, Column]:
    """root, expires, side, strike of a symbol whose last 15 characters are date, side and strike."""
    tail = F.right(symbol, F.lit(15))
    return {
        "root": F.rtrim(F.substr(symbol, F.lit(1), F.length(symbol) - 15)),
        "expires": F.try_to_timestamp(F.concat(F.lit("20"), F.substring(tail, 1, 6)), F.lit("yyyyMMdd")).cast("date"),
        "side": F.substring(tail, 7, 1),
        "strike": F.substring(tail, 8, 8).try_cast("double") / 1000,
    }


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution to about 7e-8."""
    z = F.abs(x)
    t = 1 / (1 + _P * z)
    poly = F.lit(0.0)
    for b in reversed(_B):
        poly = (poly + b) * t
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def _d1_d2(s: Column, k: Column, t: Column, r: Column, sigma: Column) -> tuple[Column, Column]:
    d1 = (F.ln(s / k) + (r + sigma * sigma / 2) * t) / (sigma * F.sqrt(t))
    return d1, d1 - sigma * F.sqrt(t)


def bs_call(s: Column, k: Column, t: Column, r: Column, sigma: Column) -> Column:
    d1, d2 = _d1_d2(s, k, t, r, sigma)
    return s * normal_cdf(d1) - k * F.exp(-r * t) * normal_cdf(d2)


def bs_put(s: Column, k: Column, t: Column, r: Column, sigma: Column) -> Column:
    return k * F.exp(-r * t) - s + bs_call(s, k, t, r, sigma)


def bs_vega(s: Column, k: Column, t: Column, r: Column, sigma: Column) -> Column:
    d1, _ = _d1_d2(s, k, t, r, sigma)
    return s * F.exp(-d1 * d1 / 2) * 0.3989422804014327 * F.sqrt(t)


def _call(s: np.ndarray, k: np.ndarray, t: np.ndarray, r: np.ndarray, sigma: np.ndarray | float) -> np.ndarray:
    """`bs_call` of arrays."""
    root = sigma * np.sqrt(t)
    d1 = (np.log(s / k) + (r + sigma * sigma / 2) * t) / root

    def cdf(x: np.ndarray) -> np.ndarray:
        z = np.abs(x)
        u = 1 / (1 + _P * z)
        poly = np.zeros_like(z)
        for b in reversed(_B):
            poly = (poly + b) * u
        tail = np.exp(-z * z / 2) * 0.3989422804014327 * poly
        return np.where(x >= 0, 1 - tail, tail)

    return s * cdf(d1) - k * np.exp(-r * t) * cdf(d1 - root)


def implied_vol(price: Column, s: Column, k: Column, t: Column, r: Column, steps: int = 40) -> Column:
    """The volatility in (0, 4] whose call price is `price`, by `steps` bisections; null outside the range of prices.

    All rows of a batch halve their bounds together: an expression of that many steps has thousands of nodes for every row.
    """

    def run(*columns: pd.Series) -> pd.Series:
        price, s, k, t, r = (c.to_numpy(float) for c in columns)
        with np.errstate(all="ignore"):
            possible = (price > _call(s, k, t, r, 1e-6)) & (price < _call(s, k, t, r, 4.0))
            low, high = np.full(len(price), 1e-6), np.full(len(price), 4.0)
            for _ in range(steps):
                middle = (low + high) / 2
                above = _call(s, k, t, r, middle) > price
                low, high = np.where(above, low, middle), np.where(above, middle, high)
        return pd.Series(np.where(possible, (low + high) / 2, np.nan))

    columns = [c.cast("double") for c in (price, s, k, t, r)]
    return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR)(*columns)
