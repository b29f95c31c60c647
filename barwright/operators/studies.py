"""Technical studies as window expressions over (symbol, date). One window spec for all, so a chain of studies costs one shuffle and one sort.

Every function takes bars (symbol, date, fOpen, fHigh, fLow, fClose, fVolume) and adds columns. Windows never cross symbols.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def W():  # noqa: N802
    """The one window: a symbol's rows by date. (A function, as windows need a session.)"""
    return Window.partitionBy("symbol").orderBy("date")


SPANS = (10, 20, 50, 200)
PAIRS = tuple((a, b) for i, a in enumerate(SPANS) for b in SPANS[i + 1 :])


def rows(first: int, last: int):
    return W().rowsBetween(first, last)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def clean(df: DataFrame) -> DataFrame:
    """One row for each symbol and date (of repeated ones the least by open, high, low, close, volume), no null volume, symbols with more than one row; range, volume in millions and previous close."""
    order = [F.col(c).asc_nulls_last() for c in ("fOpen", "fHigh", "fLow", "fClose", "fVolume")]
    one = df.withColumn("_rn", F.row_number().over(Window.partitionBy("symbol", "date").orderBy(*order))).where("_rn = 1").drop("_rn")
    several = one.withColumn("_n", F.count("*").over(Window.partitionBy("symbol"))).where("_n > 1 AND fVolume IS NOT NULL").drop("_n")
    return several.withColumns({"fRange": F.col("fHigh") - F.col("fLow"), "vol/mil": F.col("fVolume") / 1_000_000, "prev_close": F.lag("fClose").over(W())})


def change_pct(df: DataFrame, name: str = "fChangeP") -> DataFrame:
    """Change of the close from the row before; 0 on a symbol's first row."""
    before = F.lag("fClose").over(W())
    return df.withColumn(name, F.when(F.row_number().over(W()) == 1, F.lit(0.0)).otherwise(ratio(F.col("fClose") - before, before)))


def change_pct_grid(df: DataFrame, name: str = "fChangeP") -> DataFrame:
    """The same on a grid of all dates: a missing close takes that of the next date, if there is one there, and changes go from date to date.

    The grid has a row for each symbol and date (dates are few), made by an explode of the broadcast calendar.
    """
    calendar = df.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("dates"))
    grid = df.select("symbol").distinct().crossJoin(F.broadcast(calendar)).select("symbol", F.explode("dates").alias("date"))
    full = grid.join(df.select("symbol", "date", "fClose"), ["symbol", "date"], "left").withColumn("_c", F.coalesce("fClose", F.lead("fClose").over(W())))
    before = F.lag("_c").over(W())
    changed = full.withColumn(name, ratio(F.col("_c"), before) - 1).where(F.col(name).isNotNull()).select("symbol", "date", name)
    return df.join(changed, ["symbol", "date"], "left")


def gap(df: DataFrame, share: float = 0.025) -> DataFrame:
    """gap: open over the previous close less 1, to 3 decimals, where it leaves +-share, else 0; 1 on a symbol's first row."""
    before = F.lag("fClose").over(W())
    jumped = (F.col("fOpen") > (1 + share) * before) | (F.col("fOpen") < (1 - share) * before)
    return df.withColumn("gap", F.when(before.isNull(), F.lit(1.0)).when(jumped, F.round(ratio(F.col("fOpen"), before) - 1, 3)).otherwise(0.0))


def gap_range(df: DataFrame) -> DataFrame:
    """gRange: from the previous close if that is below the low, else the bar's range."""
    before = F.lag("fClose").over(W())
    return df.withColumn("gRange", F.when(before < F.col("fLow"), F.col("fHigh") - before).otherwise(F.col("fHigh") - F.col("fLow")))


def cum_pct(df: DataFrame) -> DataFrame:
    """cumPerc: the running sum of fChangeP; null on a symbol's first row."""
    total = F.sum("fChangeP").over(rows(Window.unboundedPreceding, 0))
    return df.withColumn("cumPerc", F.when(F.row_number().over(W()) > 1, total))


def forward_pct(df: DataFrame, steps: Sequence[int] = (1, 2, 3, 5, 10, 20)) -> DataFrame:
    """perc{k}: how much larger |cumPerc| is k rows later (for 5: cumPerc itself, signed). Needs cumPerc."""
    c = F.col("cumPerc")
    new = {}
    for k in steps:
        later = F.lead("cumPerc", k).over(W())
        new[f"perc{k}"] = later - c if k == 5 else F.abs(later) - F.abs(c)
    return df.withColumns(new)


def high_low_pct(df: DataFrame, steps: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """hl_perc{k}: the high k rows later over this low."""
    return df.withColumns({f"hl_perc{k}": ratio(F.lead("fHigh", k).over(W()) - F.col("fLow"), F.col("fLow")) for k in steps})


def two_row_pct(df: DataFrame) -> DataFrame:
    """perc_2weeks and perc_1month: fChangeP plus that 10 and 30 rows later."""
    return df.withColumns({"perc_2weeks": F.col("fChangeP") + F.lead("fChangeP", 10).over(W()), "perc_1month": F.col("fChangeP") + F.lead("fChangeP", 30).over(W())})


def sma(df: DataFrame, spans: Sequence[int] = SPANS, column: str = "fClose", prefix: str = "sma_") -> DataFrame:
    """Means of the last n rows; null until there are n.

    Spark adds up a sliding frame anew for each row. So the sum of a span is put together from sums of a shorter one that divides
    it, as many rows apart (200 from four of 50, 50 from five of 10); only spans without such a one slide.
    """
    if df.schema[column].dataType.simpleString().startswith("decimal"):
        return df.withColumns({f"{prefix}{n}": F.when(F.count(column).over(rows(1 - n, 0)) >= n, F.avg(column).over(rows(1 - n, 0))) for n in spans})
    x, done = F.col(column).cast("double"), []
    for n in sorted(set(spans)):
        part = max((m for m in done if n % m == 0), default=None)
        if part is None:
            total = F.when(F.count(column).over(rows(1 - n, 0)) >= n, F.sum(x).over(rows(1 - n, 0)))
        else:  # null where a part is not whole
            total = sum((F.lag(f"_sum_{part}", i * part).over(W()) for i in range(1, n // part)), F.col(f"_sum_{part}"))
        df = df.withColumn(f"_sum_{n}", total)
        done.append(n)
    return df.withColumns({f"{prefix}{n}": F.col(f"_sum_{n}") / n for n in spans}).drop(*[f"_sum_{n}" for n in done])


def rolling_sum(df: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """Sum of the last n rows or as many as there are; 0 on a symbol's first row."""
    return df.withColumn(name, F.when(F.row_number().over(W()) == 1, F.lit(0.0)).otherwise(F.sum(column).over(rows(1 - n, 0))))


def decayed(df: DataFrame, x: Column, keep: float, name: str) -> DataFrame:
    """y_n = keep * y_(n-1) + x_n by window sums, for symbols of any length; needs _rn, a row number from 0.

    y_n = keep^n * sum(x_i / keep^i). So that the powers stay in range, rows are cut into blocks over which keep falls by
    e^-300; within a block the sum is exact, and of what lies before only the block before can matter in double precision.
    """
    size = max(2, int(300 / -math.log(keep)))
    block, k = F.floor(F.col("_rn") / size), F.col("_rn") % size
    df = df.withColumns({"_block": block, "_k": k.cast("double"), "_x": x})
    within = Window.partitionBy("symbol", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_y", F.pow(F.lit(keep), F.col("_k")) * F.sum(F.col("_x") * F.pow(F.lit(keep), -F.col("_k"))).over(within))
    before = F.max_by("_y", "_rn").over(Window.partitionBy("symbol").orderBy("_block").rangeBetween(-1, -1))
    return df.withColumn(name, F.col("_y") + F.coalesce(F.pow(F.lit(keep), F.col("_k") + 1) * before, F.lit(0.0))).drop("_block", "_k", "_x", "_y")


def ema(df: DataFrame, spans: Sequence[int] = SPANS, column: str = "fClose", prefix: str = "ema_", seeded: bool = False) -> DataFrame:
    """Exponential means, alpha = 2 / (span + 1), from the first row on; null until there are `span` rows. Rows with a null value must be gone.

    seeded: from the mean of the first `span` rows instead, at row `span`.
    """
    df = df.withColumn("_rn", F.row_number().over(W()) - 1)
    for n in spans:
        alpha = 2 / (n + 1)
        value = F.col(column).cast("double")
        if seeded:
            first = F.avg(column).over(rows(1 - n, 0))
            x = F.when(F.col("_rn") < n - 1, F.lit(0.0)).when(F.col("_rn") == n - 1, first).otherwise(alpha * value)
        else:
            x = F.when(F.col("_rn") == 0, value).otherwise(alpha * value)
        df = decayed(df, x, 1 - alpha, f"{prefix}{n}").withColumn(f"{prefix}{n}", F.when(F.col("_rn") >= n - 1, F.col(f"{prefix}{n}")))
    return df.drop("_rn")


def ma_diffs(df: DataFrame, prefix: str = "sma_") -> DataFrame:
    """The shorter mean less the longer one, for each pair."""
    return df.withColumns({f"{prefix}{a}_{b}": F.col(f"{prefix}{a}") - F.col(f"{prefix}{b}") for a, b in PAIRS})


def price_ma_diffs(df: DataFrame, prices: Sequence[str] = ("fClose", "fHigh", "fLow"), prefixes: Sequence[str] = ("sma_", "ema_")) -> DataFrame:
    """Each price less each mean."""
    return df.withColumns({f"{p}_{m}{n}": F.col(p) - F.col(f"{m}{n}") for p in prices for m in prefixes for n in SPANS})


def ma_cross_ahead(df: DataFrame, prefix: str = "sma_") -> DataFrame:
    """cross_{pair}: 1 if the difference's sign rises on the next row, -1 if it falls, else 0 (also where it is 0 or unknown). Needs ma_diffs."""
    new = {}
    for a, b in PAIRS:
        d = F.col(f"{prefix}{a}_{b}")
        now, later = F.signum(d), F.signum(F.lead(d).over(W()))
        new[f"cross_{a}_{b}"] = F.when((d != 0) & (now < later), 1).when((d != 0) & (now > later), -1).otherwise(0)
    return df.withColumns(new)


def ema_cross_back(df: DataFrame, short: str, long: str, name: str) -> DataFrame:
    """1 where the difference turned positive since the row before, -1 where it turned negative, else 0; and the difference."""
    df = df.withColumn(f"{name}_diff", F.col(short) - F.col(long))
    d, before = F.col(f"{name}_diff"), F.lag(f"{name}_diff").over(W())
    return df.withColumn(name, F.when((d < 0) & (before > 0), -1).when((d > 0) & (before < 0), 1).otherwise(0))


def trend_flags(df: DataFrame, spans: Sequence[int] = (50, 200)) -> DataFrame:
    """up{n}: 1 if sma_n rose against the row before, else -1 (also where unknown). Needs sma."""
    return df.withColumns({f"up{n}": F.when(F.col(f"sma_{n}") > F.lag(f"sma_{n}").over(W()), 1).otherwise(-1) for n in spans})


def running_high(df: DataFrame) -> DataFrame:
    """fHighMax: the high where it is above all before it (and above 0), else null."""
    before = F.coalesce(F.max("fHigh").over(rows(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("fHighMax", F.when(F.col("fHigh") > before, F.col("fHigh")))


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """rsi by smoothed gains and losses (the first is a mean of n changes; null before), rsi_ob (over 70), rsi_os (under 30).

    No gains and no losses: 0; no losses: 100.
    """
    change = F.col("fClose") - F.lag("fClose").over(W())
    df = df.withColumn("_rn", F.row_number().over(W()) - 1).withColumns({"_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0))})
    for side in ("_gain", "_loss"):
        x = F.when(F.col("_rn") < n, F.lit(0.0)).when(F.col("_rn") == n, F.avg(side).over(rows(1 - n, 0))).otherwise(F.col(side) / n)
        df = decayed(df, x, 1 - 1 / n, f"{side}_mean")
    strength = F.coalesce(100 * F.try_divide(F.col("_gain_mean"), F.col("_gain_mean") + F.col("_loss_mean")), F.lit(0.0))
    df = df.withColumn("rsi", F.when(F.col("_rn") >= n, strength))
    flag = lambda c: F.when(c, 1).otherwise(0)
    return df.withColumns({"rsi_ob": flag(F.col("rsi") > 70), "rsi_os": flag(F.col("rsi") < 30)}).drop("_rn", "_gain", "_loss", "_gain_mean", "_loss_mean")


def rsi_parts(df: DataFrame, n: int = 14) -> DataFrame:
    """change, gain, loss, avg_gain, avg_loss, rs and rsi_{n} = 100 - 100 / (1 + rs), as one study: the means begin at row n (from 0) with the plain means of the changes up to it, null before.

    Without losses rs has no value and rsi is 100; without changes at all it is null.
    """
    change = F.col("fClose") - F.lag("fClose").over(W())
    df = df.withColumns({"_rn": F.row_number().over(W()) - 1, "change": change}).withColumns({"gain": F.when(F.col("change") < 0, 0.0).otherwise(F.col("change")), "loss": F.when(F.col("change") > 0, 0.0).otherwise(-F.col("change"))})
    for side in ("gain", "loss"):
        x = F.when(F.col("_rn") < n, F.lit(0.0)).when(F.col("_rn") == n, F.avg(side).over(rows(1 - n, 0))).otherwise(F.col(side) / n)
        df = decayed(df, x, 1 - 1 / n, f"avg_{side}").withColumn(f"avg_{side}", F.when(F.col("_rn") >= n, F.col(f"avg_{side}")))
    df = df.withColumn("rs", F.try_divide("avg_gain", "avg_loss"))
    value = F.when(F.col("rs").isNotNull(), 100 - 100 / (1 + F.col("rs"))).when(F.col("avg_gain") > 0, F.lit(100.0))
    return df.withColumn(f"rsi_{n}", value).drop("_rn")


def obv(df: DataFrame) -> DataFrame:
    """On-balance volume: + volume after a rise, - after a fall or no change, 0 on the first row; its running sum."""
    before = F.lag("fClose").over(W())
    df = df.withColumn("_v", F.when(before.isNull(), F.lit(0.0)).when(F.col("fClose") > before, F.col("fVolume")).otherwise(-F.col("fVolume")))
    return df.withColumn("obv", F.sum("_v").over(rows(Window.unboundedPreceding, 0))).drop("_v")


def accumulation(df: DataFrame) -> DataFrame:
    """ad: accumulation and distribution, ((C - L) - (H - C)) / (H - L) * volume (0 without a range), and its running sum ad_line."""
    c, h, low = F.col("fClose"), F.col("fHigh"), F.col("fLow")
    df = df.withColumn("ad", F.coalesce(ratio((c - low) - (h - c), h - low) * F.col("fVolume"), F.lit(0.0)))
    return df.withColumn("ad_line", F.sum("ad").over(rows(Window.unboundedPreceding, 0)))


def ttm_trend(df: DataFrame, n: int = 6) -> DataFrame:
    """ttm: 1 if the close is above the mean of the last n bars' middles, -1 if not; null until there are n."""
    middle = F.avg((F.col("fHigh") + F.col("fLow")) / 2).over(rows(1 - n, 0))
    return df.withColumn("ttm", F.when(F.count("*").over(rows(1 - n, 0)) >= n, F.when(F.col("fClose") > middle, 1).otherwise(-1)))


def local_extrema(df: DataFrame, orders: Sequence[int] = (5, 10, 20, 50, 200)) -> DataFrame:
    """min_{k}, max_{k}: the close where none within k rows on either side is lower (higher); ties and edges count.

    Extremes of 2, 4, 8... rows back and ahead come from two of half as many; those of k + 1 rows from two that overlap. So the
    work grows with the logarithm of k, not with k, as that of a sliding frame does.
    """
    name = lambda f, way, p: f"_{f}_{way}_{p}"
    folds, ways = {"min": F.least, "max": F.greatest}, {"back": F.lag, "ahead": F.lead}
    both = [(f, way) for f in folds for way in ways]
    joined = lambda f, way, p, by: folds[f](name(f, way, p), ways[way](name(f, way, p), by).over(W()))
    df, sizes = df.withColumns({name(f, way, 1): F.col("fClose") for f, way in both}), [1]
    while 2 * sizes[-1] <= max(orders, default=0) + 1:
        p = sizes[-1]
        df = df.withColumns({name(f, way, 2 * p): joined(f, way, p, p) for f, way in both})
        sizes.append(2 * p)
    new = {}
    for k in orders:
        p = max(q for q in sizes if q <= k + 1)
        for f in folds:
            side = [joined(f, way, p, k + 1 - p) if k + 1 > p else F.col(name(f, way, p)) for way in ways]
            new[f"{f}_{k}"] = F.when(F.col("fClose") == folds[f](*side), F.col("fClose"))
    return df.withColumns(new).drop(*[name(f, way, p) for f, way in both for p in sizes])


def peaks(df: DataFrame, column: str = "fClose", name: str = "peak") -> DataFrame:
    """1 at the middle of each strict local maximum (for a plateau the lower middle row), else 0."""
    df = df.withColumn("_rn", F.row_number().over(W()))
    new = F.coalesce(F.col(column) != F.lag(column).over(W()), F.lit(True)).cast("int")
    df = df.withColumn("_run", new)
    df = df.withColumn("_run", F.sum("_run").over(rows(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("symbol", "_run")
    df = df.withColumns({"_first": F.min("_rn").over(run), "_last": F.max("_rn").over(run)})
    before = F.max(F.struct("_run", F.col(column).alias("v"))).over(Window.partitionBy("symbol").orderBy("_run").rangeBetween(-1, -1))
    after = F.max(F.struct("_run", F.col(column).alias("v"))).over(Window.partitionBy("symbol").orderBy("_run").rangeBetween(1, 1))
    df = df.withColumns({"_b": before["v"], "_a": after["v"]})
    middle = F.floor((F.col("_first") + F.col("_last")) / 2)
    hit = (F.col(column) > F.col("_b")) & (F.col(column) > F.col("_a")) & (F.col("_rn") == middle)
    return df.withColumn(name, F.when(hit, 1).otherwise(0)).drop("_rn", "_run", "_first", "_last", "_b", "_a")


def derivatives(df: DataFrame, column: str = "fClose") -> DataFrame:
    """d1, d2: central differences of the first and second order; null at the edges."""
    after, before = F.lead(column).over(W()), F.lag(column).over(W())
    return df.withColumns({"d1": (after - before) / 2, "d2": after - 2 * F.col(column) + before})


def trend_fit(df: DataFrame, flag: Column, column: str = "fClose") -> DataFrame:
    """symbol, slope, intercept, n: the line through the flagged rows' values by row number (from 0)."""
    numbered = df.withColumn("_rn", (F.row_number().over(W()) - 1).cast("double")).where(flag)
    return numbered.groupBy("symbol").agg(F.regr_slope(column, "_rn").alias("slope"), F.regr_intercept(column, "_rn").alias("intercept"), F.count("*").alias("n"))


def stock_eod(df: DataFrame) -> DataFrame:
    """The daily pipeline: clean, change, gap, RSI, means of 50 and 200 with trend, running high."""
    return running_high(trend_flags(sma(rsi(gap(change_pct(clean(df)))), (50, 200))))


def moving_averages(df: DataFrame) -> DataFrame:
    """All of the averages of bars, in one window over a symbol's rows: fRange, simple and exponential means, their differences, the prices' distances from them, and the crossings ahead of both kinds (sma_cross_{pair}, ema_cross_{pair})."""
    df = price_ma_diffs(ma_diffs(ma_diffs(ema(sma(df.withColumn("fRange", F.col("fHigh") - F.col("fLow")))), "sma_"), "ema_"))
    for prefix in ("sma_", "ema_"):
        df = ma_cross_ahead(df, prefix).withColumnsRenamed({f"cross_{a}_{b}": f"{prefix}cross_{a}_{b}" for a, b in PAIRS})
    return df


def regular(df: DataFrame) -> DataFrame:
    """The standard studies of bars: relative strength with its parts, on-balance volume, accumulation and distribution."""
    return accumulation(obv(rsi_parts(df)))
