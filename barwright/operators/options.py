"""Option flow: ratios of puts to calls, unusual volume, top contracts by day, differences between days, cleaned chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.operators.studies import W


def chain(lineitem: DataFrame) -> DataFrame:
    """A chain of contracts from line items: underlying, expires, strike, side, volume, oi, mid by day (month of trade).

    Returned flag A is a call and R a put; other lines are no options.
    """
    side = F.when(F.col("l_returnflag") == "A", "C").when(F.col("l_returnflag") == "R", "P")
    rows = lineitem.select(
        F.col("l_suppkey").alias("underlying"),
        F.trunc("l_shipdate", "quarter").alias("expires"),
        (F.floor(F.col("l_extendedprice") / 20000) * 20000).alias("strike"),
        side.alias("side"),
        F.trunc("l_shipdate", "month").alias("date"),
        F.col("l_quantity").alias("volume"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
    ).where("side IS NOT NULL")
    return rows.groupBy("underlying", "expires", "strike", "side", "date").agg(F.sum("volume").alias("volume"), F.count("*").alias("oi"), F.max("price").alias("ask"), F.min("price").alias("bid"))


def put_call(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pc_ratio, oi_ratio: puts over calls by volume and open interest; 0 where either side is absent. One aggregation."""
    total = lambda c, s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col(c))), F.lit(0))
    sums = df.groupBy(*keys).agg(*[total(c, s).alias(f"{c}_{s}") for c in ("volume", "oi") for s in "PC"])
    ratio = lambda c: F.coalesce(F.try_divide(F.col(f"{c}_P"), F.col(f"{c}_C")), F.lit(0.0))
    return sums.select(*keys, ratio("volume").alias("pc_ratio"), ratio("oi").alias("oi_ratio"))


def unusual_volume(df: DataFrame, least_volume: float = 50, least_ratio: float = 0.25) -> DataFrame:
    """Contracts with more volume than a share of open interest; with v_oi and spread."""
    v_oi = F.col("volume") / F.when(F.col("oi") == 0, 1).otherwise(F.col("oi"))
    return df.withColumns({"v_oi": v_oi, "spread": F.col("ask") - F.col("bid")}).where((F.col("v_oi") > least_ratio) & (F.col("volume") > least_volume))


def top_volume_over_average(df: DataFrame, n: int, excluded: Sequence[int] = ()) -> DataFrame:
    """The n contracts (expires, underlying, side) of each date with the most volume against their mean over all dates.

    keys, tot_vol, vol_avg. Means and sums come from one aggregation of contract days; contracts of excluded names are left out.
    """
    keys = ["expires", "underlying", "side"]
    days = df.where(~F.col("underlying").isin(list(excluded)) if excluded else F.lit(True)).groupBy("date", *keys).agg(F.sum(F.abs("volume")).alias("tot_vol"))
    ratio = F.col("tot_vol") / F.avg("tot_vol").over(Window.partitionBy(*keys[1:]))
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("vol_avg"), F.desc("tot_vol"), *keys))
    return days.withColumn("vol_avg", ratio).withColumn("_rn", place).where(F.col("_rn") <= n).drop("_rn")


def new_since(df: DataFrame, keys: Sequence[str], day: Column, before: Column) -> DataFrame:
    """Rows of `day` whose keys have none on `before`."""
    return df.where(F.col("date") == day).join(df.where(F.col("date") == before).select(*keys), list(keys), "left_anti")


def horizon(days: Column) -> Column:
    """short (under 45 days), med (45 to 180, both left out), long (over 180); null on the limits."""
    return F.when(days < 45, "short").when((days > 45) & (days < 180), "med").when(days > 180, "long")


def clean_chain(df: DataFrame) -> DataFrame:
    """mid (to 3 decimals), premium (mid * volume * 100, whole), v_oi; one row for each contract and day."""
    keys = ["underlying", "expires", "strike", "side", "date"]
    mid = F.bround((F.col("bid") + F.col("ask")) / 2, 3)
    priced = df.withColumn("mid", mid).withColumns({"premium": F.bround(F.col("mid") * F.col("volume") * 100, 0), "v_oi": F.col("volume") / F.greatest(F.col("oi"), F.lit(1))})
    return priced.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("volume"), "bid", "ask"))).where("_rn = 1").drop("_rn")


def latest_interest(volume: DataFrame, interest: DataFrame, keys: Sequence[str], days: int = 20) -> DataFrame:
    """volume with each contract's latest open interest not more than `days` before the newest date of interest."""
    newest = interest.agg(F.max("date").alias("_newest"))
    recent = interest.crossJoin(F.broadcast(newest)).where(F.datediff("_newest", "date") <= days)
    last = recent.groupBy(*keys).agg(F.max_by("oi", "date").alias("last_oi"))
    return volume.join(last, list(keys), "left").withColumn("v_oi", F.col("volume") / F.when(F.col("last_oi") > 0, F.col("last_oi")))


def clean_trades(df: DataFrame, least_premium: float = 10_000) -> DataFrame:
    """Trades (key columns, volume, price, ts) with volume over 1 after 9 o'clock, one for each composite id, with premium; those over a premium."""
    kept = df.where((F.col("volume") > 1) & (F.hour("ts") > 9))
    time_no = F.dense_rank().over(Window.partitionBy(F.to_date("ts")).orderBy("ts")) - 1
    ident = F.concat_ws("_", "symbol", F.date_format("ts", "yyyyMMdd"), F.col("time_no").cast("string"))
    named = kept.withColumn("time_no", time_no).withColumn("id2", ident)
    one = named.withColumn("_rn", F.row_number().over(Window.partitionBy("id2").orderBy(F.desc("volume"), F.desc("price")))).where("_rn = 1").drop("_rn")
    return one.withColumn("premium", F.floor(F.col("volume") * F.col("price")) * 100).where(F.col("premium") > least_premium)


def bull_bear(df: DataFrame, key: str, columns: Sequence[str], low: float = 0.1, high: float = 0.9) -> DataFrame:
    """key, mood: bull where the share ranks of all columns are below `low`, bear where all are above `high`.

    Ranks are over all keys, which are as few as underlyings.
    """
    from barwright.operators.relational import pct_rank

    ranked = df.withColumn("_all", F.lit(1))
    for c in columns:
        ranked = pct_rank(ranked, ["_all"], c, f"_r_{c}")
    ranks = [F.col(f"_r_{c}") for c in columns]
    mood = F.when(F.greatest(*ranks) < low, "bull").when(F.least(*ranks) > high, "bear")
    return ranked.select(key, mood.alias("mood")).where("mood IS NOT NULL")


def group_share(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each contract's volume and open interest as a share of its group's (a window, no join back)."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"vol_share": F.col("volume") / F.sum("volume").over(w), "oi_share": F.col("oi") / F.sum("oi").over(w)})


def forward_returns(df: DataFrame, steps: Sequence[int] = (1, 2, 3, 5, 7)) -> DataFrame:
    """c_{k}, o_{k}: the return from this close (open) to that k rows later, seen from there."""
    new = {}
    for k in steps:
        new[f"c_{k}"] = -(F.try_divide(F.col("fClose"), F.lead("fClose", k).over(W())) - 1)
        new[f"o_{k}"] = -(F.try_divide(F.col("fOpen"), F.lead("fOpen", k).over(W())) - 1)
    return df.withColumns(new)


def flatten_tree(df: DataFrame, column: str) -> DataFrame:
    """expires, strike and the first contract's fields of a map of maps of arrays of structs: two explodes."""
    outer = df.select(*[c for c in df.columns if c != column], F.explode(column).alias("expires", "_strikes"))
    inner = outer.select("*", F.explode("_strikes").alias("strike", "_list")).drop("_strikes")
    return inner.withColumn("_c", F.get("_list", F.lit(0))).select(*[c for c in inner.columns if c != "_list"], "_c.*")


def missing_expiries(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """symbol, expires (sorted array) of the wanted (symbol, expires) that are not there."""
    return wanted.join(have.select("symbol", "expires").distinct(), ["symbol", "expires"], "left_anti").groupBy("symbol").agg(F.array_sort(F.collect_set("expires")).alias("expires"))


def pc_table(df: DataFrame, column: str, ratio_name: str, cutoff: float | None = None, only_ratio: bool = False) -> DataFrame:
    """underlying, sums of column by side ({column}C, {column}P; a sum of 0 counts as 1) and puts over calls (null where a side is absent); with cutoff, rows with a side above it."""
    total = lambda s: F.sum(F.when(F.col("side") == s, F.coalesce(F.col(column), F.lit(0))))
    one = lambda c: F.when(F.col(c) == 0, F.lit(1)).otherwise(F.col(c))
    c, p = f"{column}C", f"{column}P"
    wide = df.groupBy("underlying").agg(total("C").alias(c), total("P").alias(p)).withColumns({c: one(c), p: one(p)}).withColumn(ratio_name, F.try_divide(p, c))
    if cutoff is not None:
        wide = wide.where((F.col(c) > cutoff) | (F.col(p) > cutoff))
    return wide.drop(c, p) if only_ratio else wide


def clean_flex(df: DataFrame) -> DataFrame:
    """Report lines of flexible options (SYMBOL, YR, MO, DAY, SIDE and others, as text): repeated headers and lines that are no contract go; STYLE is the symbol's first character, expirationDate its three parts together."""
    kept = df.where(F.col("SIDE").isin("C", "P") & (F.col("SYMBOL") != "SYMBOL"))
    return kept.withColumns({"STYLE": F.substring("SYMBOL", 1, 1), "SYMBOL": F.expr("substring(SYMBOL, 2)"), "expirationDate": F.concat("YR", "MO", "DAY")})


def clean_trade_volume(df: DataFrame) -> DataFrame:
    """Trade volumes by exchange with short names, quantities as whole numbers (what is none: null)."""
    short = {"exchangeId": "exId", "exchangeName": "exName", "firmQuantity": "fQuant", "customerQuantity": "cQuant", "marketQuantity": "mQuant"}
    df = df.withColumnsRenamed(short)
    return df.withColumns({c: F.col(c).try_cast("bigint") for c in ("fQuant", "cQuant", "mQuant") if c in df.columns})
