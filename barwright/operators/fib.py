"""Fibonacci retracement and extension: the day of the strongest rise, the run around it, its levels, and what prices do at them.

Every step is a window or an aggregation by symbol; the bounded walks of the run are "the first row at which the walk must
stop", which is a minimum over rows. Input: bars with fChangeP, fHighMax and gap.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.operators.studies import W

#: The shares of the range at which levels lie.
LEVELS = (0.001, 0.236, 0.382, 0.5, 0.618, 0.786, 0.999, 1.236, 1.5, 1.618, 2.0, 2.618, 3.0, 4.236)
WALK = 50
LEAST_ROWS = 15


def level_name(kind: str, share: float) -> str:
    return f"{kind}_{share:g}".replace(".", "_")


def numbered(df: DataFrame) -> DataFrame:
    """df with rn (from 1) and fRange, of symbols with LEAST_ROWS rows or more."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    return df.withColumns({"rn": F.row_number().over(W()), "fRange": F.col("fHigh") - F.col("fLow"), "_n": n}).where(F.col("_n") >= LEAST_ROWS).drop("_n")


def candidates(df: DataFrame) -> DataFrame:
    """Rows among each symbol's 10 largest volumes with a rise, and hit: whether one of three conditions holds (null where a neighbour or the range is missing).

    Needs `numbered`.
    """
    lead = lambda c: F.lead(c).over(W())
    lag = lambda c: F.lag(c).over(W())
    near = df.withColumns({"next_chg": lead("fChangeP"), "next_c": lead("fClose"), "next_h": lead("fHigh"), "prev_chg": lag("fChangeP"), "prev_h": lag("fHigh"), "_vr": F.rank().over(Window.partitionBy("symbol").orderBy(F.desc("fVolume")))})
    chosen = near.where("_vr <= 10 AND fChangeP > 0").drop("_vr")
    by = lambda c: F.rank().over(Window.partitionBy("symbol").orderBy(F.desc(c)))
    chosen = chosen.withColumn("chg_rank", by("fChangeP"))
    one = (F.col("chg_rank") <= 5) & F.col("fHighMax").isNotNull() & (F.col("fClose") - F.col("fOpen") > 0.5 * F.col("fRange"))
    two = (F.col("prev_chg") > 0) & (F.col("next_chg") < 1) & (F.col("next_c") < F.col("fHigh")) & (F.col("prev_h") < F.col("fHigh"))
    three = (F.col("prev_chg") > 0) & (F.col("next_chg") < F.col("fChangeP")) & (F.col("next_h") < F.col("fHigh"))
    known = F.col("prev_chg").isNotNull() & F.col("next_chg").isNotNull() & (F.col("fRange") != 0)
    return chosen.withColumn("hit", F.when(known, one | two | three))


def max_rows(df: DataFrame) -> DataFrame:
    """symbol, m (the chosen row's number), how: the one row of each symbol that the run is built around.

    One hit: that row. Several: of the candidates from the first hit to the last, the first of these rules that leaves rows
    counts - (1) top 2 by range, top 2 by change and among the 3 earliest, (2) top 2 by change and among the 3 earliest,
    (3) top 5 by change and top 3 by gap. One row left: that row (sort1 to sort3). 2 to 5 rows left: the earliest of all
    candidates in question (sort4). None or more left: that of the largest range (sort5). No hit: the largest change. Rows
    with the value of the last one of a top are in it too; ties go to the earlier row.
    """
    c = candidates(df)
    per = Window.partitionBy("symbol")
    c = c.withColumns({"hits": F.sum(F.coalesce(F.col("hit").cast("int"), F.lit(0))).over(per), "first": F.min(F.when(F.col("hit"), F.col("rn"))).over(per), "last": F.max(F.when(F.col("hit"), F.col("rn"))).over(per)})
    c = c.withColumn("_in", F.coalesce((F.col("hits") > 1) & F.col("rn").between(F.col("first"), F.col("last")), F.lit(False)))
    rank = lambda order: F.rank().over(Window.partitionBy("symbol", "_in").orderBy(order))
    c = c.withColumns({"r_range": rank(F.desc("fRange")), "r_chg": rank(F.desc("fChangeP")), "r_gap": rank(F.desc("gap")), "r_time": rank("rn")})
    rules = ["r_range <= 2 AND r_chg <= 2 AND r_time <= 3", "r_chg <= 2 AND r_time <= 3", "r_chg <= 5 AND r_gap <= 3"]
    counts = [f(F.when(F.expr(f"_in AND {r}"), F.col("rn"))).alias(f"{n}{k}") for k, r in enumerate(rules, 1) for f, n in ((F.count, "k"), (F.min, "m"))]
    # the first of the largest
    widest, strongest = (F.min(F.when(cond, F.struct((-F.col(x)).alias("x"), "rn"))) for cond, x in ((F.col("_in"), "fRange"), (F.lit(True), "fChangeP")))
    g = c.groupBy("symbol").agg(*counts, F.max("hits").alias("hits"), F.min(F.when(F.col("hit"), F.col("rn"))).alias("only"), F.min(F.when(F.col("_in"), F.col("rn"))).alias("early"), widest.alias("wide"), strongest.alias("strong"))
    rule = F.expr("CASE WHEN k1 > 0 THEN struct('sort1' AS how, k1 AS k, m1 AS m) WHEN k2 > 0 THEN struct('sort2' AS how, k2 AS k, m2 AS m) ELSE struct('sort3' AS how, k3 AS k, m3 AS m) END")
    m = "CASE WHEN hits = 0 THEN strong.rn WHEN hits = 1 THEN only WHEN r.k = 1 THEN r.m WHEN r.k BETWEEN 2 AND 5 THEN early ELSE wide.rn END"
    how = "CASE WHEN hits = 0 THEN 'else' WHEN hits = 1 THEN '1' WHEN r.k = 1 THEN r.how WHEN r.k BETWEEN 2 AND 5 THEN 'sort4' ELSE 'sort5' END"
    return g.withColumn("r", rule).select("symbol", F.expr(m).alias("m"), F.expr(how).alias("how"))


def _continues(side: str) -> tuple[Column, Column]:
    """Whether the walk goes on past a row, and, if not, whether that row still belongs to the run."""
    chg, o, h, low, c = (F.col(x) for x in ("fChangeP", "fOpen", "fHigh", "fLow", "fClose"))
    hm, lm, om, cm = (F.col(x) for x in ("m_h", "m_l", "m_o", "m_c"))
    if side == "forward":
        return ((chg > -0.005) & (h > hm)) | ((F.abs(chg) < 0.0035) & (h > lm)), F.lit(False)
    hp, lp = F.col("p_h"), F.col("p_l")
    go = ((chg >= -0.005) & (c < cm) & (c > o)) | ((F.abs(chg) < 0.0035) & (0.995 * h < lm) & (h > hp) & (low > lp)) | ((lm > low) & (cm > h) & (h > hp) & (low > lp))
    return go, ((lm > low) & (hm < o)) | (lm - h > 0.5)


def runs(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """symbol, m, begin, end (row numbers): the run around the chosen row.

    Forward and backward at most WALK rows. A walk ends before the first row that doesn't continue it; backward, such a row
    may still belong to the run. If all WALK rows continue, that bound stays at the chosen row. Needs `numbered`.
    """
    # not as an equation, which would be a key of the join, by which all rows would be dealt out anew
    m = df.join(chosen.select("symbol", "m"), "symbol").where("rn <= m AND rn >= m").select("symbol", "m", F.col("fOpen").alias("m_o"), F.col("fHigh").alias("m_h"), F.col("fLow").alias("m_l"), F.col("fClose").alias("m_c"))
    after = df.withColumns({"p_h": F.lead("fHigh").over(W()), "p_l": F.lead("fLow").over(W()), "_last": F.count("*").over(Window.partitionBy("symbol"))})
    near = after.join(m, "symbol").where(F.abs(F.col("rn") - F.col("m")) <= WALK)
    go_f, _ = _continues("forward")
    go_b, keep_b = _continues("backward")
    off = F.col("rn") - F.col("m")
    go_f, go_b = F.coalesce(go_f, F.lit(False)), F.coalesce(go_b, F.lit(False))
    stop_f = F.min(F.when((off > 0) & ~go_f, F.col("rn")))
    stop_b = F.max(F.when((off < 0) & ~go_b, F.struct(F.col("rn").alias("rn"), F.coalesce(keep_b, F.lit(False)).alias("keep"))))
    g = near.groupBy("symbol", "m").agg(stop_f.alias("f"), stop_b.alias("b"), F.max("rn").alias("top"), F.min("rn").alias("bottom"), F.first("_last").alias("_last"))
    all_f, all_b = F.col("top") - F.col("m") >= WALK, F.col("m") - F.col("bottom") >= WALK
    end = F.when(F.col("f").isNotNull(), F.col("f") - 1).when(all_f, F.col("m")).otherwise(F.col("_last"))
    begin = F.when(F.col("b").isNotNull(), F.when(F.col("b.keep"), F.col("b.rn")).otherwise(F.col("b.rn") + 1)).when(all_b, F.col("m")).otherwise(F.lit(1))
    return g.select("symbol", "m", begin.cast("int").alias("begin"), end.cast("int").alias("end"))


def levels(df: DataFrame, run: DataFrame) -> DataFrame:
    """symbol, start, high, range, perc_range, ext_end, ext_date, cond and the 14 retracement and 14 extension levels of each run. Needs `numbered`."""
    inside = df.join(run, "symbol").where("rn BETWEEN begin AND end OR rn BETWEEN m AND m + 1")
    of_run, at_m, after = F.expr("rn BETWEEN begin AND end"), F.expr("rn = m"), F.expr("rn = m + 1")
    only = lambda f, cond, c: f(F.when(cond, F.col(c)))
    found = {"start": (F.min, of_run, "fLow"), "high": (F.max, of_run, "fHigh"), "first_date": (F.min, of_run, "date"), "last_date": (F.max, of_run, "date"), "m_l": (F.max, at_m, "fLow"), "m_date": (F.max, at_m, "date"), "n_l": (F.max, after, "fLow"), "n_date": (F.max, after, "date")}
    j = inside.groupBy("symbol", "m").agg(*[only(*how).alias(name) for name, how in found.items()]).withColumn("range", F.col("high") - F.col("start"))
    goes_on = F.coalesce(F.col("n_l") < F.col("m_l"), F.lit(False))
    by_618 = (F.col("high") - 0.382 * F.col("range")) * 0.618
    first = F.when(goes_on & (F.col("range") > F.col("start")), F.col("high") - (F.col("start") + 0.5 * F.col("range"))).otherwise(by_618)
    low = first < F.col("start")
    j = j.withColumn("ext_end", F.when(low, F.when(goes_on, F.col("n_l")).otherwise(F.col("m_l"))).otherwise(first))
    cond = F.when(low, F.when(goes_on, "nextLow").otherwise("maxLow")).when(goes_on & (F.col("range") > F.col("start")), "range").otherwise("fib618")
    j = j.withColumns({"cond": cond, "ext_date": F.when(goes_on, F.col("n_date")).otherwise(F.col("m_date")), "perc_range": F.try_divide(F.col("range"), F.col("start"))})
    ret = [F.round(F.col("high") - F.col("range") * p, 3).alias(level_name("ret", p)) for p in LEVELS]
    ext = [F.round(F.col("ext_end") + F.col("range") * p, 3).alias(level_name("ext", p)) for p in LEVELS]
    return j.select("symbol", "m", "start", "high", "range", "perc_range", "first_date", "last_date", "ext_end", "ext_date", "cond", *ret, *ext)


def confirmations(df: DataFrame, run: DataFrame, lv: DataFrame, share: float = 0.025) -> DataFrame:
    """symbol, level, date, price, diff, level_value: prices of the run's rows that lie within `share` of a level."""
    inside = df.join(run, "symbol").where("rn BETWEEN begin AND end").select("symbol", "date", "fOpen", "fHigh", "fLow", "fClose")
    prices = inside.unpivot(["symbol", "date"], ["fOpen", "fHigh", "fLow", "fClose"], "price", "v")
    names = [level_name(k, p) for k in ("ret", "ext") for p in LEVELS]
    long = lv.unpivot(["symbol"], names, "level", "level_value")
    diff = F.try_divide(F.col("v") - F.col("level_value"), F.col("level_value"))
    return prices.join(long, "symbol").withColumn("diff", diff).where(F.abs("diff") < share).select("symbol", "level", "date", "price", F.round("diff", 2).alias("diff"), "level_value")


def _least(high: pa.Array, low: pa.Array, values: pa.Array) -> pa.Array:
    """Of each row the place of the value nearest to high (of equally near ones the first), that value and the distance, and the same for low."""
    table = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
    out, each = [], np.arange(len(table))
    for x in (high, low):
        d = np.abs(x.to_numpy(zero_copy_only=False)[:, None] - table)
        k = np.argmin(d, axis=1)  # the first null one, if there is one
        out += [pa.array(k.astype(np.int32)), pa.array(table[each, k], from_pandas=True), pa.array(d[each, k], from_pandas=True)]
    return pa.StructArray.from_arrays(out, ["hk", "hv", "hd", "lk", "lv", "ld"])


def with_nearest(df: DataFrame, lv: DataFrame) -> DataFrame:
    """df with h_level and h_value (the level nearest to the high), l_level and l_value (to the low; ties: the first name), h_d and l_d, the distances; symbols without levels are left out."""
    return _nearest(_with_levels(df, lv))


#: All levels in the order of their names.
NAMES = sorted(level_name(k, p) for k in ("ret", "ext") for p in LEVELS)


def _with_levels(df: DataFrame, lv: DataFrame) -> DataFrame:
    return df.join(lv.select("symbol", F.array(*NAMES).alias("_lv")), "symbol")


def _nearest(df: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, NAMES))
    least = F.arrow_udf(_least, "struct<hk int, hv double, hd double, lk int, lv double, ld double>")
    out = df.withColumn("_near", least(F.col("fHigh").cast("double"), F.col("fLow").cast("double"), F.col("_lv")))
    found = [F.get(names, F.col(f"_near.{s}k")).alias(f"{s}_level") if n == "level" else F.col(f"_near.{s}{n[0]}").alias(f"{s}_{n}") for s in "hl" for n in ("level", "value", "d")]
    return out.select(*[c for c in df.columns if c != "_lv"], *found)


def nearest(df: DataFrame, lv: DataFrame) -> DataFrame:
    """symbol, date, and the level nearest to the high and to the low of each bar, its value and the distance as a share (ties: the first name)."""
    out = with_nearest(df.select("symbol", "date", "fHigh", "fLow"), lv)
    return out.select("symbol", "date", "h_level", "h_value", "l_level", "l_value", F.try_divide("h_d", "h_value").alias("h_pct"), F.try_divide("l_d", "l_value").alias("l_pct"))


def crossings(df: DataFrame, lv: DataFrame) -> DataFrame:
    """symbol, level, first_cross (the first date after the run whose high reaches an extension level), days_to, share_past (of later bars that do)."""
    names = [level_name("ext", p) for p in LEVELS if p >= 1]
    long = lv.select("symbol", "last_date", *names).unpivot(["symbol", "last_date"], names, "level", "v")
    later = df.select("symbol", "date", "fHigh").join(long, "symbol").where(F.col("date") > F.col("last_date"))
    past = F.col("fHigh") >= F.col("v")
    g = later.groupBy("symbol", "level", "last_date").agg(F.min(F.when(past, F.col("date"))).alias("first_cross"), (F.count_if(past) / F.count("*")).alias("share_past"))
    return g.select("symbol", "level", "first_cross", F.datediff("first_cross", "last_date").alias("days_to"), "share_past")


def hits(df: DataFrame, lv: DataFrame, shares: tuple[float, ...] = (1.618, 2.618, 4.236)) -> DataFrame:
    """symbol, hit_{share}: how many bars after the run come within 2 % of an extension level or above."""
    names = [level_name("ext", p) for p in shares]
    later = df.select("symbol", "date", "fHigh").join(lv.select("symbol", "last_date", *names), "symbol").where(F.col("date") > F.col("last_date"))
    return later.groupBy("symbol").agg(*[F.count_if(F.col("fHigh") > 0.98 * F.col(n)).alias(n.replace("ext", "hit")) for n in names])


def days_until(df: DataFrame, flag: Column) -> DataFrame:
    """df with next_date, the date of the next flagged row (this one included), and the weekdays until then."""
    from barwright.functions.dates import weekdays_between

    ahead = F.first(F.when(flag, F.col("date")), ignorenulls=True).over(W().rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("next_date", ahead).withColumn("days_until", weekdays_between(F.col("date"), F.col("next_date")))


def peaks_near_levels(df: DataFrame, lv: DataFrame, keep: Sequence[str] = (), longest: int | None = None) -> DataFrame:
    """What each bar's high and low do near the levels, with the moves after it.

    symbol, date; kind: peak (of the highs) or trough (of the lows; both: trough) or null; code: high or low, whichever is
    nearer to a level as a share of itself (equal: low), with level and close_val; prominence of that peak or trough (0 where
    it is none); perc_{k}: the absolute running change k rows later less that now (perc_5: without absolute values), and
    hl_perc_{k}: the high k rows later over the low now; both are null on a symbol's first row and where there is no such row.
    Columns to keep of df come last; longest: rows of the longest series, if known. Needs fChangeP. Levels are joined by symbol; all else happens where a symbol's rows are.
    """
    from barwright.operators.smoothing import longest_series, with_prominences
    from barwright.operators.studies import rows

    longest = longest_series(df) if longest is None else longest
    own = df.select(*dict.fromkeys(["symbol", "date", "fHigh", "fLow", "fChangeP", *keep])).withColumn("_depth", -F.col("fLow"))
    flagged = own.withColumns({"_cum": F.sum("fChangeP").over(rows(Window.unboundedPreceding, 0)), "_rn": F.row_number().over(W())})
    later = lambda c, k: F.when(F.col("_rn") > 1, F.lead(c, k).over(W()))
    moves = {f"perc_{k}": F.abs(later("_cum", k)) - F.abs("_cum") for k in (1, 2, 3, 10, 20)} | {"perc_5": later("_cum", 5) - F.col("_cum")}
    moves |= {f"hl_perc_{k}": F.try_divide(later("fHigh", k) - F.col("fLow"), F.col("fLow")) for k in (1, 2, 3)}
    share = lambda side, of: F.try_divide(F.abs(F.col(of) - F.col(f"{side}_value")), F.col(of))
    # rows are put in order before the levels are sought, so that nothing moves from there on
    flagged = _nearest(_with_levels(flagged.withColumns(moves).drop("_cum", "_rn"), lv).withColumn("_row", F.row_number().over(W())))
    flagged = flagged.withColumns({"high_diff": share("h", "fHigh"), "low_diff": share("l", "fLow")}).drop("h_value", "l_value", "h_d", "l_d")
    both = with_prominences(flagged, {"_ph": "fHigh", "_pl": "_depth"}, longest=longest).withColumns({"_peak": F.col("_ph").isNotNull(), "_trough": F.col("_pl").isNotNull()})
    by_high = F.coalesce(F.col("high_diff") < F.col("low_diff"), F.lit(False))
    pick = lambda a, b: F.when(by_high, F.col(a)).otherwise(F.col(b))
    both = both.withColumns({
        "kind": F.when(F.col("_trough"), "trough").when(F.col("_peak"), "peak"),
        "code": F.when(by_high, "high").otherwise("low"),
        "level": pick("h_level", "l_level"),
        "close_val": pick("high_diff", "low_diff"),
        "prominence": F.coalesce(pick("_ph", "_pl"), F.lit(0.0)),
    })
    return both.select("symbol", "date", "kind", "code", "level", "close_val", "prominence", "high_diff", "low_diff", "h_level", "l_level", *moves, *keep)


def closeness_by_symbol(near: DataFrame) -> DataFrame:
    """symbol, n (peaks and troughs), total and mean distance to the nearest level; symbols at no distance are left out. Needs `peaks_near_levels`."""
    g = near.where("kind IS NOT NULL").groupBy("symbol").agg(F.count("*").alias("n"), F.sum("close_val").alias("total"))
    return g.where("total > 0").withColumn("mean_close", F.col("total") / F.col("n"))


def troughs_over_peaks(near: DataFrame, lv: DataFrame, share: float = 0.05) -> DataFrame:
    """level, peaks, troughs, t_p (troughs over peaks) of rows after the run whose high and low are both within share of a level."""
    after = near.join(lv.select("symbol", "last_date"), "symbol").where((F.col("date") > F.col("last_date")) & (F.col("high_diff") < share) & (F.col("low_diff") < share))
    g = after.groupBy("level").agg(F.count_if(F.col("kind") == "peak").alias("peaks"), F.count_if(F.col("kind") == "trough").alias("troughs"))
    return g.where("peaks + troughs > 0").withColumn("t_p", F.try_divide("troughs", F.nullif("peaks", F.lit(0))))


def bounces(near: DataFrame, lv: DataFrame, share: float = 0.05) -> DataFrame:
    """Rows after the extension's date within share of a level: the first of each symbol and level of the high, and of these the first of each symbol and level of the low."""
    after = near.join(lv.select("symbol", "ext_date"), "symbol").where((F.col("date") > F.col("ext_date")) & (F.col("close_val") < share))
    for level in ("h_level", "l_level"):
        w = Window.partitionBy("symbol", level).orderBy("date")
        after = after.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return after.drop("ext_date")


def pipeline(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The levels, the confirmations and the runs of all symbols, from one plan. Numbers df, if it isn't yet."""
    n = df if "rn" in df.columns else numbered(df)
    r = runs(n, max_rows(n))
    lv = levels(n, r)
    return lv, confirmations(n, r, lv), r
