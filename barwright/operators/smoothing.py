"""Filters over each symbol's series: the local level by windows; peaks by windows; prominences and wavelets of whole short series, many at once, and of long ones in blocks or level by level."""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barwright.operators.studies import W, decayed, rows


#: Rows after which the filter's gain must have settled.
SETTLED = 2000


def gains(q: float, r: float) -> list[float]:
    """The filter's gain at each row until it no longer changes: it depends on the variances only, not on the values."""
    out, spread = [], 1.0
    while len(out) < 2 or out[-1] != out[-2]:
        if len(out) > SETTLED:
            raise ValueError(f"the gain doesn't settle within {SETTLED} rows; the state's variance is too small against the noise's")
        spread += q
        out.append(spread / (spread + r))
        spread *= 1 - out[-1]
    return out


def kalman(df: DataFrame, column: str, q: float = 0.01, r: float = 1.0) -> DataFrame:
    """symbol, date, level: a local-level filter with state variance q and noise variance r, from the first value on. Rows with a null value are left out.

    Gains are known in advance, so the level is a weighted sum of the values so far: with the gains' own weights in the rows
    until the gain settles, and from there on as an exponential mean. All of it is windows over a symbol's rows.
    """
    g = gains(q, r)
    left = [1.0]  # what is left of the first value's weight
    for x in g[1:]:
        if left[-1] < 1e-200:
            break
        left.append(left[-1] * (1 - x))
    last = len(left) - 1
    at = lambda values: F.get(F.array(*map(F.lit, values)), F.col("_rn"))
    weights = [1.0, *(x / p for x, p in zip(g[1 : last + 1], left[1:], strict=True))]
    df = df.select("symbol", "date", F.col(column).cast("double").alias("_x")).where("_x IS NOT NULL").withColumn("_rn", F.row_number().over(W()) - 1)
    early = F.col("_rn") <= last
    df = df.withColumn("_early", F.sum(F.when(early, at(weights) * F.col("_x"))).over(rows(Window.unboundedPreceding, 0)) * F.when(early, at(left)))
    x = F.when(F.col("_rn") < last, F.lit(0.0)).when(F.col("_rn") == last, F.col("_early")).otherwise(g[-1] * F.col("_x"))
    df = decayed(df, x, 1 - g[-1], "_late")
    return df.select("symbol", "date", F.when(early, F.col("_early")).otherwise(F.col("_late")).alias("level"))


#: Rows of a block of a series at least, and how many times the root of its length; so a block, and the list of all blocks' extremes, which each block gets, stay small for series of any length.
BLOCK, ROOTS = 4096, 4
#: Searches that one copy of a block answers.
SEARCHES = 65_536


def with_peaks(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """keys, date, rn (from 0), n (rows of the series), x, and peak: at the last row of a run of equal values that is a strict local maximum, the number of its (lower) middle row. Rows with a null value are left out."""
    w = Window.partitionBy(*keys).orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(*keys, "date", F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    rows = rows.withColumns({"rn": F.row_number().over(w).cast("long") - 1, "n": F.count("*").over(Window.partitionBy(*keys)), "_b": F.lag("x").over(w), "_a": F.lead("x").over(w)})
    head = F.col("_b").isNull() | (F.col("_b") != F.col("x"))
    run = F.last(F.when(head, F.struct("rn", "_b")), ignorenulls=True).over(so_far)
    top = (F.col("x") > F.col("_a")) & (F.col("x") > run["_b"])
    return rows.withColumn("peak", F.when(top, F.floor((run["rn"] + F.col("rn")) / 2))).drop("_b", "_a")


def lows(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the least value back to the nearest greater one on its left (or to the start), and whether there is one. One pass with a stack."""
    low, found, stack, least = np.empty(len(x)), np.zeros(len(x), bool), [], []
    for i, v in enumerate(x.tolist()):
        m = v
        while stack and stack[-1] <= v:
            stack.pop()
            m = min(m, least.pop())
        low[i], found[i] = m, bool(stack)
        stack.append(v)
        least.append(m)
    return low[at], found[at]


def longest_series(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> int:
    """Rows of the longest series; 0 for none. One pass over the keys."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def along_series(df: DataFrame, keys: Sequence[str], columns: Sequence[str], names: Sequence[str], work: Callable[..., list[np.ndarray]]) -> DataFrame:
    """df with the columns names: what work(series, a, b, ..) makes of the numbers of its rows' series and the values of columns (null: NaN), as one array of doubles a name (NaN: null).

    A task's rows stand in the order of the window that numbers them (`_row`, if df has none yet), so series come one after another;
    each batch that work gets holds whole series, many short ones at once. A task holds one series and one batch at a time.
    """
    numbered = df if "_row" in df.columns else df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(parts).combine_chunks()
            row = whole["_row"].to_numpy()
            if row[0] != 1 or ((row[1:] != 1) & (row[1:] != row[:-1] + 1)).any():
                raise ValueError("rows of a series are not in order")
            out = work(np.cumsum(row == 1), *[whole[c].to_numpy() for c in columns])
            for name, values in zip(names, out, strict=True):
                whole = whole.append_column(name, pa.array(values, pa.float64(), from_pandas=True))
            yield from whole.drop_columns(["_row"]).to_batches()

        kept: list[pa.RecordBatch] = []
        for batch in batches:
            first = np.flatnonzero(batch["_row"].to_numpy() == 1)
            if len(first) and (kept or first[-1]):
                yield from made([*kept, batch.slice(0, first[-1])])
                kept = []
            kept.append(batch.slice(first[-1]) if len(first) else batch)
        if sum(b.num_rows for b in kept):
            yield from made(kept)

    return numbered.mapInArrow(run, StructType([*numbered.drop("_row").schema.fields, *[StructField(n, DoubleType()) for n in names]]))


def heights(series: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The prominence of each peak of series that stand one after another, at the peak's row; NaN elsewhere. NaN values are left out.

    Only a series' first and last values and its peaks can be higher ground, so one pass each way over these, with the least
    values between them, is enough.
    """
    out, at = np.full(len(x), np.nan), np.flatnonzero(~np.isnan(x))
    if not len(at):
        return out
    series, x = series[at], x[at]
    new = np.append(True, series[1:] != series[:-1])
    head = np.flatnonzero(new | np.append(True, x[1:] != x[:-1]))  # first rows of runs of equal values
    tail = np.append(head[1:], len(x)) - 1
    v, starts = x[head], new[head]
    ends = np.append(starts[1:], True)
    peak = ~starts & ~ends
    peak[1:-1] &= (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    node = np.flatnonzero(starts | ends | peak)
    value = v[node]
    valley = np.minimum.reduceat(v, node)  # from each node to before the next
    before = np.append(value[0], np.minimum(valley[:-1], value[1:]))  # from the node before to each
    low = []
    for values, between, first in ((value, before, starts[node]), (value[::-1], np.append(np.minimum(valley[:-1], value[1:]), value[-1])[::-1], ends[node][::-1])):
        found, stack, least = [], [], []
        for y, m, f in zip(values.tolist(), between.tolist(), first.tolist(), strict=True):
            if f:
                stack, least, m = [], [], y
            while stack and stack[-1] <= y:
                stack.pop()
                m = min(m, least.pop())
            found.append(m)
            stack.append(y)
            least.append(m)
        low.append(np.array(found))
    mine = peak[node]
    out[at[(head[node] + tail[node])[mine] // 2]] = (value - np.maximum(low[0], low[1][::-1]))[mine]
    return out


def with_prominences(df: DataFrame, columns: dict[str, str], keys: Sequence[str] = ("symbol",), longest: int | None = None) -> DataFrame:
    """df with a column name for each {name: column}: the prominence of the column's peaks in the series by keys and date, null at other rows. longest: rows of the longest series, if known.

    Series of up to BLOCK rows are done where they are, many at once; longer ones in blocks (`prominences`).
    """
    keys = list(keys)
    longest = longest_series(df, keys) if longest is None else longest
    work = lambda series, *values: [heights(series, x) for x in values]
    short = lambda rows: along_series(rows, keys, list(columns.values()), list(columns), work)
    df = df.withColumns({c: F.col(c).cast("double") for c in columns.values()})
    if longest <= BLOCK:
        return short(df)
    sized = df.withColumn("_size", F.count("*").over(Window.partitionBy(*keys)))
    long = sized.where(F.col("_size") > BLOCK).drop("_size")
    series = long.select(*keys, "date", F.inline(F.array(*[F.struct(F.lit(name).alias("_series"), F.col(c).alias("_v")) for name, c in columns.items()])))
    found = _by_blocks(series, "_v", [*keys, "_series"]).groupBy(*keys, "date").agg(*[F.max(F.when(F.col("_series") == name, F.col("prominence"))).alias(name) for name in columns])
    return short(sized.where(F.col("_size") <= BLOCK).drop("_size")).unionByName(long.drop("_row").join(found, [*keys, "date"], "left"))


def prominences(df: DataFrame, column: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """keys, date, prominence of each peak: how far it stands above the higher of the two lowest points between it and higher ground (or the series' end) on either side."""
    found = with_prominences(df.select(*keys, "date", F.col(column).cast("double").alias("_x")).where("_x IS NOT NULL"), {"prominence": "_x"}, keys)
    return found.where("prominence IS NOT NULL").select(*keys, "date", "prominence")


def _by_blocks(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """`prominences` of long series.

    A series is cut into blocks. A block finds higher ground within itself; for what is left it gets the extremes of all
    blocks of the series, which tell the nearest block with higher ground and the least value of those between. Such searches
    then go to that block, in copies where there are many.
    """
    keys, kinds = list(keys), {f.name: f.dataType.simpleString() for f in df.schema.fields}
    typed = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    size = F.greatest(F.lit(BLOCK), ROOTS * F.ceil(F.sqrt("n")))
    rows = with_peaks(df, keys, column)
    block = lambda rn: F.floor(rn / size).cast("long")
    row = F.struct(block(F.col("rn")).alias("block"), F.col("rn"), F.lit(0).alias("kind"), F.col("x"), F.col("date"))
    peak = F.when(F.col("peak").isNotNull(), F.struct(block(F.col("peak")).alias("block"), F.col("peak").cast("long").alias("rn"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("x"), F.lit(None).cast(kinds["date"]).alias("date")))
    points = rows.select(*keys, F.inline(F.array_compact(F.array(row, peak))))
    extremes = rows.groupBy(*keys, block(F.col("rn")).alias("block")).agg(F.max("x").alias("high"), F.min("x").alias("low"))
    lists = extremes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "high", "low"))).alias("l")).select(*keys, F.col("l.high").alias("highs"), F.col("l.low").alias("lows"))
    lists = extremes.select(*keys, "block").join(lists, keys)
    none = lambda kind: F.lit(None).cast(kind)
    points = points.withColumns({"highs": none("array<double>"), "lows": none("array<double>")})
    lists = lists.select(*keys, "block", F.lit(-1).cast("long").alias("rn"), F.lit(2).alias("kind"), none("double").alias("x"), none(kinds["date"]).alias("date"), "highs", "lows")

    def within(part: pa.Table) -> pa.Table:
        kind, rn, b = part["kind"].to_numpy(), part["rn"].to_numpy(), part["block"][0].as_py()
        own = np.flatnonzero(kind == 0)
        own = own[np.argsort(rn[own])]
        x = part["x"].to_numpy()[own]
        at = np.sort(rn[kind == 1]) - rn[own[0]]
        listed = int(np.flatnonzero(kind == 2)[0])
        highs, least = (np.array(part[c][listed].as_py()) for c in ("highs", "lows"))
        low, target = [], []
        for side, (v, p) in enumerate(((x, at), (x[::-1], len(x) - 1 - at))):
            near, found = lows(v, p)
            far = slice(b - 1, None, -1) if side == 0 and b else slice(b + 1, None) if side else slice(0, 0)
            high = np.maximum.accumulate(highs[far])
            between = np.concatenate([[np.inf], np.minimum.accumulate(least[far])])
            k = np.where(found, 0, np.searchsorted(high, x[at], "right"))  # blocks until one is higher
            low.append(np.minimum(near, np.where(found, np.inf, between[k])))
            target.append(np.where(~found & (k < len(high)), b - 1 - k if side == 0 else b + 1 + k, -1))
        dates, n = part["date"].take(pa.array(own[at])), len(at)
        columns = {k: pa.array([part[k][0].as_py()] * (2 * n), part.schema.field(k).type) for k in keys}
        columns |= {"date": pa.chunked_array([*dates.chunks, *dates.chunks], dates.type), "x": np.tile(x[at], 2), "side": np.repeat(np.arange(2, dtype=np.int32), n), "low": np.concatenate(low), "target": np.concatenate(target).astype(np.int64)}
        return pa.table(columns)

    # parts as many as set, though they are small: the work is Python's
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = [*keys, "block"]
    seen = points.unionByName(lists).repartition(spread, *group).groupBy(*group).applyInArrow(within, f"{typed}, date {kinds['date']}, x double, side int, low double, target long")
    left = seen.where("target >= 0")
    copies = left.groupBy(*keys, "target").agg(F.ceil(F.count("*") / SEARCHES).cast("int").alias("copies"))
    copy = F.pmod(F.xxhash64("date", "side"), F.col("copies")).cast("int")
    # new names for all columns, as both sides of the cogroup stem from the same rows
    renamed = lambda df, *names: df.select(*[F.col(c).alias(c) for c in names])
    searches = renamed(left.join(copies, [*keys, "target"]).withColumn("copy", copy), *keys, "target", "copy", "date", "x", "side", "low")
    ground = rows.select(*keys, block(F.col("rn")).alias("target"), "rn", "x").join(copies, [*keys, "target"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    ground = renamed(ground, *keys, "target", "copy", "rn", "x")

    def beyond(searches: pa.Table, ground: pa.Table) -> pa.Table:
        x = ground["x"].to_numpy()[np.argsort(ground["rn"].to_numpy())]
        side, low, wanted = searches["side"].to_numpy(), searches["low"].to_numpy().copy(), searches["x"].to_numpy()
        for s, v in enumerate((x[::-1], x)):
            mine = side == s
            k = np.searchsorted(np.maximum.accumulate(v), wanted[mine], "right")  # the nearest higher row
            low[mine] = np.minimum(low[mine], np.concatenate([[np.inf], np.minimum.accumulate(v)])[k])
        at = searches.schema.get_field_index("low")
        return searches.set_column(at, "low", pa.array(low)).select([*keys, "date", "x", "side", "low"])

    group = [*keys, "target", "copy"]
    answered = searches.repartition(spread, *group).groupBy(*group).cogroup(ground.repartition(spread, *group).groupBy(*group)).applyInArrow(beyond, f"{typed}, date {kinds['date']}, x double, side int, low double")
    every = seen.where("target < 0").drop("target").unionByName(answered)
    return every.groupBy(*keys, "date").agg((F.first("x") - F.max("low")).alias("prominence"))


def distant_peaks(df: DataFrame, column: str, distance: int) -> DataFrame:
    """symbol, date: peaks at least `distance` rows apart; of nearer ones the higher stays (of equal ones the later).

    Peaks are found by windows; which of them stay is decided by symbol, from the highest down, among its peaks only.
    """
    rows = with_peaks(df, ["symbol"], column)
    at = rows.where("peak IS NOT NULL").select("symbol", F.col("peak").alias("rn"), "x")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        for rn in part.sort_values(["x", "rn"], ascending=False)["rn"].tolist():
            i = bisect.bisect(kept, rn)
            if (i == 0 or rn - kept[i - 1] >= distance) and (i == len(kept) or kept[i] - rn >= distance):
                kept.insert(i, rn)
        return pd.DataFrame({"symbol": part["symbol"].iloc[0], "rn": kept})

    return rows.select("symbol", "date", "rn").join(at.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol").groupBy("symbol").applyInPandas(run, "symbol long, rn long"), ["symbol", "rn"]).select("symbol", "date")


def daubechies(p: int) -> list[float]:
    """The 2p taps of the orthogonal scaling filter with p vanishing moments whose roots lie inside the unit circle: of the halfband polynomial's roots in z those within it, and -1 p times."""
    y = np.roots([math.comb(p - 1 + k, k) for k in range(p)][::-1])
    z = np.roots([1.0])
    for root in y:  # y = (2 - z - 1 / z) / 4
        pair = np.roots([1, 4 * root - 2, 1])
        z = np.append(z, pair[np.argmin(abs(pair))])
    taps = np.real(np.poly(np.append(z, np.full(p, -1.0))))
    return (taps * math.sqrt(2) / taps.sum()).tolist()


def _bank(p: int) -> tuple[list[float], list[float]]:
    """Analysis filters, low and high."""
    taps = daubechies(p)
    low = taps[::-1]
    return low, [(-1) ** (j + 1) * x for j, x in enumerate(taps)]


def _wrapped(df: DataFrame, keys: Sequence[str], values: Sequence[str], before: int, after: int) -> DataFrame:
    """Rows (keys, k, n, values) with as many more at either end as the windows look at, by wrapping round; short series wrap several times."""
    turn = F.sequence(F.ceil((-before - F.col("k")) / F.col("n")).cast("long"), F.floor((F.col("n") + after - 1 - F.col("k")) / F.col("n")).cast("long"))
    return df.select(*keys, "n", *values, F.col("k").alias("_k"), F.explode(turn).alias("_turn")).select(*keys, "n", *values, (F.col("_k") + F.col("_turn") * F.col("n")).alias("k"))


def analysed(df: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """One level of the periodic wavelet transform of rows (keys, k from 0, n, x): keys, k, n (half of it), x (the averages), d (the details). A series of odd length first repeats its last value."""
    low, high = _bank(p)
    odd = (F.col("n") % 2 == 1) & (F.col("k") == F.col("n") - 1)
    even = df.select(*keys, F.explode(F.when(odd, F.array("k", "n")).otherwise(F.array("k"))).alias("k"), (F.col("n") + F.col("n") % 2).alias("n"), "x")
    w = Window.partitionBy(*keys).orderBy("k")
    at = lambda j: F.lead("x", p - j).over(w) if j <= p else F.lag("x", j - p).over(w)
    out = _wrapped(even, keys, ["x"], p - 1, p + 1).withColumns({"a": sum(at(j) * c for j, c in enumerate(low)), "d": sum(at(j) * c for j, c in enumerate(high))})
    return out.where((F.col("k") >= 0) & (F.col("k") < F.col("n")) & (F.col("k") % 2 == 0)).select(*keys, F.floor(F.col("k") / 2).alias("k"), F.floor(F.col("n") / 2).alias("n"), F.col("a").alias("x"), "d")


def synthesised(df: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """The inverse of `analysed`, for rows (keys, k, n, x, d): keys, k, n (twice it), x."""
    low, high = _bank(p)
    w, half = Window.partitionBy(*keys).orderBy("k"), p // 2
    at = lambda c, by: F.lead(c, by).over(w) if by >= 0 else F.lag(c, -by).over(w)
    # output m takes tap j of the coefficient at (m - p + j) / 2
    outputs = [sum(at("x", (m - p + j) // 2) * low[j] + at("d", (m - p + j) // 2) * high[j] for j in range(2 * p) if (m - p + j) % 2 == 0) for m in (0, 1)]
    out = _wrapped(df, keys, ["x", "d"], half + 1, half + 2).withColumns({"_0": outputs[0], "_1": outputs[1]}).where((F.col("k") >= 0) & (F.col("k") < F.col("n")))
    return out.select(*keys, (F.col("n") * 2).alias("n"), F.posexplode(F.array("_0", "_1")).alias("_m", "x"), F.col("k").alias("_k")).select(*keys, (F.col("_k") * 2 + F.col("_m")).alias("k"), "n", "x")


def wavelet_levels(n: int, p: int) -> int:
    """Levels after which averages would be shorter than the filter."""
    return max(0, int(math.log2(n / (2 * p - 1)))) if n >= 2 * p - 1 else 0


def denoised(series: np.ndarray, x: np.ndarray, scale: float, p: int, levels: int | None) -> np.ndarray:
    """`wavelet_denoised` of series without missing values that stand one after another."""
    low, high = _bank(p)
    n = np.bincount(series - series[0])
    share = scale * np.maximum.reduceat(x, np.cumsum(n) - n)
    own = np.array([wavelet_levels(int(k), p) for k in n])
    own = own if levels is None else np.minimum(own, levels)
    # of each level: rows of the series that end there, and of those that go on
    sizes, steps, now = n, [], x
    which = np.arange(len(n))

    def spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row its series' place, its own place in it, and where the series begins."""
        begin = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        return of, np.arange(len(of)) - begin[of], begin

    level = 0
    while True:
        of, k, begin = spread(sizes)
        on = own[which] > level
        rest = now[~on[of]]
        if not on.any():
            break
        even = sizes[on] + sizes[on] % 2
        half = even // 2
        to, o, _ = spread(half)
        # an odd series repeats its last value
        source = lambda turn, b=begin[on], last=sizes[on] - 1, to=to, even=even: b[to] + np.minimum(turn % even[to], last[to])
        a, d = np.zeros(len(to)), np.zeros(len(to))
        for j in range(2 * p):
            v = now[source(2 * o + p - j)]
            a, d = a + v * low[j], d + v * high[j]
        d = np.sign(d) * np.maximum(np.abs(d) - share[which[on]][to], 0.0)
        steps.append((on, sizes, rest, d))
        sizes, which, now, level = half, which[on], a, level + 1
    for on, sizes, rest, d in reversed(steps):
        half = (sizes[on] + 1) // 2
        _, _, from_ = spread(half)
        of, k, _ = spread(sizes[on])
        back = np.zeros(len(of))
        for m in (0, 1):
            rows = np.flatnonzero(k % 2 == m)
            s, place = of[rows], k[rows] // 2
            for j in range(2 * p):
                if (m - p + j) % 2 == 0:
                    at = from_[s] + (place + (m - p + j) // 2) % half[s]
                    back[rows] += now[at] * low[j] + d[at] * high[j]
        whole = np.empty(int(sizes.sum()))
        mask = np.repeat(on, sizes)
        whole[mask], whole[~mask] = back, rest
        now = whole
    return now


def wavelet_denoised(df: DataFrame, column: str, scale: float, keys: Sequence[str] = ("symbol",), p: int = 6, levels: int | None = None) -> DataFrame:
    """keys, date, smooth: each series without the details that a threshold of scale times its maximum takes away (soft: details shrink by the threshold towards 0).

    A periodic wavelet transform with the orthogonal filters of 2p taps, in as many levels as a series' length allows (levels:
    so many at most). Scale 0 gives the series back. Rows with a null value are left out; series shorter than the filter stay as
    they are. Series of up to BLOCK rows are done where they are, many at once; of longer ones, each level is one window over the
    coefficients of the level before, half as many.
    """
    keys = list(keys)
    rows = df.select(*keys, "date", F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    longest = longest_series(rows, keys)
    short = lambda rows: along_series(rows, keys, ["x"], ["smooth"], lambda series, x: [denoised(series, x, scale, p, levels)]).drop("x")
    if longest <= BLOCK:
        return short(rows)
    sized = rows.withColumn("_size", F.count("*").over(Window.partitionBy(*keys)))
    long = _by_levels(sized.where(F.col("_size") > BLOCK).drop("_size"), keys, scale, p, levels, longest)
    return short(sized.where(F.col("_size") <= BLOCK).drop("_size")).unionByName(long)


def _by_levels(rows: DataFrame, keys: list[str], scale: float, p: int, levels: int | None, longest: int) -> DataFrame:
    """`wavelet_denoised` of long series of rows (keys, date, x)."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"k": F.row_number().over(w.orderBy("date")).cast("long") - 1, "n": F.count("*").over(w), "_t": F.max("x").over(w) * scale})
    most = wavelet_levels(longest, p) if levels is None else min(levels, wavelet_levels(longest, p))
    own = F.least(F.greatest(F.floor(F.log2(F.col("n0") / (2 * p - 1))), F.lit(0)), F.lit(most))  # a series' levels
    carried = [*keys, "n0", "_t"]
    now, before, details = rows.select(*keys, F.col("n").alias("n0"), "_t", "k", "n", "x"), [], []
    for level in range(most):
        before.append(now)
        step = analysed(now.where(own > level), carried, p)
        details.append(step.select(*keys, "k", (F.signum("d") * F.greatest(F.abs("d") - F.col("_t"), F.lit(0.0))).alias("d")))
        now = step.select(*carried, "k", "n", "x")
    for level in reversed(range(most)):
        back = synthesised(now.join(details[level], [*keys, "k"]), carried, p)
        size = F.ceil(F.col("n0") / (1 << level)).cast("long")  # one less than twice the coefficients where that was odd
        now = back.where(F.col("k") < size).withColumn("n", size).unionByName(before[level].where(own == level))
    return rows.select(*keys, "date", "k").join(now.select(*keys, "k", F.col("x").alias("smooth")), [*keys, "k"]).drop("k")
