"""Data quality: missing dates, gap filling, health reports, keyed deduplication, scaling and splits for training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_counted(df: DataFrame, calendar: DataFrame, key: str = "symbol", known: DataFrame | None = None) -> DataFrame:
    """key, date, n: business days between each key's first and last date that it has no row for, less those in known (key, date), and how many the key misses.

    The calendar (a few hundred rows a year) is one array, a key's dates are another, so what is missing is their difference:
    only the rows that are there are shuffled and sorted, not the missing ones, which may be many times as many.
    """
    own = df.groupBy(key).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"), F.collect_set("date").alias("_own"))
    days = F.broadcast(calendar.agg(F.array_sort(F.collect_set("date")).alias("_days")))
    wanted = F.filter("_days", lambda day: day.between(F.col("_lo"), F.col("_hi")))
    lists = own.crossJoin(days).select(key, F.array_except(wanted, "_own").alias("_missing"))
    if known is not None:
        lists = lists.join(known.groupBy(key).agg(F.collect_set("date").alias("_known")), key, "left").select(key, F.array_except("_missing", F.coalesce("_known", F.array().cast("array<date>"))).alias("_missing"))
    return lists.select(key, F.size("_missing").cast("long").alias("n"), F.explode("_missing").alias("date")).select(key, "date", "n")


def missing_dates(df: DataFrame, calendar: DataFrame, key: str = "symbol", known: DataFrame | None = None) -> DataFrame:
    """key, date of `missing_counted`."""
    return missing_counted(df, calendar, key, known).drop("n")


def with_count(missing: DataFrame, key: str = "symbol") -> DataFrame:
    """missing with n, the number of missing dates of its key: n = 1 are singles; keys with few are worth asking for one by one."""
    return missing.withColumn("n", F.count("*").over(Window.partitionBy(key)))


def singles_and_multiples(missing: DataFrame, key: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """The missing dates of keys that miss one, and those of keys that miss more. With n (`missing_counted`) nothing is counted again."""
    counted = missing if "n" in missing.columns else with_count(missing, key)
    return counted.where("n = 1").drop("n"), counted.where("n > 1").drop("n")


def gap_fill(df: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df and the rows of a second source whose keys df hasn't."""
    return df.unionByName(second.join(df.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """old and new rows, one for each key: an old row wins over a new one; among rows of one side the first in `order`."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_side", *order)
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_side")


def freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """name, newest, n of each table by its date column."""
    parts = [df.agg(F.lit(name).alias("name"), F.max(F.to_date(column)).alias("newest"), F.count("*").alias("n")) for name, (df, column) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flags_by_day(df: DataFrame, key: str, day: Column, column: str, values: dict[str, str]) -> DataFrame:
    """key, date and for each name how many rows have its value; days with none are left out."""
    sums = df.groupBy(key, day.alias("date")).agg(*[F.count_if(F.col(column) == v).alias(n) for n, v in values.items()])
    return sums.where(" OR ".join(f"{n} > 0" for n in values))


def standard_scale(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """columns as distance from the mean in population deviations, nulls as 0 first; over all rows or within groups. No deviation: 0."""
    filled = df.fillna(0, list(columns))
    if by:
        w = Window.partitionBy(*by)
        return filled.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)), F.lit(0.0)) for c in columns})
    stats = filled.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("_m", F.avg), ("_s", F.stddev_pop))])
    joined = filled.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in columns}).drop(*stats.columns)


def time_split(df: DataFrame, by: Sequence[str], order: Sequence[str], folds: int = 3, test_share: float = 0.2) -> DataFrame:
    """df with split (train, test or later) of the first of `folds` expanding splits by time within each group.

    Each of the n rows' folds tests `test_share` of n rows; the first split's test begins where the folds' tests, end to end,
    reach the last row.
    """
    w = Window.partitionBy(*by)
    rn, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    size = F.floor(n * test_share)
    first = n - folds * size
    return df.withColumn("split", F.when(rn <= first, "train").when(rn <= first + size, "test").otherwise("later"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """rmse, r2, accuracy of signs: plain aggregates."""
    a, p = F.col(actual), F.col(predicted)
    return df.agg(F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"), (1 - F.try_divide(F.sum((a - p) * (a - p)), F.var_pop(a) * F.count(a))).alias("r2"), F.avg((F.signum(a) == F.signum(p)).cast("double")).alias("sign_accuracy"))


def domain_check(df: DataFrame, allowed: dict[str, Sequence]) -> DataFrame:
    """df with problems: an array of the columns whose value is null or not among the allowed ones."""
    bad = [F.when(~F.coalesce(F.col(c).isin(list(v)), F.lit(False)), F.lit(c)) for c, v in allowed.items()]
    return df.withColumn("problems", F.array_compact(F.array(*bad)))


def view_clean(df: DataFrame, low: float = -0.9, high: float = 15.0) -> DataFrame:
    """Rows of symbols above the lowest quartile of deviation of fChangeP, without jumps that must be errors."""
    std = df.groupBy("symbol").agg(F.stddev_samp("fChangeP").alias("_std"))
    cut = std.agg(F.percentile("_std", 0.25).alias("_cut"))
    kept = std.crossJoin(F.broadcast(cut)).where("_std > _cut").select("symbol")
    return df.join(kept, "symbol", "left_semi").where(~((F.col("fChangeP") < low) | (F.col("fChangeP") > high)))
