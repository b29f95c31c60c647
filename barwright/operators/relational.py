"""Relational operators with the conventions of data frames, in terms of joins, aggregates and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chained_isin(df: DataFrame, key: str, nlargest: int | None = None, nsmallest: int | None = None) -> DataFrame:
    """Rows whose value is among the n largest or smallest values of key: n rows decide the values, rows with equal values stay.

    The n values come by a top-k (each task keeps n rows), and the rows by a semi join with that small table.
    """
    order = F.col(key).desc_nulls_last() if nlargest else F.col(key).asc_nulls_last()
    values = df.where(F.col(key).isNotNull()).select(key).orderBy(order).limit(nlargest or nsmallest).distinct()
    return df.join(F.broadcast(values), key, "left_semi")


def nlargest_members(df: DataFrame, keys: Sequence[str], value: str, n: int, largest: bool = True) -> DataFrame:
    """The same within each group of keys: one window (the value of the n-th row is the limit)."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last() if largest else F.col(value).asc_nulls_last())
    marked = df.withColumn("_rank", F.rank().over(w))  # ties share the rank of the first, so rank <= n keeps them all
    return marked.where((F.col("_rank") <= n) & F.col(value).isNotNull()).drop("_rank")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in the order given. The order must be total to be repeatable."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def drop_all_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of either that the other hasn't."""
    return a.subtract(b).unionByName(b.subtract(a))


def max_rows(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows at the greatest value of their group; ties stay."""
    return df.withColumn("_m", F.max(value).over(Window.partitionBy(*keys))).where(F.col(value) == F.col("_m")).drop("_m")


def value_counts(df: DataFrame, *keys: str, normalize: bool = False) -> DataFrame:
    """Keys and n, or their share."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    if not normalize:
        return counts
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(*keys, (F.col("n") / F.col("total")).alias("share"))


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of value by keys; quartiles by linear interpolation."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*keys).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q.alias("q"), F.max(v).alias("max"))
    return out.select(*keys, "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def skew(value: Column) -> Column:
    """Sample skewness, corrected for bias; null for fewer than three values."""
    n = F.count(value)
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1.0)) / (n - 2))


def profile(df: DataFrame) -> DataFrame:
    """column, non_null, null_share of every column: one aggregate, then one row a column."""
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in df.columns])
    long = counted.unpivot(["_n"], df.columns, "column", "non_null")
    return long.select("column", "non_null", (1 - F.try_divide(F.col("non_null"), F.col("_n"))).alias("null_share"))


def pct_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "pct") -> DataFrame:
    """Rank as a share of the non-null values, equal values at their mean rank."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    n = F.count(value).over(Window.partitionBy(*keys))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), (F.rank().over(w.orderBy(F.col(value).asc_nulls_last())) + (ties - 1) / 2) / n))


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str) -> DataFrame:
    """A 0/1 column for each of the given values (given, so no pass over the data is needed to find them)."""
    return df.withColumns({f"{prefix}{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in values})


#: Rows of a part when a whole table is put in order, and parts at most: a larger table has larger parts, which are sorted on disk.
PART_ROWS, MOST_PARTS = 100_000, 512


def in_parts(df: DataFrame, order: Sequence[tuple[str, bool]], part_rows: int | None = None) -> DataFrame:
    """df with _part: parts of about so many rows that follow each other in the order (columns, each with whether it descends; nulls come first), each in order.

    The parts are Spark's ranges. They are kept in the shared folder, as ranges come from a sample and would differ if the table
    was read again. Rows that are equal in all columns of the order are in one part.
    """
    from barwright.plans.streams import checkpointed

    parts = min(MOST_PARTS, max(1, -(-df.count() // (part_rows or PART_ROWS))))
    by = [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in order]
    return checkpointed(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, order: Sequence[tuple[str, bool]], name: str = "rn", part_rows: int | None = None) -> DataFrame:
    """df with the number (from 1) of each row in the order of the whole table: numbers within parts, after the counts of the parts before. No task sees more than a part."""
    cut = in_parts(df, order, part_rows)
    counts = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1  # parts are partitions, in order
    return cut.withColumn("_k", place).join(F.broadcast(starts), "_part").withColumn(name, F.col("_k") + F.col("_before")).drop("_part", "_k", "_before")  # starts: a row a part


def gaps_to_next(df: DataFrame, key: str, name: str = "idx_diff", last: int = 1, part_rows: int | None = None) -> DataFrame:
    """key less the next greater row's key (of equal ones 0); `last` on the last row. Each part looks at the least key of the next one that has rows."""
    cut = in_parts(df, [(key, False)], part_rows)
    heads = cut.groupBy("_part").agg(F.min(key).alias("_head"))
    after = heads.select("_part", F.lead("_head").over(Window.orderBy("_part")).alias("_next"))
    following = F.lead(key).over(Window.partitionBy("_part").orderBy(F.asc_nulls_first(key)))
    return cut.withColumn("_f", following).join(F.broadcast(after), "_part").withColumn(name, F.coalesce(F.col(key) - F.coalesce("_f", "_next"), F.lit(last))).drop("_part", "_f", "_next")


def factorize(df: DataFrame, column: str, code: str = "code") -> tuple[DataFrame, DataFrame]:
    """df with a code for each value in order of value (nulls: -1), and the dictionary (code, value). However many values there are: they are numbered in parts, and joined by what their size asks for."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    dictionary = numbered(values, [(column, False)], code).select((F.col(code) - 1).cast("int").alias(code), column)
    return df.join(dictionary, column, "left").withColumn(code, F.coalesce(code, F.lit(-1))), dictionary


def frequency_codes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """column, n, code: 0 for the most frequent value, ties in order of value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return numbered(counts, [("n", True), (column, False)], code).withColumn(code, (F.col(code) - 1).cast("int"))


def equal_bins(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int, name: str = "bin") -> DataFrame:
    """Bins 1..q of about `size` rows within each group, q = rows // size: right-closed quantile intervals of the row number."""
    w = Window.partitionBy(*keys)
    rn0, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    q = F.greatest(F.floor(n / size), F.lit(1))
    return df.withColumn(name, F.greatest(F.lit(1), F.ceil(rn0 * q / F.greatest(n - 1, F.lit(1)))).cast("int"))
