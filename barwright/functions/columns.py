"""Column functions with the conventions of data frames: ratios that don't fail, comparisons that know nulls, rounding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def perc_change(a: Column, b: Column, multiply: bool = False) -> Column:
    """(b - a) / a, in percent if multiply; null where a is 0 or null."""
    out = F.try_divide(b - a, a)
    return out * 100 if multiply else out


def signed_percent(a: Column, b: Column) -> Column:
    """Percent change from a to b to one decimal; null where a is 0."""
    return F.round(F.try_divide(b - a, a) * 100, 1)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, where a denominator of 0 counts as 1."""
    return a / F.when(b == 0, F.lit(1.0)).otherwise(b)


def finite(x: Column, other: float = 0.0) -> Column:
    """x, or `other` where x is null, NaN or infinite."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x).otherwise(F.lit(other))


def between_or_false(x: Column, low, high) -> Column:
    """Inclusive; a null is outside."""
    return F.coalesce(x.between(low, high), F.lit(False))


def same(a: Column, b: Column) -> Column:
    """Equality in which a null equals a null."""
    return a.eqNullSafe(b)


def combine_duplicates(df: DataFrame, names: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y"), default=0) -> DataFrame:
    """After a join: for each name the first non-null of name, name + suffixes, and default; the suffixed columns go."""
    out = df
    for n in names:
        have = [c for c in (n, n + suffixes[0], n + suffixes[1]) if c in df.columns]
        out = out.withColumn(n, F.coalesce(*[F.col(c) for c in have], F.lit(default)))
    return out.drop(*[n + s for n in names for s in suffixes])


def mask(df: DataFrame, key: str, value=None, equals: bool = True, greater: bool = False, lesser: bool = False, notin: bool = False) -> DataFrame:
    """Rows by a test of one column: membership for a list of several values (a list of one value tests nothing), else a comparison."""
    c = F.col(key)
    if isinstance(value, (list, tuple, set)):
        values = list(value)
        return df if len(values) == 1 else df.where(~c.isin(values) if notin else c.isin(values))
    if greater:
        return df.where(c > value)
    if lesser:
        return df.where(c < value)
    return df.where(c == value if equals else c != value)


def round_cols(df: DataFrame, names: Sequence[str] | None = None, decimals: int = 3) -> DataFrame:
    """Float columns (or those named), rounded half to even as arrays are."""
    names = names or [f.name for f in df.schema if f.dataType.typeName() in ("float", "double")]
    return df.withColumns({n: F.bround(F.col(n).cast("double"), decimals) for n in names})


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def drop_sparse(df: DataFrame, share: float = 0.75) -> DataFrame:
    """df without the columns of which more than `share` is null (one aggregation pass; an empty table keeps all)."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in df.columns]).first().asDict()
    n = counts.pop("_n")
    return df.select(*[c for c, k in counts.items() if not n or (n - k) / n <= share])


def drop_empty(df: DataFrame, prefix: str) -> DataFrame:
    """df without the columns of a name family that are null throughout (one aggregation pass; an empty table keeps all)."""
    family = [c for c in df.columns if c.startswith(prefix)]
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in family]).first()
    return df.drop(*[c for c in family if counts["_n"] and not counts[c]])


def drop_identical(df: DataFrame) -> DataFrame:
    """df without columns that equal an earlier one in type and every row: one aggregate of each column's hashes (in row pairs, so order doesn't matter)."""
    first = df.columns[0]
    sums = df.agg(*[F.bit_xor(F.xxhash64(F.col(first), F.col(c), F.lit(7))).alias(c) for c in df.columns], *[F.sum(F.hash(F.col(first), F.col(c)).cast("decimal(38,0)")).alias(f"_{c}") for c in df.columns]).first()
    seen: dict[tuple, str] = {}
    types = dict(df.dtypes)
    for c in df.columns:
        seen.setdefault((types[c], sums[c], sums[f"_{c}"]), c)
    return df.select(*seen.values())
