"""The narrowest integer types that hold a column's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spark's signed integer types by width, narrowest first.
RANGES = (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31))


def narrowest(low: int | None, high: int | None) -> str:
    if low is None or high is None:
        return "tinyint"
    return next((name for name, limit in RANGES if -limit <= low and high < limit), "bigint")


def shrink(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Integer columns cast by their least and greatest values (one aggregation pass); floats that are whole numbers too."""
    stats = df.agg(*[f(c).alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))], *[F.coalesce(F.bool_and(F.col(c) == F.floor(c)), F.lit(True)).alias(f"whole_{c}") for c in names]).first()
    return df.withColumns({c: F.col(c).cast(narrowest(stats[f"lo_{c}"], stats[f"hi_{c}"])) for c in names if stats[f"whole_{c}"]})
