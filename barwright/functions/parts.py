"""How many parts a table is dealt to."""

from __future__ import annotations

from pyspark.sql import DataFrame


def parts(df: DataFrame, rows: int) -> int:
    """As many as the session sets for shuffles, or more, so that a part has no more than so many rows on average. Counts df."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
