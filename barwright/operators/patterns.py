"""Shapes over several bars: runs, flags, moves without volume and the other way round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.operators.studies import W, rows


def rising_runs(df: DataFrame, least: int) -> DataFrame:
    """symbol, first_date, last_date, n: runs of `least` or more rows each of which closes above the row before."""
    up = F.coalesce((F.col("fClose") > F.lag("fClose").over(W())).cast("int"), F.lit(0))
    marked = df.withColumn("_up", up).withColumn("_island", F.sum(1 - F.col("_up")).over(rows(Window.unboundedPreceding, 0)))
    return marked.where("_up = 1").groupBy("symbol", "_island").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_island")


def merge_near(runs: DataFrame, days: int) -> DataFrame:
    """Runs of one symbol at most `days` weekdays apart become one: symbol, first_date, last_date, n (rows), runs."""
    from barwright.functions.dates import weekdays_between

    w = Window.partitionBy("symbol").orderBy("first_date")
    new = F.coalesce(weekdays_between(F.lag("last_date").over(w), F.col("first_date")) > days, F.lit(True)).cast("int")
    grouped = runs.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("symbol", "_g").agg(F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.sum("n").alias("n"), F.count("*").alias("runs")).drop("_g")


def bull_flags(df: DataFrame) -> DataFrame:
    """Rows whose fCP5 (the sum of five changes) is 10 to 25 %, after five rows that were flat within 5 % and before five within 2.5 %. Needs fCP5."""
    before, after = F.lag("fCP5", 5).over(W()), F.lead("fCP5", 5).over(W())
    marked = df.withColumns({"_b": before, "_a": after})
    return marked.where(F.col("fCP5").between(0.1, 0.25) & F.col("_b").between(-0.05, 0.05) & F.col("_a").between(-0.025, 0.025)).drop("_a", "_b")


def gap_recovery(df: DataFrame, drop: float = -0.05) -> DataFrame:
    """symbol, date, recovered: for each gap down (gap <= drop) the first later date whose high reaches the close before the gap, or null.

    The rows of a symbol that could recover a gap are found by one equi-join on the symbol with a range condition, of gaps only.
    """
    marked = df.withColumn("_pc", F.lag("fClose").over(W()))
    gaps = marked.where((F.col("gap") <= drop) & F.col("_pc").isNotNull()).select("symbol", "date", F.col("_pc").alias("level"))
    later = df.select(F.col("symbol").alias("s"), F.col("date").alias("d"), "fHigh")
    hit = gaps.join(later, (F.col("symbol") == F.col("s")) & (F.col("d") > F.col("date")) & (F.col("fHigh") >= F.col("level")), "left")
    return hit.groupBy("symbol", "date").agg(F.min("d").alias("recovered"))


def volume_without_move(df: DataFrame, shares: str = "shares", least_rows: int = 150) -> DataFrame:
    """Rows whose volume is over 30 % of the shares while the close moved less than 5 %, of symbols with at least `least_rows` rows. Needs fChangeP."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    return df.withColumn("_n", n).where((F.col("_n") >= least_rows) & (F.try_divide(F.col("fVolume"), F.col(shares)) > 0.3) & (F.col("fChangeP") > -0.05) & (F.col("fChangeP") < 0.05)).drop("_n")
