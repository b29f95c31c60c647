"""Sinks: keyed upsert into a table, partitioned writes, messages for an outbox."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators.quality import upsert


#: The folder column that tells a keyed table's buckets apart.
BUCKET = "bucket__"


def _listed(spark: SparkSession, path: str) -> list[str]:
    """The names of the lists of a keyed table, oldest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_lists")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if not f.getPath().getName().endswith(".new")) if fs.exists(p) else []


def _folders(spark: SparkSession, path: str, name: str | None) -> dict[int, str]:
    """The folder of each bucket by one list."""
    return {int(b): folder for b, folder in (r[0].split("\t") for r in spark.read.text(f"{path}/_lists/{name}").collect())} if name else {}


def _publish(spark: SparkSession, path: str, number: int, folders: dict[int, str]) -> None:
    """A new list under the next number. It appears at once and whole; if another writer was faster, this fails."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    new, name = p(f"{path}/_lists/{number:012d}.new"), p(f"{path}/_lists/{number:012d}")
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(new, True)
    out.write(bytearray("".join(f"{b}\t{folder}\n" for b, folder in sorted(folders.items())).encode()))
    out.close()
    if fs.exists(name) or not fs.rename(new, name):
        raise OSError(f"{path} was changed by another writer")


def keyed_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that `upsert_table` keeps at path, as of its newest list."""
    folders = _folders(spark, path, _listed(spark, path)[-1])
    return spark.read.option("mergeSchema", "true").parquet(*[f"{path}/{folder}/{BUCKET}={b}" for b, folder in sorted(folders.items())])


def upsert_table(new: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column], buckets: int = 16) -> DataFrame:
    """Adds rows to the table at path, one row for each key: old rows win. The result, read again.

    Rows are dealt into buckets by a hash of the keys. Only buckets that have new rows are read and written, to a folder of
    their own; a small list names the folder of each bucket, and the table changes when the next list appears. So there is a
    whole table at any moment, and a write that fails leaves it as it was. What the last two lists don't name is deleted.
    """
    spark, path = new.sparkSession, path.rstrip("/")
    lists = _listed(spark, path)
    before = _folders(spark, path, lists[-1] if lists else None)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    touched = [r[0] for r in new.select(bucket.alias(BUCKET)).distinct().collect()]  # as many as there are buckets at most
    parts = [f"{path}/{before[b]}/{BUCKET}={b}" for b in touched if b in before]
    old = spark.read.option("mergeSchema", "true").parquet(*parts) if parts else new.limit(0)
    folder = f"data-{uuid.uuid4().hex}"
    upsert(old, new, keys, order).withColumn(BUCKET, bucket).repartition(BUCKET, *keys).write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    _publish(spark, path, int(lists[-1]) + 1 if lists else 0, before | dict.fromkeys(touched, folder))
    kept = set(before.values()) | {folder}
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(p(path)):
        if f.getPath().getName().startswith("data-") and f.getPath().getName() not in kept:
            fs.delete(f.getPath(), True)
    return keyed_table(spark, path)


def write_by_date(df: DataFrame, path: str, date: str = "date") -> None:
    """A folder for each date; rows of a date are brought together first, so a date has few files."""
    df.repartition(date).sortWithinPartitions(date).write.partitionBy(date).mode("overwrite").parquet(path)


def write_by_key(df: DataFrame, path: str, key: str, date: str = "date") -> None:
    """Folders by year, rows sorted by key within files, so a filter on the key reads few row groups."""
    df.withColumn("year", F.year(date)).repartitionByRange("year", key).sortWithinPartitions("year", key, date).write.partitionBy("year").mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def json_to_parquet(spark: SparkSession, source: str, path: str, schema: str) -> DataFrame:
    """JSON lines (plain or compressed) as Parquet; lines that don't fit the schema become nulls."""
    spark.read.schema(schema).json(source).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def outbox(df: DataFrame, template: str, columns: Sequence[str], key: str) -> DataFrame:
    """key, message: a message for each row, for whatever sends them."""
    return df.select(key, F.format_string(template, *columns).alias("message"))


def log_calls(calls: DataFrame, path: str, ts: str = "ts") -> DataFrame:
    """Appends calls (a time and whatever else is known of each) to the event table at path, a folder for each day. The table, read again."""
    calls.withColumn("day", F.to_date(ts)).write.partitionBy("day").mode("append").parquet(path)
    return calls.sparkSession.read.parquet(path)


def call_budget(log: DataFrame, window: str, budget: int, ts: str = "ts", service: str = "service") -> DataFrame:
    """service, begin, n, left: calls of each service by window, and what is left of the budget (0 at least)."""
    g = log.groupBy(service, F.window(ts, window).alias("_w")).agg(F.count("*").alias("n"))
    return g.select(service, F.col("_w.start").alias("begin"), "n", F.greatest(F.lit(budget) - F.col("n"), F.lit(0)).alias("left"))
