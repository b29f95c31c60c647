"""A session with the settings that the queries rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "barwright", **conf: str) -> SparkSession:
    """UTC times; adaptive execution splits skewed joins and merges small partitions. conf: further settings, '.' written '__'."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
