"""Readers: delimited files with junk above the header, XML and HTML, nested JSON, the newest of dated files, a table catalogue."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One scan over any number of files and folders, pruned to columns; filters on it reach the files."""
    df = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "false").parquet(*paths)
    return df.select(*columns) if columns else df


def delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header_cell: str | None = None, skip: int = 0, null_value: str = "") -> DataFrame:
    """A delimited file with an explicit schema.

    skip: lines of each file to leave out (they lie in the first part of a file that is read by one task). header_cell:
    everything up to the line whose first field is this goes, wherever that line is in its file. Each file's lines are
    numbered as they are read; nothing is sorted.
    """
    lines = spark.read.text(path, wholetext=False).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    if header_cell is not None:
        first = F.trim(F.split_part("value", F.lit(sep), F.lit(1)))
        heads = lines.where(first == header_cell).groupBy("_file").agg(F.min("_at").alias("_head"))  # a row a file
        lines = lines.join(F.broadcast(heads), "_file").where("_at > _head")
    elif skip:
        heads = lines.where("_block = 0").groupBy("_file").agg(F.min("_at").alias("_head"))  # a row a file
        lines = lines.join(F.broadcast(heads), "_file").where((F.col("_block") > 0) | (F.col("_at") - F.col("_head") >= skip))
    kept = lines.where(F.trim("value") != "")
    return kept.select(F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": sep, "nullValue": null_value, "mode": "PERMISSIVE"}).alias("r")).select("r.*")


def xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def xml_islands(text: Column, tag: str) -> Column:
    """Array of what stands between <tag> and </tag> in a text (a filing), tags of upper or lower case."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?is)<{tag}>(.*?)</{tag}>"), 1)


def leaf_values(xml_text: Column) -> Column:
    """Map of leaf tags to their first value in a piece of XML."""
    pairs = F.regexp_extract_all(xml_text, F.lit(r"<([A-Za-z0-9_:]+)(?:\s[^>]*)?>([^<]*)</[A-Za-z0-9_:]+>"), 0)
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "^<([A-Za-z0-9_:]+)", 1).alias("k"), F.regexp_extract(p, ">([^<]*)<", 1).alias("v")))
    first = F.filter(entries, lambda e, i: (i == F.array_position(F.transform(entries, lambda x: x["k"]), e["k"]) - 1) & (F.trim(e["v"]) != ""))
    return F.map_from_entries(first)


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_links(html: Column) -> Column:
    """Array of the targets of links."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?i)<a\\s[^>]*href=[\"']([^\"']*)[\"']"), 1)


def html_text(html: Column) -> Column:
    """What is left without scripts, styles and tags, white space run together."""
    bare = F.regexp_replace(html, "(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]*>", " "), "[ \\t\\r\\n]+", " "))


#: Spans larger than that count as that.
MOST_SPAN = 1000
_CELL = "struct<text: string, left: int>"
_OPEN = "struct<at: int, text: string, left: int>"


def _span(cell: Column, name: str) -> Column:
    """A cell's rowspan or colspan; 1 where it has none, or none that is a number above 0."""
    n = F.regexp_extract(cell, rf"(?is)^<t[dh][^>]*?\s{name}\s*=\s*[\"']?\s*(\d{{1,9}})", 1)
    return F.least(F.greatest(F.coalesce(n.try_cast("int"), F.lit(1)), F.lit(1)), F.lit(MOST_SPAN))


def _placed(cells: Column, open_: Column) -> Column:
    """struct(out: array<string>, open): one row's cells put between those that come down from rows above, and what comes down from it."""
    last = F.coalesce(F.array_max(F.transform(open_, lambda o: o["at"])), F.lit(-1))  # it may lie beyond a short row's cells
    width = F.greatest(F.size(cells) + F.size(open_), last + 1)
    places = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("next"), F.array().cast(f"array<{_OPEN}>").alias("open"))

    def put(row: Column, at: Column) -> Column:
        above = F.get(F.filter(open_, lambda o: o["at"] == at), F.lit(0))
        own = F.get(cells, row["next"])
        here = F.when(above.isNotNull(), F.struct(above["text"].alias("text"), above["left"].alias("left"))).otherwise(own)
        out = F.when(here.isNull(), row["out"]).otherwise(F.concat(row["out"], F.array(here["text"])))
        down = F.when(here["left"] > 1, F.concat(row["open"], F.array(F.struct(at.alias("at"), here["text"].alias("text"), (here["left"] - 1).alias("left"))))).otherwise(row["open"])
        return F.struct(out.alias("out"), (row["next"] + F.when(above.isNull(), 1).otherwise(0)).alias("next"), down.alias("open"))

    return F.aggregate(places, start, put, lambda row: F.struct(row["out"].alias("out"), row["open"].alias("open")))


def html_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, table_no, row_no, cells: the rows of all tables of each page, in expressions only.

    A cell that spans columns is repeated in each of them, one that spans rows in each of those (a span that goes on after the
    last row ends there). Tags are taken out of cells, entities stay as they are. A table within a cell ends the outer one, as a
    pattern can't match pairs. Null pages have no rows.
    """
    tables = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit("(?is)<table(?:\\s[^>]*)?>(.*?)</table>"), 1)
    rows = F.regexp_extract_all("_table", F.lit("(?is)<tr(?:\\s[^>]*)?>(.*?)</tr>"), 1)
    found = lambda row: F.regexp_extract_all(row, F.lit("(?is)<t[dh](?:\\s[^>]*)?>.*?</t[dh]>"), 0)
    cell = lambda c: F.array_repeat(F.struct(html_text(c).alias("text"), _span(c, "rowspan").alias("left")), _span(c, "colspan"))
    cells = F.transform(rows, lambda row: F.flatten(F.transform(found(row), cell)).cast(f"array<{_CELL}>"))
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast(f"array<{_OPEN}>").alias("open"))

    def add(acc: Column, row: Column) -> Column:
        now = _placed(row, acc["open"])
        return F.struct(F.concat(acc["done"], F.array(now["out"])).alias("done"), now["open"].alias("open"))

    one = df.select(key, F.posexplode(tables).alias("table_no", "_table")).select(key, "table_no", cells.alias("_rows"))
    return one.select(key, "table_no", F.posexplode(F.aggregate("_rows", start, add, lambda acc: acc["done"])).alias("row_no", "cells"))


def normalized(df: DataFrame, column: str, schema: str, record: str | None = None, meta: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """JSON text flattened: its fields as columns, or, with record, a row for each element of that array field, with meta fields of the parent."""
    others = [c for c in df.columns if c != column]
    parsed = df.select(*others, F.from_json(column, schema).alias("_j"))
    if record is None:
        return parsed.select(*others, "_j.*")
    rows = parsed.select(*others, *[F.col(f"_j.{m}").alias(m) for m in meta], F.explode_outer(f"_j.{record}").alias("_r"))
    fields = [f.name for f in rows.schema["_r"].dataType.fields] if isinstance(rows.schema["_r"].dataType, T.StructType) else None
    return rows.select(*others, *meta, *([F.col(f"_r.{f}").alias(prefix + f) for f in fields] if fields else [F.col("_r").alias(prefix + record)]))


def newest(spark: SparkSession, path: str, pattern: str = r"(\d{4}-?\d{2}-?\d{2})") -> DataFrame:
    """The Parquet files of the newest date in their names under path; only those files are read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.replace(F.regexp_extract(F.element_at(F.split("path", "/"), -1), pattern, 1), F.lit("-"), F.lit("")).alias("day")).where("day <> ''")
    top = names.groupBy("day").agg(F.collect_list("path").alias("paths")).orderBy(F.desc("day")).limit(1).first()  # file names of one day
    if top is None:
        raise FileNotFoundError(f"no dated file under {path}")
    return spark.read.parquet(*top["paths"])


def folders(spark: SparkSession, path: str, name: str) -> list[str]:
    """The values of the partition folders name=... of a table, by their names only."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = (f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if f.isDirectory())
    return sorted(f.partition("=")[2] for f in found if f.startswith(f"{name}="))


def as_of(spark: SparkSession, path: str, day: str, holidays: Sequence[str] = (), most: int = 10, date: str = "date") -> DataFrame:
    """Of a table with a folder for each date, the rows of the last business day up to `day` that has a folder, `most` business days back at most. Only that folder is read."""
    have, at, back = set(folders(spark, path, date)), datetime.date.fromisoformat(day), 0
    while back <= most:
        if at.weekday() < 5 and str(at) not in holidays:
            if str(at) in have:
                return spark.read.option("basePath", path).parquet(f"{path}/{date}={at}")
            back += 1
        at -= datetime.timedelta(1)
    raise FileNotFoundError(f"no folder under {path} for the {most} business days up to {day}")


def file_sizes(spark: SparkSession, path: str, least_bytes: int = 100_000_000) -> DataFrame:
    """path, size of files of that size and more, from their listing: no file is opened, whatever is in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") >= least_bytes).select("path", F.col("length").alias("size"))


class Catalog:
    """Tables by name, each a folder below one root and, if it has one, a cleaning step; what comes back is lazy."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.cleaners: dict[str, object] = {}

    def register(self, name: str, cleaner) -> None:
        self.cleaners[name] = cleaner

    def table(self, name: str, columns: Sequence[str] | None = None, **equals) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        for c, v in equals.items():
            df = df.where(F.col(c) == v)
        df = self.cleaners[name](df) if name in self.cleaners else df
        return df.select(*columns) if columns else df


class Endpoints:
    """Named table functions with parameters and defaults, as a service's endpoints have them. They are SQL functions of the session, so a call is planned like a view: parameters become filters that reach the scan."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.parameters: dict[str, dict[str, tuple[str, object]]] = {}

    @staticmethod
    def _literal(kind: str, value: object) -> str:
        quoted = str(value).replace("\\", "\\\\").replace("'", "\\'")
        return f"CAST('{quoted}' AS {kind})"

    def define(self, name: str, select: str, **parameters: tuple[str, object]) -> None:
        """select: a query that names the parameters; parameters: type and default of each, None where it must be given."""
        self.parameters[name] = parameters
        order = sorted(parameters, key=lambda p: parameters[p][1] is not None)  # those without a default come first
        typed = [f"{p} {kind}" + ("" if default is None else f" DEFAULT {self._literal(kind, default)}") for p, (kind, default) in ((p, parameters[p]) for p in order)]
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(typed)}) RETURNS TABLE RETURN {select}")

    def call(self, name: str, **given: object) -> DataFrame:
        """The rows of an endpoint; unknown and missing parameters are errors."""
        known = self.parameters[name]
        unknown, missing = set(given) - set(known), {p for p, (_, default) in known.items() if default is None} - set(given)
        if unknown or missing:
            raise ValueError(f"{name}: unknown {sorted(unknown)}, missing {sorted(missing)}")
        return self.spark.sql(f"SELECT * FROM {name}({', '.join(f'{p} => {self._literal(known[p][0], v)}' for p, v in given.items())})")
