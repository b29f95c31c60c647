"""Where intermediate tables go: the shared folder of the cluster, never a machine-local one."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session (tests on one machine) gets a folder of its own; on a cluster that is an error, as no folder of one machine can serve."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="barwright-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Where `written` notes the tables it makes, if anywhere.
_noted: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there, so a lost executor costs a reread only."""
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    for paths in _noted:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Within it, the paths of tables that are written are added to paths."""
    _noted.append(paths)
    try:
        yield
    finally:
        _noted.remove(paths)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes the tables at paths, which then is empty."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of rows that a Python worker is handed at once. Spark's own limit of 64 MB is held twice over by the executor, outside its
#: heap, and by the worker, for each task; longer single rows are handed over alone.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session set to batches of about BATCH_BYTES for Python workers, unless the session has a limit set already."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(limit, None) is None:
        df.sparkSession.conf.set(limit, str(BATCH_BYTES))
    return df


#: Rows of a few longs in one file of a small table.
ROWS_A_FILE = 250_000


def files_for(rows: int, rows_a_file: int = ROWS_A_FILE) -> int:
    """Files for a table of so many rows."""
    return max(1, -(-rows // rows_a_file))


#: Up to so many ids (of 8 bytes) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is not among ids (doc_id, each once; a written table). Few ids are broadcast, so no text is shuffled for them."""
    return docs.join(ids.hint("broadcast") if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti")


def join_by_weight(left: DataFrame, right: DataFrame, keys: list[str], weight: str, parts: int = 10_000) -> DataFrame:
    """left joined with right (one row a key; weight: how many rows of left have it), whatever share of left one key has.

    Keys with more than a `parts`-th of all rows (there can be at most `parts` of them) are joined by a broadcast; all other
    keys by a shuffle, from which the rows of the heavy ones are kept out.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    limit = max(1000, total // parts)
    heavy = F.broadcast(right.where(F.col(weight) > limit).drop(weight))
    light = left.join(heavy.select(*keys), keys, "left_anti").join(right.where(F.col(weight) <= limit).drop(weight), keys)
    return left.join(heavy, keys).unionByName(light)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, name where that is one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def distinct_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, with doc_ids of their own, and the column of the ids that were given: docs as they are, or, if an id is null or repeated, rows numbered in the table's order."""
    rows, different = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if rows == different:
        return docs, "doc_id"
    name = fresh(docs, "given_doc_id")
    return written(docs.withColumnRenamed("doc_id", name).withColumn("doc_id", F.monotonically_increasing_id())), name


class Scratch:
    """Intermediate tables that are read more than once within one operator: on the executors' disks (`keep`), with their lineage, so what a lost executor held is computed again from the input, or in the shared folder (`written`). `release` gives both back."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []
        self.paths: list[str] = []
        self.spark: SparkSession | None = None

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables.append(df.persist(StorageLevel.DISK_ONLY))
        return self.tables[-1]

    def written(self, df: DataFrame) -> DataFrame:
        self.spark = df.sparkSession
        df, path = _written(df)
        self.paths.append(path)
        return df

    def table(self, df: DataFrame, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
        """df as a table in the shared folder, computed by as many tasks as it has and then put into few files."""
        held = df.persist(StorageLevel.DISK_ONLY)
        out = self.written(held.coalesce(files_for(held.count(), rows_a_file)))
        held.unpersist()
        return out

    def release(self) -> None:
        while self.tables:
            self.tables.pop().unpersist()
        if self.spark is not None:
            drop_tables(self.spark, self.paths)
