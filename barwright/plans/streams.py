"""Queries of streams: events as a file stream, run until nothing is left, result read back as a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.plans.registry import query, table
from barwright.sources.sinks import keyed_table
from barwright.streaming import feeds as S
from barwright.streaming.log_source import LogSource


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="barwright-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/streams/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, with its partitioning and order; Spark's cleaner may delete it when it is no longer referred to."""
    folder(df.sparkSession)  # sets the folder where none is set
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan doesn't tell its partitioning, and all that follows would deal the rows out again
    try:
        return df.select("*").checkpoint()
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All of a stream's output, by way of a table in the shared folder."""
    spark = stream.sparkSession
    at = folder(spark)
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


#: A window or session is given out when the watermark, an hour behind the newest event, has passed its end.
_PASSED = "<= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR"
_OHLC = "arg_min(value, row(ts, value)) AS o, max(value) AS h, min(value) AS l, arg_max(value, row(ts, value)) AS c, count(*) AS n"


@query("stream_window_watermark", f"SELECT event_type, date_trunc('hour', ts) AS bucket, {_OHLC} FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR {_PASSED}")
def stream_window_watermark(spark: SparkSession, d: str) -> DataFrame:
    return _run(S.windowed(_events(spark, d), ["event_type"], "1 hour", "1 hour", "value")).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(
    "stream_window_sliding",
    f"WITH w AS (SELECT *, date_trunc('hour', ts) AS bucket FROM events UNION ALL SELECT *, date_trunc('hour', ts) - INTERVAL 1 HOUR FROM events) SELECT event_type, bucket, {_OHLC} FROM w GROUP BY 1, 2 HAVING bucket + INTERVAL 2 HOUR {_PASSED}",
)
def stream_window_sliding(spark: SparkSession, d: str) -> DataFrame:
    return _run(S.windowed(_events(spark, d), ["event_type"], "2 hours", "1 hour", "value", "1 hour")).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(
    "stream_session",
    f"""WITH g AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS step FROM events))
SELECT user_id, min(ts) AS "begin", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE {_PASSED}""",
)
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return _run(S.sessions(_events(spark, d), ["user_id"], "30 minutes", "1 hour")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("begin", "end")})


@query("stream_dedup", "SELECT event_id, user_id, value FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    twice = _events(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _run(S.once(twice, ["event_id"], "40 days").select("event_id", "user_id", "value"))


_FFILL = "last_value(v IGNORE NULLS) OVER (PARTITION BY {0} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v"


def _filled(spark: SparkSession, d: str, key: Column, whole: bool = False) -> DataFrame:
    """whole: the log has an end, which a beat behind its newest row tells the stream, so that rows of its last hours don't wait for ever."""
    holes = _events(spark, d).select(key.alias("k"), "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"), F.lit(False).alias("beat"))
    if whole:
        at = folder(spark)
        newest = table(spark, d, "events").agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 2 HOURS")).alias("ts"))  # a stretch and the time rows may be late
        newest.where("ts IS NOT NULL").write.parquet(at)
        null = lambda kind: F.lit(None).cast(kind)
        # all that is there is one batch, so the watermark moves behind the last row only
        holes = holes.unionByName(spark.readStream.schema("ts timestamp").parquet(at).select(null("long").alias("k"), "ts", null("double").alias("v"), F.lit(True).alias("beat")))
    before = spark.conf.get(S.ROCKS[0])
    spark.conf.set(*S.ROCKS)
    try:
        return _run(S.last_known(holes, "k", "v", "1 hour", beat="beat")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    finally:
        spark.conf.set(S.ROCKS[0], before)


@query(
    "stream_ffill_state",
    f"SELECT user_id, ts, {_FFILL.format('user_id')} FROM (SELECT user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)",
)
def stream_ffill_state(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d, F.col("user_id"), whole=True).withColumnRenamed("k", "user_id")


@query(
    "stream_ffill_hot_key",
    f"SELECT * FROM (SELECT k, ts, {_FFILL.format('k')} FROM (SELECT CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS k, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)) WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR {_PASSED}",
)
def stream_ffill_hot_key(spark: SparkSession, d: str) -> DataFrame:
    """A third of all rows have one key."""
    return _filled(spark, d, F.when(F.col("user_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("user_id")))


# a source with offsets, replay and commit; sinks that take a batch once; supervision


def _log(spark: SparkSession, d: str, at: str, batches: int) -> DataFrame:
    """events as a message log, in about so many batches."""
    events = table(spark, d, "events")
    spark.dataSource.register(LogSource)
    most = -(-events.count() // batches)
    return spark.readStream.format("message_log").schema(events.schema).option("sequence", "event_id").option("batchRows", most).option("acks", f"{at}/acks").load(f"{d}/events.parquet")


def _failing(sink: Callable[[DataFrame, int], None], number: int) -> Callable[[DataFrame, int], None]:
    """The sink, which takes batch number, but reports failure of it once, as a lost connection would."""
    left = [number]

    def write(rows: DataFrame, n: int) -> None:
        sink(rows, n)
        if n in left:
            left.remove(n)
            raise ConnectionError(f"lost after batch {n}")

    return write


@query("stream_source_replayed", "SELECT event_id, user_id, event_type, value FROM events")
def stream_source_replayed(spark: SparkSession, d: str) -> DataFrame:
    """In five batches; the third is written, then lost, and comes again after a restart."""
    at = folder(spark)
    sink = _failing(S.batch_sink(f"{at}/out"), 2)
    start = lambda: _log(spark, d, at, 5).select("event_id", "user_id", "event_type", "value").writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/state").start()
    S.supervised(start, 1, drain=True)
    return spark.read.schema("event_id long, user_id long, event_type string, value double").parquet(f"{at}/out").drop("batch")


@query("stream_demultiplexed", "SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS service, event_id, value FROM events")
def stream_demultiplexed(spark: SparkSession, d: str) -> DataFrame:
    """Three services; the second one's sink fails once, after the first has taken its rows."""
    at = folder(spark)
    sinks = {"view": S.batch_sink(f"{at}/view"), "click": _failing(S.batch_sink(f"{at}/click"), 1)}
    start = lambda: S.demultiplexed(_log(spark, d, at, 3).select("event_type", "event_id", "value"), "event_type", sinks, S.batch_sink(f"{at}/other"), f"{at}/state").start()
    S.supervised(start, 1, drain=True)
    read = lambda name: spark.read.schema("event_type string, event_id long, value double").parquet(f"{at}/{name}").select(F.lit(name).alias("service"), "event_id", "value")
    return read("view").unionByName(read("click")).unionByName(read("other"))


@query("stream_supervised", "SELECT count(*) AS read_rows, 4 AS batches, 1 AS errors FROM events")
def stream_supervised(spark: SparkSession, d: str) -> DataFrame:
    """What supervision has noted of a stream of four batches that failed once."""
    at, log = folder(spark), []
    sink = _failing(S.batch_sink(f"{at}/out"), 1)
    S.supervised(lambda: _log(spark, d, at, 4).writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/state").start(), 1, drain=True, log=log)
    ended = spark.createDataFrame([(x["run"], x.get("batch"), x.get("rows"), x.get("error")) for x in log], "run int, batch long, read_rows long, error string")
    newest = ended.where("read_rows > 0").groupBy("batch").agg(F.max_by("read_rows", "run").alias("read_rows"))
    return newest.agg(F.sum("read_rows").alias("read_rows"), F.count("*").cast("int").alias("batches")).crossJoin(ended.agg(F.count("error").cast("int").alias("errors")))  # one row each


@query("stream_upsert", "SELECT user_id, max(ts) AS ts FROM events GROUP BY 1")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    stream = _events(spark, d).select("user_id", "ts")
    S.upsert_sink(stream, f"{at}/table", ["user_id"], [F.desc("ts")], f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return keyed_table(spark, f"{at}/table").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_unsent", "SELECT event_id FROM events WHERE event_type <> 'view'")
def stream_unsent(spark: SparkSession, d: str) -> DataFrame:
    sent = table(spark, d, "events").where("event_type = 'view'").select("event_id")
    return _run(S.unsent(_events(spark, d).select("event_id"), sent, "event_id"))
