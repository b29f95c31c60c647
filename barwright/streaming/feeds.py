"""Structured Streaming: windows with watermarks, deduplication, last known values by key, keyed upserts, demultiplexing, sent-once messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barwright.sources.sinks import upsert_table


def windowed(stream: DataFrame, keys: Sequence[str], width: str, late: str, price: str, slide: str | None = None) -> DataFrame:
    """keys, bucket, o, h, l, c, n by event time (ts): tumbling or sliding windows; rows later than `late` are dropped."""
    place = F.struct("ts", price)
    grouped = stream.withWatermark("ts", late).groupBy(*keys, F.window("ts", width, slide).alias("_w"))
    out = grouped.agg(F.min_by(price, place).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, place).alias("c"), F.count("*").alias("n"))
    return out.select(*keys, F.col("_w.start").alias("bucket"), "o", "h", "l", "c", "n")


def sessions(stream: DataFrame, keys: Sequence[str], pause: str, late: str) -> DataFrame:
    """keys, begin, end, n: sessions that end after a pause."""
    grouped = stream.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", pause).alias("_w")).agg(F.count("*").alias("n"))
    return grouped.select(*keys, F.col("_w.start").alias("begin"), F.col("_w.end").alias("end"), "n")


def once(stream: DataFrame, keys: Sequence[str], late: str) -> DataFrame:
    """The first row of each key within the watermark; state older than `late` is let go."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


#: State of transformWithState needs this store.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Slots that the keys are dealt to, and rows of a slot that are taken apart or given out at once.
SLOTS, AT_ONCE = 64, 250_000


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


class LastKnown(StatefulProcessor):
    """State of one slot of keys: rows that wait, as packed pieces by stretch of time; each key's newest value given out, with its time; one timer.

    A stretch is given out when the watermark has passed its end, with its rows in order. The timer is that of the first stretch
    that waits; it fires once for all stretches that are due. Where none waits it is the time at which the first value goes that
    had no successor for so long.
    """

    def __init__(self, stretch: int, idle: int) -> None:
        self.stretch, self.idle = stretch, -(-idle // stretch)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "rows binary")
        self.pieces = handle.getMapState("pieces", "stretch long, piece long", "rows binary")
        self.waiting = handle.getValueState("waiting", "stretches binary, timer long")

    def _waiting(self) -> tuple[dict[int, tuple[int, int]], int | None]:
        """Pieces and rows of each stretch, and the timer."""
        if not self.waiting.exists():
            return {}, None
        data, timer = self.waiting.get()
        return {s: (n, rows) for s, n, rows in np.frombuffer(data, "<i8").reshape(-1, 3).tolist()}, timer

    def _wait(self, stretches: dict[int, tuple[int, int]], timer: int | None, idle: int | None) -> None:
        wanted = (min(stretches) + 1) * self.stretch if stretches else idle
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if wanted is None:
            self.waiting.clear()
        else:
            self.waiting.update((np.array([(s, n, rows) for s, (n, rows) in stretches.items()], "<i8").tobytes(), wanted))

    def _table(self, part: pd.DataFrame) -> pa.Table:
        at = part["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        return pa.table({"k": pa.array(part["k"], pa.string(), from_pandas=True), "at": at, "v": part["v"].to_numpy(float), "known": part["known"].to_numpy(bool)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stretches, timer = self._waiting()
        held: list[pa.Table] = []

        def put() -> None:
            table = pa.concat_tables(held)
            held.clear()
            stretch = table["at"].to_numpy() // (1000 * self.stretch)
            order = np.argsort(stretch, kind="stable")
            table, stretch = table.take(pa.array(order)), stretch[order]
            found, begin = np.unique(stretch, return_index=True)
            for s, low, high in zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(stretch)], strict=True):
                n, count = stretches.get(s, (0, 0))
                self.pieces.updateValue((s, n), (_packed(table[low:high]),))
                stretches[s] = (n + 1, count + high - low)

        for part in rows:
            part = part[~part["beat"].to_numpy(bool)]
            if len(part):
                held.append(self._table(part))
            if sum(t.num_rows for t in held) >= AT_ONCE:
                put()
        if held:
            put()
        if stretches:
            self._wait(stretches, timer, None)
        yield self._frame(None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        stretches, timer = self._waiting()
        timer = None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer
        due = sorted(s for s in stretches if (s + 1) * self.stretch <= now)
        last = _unpacked(self.last.get()[0]) if self.last.exists() else None
        while due:
            taken, count = [], 0
            while due and (not taken or count + stretches[due[0]][1] <= AT_ONCE):
                count += stretches[due[0]][1]
                taken.append(due.pop(0))
            parts = []
            for s in taken:
                for i in range(stretches.pop(s)[0]):
                    parts.append(_unpacked(self.pieces.getValue((s, i))[0]))
                    self.pieces.removeKey((s, i))
            rows, last = self._filled(last, pa.concat_tables(parts))
            yield self._frame(rows)
        idle = None
        if last is not None:
            gone = (last["at"].to_numpy() // (1000 * self.stretch) + 1 + self.idle) * self.stretch + 1
            last, gone = last.filter(pa.array(gone > now)), gone[gone > now]
            idle = int(gone.min()) if len(gone) else None
        if idle is None:
            self.last.clear()
        else:
            self.last.update((_packed(last),))
        self._wait(stretches, timer, idle)

    def _filled(self, last: pa.Table | None, rows: pa.Table) -> tuple[pa.Table, pa.Table | None]:
        """The rows by key and time, filled, and each key's newest value."""
        before = 0 if last is None else last.num_rows
        table = (rows if last is None else pa.concat_tables([last, rows])).combine_chunks()
        code = table["k"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        at = table["at"].to_numpy()
        order = np.lexsort((np.arange(len(at)), at, np.arange(len(at)) >= before, code))
        code, at, v, known = code[order], at[order], table["v"].to_numpy()[order], table["known"].to_numpy()[order]
        stretch = at // (1000 * self.stretch)
        place = np.arange(len(at))
        first = np.maximum.accumulate(np.where(np.diff(code, prepend=-1) != 0, place, 0))
        source = np.maximum.accumulate(np.where(known, place, -1))
        there = source >= first
        fresh = there & ((stretch == stretch[source]) | (stretch < stretch[source] + 1 + self.idle))  # an idle value has gone
        ends = np.flatnonzero(np.diff(code, append=-1) != 0)
        ends = ends[there[ends]]
        keys = table["k"].take(pa.array(order))
        newest = None
        if len(ends):
            from_ = pa.array(source[ends])
            newest = pa.table({"k": keys.take(from_), "at": at[source[ends]], "v": v[source[ends]], "known": np.ones(len(ends), bool)})
        own = np.flatnonzero(order >= before)
        out = pa.table({"k": keys.take(pa.array(own)), "at": at[own], "v": v[source[own]], "known": fresh[own]})
        return out, newest

    def _frame(self, rows: pa.Table | None) -> pd.DataFrame:
        if rows is None:
            return pd.DataFrame({"k": pd.Series([], dtype="object"), "ts": np.zeros(0, "datetime64[us]"), "v": pd.Series([], dtype="Float64")})
        known = rows["known"].to_numpy()
        v = pd.Series(np.where(known, rows["v"].to_numpy(), 0.0)).astype("Float64").mask(~known)
        return pd.DataFrame({"k": rows["k"].to_pandas(), "ts": rows["at"].to_numpy().astype("datetime64[us]"), "v": v})


def last_known(stream: DataFrame, key: str, value: str, late: str, stretch: str = "1 hour", idle: str = "3650 days", beat: str | None = None, slots: int = SLOTS) -> DataFrame:
    """Rows (key, ts, value as a double) with nulls replaced by the key's last value before them by time (of equal times the one that came first).

    Rows wait until the watermark (`late` behind the newest row) has passed their stretch of time, so rows that come late and
    out of order, in one batch or in several, get what a sorted table would give; rows behind the watermark are dropped. Keys
    are dealt to slots, whose rows are held in pieces by stretch and given out AT_ONCE rows at a time (a stretch at least), so
    there is one timer a slot, whatever the number of keys and stretches, and memory does not grow with a key's rows in a batch
    nor with its history. A value without a successor for `idle` is let go. beat: a boolean column; rows where it is true only
    move the time on, as a source without news or at its end would do. The session's state store must be RocksDB (`ROCKS`).
    """
    rows = stream.withWatermark("ts", late)
    v = F.col(value).cast("double")
    slot = F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")
    kind = rows.schema[key].dataType.simpleString()
    # keys travel as text: pandas would make floats of whole numbers beside nulls
    rows = rows.select(slot.alias("slot"), F.col(key).cast("string").alias("k"), "ts", F.coalesce(v, F.lit(0.0)).alias("v"), v.isNotNull().alias("known"), (F.coalesce(F.col(beat), F.lit(False)) if beat else F.lit(False)).alias("beat"))
    ms = lambda t: int(pd.Timedelta(t).total_seconds() * 1000)
    out = rows.groupBy("slot").transformWithStateInPandas(LastKnown(ms(stretch), ms(idle)), "k string, ts timestamp, v double", "append", "EventTime")
    return out.select(F.col("k").cast(kind).alias(key), "ts", F.col("v").alias(value))


def upsert_sink(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column], checkpoint: str):
    """Writes each batch into the keyed table at path (see `sinks.upsert_table`: only buckets that it touches), old rows first: a batch that comes twice changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert_table(batch, path, keys, order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch in a folder of its own, by number: a batch that comes twice replaces itself."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def demultiplexed(stream: DataFrame, field: str, sinks: dict[str, Callable[[DataFrame, int], None]], default: Callable[[DataFrame, int], None], checkpoint: str):
    """Sends each batch's rows to the sink of their service, unknown ones to the default; the batch is read once for all of them.

    A sink is called with the rows and the batch's number. If one fails the whole batch comes again under the same number, to
    those too that had it: sinks must take a number once (`batch_sink`, `upsert_table`).
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist(StorageLevel.DISK_ONLY)
        try:
            for name, sink in sinks.items():
                sink(batch.where(F.col(field) == name), number)
            default(batch.where(~F.coalesce(F.col(field).isin(list(sinks)), F.lit(False))), number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def exploded_messages(stream: DataFrame, column: str, schema: str) -> DataFrame:
    """service, timestamp and the fields of each entry of nested messages {data: [{service, timestamp, content: [...]}]}."""
    parsed = stream.select(F.explode(F.from_json(column, f"data array<struct<service: string, timestamp: bigint, content: array<struct<{schema}>>>>")["data"]).alias("m"))
    return parsed.select("m.service", F.timestamp_millis("m.timestamp").alias("ts"), F.inline("m.content"))


def unsent(stream: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those sent (a static table, read again for each batch)."""
    return stream.join(sent.select(F.col(key).alias("_k"), F.lit(True).alias("_sent")), F.col(key) == F.col("_k"), "left").where("_sent IS NULL").drop("_k", "_sent")


class Listener(StreamingQueryListener):
    """Supervision of streams: what each batch did, as a table; streams that ended with an error are restarted by `supervised`."""

    FIELDS = "query string, batch long, ts string, rows long, rows_a_second double, state_rows long"

    def __init__(self) -> None:
        self.batches: list[tuple] = []
        self.ended: list[tuple[str, str | None]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rate = p.processedRowsPerSecond
        self.batches.append((p.name or str(p.id), p.batchId, p.timestamp, p.numInputRows, None if rate is None or rate != rate else float(rate), sum(s.numRowsTotal for s in p.stateOperators)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append((str(event.id), event.exception))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.batches, self.FIELDS)


def supervised(start: Callable[[], StreamingQuery], restarts: int, drain: bool = False, log: list[dict] | None = None) -> StreamingQuery:
    """Runs the stream that start() gives until it ends, and starts it again after an error, `restarts` times at most; its checkpoint makes it go on where it was.

    drain: for streams without an end; they are stopped when all that is there has been read. log: gets a record of each batch
    that ended (run, batch, rows) and of each error (run, error).
    """
    for run in range(restarts + 1):
        query = start()
        try:
            if drain:
                query.processAllAvailable()
                query.stop()
            else:
                query.awaitTermination()
            return query
        except StreamingQueryException as e:
            if log is not None:
                log.append({"run": run, "error": str(e).splitlines()[0]})
            if run == restarts:
                raise
        finally:
            if log is not None:
                log += [{"run": run, "batch": p["batchId"], "rows": p["numInputRows"]} for p in query.recentProgress]
    raise AssertionError
