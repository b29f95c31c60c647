"""A streaming data source over a message log: Parquet files whose rows carry a growing sequence number.

A batch is a range of sequence numbers. The driver looks at the files' footers only; each row group that a batch touches is a
partition, read by an executor. A range gives the same rows whenever it is read, so a batch that failed, or whose checkpoint
says that it was begun, is replayed as it was. What Spark has committed is written to `acks`, so whoever keeps the log may cut
off what lies before; the end of the newest batch that was planned is kept there too, from which the limit on a batch's
rows goes on after a restart.

    spark.dataSource.register(LogSource)
    spark.readStream.format("message_log").schema(s).option("sequence", "event_id").option("batchRows", 100_000).load(path)
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as files
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _at(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (files.LocalFileSystem(), path)


def log_groups(path: str, sequence: str) -> list[tuple[str, int, int, int]]:
    """File, row group, least and greatest sequence number of all row groups of a log (a file or a folder), by their footers."""
    system, at = _at(path)
    info = system.get_file_info(at)
    names = [at] if info.type == files.FileType.File else [f.path for f in system.get_file_info(files.FileSelector(at, recursive=True, allow_not_found=True)) if f.path.endswith(".parquet")]
    found = []
    for name in sorted(names):
        with system.open_input_file(name) as f:
            footer = pq.ParquetFile(f).metadata
            column = footer.schema.to_arrow_schema().get_field_index(sequence)
            for g in range(footer.num_row_groups):
                stats = footer.row_group(g).column(column).statistics
                if footer.row_group(g).num_rows:
                    if stats is None or not stats.has_min_max:
                        raise ValueError(f"{name} has no statistics of {sequence}")
                    found.append((name, g, int(stats.min), int(stats.max)))
    return found


class Range(InputPartition):
    def __init__(self, file: str, group: int, first: int, end: int) -> None:
        super().__init__((file, group, first, end))


class LogReader(DataSourceStreamReader):
    """Ranges of sequence numbers [start, end) of the log; see the module."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.path, self.sequence = schema, options["path"], options["sequence"]
        self.most = int(options.get("batchRows", 0)) or None
        self.retries = int(options.get("retries", 2))
        self.acks = options.get("acks")
        self.state = self._state()

    def _state(self) -> dict:
        if self.acks:
            system, at = _at(self.acks)
            if system.get_file_info(at).type == files.FileType.File:
                with system.open_input_stream(at) as f:
                    return json.loads(f.read())
        return {}

    def _note(self, **what: int) -> None:
        self.state |= what
        if self.acks:
            system, at = _at(self.acks)
            system.create_dir(at.rpartition("/")[0], recursive=True)
            with system.open_output_stream(at) as f:
                f.write(json.dumps(self.state).encode())

    def initialOffset(self) -> dict:
        groups = log_groups(self.path, self.sequence)
        return {"next": min((g[2] for g in groups), default=0)}

    def latestOffset(self) -> dict:
        groups = log_groups(self.path, self.sequence)
        end = max((g[3] + 1 for g in groups), default=0)
        planned = self.state.get("planned", min((g[2] for g in groups), default=0))  # of a new stream nothing is planned
        return {"next": end if self.most is None else max(planned, min(end, planned + self.most))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self._note(planned=end["next"])
        return [Range(f, g, max(low, start["next"]), min(high + 1, end["next"])) for f, g, low, high in log_groups(self.path, self.sequence) if low < end["next"] and high >= start["next"]]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        file, group, first, end = partition.value
        schema, sent = to_arrow_schema(self.schema), 0
        for attempt in range(self.retries + 1):
            try:
                system = _at(self.path)[0]
                with system.open_input_file(file) as f:
                    for i, batch in enumerate(pq.ParquetFile(f).iter_batches(8192, row_groups=[group], columns=list(dict.fromkeys([*schema.names, self.sequence])))):
                        if i >= sent:  # the connection broke after these
                            at = batch.column(self.sequence)
                            kept = batch.filter(pc.and_(pc.greater_equal(at, first), pc.less(at, end))).select(schema.names)
                            if kept.num_rows:
                                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(kept.columns, schema.types, strict=True)], schema=schema)
                            sent = i + 1
                return
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(0.1 * 2**attempt)

    def commit(self, end: dict) -> None:
        self._note(committed=end["next"])


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        raise ValueError("message_log needs the schema that it shall give")

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(schema, self.options)
