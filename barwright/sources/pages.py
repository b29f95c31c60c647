"""A batch data source over paged services: pages by number, or chains in which each page names the next one by a token.

A service is an object that executors get a copy of:

    keys()             -> the chains there are (pages by number: one chain a page)
    page(key, token)   -> rows of the page as a pyarrow table, and the token of the next page (None: no more); token None: the first

Each chain is a partition (many chains: runs of them are; a service may have runs(keys) that says which go together), so chains are
read in parallel. A filter on the key column reaches the source: only the chains it names are read (Spark needs spark.sql.python.filterPushdown.enabled). With a spool, a folder that all executors share, each page
is kept there with the token that follows it; a task that is started again, after a lost executor or an error, reads what the
spool has and asks the service from that token on.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Partitions at most, and rows of pages that are handed to Spark together.
MOST_PARTS, ROWS_AT_ONCE = 256, 10_000
_NEXT = b"next_token"


def _at(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (files.LocalFileSystem(), path)


class Spool:
    """The pages of a chain that have been read, numbered from 0; each appears whole or not at all."""

    def __init__(self, path: str, key: object) -> None:
        self.system, at = _at(path)
        self.folder = f"{at}/{hashlib.sha256(repr(key).encode()).hexdigest()[:24]}"

    def pages(self) -> Iterator[tuple[pa.Table, str | None]]:
        n = 0
        while self.system.get_file_info(f"{self.folder}/{n:08d}.parquet").type == files.FileType.File:
            with self.system.open_input_file(f"{self.folder}/{n:08d}.parquet") as f:
                page = pq.read_table(f)
            token = (page.schema.metadata or {}).get(_NEXT)
            yield page, None if token is None else token.decode()
            n += 1

    def add(self, n: int, page: pa.Table, token: str | None) -> None:
        self.system.create_dir(self.folder, recursive=True)
        meta = {} if token is None else {_NEXT: token.encode()}
        new = f"{self.folder}/{uuid.uuid4().hex}.new"
        with self.system.open_output_stream(new) as f:
            pq.write_table(page.replace_schema_metadata(meta), f)
        self.system.move(new, f"{self.folder}/{n:08d}.parquet")


def chain(service, key: object, spool: Spool | None = None, retries: int = 2, most_pages: int | None = None) -> Iterator[pa.Table]:
    """The pages of one chain; what fails with an OSError is asked for again, `retries` times. A page that names itself as the next one is an error, and so is a chain that doesn't end within most_pages, if given."""
    n, token = 0, None
    for page, token in spool.pages() if spool else ():
        yield page
        n += 1
        if token is None:
            return
    while most_pages is None or n < most_pages:
        before = token
        for attempt in range(retries + 1):
            try:
                page, token = service.page(key, before)
                break
            except OSError:
                if attempt == retries:
                    raise
                time.sleep(0.05 * 2**attempt)
        if spool:
            spool.add(n, page, token)
        yield page
        n += 1
        if token is None:
            return
        if token == before:
            raise RuntimeError(f"{key}: the page at {token} names itself as the next one")
    raise RuntimeError(f"{key}: more than {most_pages} pages")


class _Reader(DataSourceReader):
    def __init__(self, service, key: str, schema: StructType, spool: str | None, retries: int, most_pages: int | None) -> None:
        self.service, self.key, self.schema, self.spool, self.retries, self.most_pages = service, key, schema, spool, retries, most_pages
        self.wanted: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (self.key,):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        keys = [k for k in self.service.keys() if self.wanted is None or k in self.wanted]
        if hasattr(self.service, "runs"):
            return [InputPartition(run) for run in self.service.runs(keys)]
        size = -(-len(keys) // MOST_PARTS) or 1
        return [InputPartition(keys[i : i + size]) for i in range(0, len(keys), size)]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        schema, held = to_arrow_schema(self.schema), []
        for key in partition.value if partition else ():  # no partitions at all: Spark asks once, for None
            for page in chain(self.service, key, Spool(self.spool, key) if self.spool else None, self.retries, self.most_pages):
                held.append(page.select(schema.names).cast(schema))
                if sum(p.num_rows for p in held) >= ROWS_AT_ONCE:
                    yield from pa.concat_tables(held).combine_chunks().to_batches()
                    held = []
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()


def paged(spark: SparkSession, service, key: str, schema: StructType | str, spool: str | None = None, retries: int = 2, most_pages: int | None = None) -> DataFrame:
    """All rows of a service's chains; key: the column that holds a row's chain. Registers a source of its own and turns filter push-down on for the session."""
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    source = f"pages_{uuid.uuid4().hex}"

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self) -> StructType:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(service, key, schema, spool, retries, most_pages)

    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Source)
    return spark.read.format(source).load()


class _Ordered:
    """A Parquet table whose row groups' statistics say where values of `order` lie."""

    #: Rows that are looked up at once at least, and at most.
    LEAST, MOST = 50_000, 2_000_000

    def __init__(self, path: str, order: str, columns: Sequence[str], page_rows: int) -> None:
        self.path, self.order, self.columns, self.page_rows = path, order, list(columns), page_rows

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}  # what was looked up stays here

    def _data(self) -> ds.Dataset:
        if "_table" not in self.__dict__:
            system, at = _at(self.path)
            self._table = ds.dataset(at, filesystem=system, format="parquet")
        return self._table

    def _groups(self) -> list[tuple[float, float, ds.Fragment]]:
        """Least and greatest value of order in each row group, and the group; by the least."""
        if "_found" not in self.__dict__:
            self._found = []
            for piece in (p for fragment in self._data().get_fragments() for p in fragment.split_by_row_group()):
                span = (piece.row_groups[0].statistics or {}).get(self.order) or {"min": -math.inf, "max": math.inf}
                self._found.append((span["min"], span["max"], piece))
            self._found.sort(key=lambda g: g[:2])
        return self._found

    def _read(self, piece: ds.Fragment, test: pc.Expression) -> pa.Table:
        return piece.to_table(schema=self._data().schema, columns=list(dict.fromkeys([*self.columns, self.order])), filter=test)


def in_order(df: DataFrame, key: str, order: str, path: str) -> str:
    """Keeps df at path, a new folder that all executors share, with each key's rows in order in files of LEAST rows at most; so a chain's look-ups read its own rows only. The path."""
    df.repartitionByRange(key, order).sortWithinPartitions(key, order).write.option("maxRecordsPerFile", _Ordered.LEAST).parquet(path)
    return path


class TableService(_Ordered):
    """A service over a Parquet table, as a vendor's history service would give it: a chain for each value of key, pages of rows in the order of `order` (a whole number, each once), whose tokens are the last row's.

    The rows that follow a token are looked up for many pages at once, in the row groups that can hold them, and kept for the
    next calls, LEAST at least and MOST at most; so a chain reads a table that was written in order once, and any other once
    for MOST of its rows (`in_order` writes one in order).
    """

    def __init__(self, path: str, key: str, order: str, columns: Sequence[str], page_rows: int) -> None:
        super().__init__(path, order, columns, page_rows)
        self.key = key

    def keys(self) -> list:
        found: set = set()
        for batch in self._data().to_batches(columns=[self.key]):
            found |= set(pc.unique(batch.column(0)).to_pylist())
        return sorted(k for k in found if k is not None)

    def _look_up(self, key: object, after: int | None) -> None:
        """Keeps the first rows of key behind `after`, and whether they are all there are."""
        test = ds.field(self.key) == key
        if after is not None:
            test &= ds.field(self.order) > after
        groups = [g for g in self._groups() if after is None or g[1] > after]
        least, end, rows = max(self.LEAST, self.page_rows + 1), math.inf, None
        for low, _, piece in groups:
            if low > end:
                break
            if rows is not None and rows.num_rows >= least and low > rows[self.order][least - 1].as_py():
                end = min(end, low - 1)  # what lies before this group is complete
                break
            more = self._read(piece, test & (ds.field(self.order) <= end) if end < math.inf else test)
            rows = more if rows is None else pa.concat_tables([rows, more])
            if rows.num_rows and more.num_rows:
                rows = rows.sort_by(self.order)
            if rows.num_rows > max(self.MOST, least):
                rows = rows[: max(self.MOST, least)]
                end = rows[self.order][-1].as_py()
        if rows is None:
            rows = self._data().schema.empty_table().select(list(dict.fromkeys([*self.columns, self.order])))
        else:
            rows = rows.combine_chunks()
        order = rows[self.order].to_numpy()
        if end < math.inf:
            rows = rows[: int(np.searchsorted(order, end, "right"))]
        self._kept = key, -math.inf if after is None else after, rows, order[: rows.num_rows], end == math.inf

    def page(self, key: object, token: str | None) -> tuple[pa.Table, str | None]:
        after = -math.inf if token is None else int(token)
        for fresh in (False, True):
            if fresh or "_kept" not in self.__dict__:
                self._look_up(key, None if token is None else int(token))
            kept, since, rows, order, whole = self._kept
            at = int(np.searchsorted(order, after, "right"))
            if kept == key and since <= after and (whole or at + self.page_rows < rows.num_rows):
                break
        page, more = rows[at : at + self.page_rows], at + self.page_rows < rows.num_rows
        return page.select(self.columns), str(order[at + self.page_rows - 1]) if more else None


class NumberedService(_Ordered):
    """The same with a chain for each page: pages by number, each of a range of `order`. Pages that follow are looked up together.

    For tables that were written in order: of another one each look-up reads every row group. `StoredPages` takes any table.
    """

    def keys(self) -> list[int]:
        last = max((pc.max(b.column(0)).as_py() for b in self._data().to_batches(columns=[self.order]) if b.num_rows), default=-1)
        return list(range(last // self.page_rows + 1))

    def page(self, key: int, token: str | None) -> tuple[pa.Table, None]:
        begin, end = key * self.page_rows, (key + 1) * self.page_rows
        if "_kept" not in self.__dict__ or not self._kept[0] <= begin < self._kept[1]:
            upto = begin + self.page_rows * -(-2 * self.LEAST // self.page_rows)
            test = (ds.field(self.order) >= begin) & (ds.field(self.order) < upto)
            parts = [self._read(piece, test) for low, high, piece in self._groups() if low < upto and high >= begin]
            rows = pa.concat_tables(parts).sort_by(self.order).combine_chunks() if parts else self._data().schema.empty_table()
            self._kept = begin, upto, rows, rows[self.order].to_numpy()
        _, _, rows, order = self._kept
        low, high = np.searchsorted(order, [begin, end])
        rows = rows[int(low) : int(high)].select(self.columns)
        return rows.append_column("page", pa.array([key] * rows.num_rows, pa.int64())), None


class StoredPages:
    """Pages by number of a table that Spark has put in order: a run of pages is a folder, found by its number, and is read once."""

    #: Rows of a run, about.
    RUN_ROWS = 50_000

    def __init__(self, path: str, columns: Sequence[str], page_rows: int, rows: int) -> None:
        self.path, self.columns, self.page_rows, self.rows = path, list(columns), page_rows, rows
        self.run_pages = max(1, self.RUN_ROWS // page_rows)

    @classmethod
    def of(cls, df: DataFrame, order: str, page_rows: int, path: str) -> StoredPages:
        """df's rows by `order` (nulls first, equal ones by the other columns), all pages but the last of page_rows; they are kept at path, a new folder that all executors share."""
        from barwright.operators.relational import numbered

        service = cls(path, df.columns, page_rows, 0)
        rows = numbered(df, [(c, False) for c in [order, *(c for c in df.columns if c != order)]], "rn__")
        rows.withColumn("run__", F.expr(f"(rn__ - 1) div {service.run_pages * page_rows}")).write.partitionBy("run__").parquet(path)
        service.rows = df.sparkSession.read.schema("rn__ long").parquet(path).agg(F.max("rn__")).first()[0] or 0
        return service

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}  # the run that was read stays here

    def keys(self) -> range:
        return range(-(-self.rows // self.page_rows))

    def runs(self, keys: Iterable[int]) -> list[list[int]]:
        return [list(run) for _, run in itertools.groupby(keys, lambda k: k // self.run_pages)]

    def page(self, key: int, token: str | None) -> tuple[pa.Table, None]:
        run = key // self.run_pages
        if "_kept" not in self.__dict__ or self._kept[0] != run:
            system, at = _at(f"{self.path}/run__={run}")
            rows = ds.dataset(at, filesystem=system, format="parquet").to_table(columns=[*self.columns, "rn__"])
            self._kept = run, rows.sort_by("rn__").combine_chunks()
        rows = self._kept[1].slice((key - run * self.run_pages) * self.page_rows, self.page_rows).select(self.columns)
        return rows.append_column("page", pa.array([key] * rows.num_rows, pa.int64())), None
