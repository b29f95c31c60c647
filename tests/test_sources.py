"""Readers and sinks on small files, and streams against batches."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.functions import dates, options, text
from barwright.sources import readers, sinks
from barwright.streaming import feeds


def test_header_found_within_the_data(spark, tmp_path):
    (tmp_path / "a.csv").write_text("report of today\nx,1\nSYMBOL,QTY\nAA,5\nBB,\n\n")
    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("qty", T.IntegerType())])
    got = readers.delimited(spark, str(tmp_path), schema, header_cell="SYMBOL")
    assert sorted(map(tuple, got.collect())) == [("AA", 5), ("BB", None)]
    skipped = readers.delimited(spark, str(tmp_path), schema, skip=3)
    assert skipped.count() == 2


def test_xml_rows_and_islands(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><item><a>1</a><b>x</b></item><item><a>2</a></item></r>")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    assert sorted(map(tuple, readers.xml(spark, str(tmp_path), "item", schema).collect())) == [(1, "x"), (2, None)]
    df = spark.createDataFrame([("junk<XML><q><n>7</n></q></XML>more<xml>z</xml>",), (None,)], "t string")
    assert [r[0] for r in df.select(readers.xml_islands(F.col("t"), "XML")).collect()] == [["<q><n>7</n></q>", "z"], []]


def test_html_rows(spark):
    html = """<p>x</p><TABLE id="t"><thead><tr><th rowspan=2>Day</th><th colspan='2'>Price</th></tr><tr><th>open</th><th>close</th></tr></thead>
<tr><td>1</td><td><b>2</b> <i>3</i></td><td rowspan="3">4</td></tr><tr><td colspan="2">5</td></tr><tr></tr></TABLE>
<table><tr><td colspan="0">a</td><td rowspan="x">b</td></tr><tr><td rowspan=5 colspan=2>c</td></tr></table>"""
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<table></table>")], "id int, html string")
    got = [(r["id"], r["table_no"], r["row_no"], r["cells"]) for r in readers.html_rows(df, "id", "html").orderBy("id", "table_no", "row_no").collect()]
    first = [["Day", "Price", "Price"], ["Day", "open", "close"], ["1", "2 3", "4"], ["5", "5", "4"], ["4"]]
    assert got == [(1, 0, i, row) for i, row in enumerate(first)] + [(1, 1, 0, ["a", "b"]), (1, 1, 1, ["c", "c"])]


def test_newest_file_and_upsert_table(spark, tmp_path):
    for day, v in (("2024-01-02", 1), ("2024-01-09", 2)):
        spark.createDataFrame([(v,)], "v int").coalesce(1).write.parquet(str(tmp_path / f"x_{day}"))
    for f in tmp_path.glob("x_*/part*"):
        f.rename(tmp_path / f"{f.parent.name}.parquet")
    assert readers.newest(spark, str(tmp_path), r"x_(\d{4}-\d{2}-\d{2})").collect()[0]["v"] == 2
    path = str(tmp_path / "table")
    new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.upsert_table(new, path, ["k"], [F.col("v")])
    got = sinks.upsert_table(spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), path, ["k"], [F.col("v")])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_partitioned_write_prunes(spark, tmp_path):
    df = spark.createDataFrame([(i, datetime.date(2024, 1, 1 + i % 3)) for i in range(30)], "v int, date date")
    sinks.write_by_date(df, str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d")).where("date = '2024-01-02'")
    assert back.count() == 10 and "PartitionFilters: [isnotnull(date" in back._jdf.queryExecution().toString()


def test_stream_windows_equal_batch_and_late_rows_are_dropped(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [("a", start + datetime.timedelta(minutes=m), float(m)) for m in (1, 5, 61, 130, 200)]
    schema = "k string, ts timestamp, price double"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    query = feeds.windowed(stream, ["k"], "1 hour", "10 minutes", "price").writeStream.format("memory").queryName("w1").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["bucket"].hour: (r["o"], r["c"], r["n"]) for r in spark.table("w1").collect()}
    assert got[0] == (1.0, 5.0, 2) and got[1] == (61.0, 61.0, 1) and 3 not in got  # the last hour isn't over


def test_nested_messages_keep_all_services(spark):
    message = json.dumps({"data": [{"service": "Q", "timestamp": 1000, "content": [{"key": "A", "p": 1.0}, {"key": "B", "p": None}]}, {"service": "T", "timestamp": 2000, "content": [{"key": "C", "p": 3.0}]}]})
    df = spark.createDataFrame([(message,)], "raw string")
    got = feeds.exploded_messages(df, "raw", "key: string, p: double").collect()
    assert [(r["service"], r["key"], r["p"]) for r in got] == [("Q", "A", 1.0), ("Q", "B", None), ("T", "C", 3.0)]


def test_business_days(spark):
    day = lambda s: F.lit(s).cast("date")
    row = spark.range(1).select(
        dates.business_days(day("2024-01-01"), day("2024-01-08"), ["2024-01-01"]).alias("a"),
        dates.business_days(day("2024-01-08"), day("2024-01-01")).alias("b"),
        dates.third_friday(day("2024-03-09")).alias("c"),
        dates.next_monthly_expiry(day("2024-03-16")).alias("d"),
    ).first()
    assert (row["a"], row["b"], str(row["c"]), str(row["d"])) == (4, -5, "2024-03-15", "2024-04-19")


def test_option_symbols_round_trip(spark):
    df = spark.createDataFrame([("SPY", datetime.date(2024, 3, 15), "C", 512.5)], "r string, e date, s string, k double")
    built = df.select(options.build_symbol(F.col("r"), F.col("e"), F.col("s"), F.col("k")).alias("o"))
    assert built.first()["o"] == "SPY   240315C00512500"
    parsed = built.select(*[c.alias(n) for n, c in options.parse_symbol(F.col("o")).items()]).first()
    assert tuple(parsed) == ("SPY", datetime.date(2024, 3, 15), "C", 512.5)


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("$1,234",), ("($0.12)",), ("5%",), ("N/A",), (None,)], "t string")
    assert [r[0] for r in df.select(text.number_of(F.col("t"))).collect()] == [1234.0, -0.12, 5.0, None, None]


def test_a_failed_upsert_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    sinks.upsert_table(rows((1, "a"), (2, "b")), path, ["k"], [F.col("v")])
    publish = sinks._publish

    def fails(*_):
        raise OSError("lost")

    monkeypatch.setattr(sinks, "_publish", fails)
    try:
        sinks.upsert_table(rows((3, "c")), path, ["k"], [F.col("v")])
        raise AssertionError
    except OSError:
        pass
    assert sorted(map(tuple, sinks.keyed_table(spark, path).collect())) == [(1, "a"), (2, "b")]
    monkeypatch.setattr(sinks, "_publish", publish)
    held = sinks.keyed_table(spark, path)
    after = sinks.upsert_table(rows((3, "c"), (1, "z")), path, ["k"], [F.col("v")])
    assert sorted(map(tuple, after.collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert held.count() == 2  # a reader of the table as it was is not disturbed


def test_an_upsert_writes_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.upsert_table(spark.range(200).selectExpr("id AS k", "'old' AS v"), path, ["k"], [F.col("v")])
    first = sinks._folders(spark, path, sinks._listed(spark, path)[-1])
    sinks.upsert_table(spark.createDataFrame([(1000, "new")], "k long, v string"), path, ["k"], [F.col("v")])
    second = sinks._folders(spark, path, sinks._listed(spark, path)[-1])
    assert len(first) == 16 and sum(first[b] != second[b] for b in first) == 1
    assert sinks.keyed_table(spark, path).count() == 201


def test_last_known_by_time_with_late_rows(spark, tmp_path):
    """Rows in three batches, out of order: those within the watermark are put in order, those behind it are dropped, an idle value goes."""
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    batches = [
        [("a", at(1, 10), 1.0), ("a", at(1, 30), None), ("b", at(1, 5), None)],
        [("a", at(1, 20), 2.0), ("a", at(1, 50), None), ("a", at(2, 10), None), ("b", at(2, 0), 5.0)],
        [("a", at(6), None), ("b", at(6, 30), None), ("c", at(9), None)],  # the watermark goes to 8:00
        [("a", at(1, 40), 7.0), ("c", at(12), None)],
    ]
    before = spark.conf.get(feeds.ROCKS[0])
    spark.conf.set(*feeds.ROCKS)
    try:
        for rows in batches:
            spark.createDataFrame(rows, "k string, ts timestamp, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(tmp_path / "in"))
            out = feeds.last_known(stream, "k", "v", "1 hour", idle="3 hours")
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(feeds.ROCKS[0], before)
    got = sorted((r["k"], r["ts"].hour, r["ts"].minute, r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = [("a", 1, 10, 1.0), ("a", 1, 20, 2.0), ("a", 1, 30, 2.0), ("a", 1, 50, 2.0), ("a", 2, 10, 2.0), ("a", 6, 0, None), ("b", 1, 5, None), ("b", 2, 0, 5.0), ("b", 6, 30, None), ("c", 9, 0, None)]
    assert got == want


def test_log_source_replays_a_range_and_notes_what_is_committed(spark, tmp_path):
    import json

    from barwright.streaming.log_source import LogReader, log_groups

    df = spark.createDataFrame([(i, f"v{i}") for i in range(100)], "seq long, v string")
    for part in (df.where("seq < 40"), df.where("seq >= 40 AND seq < 70"), df.where("seq >= 70")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    options = {"path": str(tmp_path / "log"), "sequence": "seq", "batchRows": "25", "acks": str(tmp_path / "acks" / "state")}
    reader = LogReader(df.schema, options)
    assert sorted(g[2:] for g in log_groups(options["path"], "seq")) == [(0, 39), (40, 69), (70, 99)]
    assert reader.initialOffset() == {"next": 0} and reader.latestOffset() == {"next": 25}
    values = lambda parts: sorted(x for p in parts for b in reader.read(p) for x in b.column("seq").to_pylist())
    assert len(reader.partitions({"next": 30}, {"next": 75})) == 3
    first = values(reader.partitions({"next": 30}, {"next": 75}))
    assert first == list(range(30, 75)) == values(reader.partitions({"next": 30}, {"next": 75}))
    reader.commit({"next": 75})
    assert json.loads((tmp_path / "acks" / "state").read_text()) == {"planned": 75, "committed": 75}
    again = LogReader(df.schema, options)  # after a restart
    assert again.latestOffset() == {"next": 100} and again.initialOffset() == {"next": 0}


def test_log_source_reads_on_after_a_lost_connection(spark, tmp_path, monkeypatch):
    from barwright.streaming import log_source

    spark.range(20_000).withColumnRenamed("id", "seq").coalesce(1).write.parquet(str(tmp_path / "log"))
    reader = log_source.LogReader(spark.read.parquet(str(tmp_path / "log")).schema, {"path": str(tmp_path / "log"), "sequence": "seq"})
    real, calls = log_source.pq.ParquetFile, []

    class Breaking:
        def __init__(self, f):
            self.file = real(f)
            self.metadata = self.file.metadata

        def iter_batches(self, *args, **kwargs):
            calls.append(1)
            for i, batch in enumerate(self.file.iter_batches(*args, **kwargs)):
                if i == len(calls) and len(calls) < 3:
                    raise OSError("lost")
                yield batch

    monkeypatch.setattr(log_source.pq, "ParquetFile", Breaking)
    (part,) = reader.partitions({"next": 5}, {"next": 19_000})
    assert [x for b in reader.read(part) for x in b.column("seq").to_pylist()] == list(range(5, 19_000)) and len(calls) == 3


def test_supervised_stream_goes_on_after_an_error(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    failures, seen, listener = [1], [], feeds.Listener()

    def sink(batch, number):
        if failures:
            failures.pop()
            raise RuntimeError("once")
        seen.extend(r["id"] for r in batch.collect())

    start = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.queryName("watched").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    spark.streams.addListener(listener)
    try:
        feeds.supervised(start, 2)
        for _ in range(50):
            if listener.batches:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(seen) == list(range(10))
    assert listener.table(spark).where("query = 'watched'").agg(F.sum("rows")).first()[0] == 10


def test_files_by_key_date_csv_json_and_size(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, datetime.date(2023 + i % 2, 1, 1 + i), float(i)) for i in range(12)], "k int, date date, v double")
    sinks.write_by_key(df, str(tmp_path / "k"), "k")
    assert spark.read.parquet(str(tmp_path / "k")).where("year = 2023 AND k = 0").count() == df.where("year(date) = 2023 AND k = 0").count() > 0
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).schema("k int, date date, v double").csv(str(tmp_path / "c")).exceptAll(df).count() == 0
    df.select("k", "v").write.option("compression", "gzip").json(str(tmp_path / "j"))
    assert sinks.json_to_parquet(spark, str(tmp_path / "j"), str(tmp_path / "p"), "k int, v double").count() == 12
    assert readers.file_sizes(spark, str(tmp_path / "k"), 1).count() > 0 and readers.file_sizes(spark, str(tmp_path / "k"), 10**9).count() == 0


def test_messages_go_to_their_service(spark, tmp_path):
    spark.createDataFrame([("Q", 1), ("T", 2), ("X", 3), (None, 4)], "service string, v int").write.json(str(tmp_path / "in"))
    got = {"Q": [], "T": [], "rest": []}
    put = lambda name: lambda batch, _: got[name].extend(r["v"] for r in batch.collect())
    stream = spark.readStream.schema("service string, v int").json(str(tmp_path / "in"))
    feeds.demultiplexed(stream, "service", {"Q": put("Q"), "T": put("T")}, put("rest"), str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    assert {k: sorted(v) for k, v in got.items()} == {"Q": [1], "T": [2], "rest": [3, 4]}


def test_catalog_filters_reach_the_scan(spark):
    catalog = readers.Catalog(spark, "/root/testdata/sf0.001")
    catalog.register("orders", lambda df: df.withColumn("o_orderstatus", F.upper("o_orderstatus")))
    one = catalog.table("orders", ["o_orderkey", "o_orderstatus"], o_custkey=7)
    plan = one._jdf.queryExecution().toString()
    assert "EqualTo(o_custkey,7)" in plan and one.count() == catalog.table("orders").where("o_custkey = 7").count()


class Numbers:
    """Chains of as many pages as the key says; a page has two rows. Breaks where it is told to, and counts what it was asked."""

    def __init__(self, breaks=()):
        self.breaks, self.asked = list(breaks), []

    def keys(self):
        return [0, 2, 5]

    def page(self, key, token):
        import pyarrow as pa

        at = int(token or 0)
        self.asked.append((key, at))
        if (key, at) in self.breaks:
            self.breaks.remove((key, at))
            raise ConnectionError("lost")
        return pa.table({"k": [key, key], "at": [2 * at, 2 * at + 1]}), str(at + 1) if at < key else None


def test_pages_by_token_and_filters_that_reach_the_source(spark):
    from barwright.sources import pages

    df = pages.paged(spark, Numbers([(2, 1), (5, 3)]), "k", "k long, at long")
    assert sorted(map(tuple, df.collect())) == [(k, i) for k in (0, 2, 5) for i in range(2 * k + 2)]
    some = df.where("k IN (0, 2) AND at > 1")
    assert sorted(map(tuple, some.collect())) == [(2, i) for i in range(2, 6)]
    assert some.rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="more than 3 pages"):
        pages.paged(spark, Numbers(), "k", "k long, at long", most_pages=3).collect()


def test_a_chain_that_starts_again_asks_for_the_rest_only(tmp_path):
    from barwright.sources import pages

    lost = Numbers([(5, 3)] * 2)
    spool = lambda: pages.Spool(str(tmp_path), 5)
    first = []
    with pytest.raises(ConnectionError):
        first += pages.chain(lost, 5, spool(), retries=1)
    again = Numbers()
    rows = [v for page in pages.chain(again, 5, spool()) for v in page["at"].to_pylist()]
    assert rows == list(range(12)) and again.asked == [(5, 3), (5, 4), (5, 5)]
    done = Numbers()
    assert sum(page.num_rows for page in pages.chain(done, 5, spool())) == 12 and done.asked == []


def test_pages_of_a_table(spark, tmp_path):
    from barwright.sources import pages

    spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(25)] + [(25, None, 1.0)], "n long, k string, v double").repartition(3).write.parquet(str(tmp_path / "t"))
    service = pages.TableService(str(tmp_path / "t"), "k", "n", ["n", "k", "v"], 5)
    assert service.keys() == ["a", "b"]
    assert [page["n"].to_pylist() for page in pages.chain(service, "a")] == [[0, 2, 4, 6, 8], [10, 12, 14, 16, 18], [20, 22, 24]]
    assert [page.num_rows for page in pages.chain(service, "nobody")] == [0]


def test_endpoints_have_parameters_with_defaults(spark):
    ends = readers.Endpoints(spark)
    ends.define("rows_of", "SELECT id, name FROM VALUES (1L, 'it''s'), (2L, 'b'), (3L, 'b') AS t(id, name) WHERE id >= least AND name = wanted", wanted=("STRING", None), least=("BIGINT", 2))
    ids = lambda **given: sorted(r["id"] for r in ends.call("rows_of", **given).collect())
    assert ids(wanted="b") == [2, 3] and ids(wanted="b", least=3) == [3] and ids(least=0, wanted="it's") == [1]
    for wrong in ({}, {"wanted": "b", "other": 1}):
        with pytest.raises(ValueError):
            ends.call("rows_of", **wrong)


def test_call_log_counts_against_a_budget(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    sinks.log_calls(spark.createDataFrame([("news", at(1, 0)), ("news", at(1, 30))], "service string, ts timestamp"), str(tmp_path / "log"))
    log = sinks.log_calls(spark.createDataFrame([("news", at(1, 40)), ("bars", at(2, 0))], "service string, ts timestamp"), str(tmp_path / "log"))
    assert sorted((r["service"], r["begin"].hour, r["n"], r["left"]) for r in sinks.call_budget(log, "1 hour", 2).collect()) == [("bars", 2, 1, 1), ("news", 1, 3, 0)]


def test_the_last_business_day_that_has_a_folder(spark, tmp_path):
    days = [datetime.date(2024, 1, d) for d in (2, 4, 5, 6)]  # Tuesday, Thursday, Friday, Saturday
    sinks.write_by_date(spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, v int"), str(tmp_path))
    at = lambda day, **more: [(r["v"], str(r["date"])) for r in readers.as_of(spark, str(tmp_path), day, **more).collect()]
    assert at("2024-01-07") == at("2024-01-05") == [(2, "2024-01-05")] and at("2024-01-07", holidays=["2024-01-05"]) == [(1, "2024-01-04")]
    assert at("2024-01-03") == [(0, "2024-01-02")]
    with pytest.raises(FileNotFoundError):
        at("2024-01-25", most=5)
    with pytest.raises(FileNotFoundError):
        at("2024-01-01")


def test_last_known_has_one_timer_a_slot_and_a_beat_gives_out_the_rest(spark, tmp_path):
    """As many keys and hours as one likes: state is kept by slot. Null keys are a key; nothing waits behind a beat."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(None if i % 7 == 0 else 2**60 + i % 7, start + datetime.timedelta(minutes=17 * i), float(i) if i % 3 == 0 else None, False) for i in range(120)]
    rows.append((None, start + datetime.timedelta(days=9), None, True))
    schema = "k long, ts timestamp, v double, beat boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get(feeds.ROCKS[0])
    spark.conf.set(*feeds.ROCKS)
    try:
        out = feeds.last_known(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", "v", "1 hour", beat="beat", slots=2)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        operator = query.lastProgress["stateOperators"][0]["customMetrics"]
    finally:
        spark.conf.set(feeds.ROCKS[0], before)
    last, want = {}, []
    for k, ts, v, _ in rows[:-1]:
        last[k] = last.get(k) if v is None else v
        want.append((k, ts, last[k]))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert operator["numExpiredTimers"] <= 3


def test_the_filled_stream_has_every_event(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    assert entry.queries()["stream_ffill_state"](spark, d).count() == spark.read.parquet(f"{d}/events.parquet").count()
    assert " WHERE date_trunc" not in entry.oracle_sql()["stream_ffill_state"]


def test_pages_of_a_chain_are_looked_up_together_and_have_no_limit(spark, tmp_path, monkeypatch):
    from barwright.sources import pages

    df = spark.range(30_000).selectExpr("id AS n", "id % 2 AS k", "id * 7 % 30000 AS m")
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    for order in ("n", "m"):
        service = pages.TableService(str(tmp_path / "t"), "k", order, ["n", "k", "m"], 1)
        monkeypatch.setattr(pages.TableService, "LEAST", 1000)
        monkeypatch.setattr(pages.TableService, "MOST", 4000)
        looked, look_up = [], service._look_up
        service._look_up = lambda key, after: (looked.append(after), look_up(key, after))
        got = [page[order].to_pylist() for page in pages.chain(service, 1)]
        want = sorted(r[order] for r in df.where("k = 1").collect())
        assert got == [[v] for v in want] and len(got) > 10_000 and len(looked) < 20
    numbered = pages.NumberedService(str(tmp_path / "t"), "m", ["m"], 7)
    assert [v for key in numbered.keys() for v in numbered.page(key, None)[0]["m"].to_pylist()] == list(range(30_000))
    assert pages.paged(spark, numbered, "page", "m long, page long").rdd.getNumPartitions() <= pages.MOST_PARTS


def test_a_page_that_names_itself_is_an_error():
    from barwright.sources import pages

    class Stuck(Numbers):
        def page(self, key, token):
            return super().page(key, token)[0], "1"

    with pytest.raises(RuntimeError, match="names itself"):
        list(pages.chain(Stuck(), 5))


def test_pages_by_number_of_a_table_in_any_order(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry
    from barwright.sources import pages

    ids = [None, -3, -3, 10**6, *range(1000)]
    events = spark.createDataFrame([(i, "ab"[n % 2], float(n)) for n, i in enumerate(ids)], "event_id long, event_type string, value double")
    events.orderBy("value").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["paged_service"](spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, events.collect()))

    monkeypatch.setattr(pages.StoredPages, "RUN_ROWS", 100)
    service = pages.StoredPages.of(events, "event_id", 7, str(tmp_path / "pages"))
    every = [service.page(key, None)[0] for key in service.keys()]
    assert [p.num_rows for p in every] == [7] * (len(ids) // 7) + [len(ids) % 7]
    assert [v for p in every for v in p["event_id"].to_pylist()] == [None, -3, -3, *range(1000), 10**6]
    runs = service.runs(service.keys())
    assert [len(run) for run in runs] == [14] * 10 + [4]  # each is a partition, and is all that its task reads
    assert [spark.read.parquet(f"{tmp_path}/pages/run__={n}").count() for n in range(len(runs))] == [98] * 10 + [len(ids) - 980]
    df = pages.paged(spark, service, "page", "event_id long, event_type string, value double, page long")
    assert df.rdd.getNumPartitions() == len(runs) and df.count() == len(ids)
    assert df.where("page IN (2, 143)").rdd.getNumPartitions() == 2 and df.where("page IN (2, 143)").count() == 7 + 3


def test_pages_by_number_of_no_rows(spark, tmp_path):
    import __spark_entry__ as entry

    spark.range(0).selectExpr("id AS event_id", "'a' AS event_type", "1.0D AS value").write.parquet(str(tmp_path / "events.parquet"))
    assert entry.queries()["paged_service"](spark, str(tmp_path)).count() == 0


def test_chains_of_a_table_in_any_order_read_their_own_rows(spark, tmp_path, monkeypatch):
    from barwright.sources import pages

    monkeypatch.setattr(pages._Ordered, "LEAST", 500)
    monkeypatch.setattr(pages._Ordered, "MOST", 1000)
    df = spark.range(20_000).selectExpr("id * 7919 % 20000 AS n", "id % 4 AS k")  # each row group spans all of n
    df.repartition(8).write.parquet(str(tmp_path / "t"))
    service = pages.TableService(pages.in_order(spark.read.parquet(str(tmp_path / "t")), "k", "n", str(tmp_path / "new")), "k", "n", ["n", "k"], 10)
    read, pieces = [], service._read
    service._read = lambda piece, test: read.append((out := pieces(piece, test)).num_rows) or out
    got = [v for page in pages.chain(service, 1) for v in page["n"].to_pylist()]
    assert got == sorted(r["n"] for r in df.where("k = 1").collect()) and len(got) == 5000
    assert sum(read) <= 4 * len(got) and max(read) <= 500
