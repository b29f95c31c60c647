"""Queries of dates and business days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import dates as D
from barwright.plans.registry import query, table

#: Two holidays for the calendar queries.
HOLIDAYS = ("1996-01-01", "1996-07-04")


@query("date_parts", "SELECT event_id, year(ts) AS y, quarter(ts) AS q, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, isodow(ts) - 1 AS wd, dayofyear(ts) AS doy, week(ts) AS wk, (day(ts) = 1)::INT AS month_start, (ts::DATE = last_day(ts))::INT AS month_end, ts::DATE AS day FROM events")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ts")
    parts = {"y": F.year(t), "q": F.quarter(t), "m": F.month(t), "d": F.day(t), "h": F.hour(t), "mi": F.minute(t), "wd": F.weekday(t), "doy": F.dayofyear(t), "wk": F.weekofyear(t)}
    return table(spark, d, "events").select("event_id", *[c.cast("long").alias(n) for n, c in parts.items()], (F.day(t) == 1).cast("int").alias("month_start"), (F.to_date(t) == F.last_day(t)).cast("int").alias("month_end"), F.to_date(t).alias("day"))


@query("parse_format", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS ymd, strftime(o_orderdate, '%m/%d/%Y') AS us, strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y')::DATE AS back, epoch(o_orderdate)::BIGINT AS secs, epoch_ms(o_orderdate) AS millis FROM orders")
def parse_format(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_format(t, "yyyyMMdd").alias("ymd"), F.date_format(t, "MM/dd/yyyy").alias("us"), F.to_date(F.date_format(t, "dd.MM.yyyy"), "dd.MM.yyyy").alias("back"), F.unix_seconds(t).alias("secs"), F.unix_millis(t).alias("millis")
    )


@query("tz_convert", "SELECT event_id, ts - INTERVAL 5 HOUR AS eastern, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S') || '-05:00' AS rfc FROM events")
def tz_convert(spark: SparkSession, d: str) -> DataFrame:
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")  # the events are in January: no daylight time
    return table(spark, d, "events").select("event_id", local.cast("timestamp_ntz").alias("eastern"), F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00")).alias("rfc"))


_H = ", ".join(f"DATE '{h}'" for h in HOLIDAYS)


@query(
    "business_calendar",
    f"WITH ends AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders), c AS (SELECT d::DATE AS date, row_number() OVER (ORDER BY d) AS n FROM ends, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS t(d) WHERE isodow(d) < 6 AND d::DATE NOT IN ({_H})) SELECT c.date, c.n, count(o_orderkey) AS orders FROM c LEFT JOIN orders ON o_orderdate::DATE = c.date GROUP BY 1, 2",
)
def business_calendar(spark: SparkSession, d: str) -> DataFrame:
    """The business days that orders span, numbered, with each day's orders."""
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    first, last = orders.agg(F.min("date"), F.max("date")).first()
    by_day = orders.groupBy("date").agg(F.count("*").alias("orders"))
    days = D.calendar(spark, str(first), str(last), HOLIDAYS).withColumn("n", F.col("n").cast("long"))
    return days.join(by_day, "date", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


@query(
    "calendar_diff",
    f"WITH c AS (SELECT d::DATE AS date FROM generate_series(DATE '1994-12-01', DATE '2003-12-31', INTERVAL 1 DAY) AS t(d) WHERE isodow(d) < 6 AND d::DATE NOT IN ({_H})), n AS (SELECT x::DATE AS day, (SELECT count(*) FROM c WHERE c.date < x::DATE) AS k FROM generate_series(DATE '1994-12-01', DATE '2003-12-31', INTERVAL 1 DAY) AS t(x)) SELECT o_orderkey, b.k - a.k AS days FROM (SELECT o_orderkey, o_orderdate::DATE AS d1, o_orderdate::DATE + (o_orderkey % 400)::INT AS d2 FROM orders) JOIN n a ON a.day = d1 JOIN n b ON b.day = d2",
)
def calendar_diff(spark: SparkSession, d: str) -> DataFrame:
    d1 = F.to_date("o_orderdate")
    d2 = F.date_add(d1, (F.col("o_orderkey") % 400).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", D.business_days(d1, d2, HOLIDAYS).alias("days"))


_FIRST = "date_trunc('month', {d})::DATE"
_THIRD = lambda d: f"({_FIRST.format(d=d)} + ((12 - isodow({_FIRST.format(d=d)})) % 7)::INT + 14)"


@query("third_friday", f"SELECT o_orderkey, {_THIRD('o_orderdate')}::DATE AS third FROM orders")
def third_friday(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", D.third_friday(F.to_date("o_orderdate")).alias("third"))


@query(
    "next_expiry",
    f"SELECT o_orderkey, (o_orderdate::DATE + (5 - isodow(o_orderdate))::INT)::DATE AS friday, CASE WHEN {_THIRD('o_orderdate')} >= o_orderdate::DATE THEN {_THIRD('o_orderdate')} ELSE {_THIRD('(o_orderdate + INTERVAL 1 MONTH)')} END::DATE AS monthly, CASE WHEN {_THIRD('make_date(year(o_orderdate), 1, 1)')} >= o_orderdate::DATE THEN {_THIRD('make_date(year(o_orderdate), 1, 1)')} ELSE {_THIRD('make_date(year(o_orderdate) + 1, 1, 1)')} END::DATE AS january FROM orders",
)
def next_expiry(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", D.next_friday(day).alias("friday"), D.next_monthly_expiry(day).alias("monthly"), D.january_expiry(day).alias("january"))


@query("filing_quarter", "SELECT o_orderkey, 'QTR' || quarter(o_orderdate) AS q FROM orders")
def filing_quarter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", D.filing_quarter(F.col("o_orderdate")).alias("q"))


@query("session_date", "SELECT event_id, (x - greatest(isodow(x) - 5, 0)::INT)::DATE AS session FROM (SELECT event_id, CASE WHEN hour(ts - INTERVAL 5 HOUR) >= 17 THEN (ts - INTERVAL 5 HOUR)::DATE ELSE ((ts - INTERVAL 5 HOUR)::DATE - 1)::DATE END AS x FROM events)")
def session_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", D.session_date(F.col("ts").cast("timestamp"), 17).alias("session"))


@query("list_literal", "SELECT event_id, len(l)::INT AS n, l[1] AS first FROM (SELECT event_id, [event_id % 7, event_id % 5] AS l FROM events)")
def list_literal(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string("[%d, %d]", F.col("event_id") % 7, F.col("event_id") % 5)
    l = F.from_json(text, "array<bigint>")  # noqa: E741
    return table(spark, d, "events").select("event_id", F.size(l).alias("n"), F.get(l, F.lit(0)).alias("first"))


@query("math_basics", "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_discount - 0.05::DOUBLE) AS a, sign(l_discount - 0.05::DOUBLE)::INT AS s, sqrt(l_quantity) AS r, CASE WHEN l_tax > 0 THEN ln(l_tax) END AS n, l_quantity ** 2 AS p FROM lineitem", "a r n")
def math_basics(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_discount") - 0.05
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.abs(x).alias("a"), F.signum(x).cast("int").alias("s"), F.sqrt("l_quantity").alias("r"), F.when(F.col("l_tax") > 0, F.ln("l_tax")).alias("n"), F.pow("l_quantity", F.lit(2)).alias("p"))
