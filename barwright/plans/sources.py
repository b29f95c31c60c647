"""Queries of sources and sinks over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.plans.registry import query, table
from barwright.plans.streams import folder
from barwright.sources import pages as P
from barwright.sources import readers as R
from barwright.sources import sinks


@query("scan_pruned", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_shipdate < TIMESTAMP '2000-02-01'")
def scan_pruned(spark: SparkSession, d: str) -> DataFrame:
    df = R.parquet(spark, f"{d}/lineitem.parquet", columns=["l_orderkey", "l_quantity", "l_shipdate"])
    return df.where("l_shipdate >= '2000-01-01' AND l_shipdate < '2000-02-01'").drop("l_shipdate")


@query("catalog_table", "SELECT o_orderkey, upper(o_orderstatus) AS o_orderstatus FROM orders")
def catalog_table(spark: SparkSession, d: str) -> DataFrame:
    catalog = R.Catalog(spark, d)
    catalog.register("orders", lambda df: df.withColumn("o_orderstatus", F.upper("o_orderstatus")))
    return catalog.table("orders", ["o_orderkey", "o_orderstatus"])


@query("html_titles", "SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=[\"'']([^\"'']*)[\"'']'))::INT AS links FROM pages")
def html_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", R.html_title(F.col("html")).alias("title"), F.size(R.html_links(F.col("html"))).alias("links"))


@query("html_plain_text", r"SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS t FROM pages)")
def html_plain_text(spark: SparkSession, d: str) -> DataFrame:
    t = R.html_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("digest"))


@query("json_normalize", "SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS p_k FROM events")
def json_normalize(spark: SparkSession, d: str) -> DataFrame:
    packed = table(spark, d, "events").select(F.format_string('{"user": {"id": %d}, "items": [{"event_id": %d, "k": %s}]}', "user_id", "event_id", F.get_json_object("props", "$.k")).alias("raw"))
    flat = R.normalized(packed, "raw", "user struct<id: bigint>, items array<struct<event_id: bigint, k: bigint>>", "items", ["user"], "p_")
    return flat.select(F.col("user.id").alias("user_id"), F.col("p_event_id").alias("event_id"), "p_k")


@query("xml_leaf_values", "SELECT p_partkey, p_name AS name, p_size::VARCHAR AS size FROM part")
def xml_leaf_values(spark: SparkSession, d: str) -> DataFrame:
    filing = F.format_string("HEADER\n<XML><part><name>%s</name><size>%d</size></part></XML>\nFOOTER", "p_name", "p_size")
    island = F.get(R.xml_islands(filing, "XML"), F.lit(0))
    v = R.leaf_values(F.col("island"))
    return table(spark, d, "part").select("p_partkey", island.alias("island")).select("p_partkey", F.element_at(v, "name").alias("name"), F.element_at(v, "size").alias("size"))


@query("paged_service", "SELECT event_id, event_type, value FROM events")
def paged_service(spark: SparkSession, d: str) -> DataFrame:
    """Pages by number. Spark puts the table in order first, so no page looks for its rows in all of it."""
    service = P.StoredPages.of(table(spark, d, "events").select("event_id", "event_type", "value"), "event_id", 500, folder(spark))
    return P.paged(spark, service, "page", "event_id long, event_type string, value double, page long").drop("page")


class _Unsteady(P.TableService):
    """Loses its connection after the third page of a chain, unless that page was asked for by someone who has the first three: a task that starts again must not begin anew."""

    def page(self, key: object, token: str | None):
        at = getattr(self, "asked", 0)
        self.asked = at + 1
        if at == 3:
            raise ConnectionError("lost")
        return super().page(key, token)


@query("token_pages", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('view', 'purchase')")
def token_pages(spark: SparkSession, d: str) -> DataFrame:
    """Chains of tokens, one for each type; of two types only, by a filter that reaches the source; connections that break are resumed."""
    columns = ["event_id", "event_type", "value"]
    at = P.in_order(table(spark, d, "events").select(columns), "event_type", "event_id", folder(spark))
    service = _Unsteady(at, "event_type", "event_id", columns, 100)
    return P.paged(spark, service, "event_type", "event_id long, event_type string, value double", spool=folder(spark)).where("event_type IN ('view', 'purchase')")


@query(
    "endpoint_calls",
    "SELECT 'defaults' AS call, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 200000 AND o_orderdate >= DATE '1995-01-01' UNION ALL SELECT 'given', o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 300000 AND o_orderdate >= DATE '1995-01-01' UNION ALL SELECT 'symbol', l_orderkey, l_extendedprice FROM lineitem WHERE l_suppkey = 3 AND l_quantity >= 25",
)
def endpoint_calls(spark: SparkSession, d: str) -> DataFrame:
    """Two endpoints with parameters and defaults, one called with none given and with two."""
    ends = R.Endpoints(spark)
    ends.define("orders_of", f"SELECT o_orderkey, o_totalprice FROM parquet.`{d}/orders.parquet` WHERE o_orderstatus = status AND o_totalprice >= least_price AND o_orderdate >= since", status=("STRING", "F"), least_price=("DOUBLE", 200000), since=("DATE", "1995-01-01"))
    ends.define("trades_of", f"SELECT l_orderkey AS o_orderkey, l_extendedprice AS o_totalprice FROM parquet.`{d}/lineitem.parquet` WHERE l_suppkey = symbol AND l_quantity >= least", symbol=("BIGINT", None), least=("DOUBLE", 25))
    calls = {"defaults": ends.call("orders_of"), "given": ends.call("orders_of", status="O", least_price=300000), "symbol": ends.call("trades_of", symbol=3)}
    named = [df.withColumn("call", F.lit(name)) for name, df in calls.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


_CELLS = "list_transform(regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), '(?s)<li>(.*?)</li>', 1), lambda t: trim(regexp_replace(regexp_replace(t, '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')))"


@query(
    "html_table_rows",
    f"WITH c AS (SELECT page_id, {_CELLS} AS items FROM pages WHERE contains(html, '<ul>')), r AS (SELECT page_id, 0 AS row_no, ['links', 'menu', 'menu'] AS cells FROM c UNION ALL SELECT page_id, i, CASE WHEN i < 3 THEN ['links', items[i]] ELSE [items[i]] END FROM c, unnest(range(1, len(items) + 1)) AS t(i)) SELECT page_id, row_no::INT AS row_no, array_to_string(cells, '|') AS cells FROM r",
)
def html_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """The pages' menus as tables, with a heading over two columns and a label beside three rows."""
    html = F.col("html")
    for a, b in (("<ul>", '<table class="menu"><tr><th rowspan="3">links</th><td COLSPAN=2>menu</td></tr>'), ("</ul>", "</table>"), ("<li>", "<tr><td>"), ("</li>", "</td></tr>")):
        html = F.replace(html, F.lit(a), F.lit(b))
    rows = R.html_rows(table(spark, d, "pages").where(F.contains("html", F.lit("<ul>"))).select("page_id", html.alias("html")), "page_id", "html")
    return rows.where("table_no = 0").select("page_id", "row_no", F.array_join("cells", "|").alias("cells"))


# files written to the shared folder and read again


@query("scan_many_files", "SELECT r_regionkey, r_name, NULL AS n_nationkey, NULL AS n_name FROM region UNION ALL SELECT NULL, NULL, n_nationkey, n_name FROM nation")
def scan_many_files(spark: SparkSession, d: str) -> DataFrame:
    return R.parquet(spark, f"{d}/region.parquet", f"{d}/nation.parquet", columns=["r_regionkey", "r_name", "n_nationkey", "n_name"])


@query("csv_with_headers_inside", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def csv_with_headers_inside(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    sinks.write_csv(rows, at)
    return R.delimited(spark, at, rows.schema, header_cell="o_orderkey")


@query("json_to_parquet", "SELECT o_orderkey, o_orderpriority FROM orders")
def json_to_parquet(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    table(spark, d, "orders").select("o_orderkey", "o_orderpriority").write.option("compression", "gzip").json(f"{at}/json")
    return sinks.json_to_parquet(spark, f"{at}/json", f"{at}/parquet", "o_orderkey bigint, o_orderpriority string")


@query("latest_day", "SELECT event_id, event_type FROM events WHERE ts::DATE = (SELECT max(ts)::DATE FROM events)")
def latest_day(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    sinks.write_by_date(table(spark, d, "events").select("event_id", "event_type", F.to_date("ts").alias("date")), at)
    days = spark.read.parquet(at)
    return days.join(F.broadcast(days.agg(F.max("date").alias("date"))), "date").select("event_id", "event_type")  # one row


@query("latest_business_day", "SELECT event_id, event_type, ts::DATE AS date FROM events WHERE ts::DATE = (SELECT max(ts::DATE) FROM events WHERE isodow(ts) < 6 AND ts::DATE <= DATE '2024-01-14' AND ts::DATE <> DATE '2024-01-12')")
def latest_business_day(spark: SparkSession, d: str) -> DataFrame:
    """As of a Sunday after a holiday: two business days back."""
    at = folder(spark)
    sinks.write_by_date(table(spark, d, "events").select("event_id", "event_type", F.to_date("ts").alias("date")), at)
    return R.as_of(spark, at, "2024-01-14", holidays=["2024-01-12"])


@query("per_key_layout", "SELECT l_suppkey, year(l_shipdate) AS year, count(*) AS n, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2", "volume")
def per_key_layout(spark: SparkSession, d: str) -> DataFrame:
    """Trades in folders by year, sorted by symbol within, read again."""
    at = folder(spark)
    trades = table(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_quantity")
    sinks.write_by_key(trades, at, "l_suppkey")
    return spark.read.parquet(at).groupBy("l_suppkey", F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("volume"))


@query("file_size_audit", "SELECT event_type, true AS found FROM events GROUP BY 1 UNION ALL SELECT 'over 1 GB', false")
def file_size_audit(spark: SparkSession, d: str) -> DataFrame:
    """Which folders of a written table have files of a byte and more, and whether any file is over 1 GB."""
    at = folder(spark)
    table(spark, d, "events").write.partitionBy("event_type").parquet(at)
    some = R.file_sizes(spark, at, 1).select(F.regexp_extract("path", "event_type=([^/]*)/", 1).alias("event_type")).where("event_type <> ''").distinct().withColumn("found", F.lit(True))
    large = R.file_sizes(spark, at, 1 << 30).agg((F.count("*") > 0).alias("found")).select(F.lit("over 1 GB").alias("event_type"), "found")
    return some.unionByName(large)


@query("csv_with_junk_above", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def csv_with_junk_above(spark: SparkSession, d: str) -> DataFrame:
    """Eight files, each with lines of a report above its header."""
    at = folder(spark)
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    part = F.pmod("o_orderkey", F.lit(8)).cast("int")
    lines = rows.select(part.alias("part"), F.col("o_orderkey").alias("at"), F.concat_ws(",", "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("string")).alias("value"))
    above = spark.range(8).select(F.col("id").cast("int").alias("part"), F.posexplode(F.array(F.lit("Report of orders,,"), F.lit("9,X,1.5"), F.lit("o_orderkey,o_orderstatus,o_totalprice"))).alias("at", "value"))
    above = above.withColumn("at", F.col("at").cast("long") - 3)
    lines.unionByName(above).repartition("part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(at)
    return R.delimited(spark, at, rows.schema, header_cell="o_orderkey")


@query("upsert_into_table", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal ELSE s_acctbal + 1 END AS s_acctbal FROM supplier")
def upsert_into_table(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    rows = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    sinks.upsert_table(rows.where("s_suppkey % 2 = 0"), at, ["s_suppkey"], [F.col("s_acctbal")])
    return sinks.upsert_table(rows.withColumn("s_acctbal", F.col("s_acctbal") + 1), at, ["s_suppkey"], [F.col("s_acctbal")])


@query("xml_rows", "SELECT p_partkey, p_name, p_size FROM part")
def xml_rows(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    rows.write.format("xml").option("rowTag", "part").option("rootTag", "parts").save(at)
    return R.xml(spark, at, "part", rows.schema)
