"""Queries of the relational operators: projection and filter, joins, aggregation, sort and top-k, set operations, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.functions import columns as C
from barwright.operators import relational as R
from barwright.plans.registry import query, table

ROUND_TRADE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


# projection, filter, predicate


@query("project_rename", "SELECT o_orderkey AS order_id, o_totalprice * 1.1 AS gross, o_orderstatus AS status FROM orders", "gross")
def project_rename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") * 1.1).alias("gross")).withColumnsRenamed({"o_orderkey": "order_id", "o_orderstatus": "status"})


@query("filter_and_or", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity > 45 AND l_returnflag = 'R') OR l_discount < 0.005")
def filter_and_or(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where(((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")) | (F.col("l_discount") < 0.005)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("mask_in_notin", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3) AND c_acctbal > 0")
def mask_in_notin(spark: SparkSession, d: str) -> DataFrame:
    df = C.mask(table(spark, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])
    df = C.mask(C.mask(df, "c_nationkey", [1, 2, 3], notin=True), "c_acctbal", 0, greater=True)
    return C.mask(df, "c_nationkey", [7]).select("c_custkey", "c_mktsegment")  # a list of one value tests nothing


@query(
    "chained_isin_nlargest",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice IN (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 25) OR o_totalprice IN (SELECT o_totalprice FROM orders ORDER BY o_totalprice LIMIT 10)",
)
def chained_isin_nlargest(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return R.chained_isin(orders, "o_totalprice", nlargest=25).union(R.chained_isin(orders, "o_totalprice", nsmallest=10)).distinct()


@query("chained_isin_gaps", "SELECT s_suppkey, CASE WHEN nxt IS NULL THEN 1 ELSE s_suppkey - nxt END AS idx_diff FROM (SELECT s_suppkey, lead(s_suppkey) OVER (ORDER BY s_suppkey) AS nxt FROM supplier)")
def chained_isin_gaps(spark: SparkSession, d: str) -> DataFrame:
    return R.gaps_to_next(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey")


@query("order_gaps", "SELECT o_orderkey, CASE WHEN nxt IS NULL THEN 1 ELSE o_orderkey - nxt END AS idx_diff FROM (SELECT o_orderkey, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS nxt FROM orders WHERE o_orderstatus = 'F')")
def order_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The same over a table of facts, in parts of 1,000 rows."""
    return R.gaps_to_next(table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", part_rows=1000)


@query("between_inclusive", "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0) BETWEEN 0.02 AND 0.04, false) AS mid FROM lineitem")
def between_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.between_or_false(F.nullif("l_discount", F.lit(0.0)), 0.02, 0.04).alias("mid"))


@query("any_all_flags", "SELECT p_partkey, (p_size < 5 OR p_retailprice > 1500 OR p_type LIKE 'PROMO%')::INT AS any_flag, (p_size < 25 AND p_retailprice > 1000)::INT AS all_flag FROM part")
def any_all_flags(spark: SparkSession, d: str) -> DataFrame:
    any_flag = C.any_of([F.col("p_size") < 5, F.col("p_retailprice") > 1500, F.col("p_type").startswith("PROMO")])
    all_flag = C.all_of([F.col("p_size") < 25, F.col("p_retailprice") > 1000])
    return table(spark, d, "part").select("p_partkey", any_flag.cast("int").alias("any_flag"), all_flag.cast("int").alias("all_flag"))


@query("conditional_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size_class FROM orders")
def conditional_case(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("o_totalprice") > 300000, "large").when(F.col("o_totalprice") > 100000, "mid").otherwise("small")
    return table(spark, d, "orders").select("o_orderkey", size.alias("size_class"))


@query(
    "null_fill_forward",
    "SELECT event_id, user_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS filled, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS back_filled FROM (SELECT *, CASE WHEN event_type = 'purchase' OR event_id % 3 = 0 THEN value END AS v FROM events)",
)
def null_fill_forward(spark: SparkSession, d: str) -> DataFrame:
    v = F.when((F.col("event_type") == "purchase") | (F.col("event_id") % 3 == 0), F.col("value"))
    w = Window.partitionBy("user_id").orderBy("ts")
    forward = F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first("v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return table(spark, d, "events").withColumn("v", v).select("event_id", "user_id", F.coalesce(forward, F.lit(0.0)).alias("filled"), back.alias("back_filled"))


@query("drop_null_rows", "SELECT l_orderkey, l_linenumber, d FROM (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.0) AS d, nullif(l_tax, 0.0) AS t FROM lineitem) WHERE d IS NOT NULL AND t IS NOT NULL")
def drop_null_rows(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("d"), F.nullif("l_tax", F.lit(0.0)).alias("t"))
    return df.dropna(subset=["d", "t"]).drop("t")


@query("drop_sparse_columns", "SELECT doc_id, lang FROM documents")
def drop_sparse_columns(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 10 == 0, F.col("source")).alias("sparse"), F.lit(None).cast("string").alias("empty"))
    return C.drop_sparse(df, 0.75)


@query("round_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8, 1) AS q FROM lineitem")
def round_half_even(spark: SparkSession, d: str) -> DataFrame:
    return C.round_cols(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 8).alias("q")), ["q"], 1)


@query("perc_change_safe_ratio", "SELECT s_suppkey, (s_acctbal - s_nationkey) / nullif(CAST(s_nationkey AS DOUBLE), 0) AS chg, s_acctbal / CASE WHEN s_nationkey = 0 THEN 1 ELSE s_nationkey END AS ratio FROM supplier", "chg ratio")
def perc_change_safe_ratio(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("s_nationkey").cast("double"), F.col("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", C.perc_change(a, b).alias("chg"), C.safe_ratio(b, a).alias("ratio"))


@query("finite_or_zero", "SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 0 ELSE c_acctbal / c_nationkey END AS r FROM customer", "r")
def finite_or_zero(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", C.finite(F.try_divide(F.col("c_acctbal"), F.col("c_nationkey"))).alias("r"))


@query(
    "combine_duplicate_columns",
    "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, o_max, 0) AS worth FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS o_max FROM orders GROUP BY 1) ON c_custkey = o_custkey",
)
def combine_duplicate_columns(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("worth_x"))
    right = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("worth_y"))
    return C.combine_duplicates(left.join(right, "c_custkey", "left"), ["worth"], default=0.0)


@query("null_safe_equal", "SELECT a.doc_id, (a.v IS NOT DISTINCT FROM a.w)::INT AS same FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS v, CASE WHEN doc_id % 3 = 0 THEN lang END AS w FROM documents) a")
def null_safe_equal(spark: SparkSession, d: str) -> DataFrame:
    v, w = F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.when(F.col("doc_id") % 3 == 0, F.col("lang"))
    return table(spark, d, "documents").select("doc_id", C.same(v, w).cast("int").alias("same"))


@query("row_template", "SELECT o_orderkey, 'order ' || o_orderkey || ' is ' || o_orderstatus || ' (' || o_orderpriority || ')' AS line FROM orders")
def row_template(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.format_string("order %d is %s (%s)", "o_orderkey", "o_orderstatus", "o_orderpriority").alias("line"))


@query("narrow_types", "SELECT p_partkey, CAST(p_size AS TINYINT) AS p_size FROM part")
def narrow_types(spark: SparkSession, d: str) -> DataFrame:
    from barwright.functions.types import shrink

    return shrink(table(spark, d, "part").select("p_partkey", "p_size"), ["p_size"])


# joins


@query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query(
    "join_composite",
    "SELECT a.l_suppkey, a.m, a.q, b.n FROM (SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE AS m, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) a JOIN (SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE AS m, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b ON a.l_suppkey = b.l_suppkey AND a.m = b.m",
)
def join_composite(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_suppkey", F.trunc("l_shipdate", "month").alias("m"), "l_quantity", "l_returnflag")
    a = lines.where("l_returnflag = 'A'").groupBy("l_suppkey", "m").agg(F.sum("l_quantity").alias("q"))
    b = lines.where("l_returnflag = 'R'").groupBy("l_suppkey", "m").agg(F.count("*").alias("n"))
    return a.join(b, ["l_suppkey", "m"])


@query("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))  # aggregated before the join
    return table(spark, d, "customer").select("c_custkey").join(counts, "c_custkey", "left").fillna(0, ["n"])


@query("join_right", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_suppkey")


_YEARS = "SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = "


@query(
    "join_full_indicator",
    f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS side FROM ({_YEARS} 1995) a FULL JOIN ({_YEARS} 1996) b ON a.k = b.k",
)
def join_full_indicator(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    year = lambda y: orders.where((F.col("o_orderdate") >= f"{y}-01-01") & (F.col("o_orderdate") < f"{y + 1}-01-01")).select(F.col("o_custkey").alias("k")).distinct()
    a, b = year(1995).withColumn("in_a", F.lit(True)), year(1996).withColumn("in_b", F.lit(True))
    side = F.when(F.col("in_b").isNull(), "left_only").when(F.col("in_a").isNull(), "right_only").otherwise("both")
    return a.join(b, "k", "full").select("k", side.alias("side"))


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("join_semi", "SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    sold = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_name").join(sold, "p_partkey", "left_semi")


@query("join_case_folded", "SELECT a.n_name AS name, b.r_name AS region FROM nation a JOIN region b ON lower(substr(a.n_name, 1, 1)) = lower(substr(b.r_name, 1, 1))")
def join_case_folded(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, F.lower(F.substring("n_name", 1, 1)) == F.lower(F.substring("r_name", 1, 1))).select(F.col("n_name").alias("name"), F.col("r_name").alias("region"))


@query(
    "join_chain_index",
    "SELECT s_suppkey, n_name, r_name, q FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey",
)
def join_chain_index(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").alias("q"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(sums, "s_suppkey", "left").select("s_suppkey", "n_name", "r_name", "q")


@query("join_self_max", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_totalprice = m")
def join_self_max(spark: SparkSession, d: str) -> DataFrame:
    return R.max_rows(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice")


@query(
    "join_residual_range",
    "SELECT a.o_custkey, a.o_orderkey, count(b.o_orderkey) AS later_cheaper FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_totalprice < a.o_totalprice GROUP BY 1, 2",
)
def join_residual_range(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    a, b = o.alias("a"), o.alias("b")
    on = (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("b.o_orderdate") > F.col("a.o_orderdate")) & (F.col("b.o_totalprice") < F.col("a.o_totalprice"))
    return a.join(b, on, "left").groupBy("a.o_custkey", "a.o_orderkey").agg(F.count("b.o_orderkey").alias("later_cheaper"))


@query(
    "join_dict_map",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS status FROM orders",
)
def join_dict_map(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("F", "filled", "O", "open", "P", "partial")])
    return table(spark, d, "orders").select("o_orderkey", F.try_element_at(names, F.col("o_orderstatus")).alias("status"))


@query(
    "join_followers",
    "SELECT a.o_orderkey, b.o_orderkey AS o_orderkey_ne FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') a LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate",
)
def join_followers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    entries, others = o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("o_orderkey_ne"), "o_custkey", "o_orderdate")
    return entries.join(others, ["o_custkey", "o_orderdate"], "left").select("o_orderkey", "o_orderkey_ne")


@query(
    "join_positional_zip",
    "SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier) JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) USING (rn)",
)
def join_positional_zip(spark: SparkSession, d: str) -> DataFrame:
    bins = R.numbered(table(spark, d, "supplier").select("s_suppkey"), [("s_suppkey", False)])
    proxies = R.numbered(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [("c_acctbal", True), ("c_custkey", False)], part_rows=500)
    return bins.join(proxies, "rn").select("s_suppkey", "c_custkey")


@query("join_not_in_manifest", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def join_not_in_manifest(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, d, "lineitem").select("l_suppkey").distinct().join(done, "l_suppkey", "left_anti")


# aggregation


@query("agg_sum_mean", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, avg(l_extendedprice) AS avg_price, max(l_discount) AS max_disc, min(l_tax) AS min_tax, count(*) AS n FROM lineitem GROUP BY 1, 2", "avg_price")
def agg_sum_mean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.avg("l_extendedprice").alias("avg_price"), F.max("l_discount").alias("max_disc"), F.min("l_tax").alias("min_tax"), F.count("*").alias("n")
    )


@query("agg_sum_null_is_zero", "SELECT c_mktsegment, coalesce(sum(CASE WHEN c_acctbal > 9900 THEN 1 END), 0)::BIGINT AS rich FROM customer GROUP BY 1")
def agg_sum_null_is_zero(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.coalesce(F.sum(F.when(F.col("c_acctbal") > 9900, 1)), F.lit(0)).alias("rich"))


@query(
    "agg_sum_mean_disjoint",
    "SELECT o_custkey, sum((o_orderstatus = 'F')::INT)::BIGINT AS filled, sum((o_orderpriority = '1-URGENT')::INT)::BIGINT AS urgent, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1 HAVING sum((o_orderstatus = 'F')::INT) <> 0 OR sum((o_orderpriority = '1-URGENT')::INT) <> 0",
    "mean_price",
)
def agg_sum_mean_disjoint(spark: SparkSession, d: str) -> DataFrame:
    filled, urgent = (F.col("o_orderstatus") == "F").cast("int"), (F.col("o_orderpriority") == "1-URGENT").cast("int")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(filled).alias("filled"), F.sum(urgent).alias("urgent"), F.avg("o_totalprice").alias("mean_price")).where("filled <> 0 OR urgent <> 0")


@query("value_counts", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.value_counts(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@query("value_counts_share", "SELECT source, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY 1", "share", 9)
def value_counts_share(spark: SparkSession, d: str) -> DataFrame:
    return R.value_counts(table(spark, d, "documents"), "source", normalize=True)


@query("having_count", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1)")
def having_count(spark: SparkSession, d: str) -> DataFrame:
    return R.drop_all_duplicates(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"])


@query("collect_list_sorted", "SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS keys FROM orders GROUP BY 1")
def collect_list_sorted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("keys"))


@query("distinct_counts", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_shipdate::DATE) AS days FROM lineitem GROUP BY 1")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct(F.to_date("l_shipdate")).alias("days"))


@query("latest_rows", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def latest_rows(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return orders.join(F.broadcast(orders.agg(F.max("o_orderdate").alias("o_orderdate"))), "o_orderdate")


@query(
    "describe_by_group",
    'SELECT l_returnflag, count(l_extendedprice) AS "count", avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS std, min(l_extendedprice) AS "min", quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.75) AS p75, max(l_extendedprice) AS "max" FROM lineitem GROUP BY 1',
    "mean std p25 p50 p75",
)
def describe_by_group(spark: SparkSession, d: str) -> DataFrame:
    return R.describe(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("skew_corrected", "SELECT event_type, skewness(value) AS skew FROM events GROUP BY 1", "skew", 5)
def skew_corrected(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(R.skew(F.col("value")).alias("skew"))


@query(
    "null_profile",
    "SELECT 'o_orderkey' AS \"column\", count(o_orderkey) AS non_null, 1 - count(o_orderkey) / count(*) AS null_share FROM orders UNION ALL SELECT 'urgent_price', count(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END), 1 - count(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) / count(*) FROM orders",
    "null_share",
)
def null_profile(spark: SparkSession, d: str) -> DataFrame:
    return R.profile(table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).alias("urgent_price")))


@query(
    "quantile_cutoff",
    "WITH s AS (SELECT l_suppkey, stddev_samp(l_extendedprice) AS std FROM lineitem GROUP BY 1) SELECT l_suppkey FROM s WHERE std > (SELECT quantile_cont(std, 0.25) FROM s)",
)
def quantile_cutoff(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.stddev_samp("l_extendedprice").alias("std"))
    cut = s.agg(F.percentile("std", 0.25).alias("cut"))
    return s.crossJoin(F.broadcast(cut)).where("std > cut").select("l_suppkey")


@query(
    "row_argmin",
    "SELECT p_partkey, CASE WHEN a <= b AND a <= c THEN 'lvl_1000' WHEN b <= c THEN 'lvl_1250' ELSE 'lvl_1500' END AS nearest, least(a, b, c) AS dist FROM (SELECT p_partkey, abs(p_retailprice - 1000) AS a, abs(p_retailprice - 1250) AS b, abs(p_retailprice - 1500) AS c FROM part)",
    "dist",
)
def row_argmin(spark: SparkSession, d: str) -> DataFrame:
    levels = F.array(*[F.struct(F.abs(F.col("p_retailprice") - x).alias("dist"), F.lit(f"lvl_{x}").alias("name")) for x in (1000, 1250, 1500)])
    return table(spark, d, "part").select("p_partkey", F.array_min(levels).alias("m")).select("p_partkey", F.col("m.name").alias("nearest"), F.col("m.dist").alias("dist"))


@query("concat_columns", "SELECT c_custkey, c_mktsegment || '-' || c_nationkey AS code FROM customer")
def concat_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("code"))


@query("coverage_percent", "SELECT count(DISTINCT l.doc_id) * 100.0 / count(DISTINCT d.doc_id) AS coverage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "coverage")
def coverage_percent(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("has")).distinct(), "doc_id", "left")
    return joined.agg((F.count("has") * 100.0 / F.count("*")).alias("coverage"))


@query("count_ratio", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS returned FROM lineitem GROUP BY 1", "returned", 9)
def count_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("returned"))


@query("rollup_totals", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))


# sort, limit, top-k


@query("topk_price", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def topk_price(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("head_by_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def head_by_group(spark: SparkSession, d: str) -> DataFrame:
    first = F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))  # no sort, partial minima
    return table(spark, d, "orders").groupBy("o_custkey").agg(first.alias("o_orderkey"))


@query("top3_values", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 3")
def top3_values(spark: SparkSession, d: str) -> DataFrame:
    return R.value_counts(table(spark, d, "documents"), "source").orderBy(F.desc("n"), "source").limit(3)


@query("sorted_rank", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer")
def sorted_rank(spark: SparkSession, d: str) -> DataFrame:
    return R.numbered(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [("c_acctbal", True), ("c_custkey", False)], "place", part_rows=500).select("c_custkey", "place")


@query("sorted_rank_lines", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem")
def sorted_rank_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return R.numbered(lines, [("l_extendedprice", True), ("l_orderkey", False), ("l_linenumber", False)], "place", part_rows=5000).select("l_orderkey", "l_linenumber", "place")


# set operations


@query("union_by_name", "SELECT s_name AS name, s_acctbal AS bal, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return s.unionByName(c, allowMissingColumns=True)


_A, _B = "SELECT DISTINCT l_suppkey AS k, l_partkey AS p FROM lineitem WHERE l_returnflag = 'A'", "SELECT DISTINCT l_suppkey AS k, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, d, "lineitem")
    return tuple(lines.where(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("p")) for f in ("A", "R"))


@query("union_distinct", f"{_A} UNION {_B}")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return a.union(b).distinct()


@query("set_except", f"{_A} EXCEPT {_B}")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return a.subtract(b)


@query("set_intersect", f"{_A} INTERSECT {_B}")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return a.intersect(b)


@query("set_symmetric_difference", f"({_A} EXCEPT {_B}) UNION ALL ({_B} EXCEPT {_A})")
def set_symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    return R.symmetric_difference(*_sides(spark, d))


@query("drop_duplicates_keep_last", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def drop_duplicates_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return R.first_by(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


# reshaping


@query("pivot_counts", "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{e}') AS {e}" for e in ("click", "purchase", "view")) + " FROM events GROUP BY 1")
def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.count(F.lit(1))).fillna(0)


@query("unpivot_prices", "SELECT l_orderkey, l_linenumber, l_partkey, 'disc' AS col, l_discount AS val FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'tax', l_tax FROM lineitem")
def unpivot_prices(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"))
    return df.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["disc", "tax"], "col", "val")


@query("explode_words", "SELECT event_id, w FROM (SELECT event_id, unnest(string_split(event_type || ' ' || props, ' ')) AS w FROM events)")
def explode_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.explode(F.split(F.concat_ws(" ", "event_type", "props"), " ")).alias("w"))


@query("json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("onehot_priority", "SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::INT AS st_{v}" for v in "FOP") + " FROM orders")
def onehot_priority(spark: SparkSession, d: str) -> DataFrame:
    return R.one_hot(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", list("FOP"), "st_").drop("o_orderstatus")


@query("factorize_decode", "SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def factorize_decode(spark: SparkSession, d: str) -> DataFrame:
    coded, dictionary = R.factorize(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
    return coded.drop("c_mktsegment").join(F.broadcast(dictionary), "code").select("c_custkey", "c_mktsegment", F.col("code").cast("long").alias("code"))


@query("frequency_encode", "SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS code FROM documents GROUP BY 1")
def frequency_encode(spark: SparkSession, d: str) -> DataFrame:
    return R.frequency_codes(table(spark, d, "documents"), "source").withColumn("code", F.col("code").cast("long"))


@query(
    "equal_bins",
    "SELECT o_orderkey, greatest(1, ceil(rn0 * greatest(n // 40, 1) / greatest(n - 1, 1)))::INT AS bin FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS rn0, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS n FROM orders)",
)
def equal_bins(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    return R.equal_bins(orders, ["o_orderpriority", "o_orderstatus"], [F.col("o_orderdate"), F.col("o_orderkey")], 40).select("o_orderkey", "bin")


@query("split_expand", "SELECT c_custkey, split_part(c_name, '#', 1) AS head, split_part(c_name, '#', 2) AS tail FROM customer")
def split_expand(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(1)).alias("head"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("tail"))
