"""Queries that combine operators, and the smaller ones left over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import columns as C
from barwright.operators import fib as B
from barwright.operators import intraday as I
from barwright.operators import options as P
from barwright.operators import quality as Q
from barwright.operators import studies as S
from barwright.plans.bars import load, over
from barwright.plans.fib import _LEVELS, _input
from barwright.plans.options import _chain, with_chain
from barwright.plans.registry import query, table
from barwright.plans.studies import CHANGED


@query("sample_rows", "SELECT c_custkey FROM customer ORDER BY md5('7:' || c_custkey), c_custkey LIMIT 50")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    """A sample of n rows by a seeded order: a top-k, which sorts nothing whole."""
    return table(spark, d, "customer").select("c_custkey").orderBy(F.md5(F.concat(F.lit("7:"), F.col("c_custkey").cast("string"))), "c_custkey").limit(50)


@query("identical_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def identical_columns(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("copy"), F.lower(F.upper("o_orderstatus")).alias("other"))
    return C.drop_identical(df).select("o_orderkey", "o_orderstatus")


@query("drop_empty_family", "SELECT o_orderkey, 1 AS sym_1 FROM orders")
def drop_empty_family(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", F.lit(1).alias("sym_1"), F.lit(None).cast("int").alias("sym_2"), F.lit(None).cast("int").alias("sym_3"))
    return C.drop_empty(df, "sym_")


@query("url_encode", "SELECT s_suppkey, replace(replace(s_name || ' a&b', '&', '%26'), ' ', '+') AS u FROM (SELECT s_suppkey, replace(s_name, '#', '%23') AS s_name FROM supplier)")
def url_encode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", F.url_encode(F.concat("s_name", F.lit(" a&b"))).alias("u"))


@query("minute_clean", "SELECT event_id, date_trunc('minute', ts) AS dtime, value::FLOAT::DOUBLE AS price FROM events WHERE value IS NOT NULL AND value > 1")
def minute_clean(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH:mm").alias("minute"), F.when(F.col("value") > 1, F.col("value")).alias("value"))
    return I.clean_minutes(df, "date", "minute", "value").select("event_id", F.col("dtime").cast("timestamp_ntz").alias("dtime"), F.col("value").cast("double").alias("price"))


@query(
    "social_option_volume",
    with_chain(", m AS (SELECT o_custkey % 100 AS underlying, o_orderdate::DATE AS day FROM orders WHERE o_orderpriority = '1-URGENT') SELECT m.underlying, m.day, c.side, CASE WHEN c.expires - m.day < 45 THEN 'short' WHEN c.expires - m.day > 45 AND c.expires - m.day < 180 THEN 'med' WHEN c.expires - m.day > 180 THEN 'long' END AS horizon, sum(c.volume) AS volume FROM m JOIN chain c ON c.underlying = m.underlying AND c.date = date_trunc('month', m.day)::DATE GROUP BY 1, 2, 3, 4"),
)
def social_option_volume(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") % 100).alias("underlying"), F.to_date("o_orderdate").alias("day")).withColumn("date", F.trunc("day", "month"))
    j = m.join(_chain(spark, d), ["underlying", "date"])
    return j.groupBy("underlying", "day", "side", P.horizon(F.datediff("expires", "day")).alias("horizon")).agg(F.sum("volume").alias("volume"))


@query(
    "fib_view_clean",
    over("week", f", {CHANGED}, s AS (SELECT symbol, stddev_samp(fChangeP) AS std FROM changed GROUP BY 1) SELECT symbol, date, fChangeP FROM changed JOIN s USING (symbol) WHERE std > (SELECT quantile_cont(std, 0.25) FROM s) AND NOT (fChangeP < -0.9::DOUBLE OR fChangeP > 15)"),
    "fChangeP",
)
def fib_view_clean(spark: SparkSession, d: str) -> DataFrame:
    return Q.view_clean(S.change_pct(load(spark, d, "week"))).select("symbol", "date", "fChangeP")


@query(
    "fib_top_candidate",
    over("week", f", {_LEVELS} SELECT symbol, range, cond FROM lv ORDER BY perc_range DESC, symbol LIMIT 10"),
)
def fib_top_candidate(spark: SparkSession, d: str) -> DataFrame:
    return B.pipeline(_input(spark, d))[0].orderBy(F.desc("perc_range"), "symbol").limit(10).select("symbol", "range", "cond")


# models: next month's close from this month's close, its mean of ten and the volume

_FEATURES = ("fClose", "sma_10", "fVolume")
_SPLIT = """m AS (SELECT symbol, date, fClose, fVolume, CASE WHEN count(*) OVER w10 >= 10 THEN avg(fClose) OVER w10 END AS sma_10, lead(fClose) OVER w AS y, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date), w10 AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING)),
whole AS (SELECT [fClose, sma_10, fVolume]::DOUBLE[] AS x, y, CASE WHEN rn <= n - 3 * floor(n * 0.2::DOUBLE) THEN 'train' WHEN rn <= n - 2 * floor(n * 0.2::DOUBLE) THEN 'test' END AS split FROM m WHERE sma_10 IS NOT NULL AND y IS NOT NULL)"""
_METRICS = "SELECT sqrt(avg((y - p) ** 2)) AS rmse, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, avg((sign(y) = sign(p))::INT) AS sign_accuracy FROM predicted"


def _training(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = S.sma(load(spark, d, "month"), (10,)).withColumn("next", F.lead("fClose").over(S.W()))
    split = Q.time_split(df, ["symbol"], ["date"]).dropna(subset=[*_FEATURES, "next"])
    return split.where("split = 'train'"), split.where("split = 'test'")


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _linear_sql(ridge: float) -> str:
    """The three normal equations of standardised features by determinants."""
    r = [[f"({f'covar_pop(x[{i}], x[{j}]) / (stddev_pop(x[{i}]) * stddev_pop(x[{j}]))' if i != j else '1'} + {ridge if i == j else 0}::DOUBLE)" for j in (1, 2, 3)] for i in (1, 2, 3)]
    cols = ", ".join([f"{r[i][j]} AS r{i}{j}" for i in range(3) for j in range(3)] + [f"covar_pop(x[{i}], y) / stddev_pop(x[{i}]) AS b{i - 1}, stddev_pop(x[{i}]) AS s{i - 1}, avg(x[{i}]) AS m{i - 1}" for i in (1, 2, 3)])
    m = [[f"r{i}{j}" for j in range(3)] for i in range(3)]
    weight = lambda k: _det([[f"b{i}" if j == k else m[i][j] for j in range(3)] for i in range(3)]) + f" / {_det(m)} / s{k}"
    return f"""eq AS (SELECT {cols}, avg(y) AS my FROM whole WHERE split = 'train'), w AS (SELECT *, {', '.join(f'{weight(k)} AS w{k}' for k in range(3))} FROM eq),
predicted AS (SELECT y, my + w0 * (x[1] - m0) + w1 * (x[2] - m1) + w2 * (x[3] - m2) AS p FROM whole, w WHERE split = 'test')"""


@query("linear_model_metrics", over("month", f", {_SPLIT}, {_linear_sql(0.1)} {_METRICS}"), "rmse r2 sign_accuracy", 3)
def linear_model_metrics(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.models import linear

    train, test = _training(spark, d)
    return Q.regression_metrics(test.withColumn("_p", linear(train, _FEATURES, "next", ridge=0.1).predicted()), "next", "_p")


def _tree_sql(depth: int, bins: int) -> str:
    """The tree level by level: histograms of each node, the best cut, rows sent to the next level."""
    parts = [
        f"ends AS (SELECT {', '.join(f'min(x[{i}]) AS lo{i}, max(x[{i}]) AS hi{i}' for i in (1, 2, 3))} FROM whole WHERE split = 'train')",
        f"edges AS (SELECT [{', '.join(f'list_transform(range({bins}), lambda b: lo{i} + (hi{i} - lo{i}) * (b + 1) / {bins})' for i in (1, 2, 3))}] AS e FROM ends)",
        f"r0 AS (SELECT x, y, split, 1 AS node, (SELECT avg(y) FROM whole WHERE split = 'train') AS p, list_transform(range(3), lambda f: least(len(list_filter(e[f + 1], lambda t: t < x[f + 1])), {bins - 1})) AS b FROM whole, edges WHERE split IS NOT NULL)",
    ]
    for i in range(depth):
        parts += [
            f"h{i} AS (SELECT node, f, b[f + 1] AS bin, count(*)::DOUBLE AS n, sum(y) AS s FROM r{i}, unnest(range(3)) AS u(f) WHERE split = 'train' GROUP BY 1, 2, 3)",
            f"c{i} AS (SELECT node, f, bin, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER (PARTITION BY node, f) AS tn, sum(s) OVER (PARTITION BY node, f) AS ts FROM h{i} WINDOW w AS (PARTITION BY node, f ORDER BY bin))",
            f"g{i} AS (SELECT *, s * s / n + (ts - s) * (ts - s) / (tn - n) - ts * ts / tn AS gain FROM c{i} WHERE tn > n)",
            f"k{i} AS (SELECT node, f, bin, s / n AS yes, (ts - s) / (tn - n) AS no FROM g{i} WHERE gain > 1e-9 * greatest(1, ts * ts / tn) QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) = 1)",
            f"r{i + 1} AS (SELECT x, y, split, r.b, CASE WHEN k.node IS NULL THEN r.node ELSE 2 * r.node + CASE WHEN x[f + 1] <= e[f + 1][bin + 1] THEN 0 ELSE 1 END END AS node, CASE WHEN k.node IS NULL THEN p WHEN x[f + 1] <= e[f + 1][bin + 1] THEN yes ELSE no END AS p FROM r{i} r CROSS JOIN edges LEFT JOIN k{i} k ON k.node = r.node)",
        ]
    return ", ".join([*parts, f"predicted AS (SELECT y, p FROM r{depth} WHERE split = 'test')"])


@query("tree_model_metrics", over("month", f", {_SPLIT}, {_tree_sql(3, 16)} {_METRICS}"), "rmse r2 sign_accuracy", 3)
def tree_model_metrics(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.models import tree

    train, test = _training(spark, d)
    return Q.regression_metrics(test.withColumn("_p", tree(train, _FEATURES, "next", depth=3, bins=16).predicted()), "next", "_p")


def _lloyd_sql(k: int, rounds: int) -> str:
    """Round by round: rows to their nearest centre, centres to the means of their rows."""
    parts = [f"v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), m0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, x FROM (SELECT * FROM v ORDER BY vec_id LIMIT {k}))"]
    for i in range(rounds + 1):
        parts.append(f"p{i} AS (SELECT vec_id, any_value(v.x) AS x, arg_min(c, row(list_sum(list_transform(range(len(v.x)), lambda j: (v.x[j + 1] - m.x[j + 1]) * (v.x[j + 1] - m.x[j + 1]))), c)) AS c FROM v, m{i} m GROUP BY vec_id)")
        parts.append(f"a{i} AS (SELECT c, j, avg(x[j]) AS x FROM p{i}, unnest(range(1, len(x) + 1)) AS t(j) GROUP BY 1, 2), m{i + 1} AS (SELECT o.c, coalesce(n.x, o.x) AS x FROM m{i} o LEFT JOIN (SELECT c, list(x ORDER BY j) AS x FROM a{i} GROUP BY 1) n ON n.c = o.c)")
    return f"WITH {', '.join(parts)} SELECT vec_id, c::INT AS cluster FROM p{rounds}"


@query("embedding_clusters", _lloyd_sql(5, 4))
def embedding_clusters(spark: SparkSession, d: str) -> DataFrame:
    from barwright.operators.models import lloyd

    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    first = [r["embedding"] for r in vectors.orderBy("vec_id").limit(5).collect()]  # five rows
    return lloyd(vectors, "embedding", first, 4).select("vec_id", "cluster")


@query("approximate_aggregates", None)
def approximate_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("median"))


@query("cube_totals", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("volume_weighted_by_session", "SELECT user_id, ts::DATE AS day, hour(ts) * 60 + minute(ts) BETWEEN 570 AND 960 AS in_session, sum(value) AS total FROM events GROUP BY 1, 2, 3", "total")
def volume_weighted_by_session(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"), I.session(F.col("ts")).alias("in_session")).agg(F.sum("value").alias("total"))
