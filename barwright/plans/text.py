"""Queries of text extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import text as X
from barwright.plans.registry import query, table

#: Messages made from orders, as documents hold no tickers.
MESSAGES = """messages AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'RT @user' || (o_custkey % 9) || ': ' ELSE '' END || 'bought $SYM' || chr(65 + (o_custkey % 26)::INT) || ' ' || (o_orderkey % 300) || 'c and $ZZ' || ' ' || (o_custkey % 50) || '.5p #tag' || (o_orderkey % 7)
 || CASE WHEN o_orderkey % 5 = 0 THEN ' | sold $QQ calls | WATCHING' ELSE '' END || CASE WHEN o_orderkey % 4 = 0 THEN chr(10) || 'A | b | c' ELSE '' END AS text, o_orderdate AS ts FROM orders)"""


def _messages(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    text = F.concat(
        F.when(k % 3 == 0, F.concat(F.lit("RT @user"), s(c % 9), F.lit(": "))).otherwise(""), F.lit("bought $SYM"), F.char((65 + c % 26).cast("int")), F.lit(" "), s(k % 300), F.lit("c and $ZZ "), s(c % 50), F.lit(".5p #tag"), s(k % 7),
        F.when(k % 5 == 0, " | sold $QQ calls | WATCHING").otherwise(""), F.when(k % 4 == 0, "\nA | b | c").otherwise(""),
    )
    return table(spark, d, "orders").select(k.alias("id"), text.alias("text"), F.col("o_orderdate").alias("ts"))


def with_messages(sql: str) -> str:
    return f"WITH {MESSAGES} {sql}"


@query("retweet_flags", with_messages("SELECT id, regexp_matches(text, '^RT @') AS rt, nullif(regexp_extract(text, '^RT @([A-Za-z0-9_]+)', 1), '') AS source FROM messages"))
def retweet_flags(spark: SparkSession, d: str) -> DataFrame:
    rt, source = X.retweet(F.col("text"))
    return _messages(spark, d).select("id", rt.alias("rt"), source.alias("source"))


_CALL, _PUT = r"(?i)\b[0-9]+(?:[.][0-9]+)?c\b|\bcalls?\b", r"(?i)\b[0-9]+(?:[.][0-9]+)?p\b|\bputs?\b"


@query("calls_puts", with_messages(f"SELECT id, regexp_matches(text, '{_CALL}') AS calls, regexp_matches(text, '{_PUT}') AS puts FROM messages"))
def calls_puts(spark: SparkSession, d: str) -> DataFrame:
    calls, puts = X.calls_puts(F.col("text"))
    return _messages(spark, d).select("id", calls.alias("calls"), puts.alias("puts"))


@query(
    "token_extract",
    with_messages(f"SELECT id, array_to_string(regexp_extract_all(text, '{X.TICKER}'), ' ') AS symbols, array_to_string(regexp_extract_all(text, '{X.HASHTAG}'), ' ') AS tags, len(regexp_extract_all(text, '{X.NUMBER}'))::INT AS n_numbers FROM messages"),
)
def token_extract(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _messages(spark, d).select("id", F.array_join(X.all_matches(t, X.TICKER), " ").alias("symbols"), F.array_join(X.all_matches(t, X.HASHTAG), " ").alias("tags"), X.count_matches(t, X.NUMBER).alias("n_numbers"))


_STRIKES = r"strikes AS (SELECT id, unnest(regexp_extract_all(text, '([0-9]+(?:[.][0-9]+)?[cpCP])\b', 1)) AS tok FROM messages), sides AS (SELECT id, left(tok, -1)::DOUBLE AS strike, upper(right(tok, 1)) AS side FROM strikes)"


@query("strike_extract", with_messages(f", {_STRIKES} SELECT * FROM sides WHERE (strike * 2 = floor(strike * 2) AND strike BETWEEN 0.5 AND 249.5) OR (strike = floor(strike) AND strike BETWEEN 1 AND 49999)"))
def strike_extract(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("id", F.inline(X.strikes(F.col("text"))))


@query(
    "trade_flags",
    with_messages(r"SELECT id, regexp_matches(text, '(?i)\b(?:watch(?:list|ing)?)\b') AS watch, regexp_matches(text, '(?i)\b(?:lottos?)\b') AS lotto, regexp_matches(text, '(?i)\b(?:sold|closed|out of|trimmed|exit(?:ed)?)\b') AS exit, regexp_matches(text, '(?i)\b(?:bought|long|entry|entered|in at)\b') AS entry FROM messages"),
)
def trade_flags(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("id", *[c.alias(n) for n, c in X.trade_flags(F.col("text")).items()])


@query(
    "trade_codes",
    with_messages(
        f", {_STRIKES}, c AS (SELECT id, 'ZZ_' || side || '_' || strftime(ts, '%Y%m%d') || '_' || printf('%.1f', strike) AS tcode FROM sides JOIN messages USING (id)) SELECT id, tcode, split_part(tcode, '_', 2) AS side, strptime(split_part(tcode, '_', 3), '%Y%m%d')::DATE AS expires, split_part(tcode, '_', 4)::DOUBLE AS strike FROM c"
    ),
)
def trade_codes(spark: SparkSession, d: str) -> DataFrame:
    tokens = _messages(spark, d).withColumn("s", F.explode(F.transform(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:[.][0-9]+)?[cpCP])\b"), 1), lambda t: F.struct(F.substr(t, F.lit(1), F.length(t) - 1).cast("double").alias("strike"), F.upper(F.right(t, F.lit(1))).alias("side")))))
    code = X.trade_code(F.lit("ZZ"), F.col("s.side"), F.to_date("ts"), F.col("s.strike"))
    parsed = X.parse_trade_code(F.col("tcode"))
    return tokens.select("id", code.alias("tcode")).select("id", "tcode", parsed["side"].alias("side"), parsed["expires"].alias("expires"), parsed["strike"].alias("strike"))


@query("trade_pairs", with_messages(", e AS (SELECT regexp_extract(text, '[$]SYM[A-Z]', 0) AS code, min(ts) AS entered_at FROM messages GROUP BY 1), x AS (SELECT regexp_extract(text, '[$]SYM[A-Z]', 0) AS code, min(ts) AS exit_at FROM messages WHERE regexp_matches(text, 'sold') GROUP BY 1) SELECT e.code, entered_at, exit_at FROM e LEFT JOIN x ON e.code = x.code AND exit_at > entered_at"))
def trade_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).withColumn("code", F.regexp_extract("text", "[$]SYM[A-Z]", 0))
    first = m.groupBy("code").agg(F.min("ts").alias("entered_at"), F.min(F.when(X.has(F.col("text"), "sold", False), F.col("ts"))).alias("x"))
    return first.select("code", "entered_at", F.when(F.col("x") > F.col("entered_at"), F.col("x")).alias("exit_at"))


@query("watchlist_parse", with_messages(", l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM messages) SELECT id, line_no::INT AS line_no, trim(split_part(line, '|', 1)) AS first, trim(split_part(line, '|', 2)) AS second, trim(split_part(line, '|', 3)) AS third FROM l WHERE len(regexp_extract_all(line, '[|]')) >= 2"))
def watchlist_parse(spark: SparkSession, d: str) -> DataFrame:
    return X.watchlist_lines(_messages(spark, d), "id", "text")


@query("watchlist_detect", with_messages(r"SELECT id, len(regexp_extract_all(text, '[$][A-Za-z]{1,5}')) >= 3 AND len(regexp_extract_all(text, '(?i)\bcalls?\b|[0-9]c\b')) > 1 AND len(regexp_extract_all(text, '(?i)\bputs?\b|[0-9]p\b')) > 1 AS is_list FROM messages"))
def watchlist_detect(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("id", X.watchlist(F.col("text")).alias("is_list"))


@query(
    "watchlist_performance",
    "SELECT s_suppkey, day, CASE WHEN h > c AND l < p THEN 'both' WHEN h > c THEN 'call' WHEN l < p THEN 'put' ELSE 'none' END AS hit, CASE WHEN h > c THEN h - c WHEN l < p THEN p - l END AS price_diff FROM (SELECT l_suppkey AS s_suppkey, l_shipdate::DATE AS day, max(l_extendedprice) AS h, min(l_extendedprice) AS l, 60000.0::DOUBLE AS c, 20000.0::DOUBLE AS p FROM lineitem GROUP BY 1, 2)",
)
def watchlist_performance(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), F.to_date("l_shipdate").alias("day")).agg(F.max("l_extendedprice").alias("h"), F.min("l_extendedprice").alias("l"))
    call, put = F.col("h") > 60000.0, F.col("l") < 20000.0
    hit = F.when(call & put, "both").when(call, "call").when(put, "put").otherwise("none")
    return days.select("s_suppkey", "day", hit.alias("hit"), F.when(call, F.col("h") - 60000.0).when(put, 20000.0 - F.col("l")).alias("price_diff"))


_CAPS = r"list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '')"


@query("caps_share", f"SELECT doc_id, coalesce(len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) / nullif(len(w), 0), 0) AS caps FROM (SELECT doc_id, {_CAPS} AS w FROM documents)", "caps", 9)
def caps_share(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.uppercase_share(F.col("text")).alias("caps"))


@query(
    "mention_counts",
    f"WITH calm AS (SELECT doc_id, text, {_CAPS} AS w FROM documents), kept AS (SELECT doc_id, text FROM calm WHERE coalesce(len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) / nullif(len(w), 0), 0) <= 0.75), words AS (SELECT DISTINCT doc_id, unnest(string_split_regex(text, '[^A-Za-z0-9]+')) AS symbol FROM kept) SELECT symbol, count(*) AS mentions FROM words WHERE symbol IN ('The', 'Is', 'Anat', 'and', 'Der') AND symbol <> 'and' GROUP BY 1",
)
def mention_counts(spark: SparkSession, d: str) -> DataFrame:
    symbols = spark.createDataFrame([(x,) for x in ("The", "Is", "Anat", "and", "Der")], "symbol string")
    return X.mention_counts(table(spark, d, "documents").select("doc_id", "text"), "text", symbols, ("and",), per="doc_id")


@query("phrase_window", "SELECT doc_id, CASE WHEN a > 0 THEN substr(text, greatest(a - 20, 1), a - greatest(a - 20, 1) + 40) END AS near FROM (SELECT doc_id, text, strpos(text, 'of the') AS a FROM documents)")
def phrase_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.phrase_window(F.col("text"), "of the", 20, 40).alias("near"))


@query("universe_filter", "SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '(?i)" + "|".join(X.FUND_WORDS) + "') AND p_type NOT IN ('PROMO BRUSHED')")
def universe_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(X.common_stock(F.col("p_name")) & ~F.col("p_type").isin("PROMO BRUSHED")).select("p_partkey", "p_name")


@query("clean_numbers", "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE round(c_acctbal, 2) END AS v FROM customer")
def clean_numbers(spark: SparkSession, d: str) -> DataFrame:
    bal = F.format_number(F.abs("c_acctbal"), 2)
    shown = F.when(F.col("c_custkey") % 11 == 0, "N/A").when(F.col("c_acctbal") < 0, F.concat(F.lit("($"), bal, F.lit(")"))).otherwise(F.concat(F.lit("$"), bal))
    return table(spark, d, "customer").select("c_custkey", X.number_of(shown).alias("v"))


@query("morning_night", "SELECT event_id, CASE WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) > 12 THEN 'night' END AS part FROM events")
def morning_night(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", X.morning_night(F.col("ts")).alias("part"))


@query("regex_flags", "SELECT conv_id, turn, regexp_matches(text, '(?i)crypto|bitcoin|the') AS crypto, len(regexp_extract_all(text, '[.]'))::INT AS sentences FROM conversations")
def regex_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", X.has(t, "crypto|bitcoin|the").alias("crypto"), X.count_matches(t, "[.]").alias("sentences"))


@query("string_basics", "SELECT s_suppkey, lower(s_name) AS low, upper(s_name) AS up, length(s_name) AS n, lpad(s_suppkey::VARCHAR, 10, '0') AS cik, replace(s_name, 'Supplier', 'S') AS short, regexp_replace(s_name, '[^0-9]', '', 'g') AS digits FROM supplier")
def string_basics(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_name")
    return table(spark, d, "supplier").select(
        "s_suppkey", F.lower(n).alias("low"), F.upper(n).alias("up"), F.length(n).cast("long").alias("n"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"), F.replace(n, F.lit("Supplier"), F.lit("S")).alias("short"), F.regexp_replace(n, "[^0-9]", "").alias("digits")
    )


@query("url_parts", "SELECT page_id, split_part(url, '/', 3) AS host, regexp_replace(url, '^https?://[^/]*', '') AS path FROM pages")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.split_part(u, F.lit("/"), F.lit(3)).alias("host"), F.regexp_replace(u, "^https?://[^/]*", "").alias("path"))


@query("array_ops", "SELECT user_id, len(l) AS n, array_to_string(list_sort(list_distinct(l)), ',') AS kinds, array_to_string(list_sort(list_distinct(list_filter(l, lambda x: x <> 'view'))), ',') AS rest FROM (SELECT user_id, list(event_type) AS l FROM events GROUP BY 1)")
def array_ops(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("l"))
    kinds = F.array_sort(F.array_distinct("l"))
    return lists.select("user_id", F.size("l").cast("long").alias("n"), F.array_join(kinds, ",").alias("kinds"), F.array_join(F.array_except(kinds, F.array(F.lit("view"))), ",").alias("rest"))
