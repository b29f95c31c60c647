"""Text extraction as column expressions; patterns are free of look-around, so every engine reads them alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TICKER, HASHTAG, NUMBER = "[$][A-Za-z]{1,5}", "#[A-Za-z0-9_]+", r"[0-9]+(?:[.][0-9]+)?"
#: Words of names that are no common stock.
FUND_WORDS = ("fund", "trust", "acquisition", "etf", "index", "bond", "income", "portfolio")


def all_matches(text: Column, pattern: str) -> Column:
    """All matches as an array; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), 1)


def count_matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def has(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whether a pattern occurs; null counts as no."""
    return F.coalesce(F.rlike(text, F.lit(("(?i)" if ignore_case else "") + pattern)), F.lit(False))


def retweet(text: Column) -> tuple[Column, Column]:
    """Whether a message repeats another's, and whose."""
    return has(text, "^RT @", False), F.nullif(F.regexp_extract(text, "^RT @([A-Za-z0-9_]+)", 1), F.lit(""))


def calls_puts(text: Column) -> tuple[Column, Column]:
    """Whether calls (a number with c, or the word) and puts are mentioned."""
    return has(text, r"\b[0-9]+(?:[.][0-9]+)?c\b|\bcalls?\b"), has(text, r"\b[0-9]+(?:[.][0-9]+)?p\b|\bputs?\b")


def valid_strike(x: Column) -> Column:
    """Halves from 0.5 to 249.5, or whole numbers from 1 to 49999."""
    return F.coalesce(((x * 2 == F.floor(x * 2)) & x.between(0.5, 249.5)) | ((x == F.floor(x)) & x.between(1, 49999)), F.lit(False))


def strikes(text: Column) -> Column:
    """Array of (strike, side) of tokens such as 120c or 7.5p with a valid strike."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]+(?:[.][0-9]+)?[cpCP])\b"), 1)
    parts = F.transform(tokens, lambda t: F.struct(F.substr(t, F.lit(1), F.length(t) - 1).try_cast("double").alias("strike"), F.upper(F.right(t, F.lit(1))).alias("side")))
    return F.filter(parts, lambda p: valid_strike(p["strike"]))


def trade_flags(text: Column) -> dict[str, Column]:
    """watch, lotto, exit, entry: whether words of each kind occur."""
    #: The words of each kind.
    words = {"watch": "watch(?:list|ing)?", "lotto": "lottos?", "exit": "sold|closed|out of|trimmed|exit(?:ed)?", "entry": "bought|long|entry|entered|in at"}
    return {k: has(text, rf"\b(?:{w})\b") for k, w in words.items()}


def trade_code(symbol: Column, side: Column, expires: Column, strike: Column) -> Column:
    return F.concat_ws("_", symbol, side, F.date_format(expires, "yyyyMMdd"), F.format_string("%.1f", strike.cast("double")))


def parse_trade_code(code: Column) -> dict[str, Column]:
    part = lambda i: F.get(F.split(code, "_"), F.lit(i))
    return {"symbol": part(0), "side": part(1), "expires": F.try_to_timestamp(part(2), F.lit("yyyyMMdd")).cast("date"), "strike": part(3).try_cast("double")}


def watchlist(text: Column) -> Column:
    """Whether a message is a list of ideas: three tickers or more, with more than one call and more than one put."""
    return (count_matches(text, TICKER) >= 3) & (count_matches(text, r"(?i)\bcalls?\b|[0-9]c\b") > 1) & (count_matches(text, r"(?i)\bputs?\b|[0-9]p\b") > 1)


def watchlist_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, first, second, third: the lines of each message with two bars or more, split on '|'."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(count_matches(F.col("line"), "[|]") >= 2)
    part = lambda i: F.trim(F.split_part("line", F.lit("|"), F.lit(i)))
    return lines.select(key, "line_no", part(1).alias("first"), part(2).alias("second"), part(3).alias("third"))


def uppercase_share(text: Column) -> Column:
    """The share of words (split on white space) that are upper case throughout and have a letter; 0 without words."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r]+"), lambda w: w != "")
    caps = F.filter(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w))
    return F.coalesce(F.try_divide(F.size(caps).cast("double"), F.size(words).cast("double")), F.lit(0.0))


def mention_counts(messages: DataFrame, text: str, symbols: DataFrame, stop_words: Sequence[str] = (), most_caps: float = 0.75, per: str | None = None) -> DataFrame:
    """symbol, mentions: messages that mention each symbol as a word (once a message), messages in capitals left out.

    Words are joined to the symbols, a table of reference size, rather than matched by one large pattern.
    """
    calm = messages.where(uppercase_share(F.col(text)) <= most_caps)
    words = calm.select(F.col(per) if per else F.monotonically_increasing_id().alias("_id"), F.explode(F.array_distinct(F.split(text, "[^A-Za-z0-9]+"))).alias("symbol"))
    kept = words.where(~F.col("symbol").isin(list(stop_words)) & (F.col("symbol") != "")) if stop_words else words.where("symbol <> ''")
    return kept.join(F.broadcast(symbols.select("symbol").distinct()), "symbol").groupBy("symbol").agg(F.count("*").alias("mentions"))


def phrase_window(text: Column, phrase: str, before: int, after: int) -> Column:
    """What stands up to `before` characters ahead of a phrase's first occurrence and `after` behind its begin; null if it isn't there."""
    at = F.locate(phrase, text)
    begin = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substr(text, begin, at - begin + after))


def common_stock(name: Column) -> Column:
    """Whether a name holds none of the words of funds and shells."""
    return ~has(name, "|".join(FUND_WORDS))


def number_of(text: Column) -> Column:
    """A number from text such as '$1,234', '(0.12)', '5%', 'N/A': brackets are a minus sign; what is no number is null."""
    bare = F.regexp_replace(text, "[$,%() ]", "")
    value = bare.try_cast("double")
    return F.when(F.rlike(text, F.lit("^[ $]*[(]")), -value).otherwise(value)


def morning_night(ts: Column) -> Column:
    """morning before 12 o'clock, night after the hour of 12; null within that hour."""
    return F.when(F.hour(ts) < 12, "morning").when(F.hour(ts) > 12, "night")
