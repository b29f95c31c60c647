"""Analyst ratings: missing actions filled in, price targets as numbers, flags and classes of words, one row a symbol and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Actions on price targets that are known, what a company's action stands for where they are missing, and the
#: actions that are kept.
KNOWN = ("Raises", "Announces", "Lowers", "Maintains", "Adjusts")
STANDS_FOR = {"Upgrades": "Raises", "Initiates Coverage On": "Announces", "Downgrades": "Lowers"}
TARGET_FLAGS = {"Raises": "acp_upgr", "Announces": "acp_init", "Lowers": "acp_down"}
COMPANY_FLAGS = {"Maintains": "acc_main", "Initiates Coverage On": "acc_init", "Upgrades": "acc_upgr", "Downgrades": "acc_down"}
#: Words of ratings by class.
WORDS = {
    "pos": ("Buy", "Outperform", "Strong", "Positive", "Accumulate", "Overweight"),
    "neut": ("Neutral", "Hold", "Equal", "Perform", "In-Line", "Weight", "Mixed"),
    "neg": ("Sell", "Under", "Reduce", "Below", "Negative"),
}


def cleaned(df: DataFrame) -> DataFrame:
    """df with action_pt filled in from action_company where it is none of the known ones, targets as doubles (empty: null), pt_perc_change, morning (hour under 12) and night (over 12; hour 12 is neither). Needs time."""
    filled = F.when(F.col("action_pt").isin(*KNOWN), F.col("action_pt"))
    for company, action in STANDS_FOR.items():
        filled = filled.when(F.col("action_company") == company, action)
    number = lambda c: F.nullif(F.trim(c), F.lit("")).try_cast("double")
    df = df.withColumns({"action_pt": filled.otherwise(F.col("action_pt")), "pt_prior": number("pt_prior"), "pt_current": number("pt_current")})
    flag = lambda c: F.when(c, 1).otherwise(0)
    change = F.try_divide(F.col("pt_current") - F.col("pt_prior"), F.col("pt_prior"))
    return df.withColumns({"pt_perc_change": change, "morning": flag(F.hour("time") < 12), "night": flag(F.hour("time") > 12)})


def rating_class(rating: Column, kind: str) -> Column:
    """1 if a word of the class is in the rating or the rating is in a word, else 0."""
    either = F.lit(False)
    for word in WORDS[kind]:
        either = either | F.contains(rating, F.lit(word)) | F.contains(F.lit(word), rating)
    return F.when(either, 1).otherwise(0)


def by_day(df: DataFrame, flags: Sequence[str] = ("morning", "night")) -> DataFrame:
    """symbol, date, sums of flags and of those of the actions, means of the targets (null where one of them is missing on all rows); days without any flag are left out. Needs `cleaned`."""
    kept = df.where(F.col("action_pt").isin(*TARGET_FLAGS) & F.col("action_company").isin(*COMPANY_FLAGS))
    hot = {name: F.when(F.col(c) == value, 1).otherwise(0) for c, table in (("action_company", COMPANY_FLAGS), ("action_pt", TARGET_FLAGS)) for value, name in table.items()}
    names = [*hot, *flags]
    targets = ("pt_prior", "pt_current", "pt_perc_change")
    days = kept.withColumns(hot).groupBy("symbol", "date").agg(*[F.sum(n).alias(n) for n in names], *[F.avg(t).alias(t) for t in targets])
    whole = F.col(targets[0]).isNotNull() & F.col(targets[1]).isNotNull() & F.col(targets[2]).isNotNull()
    return days.where(sum((F.col(n) for n in names), F.lit(0)) > 0).withColumns({t: F.when(whole, F.col(t)) for t in targets})
