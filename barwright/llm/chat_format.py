"""Preference formatting of conversations, in DataFrame functions only.

Conversations are paired: 2k is chosen, 2k + 1 is rejected (`pair_of`). The longest common prefix of their turns is rendered
once, as the prompt; what follows in each is its completion, rendered with a loss mask: one flag for each rendered turn, 1
for turns of the assistant. A turn is rendered as <|role|>, a line break, its text and another line break.

Every turn goes to its conversation by one shuffle. A conversation is a row in the end, as training examples are; its size
is that of the conversation itself, whatever the number of conversations that begin alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"


def pair_of(conv_id: Column) -> tuple[Column, Column]:
    """The pair of a conversation, and whether it is the chosen one; in whole numbers throughout, so the largest ids have their own pairs too."""
    return F.shiftright(conv_id.cast("long"), 1), conv_id.cast("long").bitwiseAND(1) == 0


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("\n"))


def text_of(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def preferences(conversations: DataFrame) -> DataFrame:
    """pair_id, prompt, chosen, rejected, their loss masks (by turn), n_prompt, n_chosen, n_rejected turns.

    Turns go by their number; turns of one number in a conversation by role, then text; a null number comes first. Null roles
    and texts count as empty and equal each other. A conversation without its partner has null for the partner's completion and mask, and
    all of its own turns are completion (a prompt is what both have). Of rows that repeat a turn all stay. Rows with a null
    conv_id belong to no conversation and are left out; other columns are ignored.
    """
    pair, is_chosen = pair_of(F.col("conv_id"))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(pair.alias("pair_id"), is_chosen.alias("is_chosen"), turn.alias("t"))
    both = rows.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_chosen"), F.col("t")))).alias("a"),
        F.array_sort(F.collect_list(F.when(~F.col("is_chosen"), F.col("t")))).alias("b"),
    )
    n_a, n_b = F.size("a"), F.size("b")
    shorter = F.least(n_a, n_b)
    # the first place where role or text differ, else the whole shorter one
    differs = F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: (i <= shorter) & ((F.get("a", i - 1)["role"] != F.get("b", i - 1)["role"]) | (F.get("a", i - 1)["text"] != F.get("b", i - 1)["text"])))
    both = both.withColumn("n_prompt", F.coalesce(F.get(differs, F.lit(0)) - 1, shorter).cast("long"))
    start = (F.col("n_prompt") + 1).cast("int")
    both = both.withColumn("p", F.slice("a", F.lit(1), F.col("n_prompt").cast("int"))).withColumn("x", F.slice("a", start, n_a)).withColumn("y", F.slice("b", start, n_b))
    mask = lambda turns: F.array_join(F.transform(turns, lambda t: F.when(t["role"] == LOSS_ROLE, F.lit("1")).otherwise("0")), "")
    return both.select(
        "pair_id",
        "n_prompt",
        F.when(n_a > 0, F.size("x")).cast("long").alias("n_chosen"),
        F.when(n_b > 0, F.size("y")).cast("long").alias("n_rejected"),
        text_of(F.col("p")).alias("prompt"),
        F.when(n_a > 0, text_of(F.col("x"))).alias("chosen"),
        F.when(n_a > 0, mask(F.col("x"))).alias("chosen_mask"),
        F.when(n_b > 0, text_of(F.col("y"))).alias("rejected"),
        F.when(n_b > 0, mask(F.col("y"))).alias("rejected_mask"),
    )


ORACLE_SQL = """
WITH t AS (
  SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS is_chosen,
         coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
sides AS (
  SELECT pair_id, count(*) FILTER (WHERE is_chosen) AS n_a, count(*) FILTER (WHERE NOT is_chosen) AS n_b FROM t GROUP BY pair_id),
differs AS (
  SELECT a.pair_id, min(a.i) AS i FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i
  WHERE a.is_chosen AND NOT b.is_chosen AND (a.role <> b.role OR a.text <> b.text) GROUP BY a.pair_id),
cut AS (
  SELECT s.*, coalesce(d.i - 1, least(n_a, n_b)) AS n_prompt FROM sides s LEFT JOIN differs d ON s.pair_id = d.pair_id),
shown AS (
  SELECT t.*, c.n_prompt, '<|' || role || '|>' || chr(10) || text || chr(10) AS shown,
         CASE WHEN role = 'assistant' THEN '1' ELSE '0' END AS loss
  FROM t JOIN cut c ON t.pair_id = c.pair_id)
SELECT c.pair_id, CAST(c.n_prompt AS BIGINT) AS n_prompt,
       CASE WHEN n_a > 0 THEN CAST(n_a - c.n_prompt AS BIGINT) END AS n_chosen,
       CASE WHEN n_b > 0 THEN CAST(n_b - c.n_prompt AS BIGINT) END AS n_rejected,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE is_chosen AND i <= c.n_prompt), '') AS prompt,
       CASE WHEN n_a > 0 THEN coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE is_chosen AND i > c.n_prompt), '') END AS chosen,
       CASE WHEN n_a > 0 THEN coalesce(string_agg(loss, '' ORDER BY i) FILTER (WHERE is_chosen AND i > c.n_prompt), '') END AS chosen_mask,
       CASE WHEN n_b > 0 THEN coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE NOT is_chosen AND i > c.n_prompt), '') END AS rejected,
       CASE WHEN n_b > 0 THEN coalesce(string_agg(loss, '' ORDER BY i) FILTER (WHERE NOT is_chosen AND i > c.n_prompt), '') END AS rejected_mask
FROM cut c JOIN shown s ON c.pair_id = s.pair_id
GROUP BY c.pair_id, c.n_prompt, n_a, n_b
"""
