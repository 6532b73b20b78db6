"""Chat formatting: cumulative snapshots collapse to maximal conversations, which are rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.scratch import Scratch


def turn_hash(n: Column) -> list[Column]:
    """Two 64-bit hashes of a turn with its number; sums of them over a prefix identify the prefix."""
    role, text = (F.concat(F.when(F.col(c).isNull(), "n").otherwise("v"), F.coalesce(F.col(c), F.lit(""))) for c in ("role", "text"))
    return [F.xxhash64(F.lit(salt), n, role, F.lit(0), text) for salt in (1, 2)]


def maximal(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id of the conversations that are no proper prefix of another; of equal ones the smallest conv_id stays.

    turns: (conv_id, n, role, text), n from 1 on without gaps. Each prefix of a conversation is known by the running
    sum of its turns' hashes (exact 38-digit sums, two of them) and its length; a conversation goes if its own is
    among the shorter prefixes of any. Prefixes are distinct before the anti-join, so a first turn that most
    conversations share is one row.
    """
    so_far = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    a, b = turn_hash(F.col("n"))
    hashed = turns.select("conv_id", "n", a.cast("decimal(20,0)").alias("a"), b.cast("decimal(20,0)").alias("b"))
    prefix = hashed.select("conv_id", "n", F.sum("a").over(so_far).alias("a"), F.sum("b").over(so_far).alias("b"), F.lead("n").over(Window.partitionBy("conv_id").orderBy("n")).isNull().alias("whole"))
    prefix = scratch.keep(prefix, "prefixes")
    whole = prefix.filter("whole").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    shorter = prefix.filter("NOT whole").select("n", "a", "b").distinct()
    return whole.join(shorter, ["n", "a", "b"], "left_anti").select("conv_id")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def collapse(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations of (conv_id, turn, role, text).

    Turns are taken in the order of turn, role and text (nulls first); rows that repeat are one turn. Null roles and
    texts render as empty. Rows with a null conv_id belong to no conversation and go; an empty table gives an empty
    table; other columns are ignored.
    """
    scratch = Scratch(conversations.sparkSession, "chats")
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text").distinct()
    turns = rows.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("n"), "role", "text")
    turns = scratch.keep(turns, "turns")
    kept = scratch.keep(maximal(turns, scratch), "maximal")
    mine = turns.join(kept, "conv_id", "left_semi").select("conv_id", "n", render(F.col("role"), F.col("text")).alias("t"))
    whole = mine.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(F.struct("n", "t"))).alias("ts"))
    return whole.select("conv_id", "n_turns", F.array_join(F.col("ts.t"), "").alias("rendered"))


def op7_chat_collapse(spark, sf_dir: str) -> DataFrame:
    return collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP7_SQL = r"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
r AS (SELECT conv_id, n, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS s,
  CASE WHEN role IS NULL THEN 'n' ELSE 'v' || length(role) || ':' || role END || CASE WHEN text IS NULL THEN 'n' ELSE 'v' || length(text) || ':' || text END AS k FROM t),
p AS (SELECT conv_id, n, string_agg(k, '|') OVER w AS prefix, string_agg(s, '') OVER w AS rendered,
  n = max(n) OVER (PARTITION BY conv_id) AS whole FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
u AS (SELECT min(conv_id) AS conv_id, n, prefix, any_value(rendered) AS rendered FROM p WHERE whole GROUP BY n, prefix)
SELECT conv_id, n AS n_turns, rendered FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE NOT p.whole AND p.n = u.n AND p.prefix = u.prefix)
"""
