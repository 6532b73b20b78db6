"""Latest rows, upserts and other shapes of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first by ``order``. Spark cuts groups to their first row before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_with_ties(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.rank().over(w)).filter("_n = 1").drop("_n")


def first_n_by(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All columns of ``new`` over those of ``old``, and ``action`` (kept, inserted, updated); a row's id stays."""
    columns = [c for c in old.columns if c not in (key, "id")]
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    was, comes = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    return both.select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key), F.coalesce("o.id", "n.id").alias("id"), *[F.when(comes, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns],
        F.when(was & comes, "updated").when(comes, "inserted").otherwise("kept").alias("action"),
    )


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new``, one a key, that ``old`` lacks."""
    return new.dropDuplicates(keys).join(old, keys, "left_anti")


def page_of(df: DataFrame, order: Column, key: Column, size: int) -> DataFrame:
    """A page's offset for the row with a key: rows before it in pages of ``size``. Counts instead of ranking all rows."""
    at = df.filter(key).agg(F.min(order).alias("_at"))
    before = df.crossJoin(F.broadcast(at)).agg(F.sum(F.when(order < F.col("_at"), 1).otherwise(0)).alias("rows_before"))  # one row
    return before.select("rows_before", (F.floor(F.col("rows_before") / size) * size).cast("long").alias("page_offset"))
