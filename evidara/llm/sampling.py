"""Samples with hard bounds, drawn by a hash of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(seed: int, *columns: str) -> Column:
    """A 64-bit hash of the columns: the same for equal rows, apart for rows that share an id."""
    return F.xxhash64(F.lit(seed), *columns)


def limit(rows: DataFrame, most: int, most_bytes: int) -> int | None:
    """The largest hash of a sample of ``rows`` (h, size): the distinct hashes up to it are ``most`` and their sizes ``most_bytes`` at most.

    None if nothing fits. Distinct hashes are counted first, so repeats neither fill the sample nor thin it out; about
    1.3 * ``most`` of the smallest meet in one task, where ranks and running sums give the exact cut.
    """
    n = rows.agg(F.count_distinct("h")).head()[0]
    share = min(1.0, (1.3 * most + 100) / max(n, 1))
    near = rows.filter(F.col("h") <= int(share * 2**64) - 2**63 - 1 if share < 1 else F.lit(True))
    near = near.groupBy("h").agg(F.max("size").alias("size"))
    upto = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    ranked = near.select("h", F.count(F.lit(1)).over(upto).alias("n"), F.sum("size").over(upto).alias("bytes"))
    return ranked.filter((F.col("n") <= most) & (F.col("bytes") <= most_bytes)).agg(F.max("h")).head()[0]
