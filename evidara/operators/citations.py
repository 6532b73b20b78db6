"""Cite ids that no two keys share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import scalar as S
from evidara.operators.rounds import kept

#: Attempts of a key.
MOST = 5000


def allocated(keys: DataFrame, id_of: Callable[[Column, Column], Column] = S.cite_id, most: int = MOST) -> DataFrame:
    """(key, cite) of the distinct folded keys in column ``key``: attempts 0 to ``most`` - 1 in key order until the id is free.

    Every key wants its id of attempt 0; of those that want an id the smallest key holds it, and each other key wants its
    next attempt's id, which may take that from a larger key in turn. Whatever the order of rounds, this ends where keys
    served one by one in key order end. The ids of attempt 0 are stored once; a round joins what moves (about n^2 / 62^4 / 2 of n keys) with the holders of the
    ids that it wants, and stores the changes. Only counts come to the driver.
    """
    wants = keys.filter("key IS NOT NULL").select("key").distinct().withColumn("cite", id_of(F.col("key"), F.lit(0)))
    first = kept(wants.groupBy("cite").agg(F.min("key").alias("key")))
    moving = wants.join(first.select("cite", F.col("key").alias("holder")), "cite").filter("key <> holder").select("key", F.lit(0).alias("attempt"))
    changed = None
    moving = kept(moving)
    while not moving.isEmpty():
        if moving.agg(F.max("attempt")).head()[0] + 1 >= most:
            raise ValueError("no free cite id for a key")
        moving = moving.select("key", (F.col("attempt") + 1).alias("attempt")).withColumn("cite", id_of(F.col("key"), F.col("attempt")))
        asked = moving.select("cite").distinct()
        before = first.join(asked, "cite", "left_semi").select("key", F.lit(0).alias("attempt"), "cite")
        if changed is not None:
            before = before.join(changed.select("cite"), "cite", "left_anti").select("key", "attempt", "cite").unionByName(changed.join(asked, "cite", "left_semi"))
        contest = kept(moving.unionByName(before))
        won = contest.groupBy("cite").agg(F.min(F.struct("key", "attempt")).alias("w"))
        rest = changed.join(asked, "cite", "left_anti") if changed is not None else contest.limit(0)
        changed = kept(rest.unionByName(won.select("w.key", "w.attempt", "cite")))
        moving = kept(contest.join(won, "cite").filter(F.col("key") != F.col("w.key")).select("key", "attempt"))
    if changed is None:
        return first.select("key", "cite")
    return first.join(changed.select("cite"), "cite", "left_anti").select("key", "cite").unionByName(changed.select("key", "cite"))


def import_summary(entries: DataFrame, citations: DataFrame, references: DataFrame) -> DataFrame:
    """One row for an import: entries_seen, mappings_created, references_inserted, references_updated.

    entries: (cite_key) as written; citations: (key) that have a cite id; references: (key) with an entry. Keys are
    folded; a key that recurs is created and inserted once and updated after that. Entries with a null key don't count.
    """
    mark = lambda df, name: df.select("key").distinct().withColumn(name, F.lit(1))
    n = entries.select(S.cite_key(F.col("cite_key")).alias("key")).groupBy("key").agg(F.count("key").alias("n")).filter("key IS NOT NULL")
    n = n.join(mark(citations, "cited"), "key", "left").join(mark(references, "held"), "key", "left")
    new, seen = F.count_if(F.col("held").isNull()), F.coalesce(F.sum("n"), F.lit(0))
    return n.agg(seen.alias("entries_seen"), F.count_if(F.col("cited").isNull()).alias("mappings_created"), new.alias("references_inserted"), (seen - new).alias("references_updated"))
