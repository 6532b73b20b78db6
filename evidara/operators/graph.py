"""Propositions, assertions of them and relations between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.operators.rounds import kept

c = F.col
# The kinds of relations.
KINDS = ("supports", "rebuts", "undercuts", "qualifies")


def propositions(rows: DataFrame) -> DataFrame:
    """``rows`` (id, payload, ...) with reason: empty_payload for a null or blank one and for an object without fields, else null."""
    blank = F.coalesce(F.trim("payload").isin("", "{}") | F.trim("payload").rlike(r"^\{\s*\}$"), F.lit(True))
    return rows.withColumn("reason", F.when(blank, "empty_payload"))


def assertions(rows: DataFrame, known: DataFrame, evidence: DataFrame) -> DataFrame:
    """``rows`` (id, proposition_id, evidence_id, ...) with reason: proposition_missing, evidence_missing, or null; no evidence is fine.

    ``known`` and ``evidence``: (id, ...).
    """
    there = lambda df, key, name: df.select(c("id").alias(key), F.lit(True).alias(name)).distinct()
    both = rows.join(there(known, "proposition_id", "_p"), "proposition_id", "left").join(there(evidence, "evidence_id", "_e"), "evidence_id", "left")
    reason = F.when(c("_p").isNull(), "proposition_missing").when(c("evidence_id").isNotNull() & c("_e").isNull(), "evidence_missing")
    return both.select(*rows.columns, reason.alias("reason"))


def relations(rows: DataFrame) -> DataFrame:
    """``rows`` (id, kind, ...) with reason: unsupported_type or null. Ends of a relation aren't checked."""
    return rows.withColumn("reason", F.when(~F.coalesce(c("kind").isin(*KINDS), F.lit(False)), "unsupported_type"))


def reached(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(id, hops) of all nodes that can be reached over ``edges`` (source_id, target_id) from ``starts`` (id), hops from the nearest one.

    Rounds go on until one finds no new node (or ``most`` are done); each joins only the nodes that were new in the one
    before, and stores what it finds, so circles end and no round is computed twice.
    """
    edges = edges.select("source_id", "target_id").distinct()
    front = seen = kept(starts.select("id").distinct().withColumn("hops", F.lit(0)))
    hop = 0
    while (most is None or hop < most) and not front.isEmpty():
        hop += 1
        new = edges.join(front, c("source_id") == c("id")).select(c("target_id").alias("id")).distinct()
        front = kept(new.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen
