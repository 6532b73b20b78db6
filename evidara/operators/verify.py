"""Claims against evidence: validation, binding and the verdict of every claim at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import scalar as S
from evidara.operators.latest import latest_by

c = F.col
# Roles that a quantitative claim's evidence must fill, and the one for other claims.
QUANTITATIVE_ROLES = ("value-cell", "row-header", "column-header", "caption")
QUOTE_ROLES = ("quote",)


def claim_error(kind: Column, text: Column, subject: Column, predicate: Column, raw: Column, parsed: Column) -> Column:
    """Why a claim can't be taken; null for a good one."""
    has = lambda x: S.blank_to_null(x).isNotNull()
    return (
        F.when(kind == "narrative", F.when(~has(text), "narrative_needs_text"))
        .when(kind == "quantitative", F.when(~has(subject) | ~has(predicate), "quantitative_needs_subject_and_predicate").when(~has(raw) & parsed.isNull(), "quantitative_needs_value"))
        .otherwise("unsupported_type")
    )


def binding(claims: DataFrame, evidence: DataFrame, selectors: DataFrame) -> DataFrame:
    """(claim_id, missing roles, weak evidence count, ok): all roles filled, two kinds of selectors on every evidence."""
    kinds = selectors.groupBy("evidence_id").agg(F.countDistinct("selector_type").alias("kinds"))
    per = evidence.select("id", "claim_id", "role").join(kinds, c("id") == c("evidence_id"), "left")
    per = per.groupBy("claim_id").agg(F.collect_set("role").alias("roles"), F.count_if(F.coalesce("kinds", F.lit(0)) < 2).alias("weak"))
    need = F.when(c("claim_type") == "quantitative", F.array(*map(F.lit, QUANTITATIVE_ROLES))).otherwise(F.array(*map(F.lit, QUOTE_ROLES)))
    both = claims.select(c("id").alias("claim_id"), "claim_type").join(per, "claim_id", "left")
    both = both.withColumn("missing", F.array_except(need, F.coalesce("roles", F.array().cast("array<string>"))))
    weak = F.coalesce("weak", F.lit(0))
    return both.select("claim_id", F.array_join("missing", ",").alias("missing"), weak.alias("weak"), ((F.size("missing") == 0) & (weak == 0)).alias("ok"))


def narrative_verdict(claims: DataFrame, evidence: DataFrame, quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(claim_id, status, reason). quotes: (evidence_id, ord, exact); texts: (resource_id, text), the latest of each.

    The first quote, in the order of evidence and selectors, that stands in its source decides; else one that stands
    in the claim's own text.
    """
    q = evidence.select(c("id").alias("evidence_id"), "claim_id", "resource_id", c("ord").alias("e_ord")).join(quotes.select("evidence_id", c("ord").alias("s_ord"), "exact"), "evidence_id")
    q = q.join(texts, "resource_id", "left").join(claims.select(c("id").alias("claim_id"), "narrative_text"), "claim_id")
    within = lambda t: F.coalesce(F.contains(F.lower(t), F.lower("exact")), F.lit(False))
    q = q.filter(S.blank_to_null(c("exact")).isNotNull())
    reason = F.when(within(c("text")), "narrative_quote_match_source").when(within(c("narrative_text")), "narrative_quote_match_claim_text")
    first = q.withColumn("reason", reason).filter(c("reason").isNotNull())
    first = first.groupBy("claim_id").agg(F.min_by("reason", F.struct((c("reason") != "narrative_quote_match_source").alias("later"), "e_ord", "s_ord")).alias("reason"))
    out = claims.select(c("id").alias("claim_id")).join(first, "claim_id", "left")
    return out.select("claim_id", F.when(c("reason").isNotNull(), "pass").otherwise("fail").alias("status"), F.coalesce("reason", F.lit("no_matching_text_quote_selector")).alias("reason"))


def resolved_address(claims: DataFrame, evidence: DataFrame, selectors: DataFrame, tables: DataFrame) -> DataFrame:
    """Claims (id as claim_id) with evidence_id, table_id, row_index, col_index, s_currency, s_scale, s_period and unresolved.

    The first value-cell evidence, its first table address and whether ``tables`` (table_id) has that table; unresolved
    says what is missing. A blank table_id counts as none.
    """
    value_cell = latest_by(evidence.filter("role = 'value-cell'"), ["claim_id"], c("ord"), c("id")).select("claim_id", c("id").alias("evidence_id"))
    table = F.when(F.trim(c("table_id").cast("string")) != "", c("table_id")).alias("table_id")
    address = latest_by(selectors.filter("selector_type = 'TableAddressSelector'"), ["evidence_id"], c("ord")).select(
        "evidence_id", table, "row_index", "col_index", c("currency").alias("s_currency"), c("scale_factor").alias("s_scale"), c("period").alias("s_period"), F.lit(True).alias("has_address"))
    known = tables.select("table_id").distinct().withColumn("has_table", F.lit(True))
    q = claims.withColumnRenamed("id", "claim_id").join(value_cell, "claim_id", "left").join(address, "evidence_id", "left").join(known, "table_id", "left")
    reason = (
        F.when(c("evidence_id").isNull(), "missing_value_cell").when(c("has_address").isNull(), "missing_table_address_selector")
        .when(c("table_id").isNull(), "table_address_missing_table_id").when(c("has_table").isNull(), "table_not_found")
    )
    return q.withColumn("unresolved", reason).drop("has_address", "has_table")


def semantic_mismatch(currency: Column, scale: Column, period: Column, s_currency: Column, s_scale: Column, s_period: Column) -> Column:
    """The first of currency, scale and period that claim and address both have and that differs; null if none. Blanks aren't set."""
    is_set = lambda x: F.coalesce(x, F.lit("")) != ""
    return (
        F.when(is_set(currency) & is_set(s_currency) & (currency != s_currency), "currency_mismatch").when(scale.isNotNull() & s_scale.isNotNull() & (scale != s_scale), "scale_factor_mismatch")
        .when(is_set(period) & is_set(s_period) & (period != s_period), "period_mismatch")
    )


def quantitative_verdict(claims: DataFrame, evidence: DataFrame, selectors: DataFrame, cells: DataFrame, dataset: DataFrame | None = None, tolerance: float = 1e-9) -> DataFrame:
    """(claim_id, status, reason, actual).

    The first value-cell evidence, its first table address, the address's cell, its number against the claim's; then
    the dataset cells of all evidence (dataset: (claim_id, value)), then currency, scale and period, each only where
    both sides have one. cells: (table_id, row_index, col_index, value), the smallest value of each; they are grouped once,
    for the values and for the tables that there are.
    """
    cell = cells.groupBy("table_id", "row_index", "col_index").agg(F.min("value").alias("actual_raw"), F.lit(True).alias("has_cell"))
    q = resolved_address(claims.filter("claim_type = 'quantitative'"), evidence, selectors, cell)
    q = q.join(cell, ["table_id", "row_index", "col_index"], "left")
    q = q.withColumn("actual", S.parse_numeric(c("actual_raw"))).withColumn("expected", F.coalesce("value_parsed", S.parse_numeric(c("value_raw"))))
    if dataset is not None:
        d = dataset.withColumn("number", S.parse_numeric(c("value"))).join(q.select("claim_id", "actual", "expected"), "claim_id")
        d = d.groupBy("claim_id").agg(F.bool_or(S.nearly_equal(c("number"), c("actual"), tolerance)).alias("any_actual"), F.bool_and(S.nearly_equal(c("number"), c("expected"), tolerance)).alias("all_expected"), F.count("number").alias("n_data"))
        q = q.join(d, "claim_id", "left")
    else:
        q = q.withColumns({"any_actual": F.lit(None).cast("boolean"), "all_expected": F.lit(None).cast("boolean"), "n_data": F.lit(0)})
    has_data = F.coalesce("n_data", F.lit(0)) > 0
    reason = (
        F.when(c("unresolved").isNotNull(), c("unresolved"))
        .when(c("row_index").isNull() | c("col_index").isNull(), "unable_to_resolve_cell_coordinates")
        .when(c("has_cell").isNull(), "cell_not_found")
        .when(c("actual").isNull() | c("expected").isNull(), "numeric_parse_failed")
        .when(~S.nearly_equal(c("actual"), c("expected"), tolerance), "value_mismatch")
        .when(has_data & ~c("any_actual"), "cross_source_mismatch")
        .when(has_data & ~c("all_expected"), "dataset_claim_mismatch")
        .otherwise(semantic_mismatch(*map(c, ("currency", "scale_factor", "period", "s_currency", "s_scale", "s_period"))))
    )
    good = F.when(has_data, "quantitative_match_cross_source").otherwise("quantitative_match")
    return q.withColumn("reason", reason).select("claim_id", F.when(c("reason").isNull(), "pass").otherwise("fail").alias("status"), F.coalesce("reason", good).alias("reason"), "actual")


def verdicts(claims: DataFrame, evidence: DataFrame, selectors: DataFrame, cells: DataFrame, texts: DataFrame, dataset: DataFrame | None = None) -> DataFrame:
    """(claim_id, status, reason) of every claim: a failed binding first, then by the claim's type."""
    bound = binding(claims, evidence, selectors).select("claim_id", "ok")
    quotes = selectors.filter("selector_type = 'TextQuoteSelector'").select("evidence_id", "ord", "exact")
    n = narrative_verdict(claims.filter("claim_type = 'narrative'"), evidence, quotes, texts).select("claim_id", "status", "reason")
    q = quantitative_verdict(claims, evidence, selectors, cells, dataset).select("claim_id", "status", "reason")
    by_type = n.unionByName(q)
    out = claims.select(c("id").alias("claim_id")).join(bound, "claim_id").join(by_type, "claim_id", "left")
    reason = F.when(~c("ok"), "binding_validation_failed").otherwise(F.coalesce("reason", F.lit("unsupported_claim_type")))
    return out.select("claim_id", F.when(c("ok"), F.coalesce("status", F.lit("fail"))).otherwise("fail").alias("status"), reason.alias("reason"))


def coordinate(index: Column, headers: Column, path: Column) -> Column:
    """The index where given, else the place of the path's last label among the headers (trimmed, without case), else null."""
    fold = lambda x: F.lower(F.trim(x))
    found = F.nullif(F.array_position(F.transform(headers, fold), fold(F.element_at(path, -1))), F.lit(0)) - 1
    return F.coalesce(index.cast("long"), found)
