"""Queries of claims, bindings, verdicts, traces and the argument graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import scalar as S
from evidara.operators import verify as V
from evidara.operators.latest import insert_or_ignore
from evidara.operators import graph as R
from evidara.plans.registry import query
from evidara.plans.scalars import NUM

c = F.col

PARSED = f"""SELECT *, coalesce(value_parsed, CASE WHEN trim(value_raw) LIKE '(%' AND trim(value_raw) LIKE '%)' THEN -({NUM}) ELSE {NUM} END) AS expected
  FROM (SELECT *, trim(regexp_replace(trim(value_raw), '[,£$mM()]', '', 'g')) AS t FROM claims)"""
BOUND = """SELECT k.id AS claim_id, coalesce(b.weak, 0) AS weak, array_to_string(list_filter(CASE WHEN k.claim_type = 'quantitative' THEN ['value-cell', 'row-header', 'column-header', 'caption'] ELSE ['quote'] END,
  lambda r: NOT list_contains(coalesce(b.roles, []), r)), ',') AS missing FROM claims k LEFT JOIN (SELECT e.claim_id, list(DISTINCT e.role) AS roles, count(*) FILTER (coalesce(s.kinds, 0) < 2) AS weak
  FROM evidence e LEFT JOIN (SELECT evidence_id, count(DISTINCT selector_type) AS kinds FROM selectors GROUP BY 1) s ON s.evidence_id = e.id GROUP BY e.claim_id) b ON b.claim_id = k.id"""
QUANT = f"""SELECT k.id AS claim_id, a.actual, CASE WHEN v.eid IS NULL THEN 'missing_value_cell' WHEN s.evidence_id IS NULL THEN 'missing_table_address_selector' WHEN s.table_id IS NULL THEN 'table_address_missing_table_id'
  WHEN s.table_id NOT IN (SELECT table_id FROM cells) THEN 'table_not_found' WHEN s.row_index IS NULL OR s.col_index IS NULL THEN 'unable_to_resolve_cell_coordinates' WHEN a.table_id IS NULL THEN 'cell_not_found'
  WHEN a.actual IS NULL OR k.expected IS NULL THEN 'numeric_parse_failed' WHEN abs(a.actual - k.expected) > 1e-9 THEN 'value_mismatch'
  WHEN k.currency <> s.currency THEN 'currency_mismatch' WHEN k.scale_factor <> s.scale_factor THEN 'scale_factor_mismatch' WHEN k.period <> s.period THEN 'period_mismatch' ELSE 'quantitative_match' END AS reason
  FROM ({PARSED}) k LEFT JOIN (SELECT claim_id, min_by(id, (ord, id)) AS eid FROM evidence WHERE role = 'value-cell' GROUP BY claim_id) v ON v.claim_id = k.id
  LEFT JOIN (SELECT * FROM selectors WHERE selector_type = 'TableAddressSelector') s ON s.evidence_id = v.eid
  LEFT JOIN (SELECT table_id, row_index, col_index, CAST(value AS DOUBLE) AS actual FROM cells) a ON a.table_id = s.table_id AND a.row_index = s.row_index AND a.col_index = s.col_index WHERE k.claim_type = 'quantitative'"""
CELLS = "WITH cells AS (SELECT table_id, row_index, col_index, min(value) AS value FROM grid GROUP BY ALL) "
NARR = """SELECT k.id AS claim_id, coalesce(min(CASE WHEN contains(lower(t.text), lower(s.exact)) THEN 'narrative_quote_match_source' END), min(CASE WHEN contains(lower(k.narrative_text), lower(s.exact)) THEN 'narrative_quote_match_claim_text' END),
  'no_matching_text_quote_selector') AS reason FROM claims k LEFT JOIN evidence e ON e.claim_id = k.id LEFT JOIN selectors s ON s.evidence_id = e.id AND s.selector_type = 'TextQuoteSelector'
  LEFT JOIN notes t ON t.id = e.resource_id WHERE k.claim_type = 'narrative' GROUP BY k.id"""


def _texts(t):
    return t.select(c("id").alias("resource_id"), "text")


@query("CLM-01_claim_validation", "claims", sql="""SELECT id, CASE claim_type WHEN 'narrative' THEN CASE WHEN nullif(trim(narrative_text), '') IS NULL THEN 'narrative_needs_text' END
  WHEN 'quantitative' THEN CASE WHEN nullif(trim(subject), '') IS NULL OR nullif(trim(predicate), '') IS NULL THEN 'quantitative_needs_subject_and_predicate' WHEN nullif(trim(value_raw), '') IS NULL AND value_parsed IS NULL THEN 'quantitative_needs_value' END
  ELSE 'unsupported_type' END AS error FROM claims""")  # fmt: skip
def claim_validation(k):
    return k.select("id", V.claim_error(*map(c, ("claim_type", "narrative_text", "subject", "predicate", "value_raw", "value_parsed"))).alias("error"))


@query("BND-02_binding_validation", "claims", "evidence", "selectors", sql=f"SELECT claim_id, missing, weak, missing = '' AND weak = 0 AS ok FROM ({BOUND})")
def binding_validation(k, e, s):
    return V.binding(k, e, s)


@query("VER-02_narrative", "claims", "evidence", "selectors", "notes", sql=f"SELECT claim_id, reason, CASE WHEN reason LIKE 'narrative%' THEN 'pass' ELSE 'fail' END AS status FROM ({NARR})")
def narrative(k, e, s, t):
    return V.narrative_verdict(k.filter("claim_type = 'narrative'"), e, s.filter("selector_type = 'TextQuoteSelector'"), _texts(t))


@query("VER-06_quantitative", "claims", "evidence", "selectors", "grid", sql=f"{CELLS} SELECT claim_id, actual, reason, CASE WHEN reason = 'quantitative_match' THEN 'pass' ELSE 'fail' END AS status FROM ({QUANT})")
def quantitative(k, e, s, g):
    return V.quantitative_verdict(k, e, s, g)


@query("VER-07_cross_source", "claims", "evidence", "selectors", "grid", "lineitem", sql=f"""{CELLS}, q AS (SELECT q.*, p.expected FROM ({QUANT}) q JOIN ({PARSED}) p ON p.id = q.claim_id),
  d AS (SELECT q.claim_id, bool_or(abs(l_quantity - actual) <= 1e-9) AS a, bool_and(abs(l_quantity - expected) <= 1e-9) AS x FROM q JOIN lineitem ON l_orderkey = claim_id GROUP BY q.claim_id)
  SELECT claim_id, CASE WHEN reason NOT IN ('quantitative_match', 'currency_mismatch', 'scale_factor_mismatch', 'period_mismatch') OR d.claim_id IS NULL THEN reason WHEN NOT a THEN 'cross_source_mismatch' WHEN NOT x THEN 'dataset_claim_mismatch'
  WHEN reason = 'quantitative_match' THEN 'quantitative_match_cross_source' ELSE reason END AS reason FROM q LEFT JOIN d USING (claim_id)""")  # fmt: skip
def cross_source(k, e, s, g, l):
    data = l.select(c("l_orderkey").alias("claim_id"), c("l_quantity").cast("string").alias("value"))
    return V.quantitative_verdict(k, e, s, g, data).select("claim_id", "reason")


VERDICTS = f"""SELECT b.claim_id, CASE WHEN NOT (missing = '' AND weak = 0) THEN 'binding_validation_failed' ELSE coalesce(q.reason, n.reason, 'unsupported_claim_type') END AS reason
  FROM ({BOUND}) b LEFT JOIN ({QUANT}) q USING (claim_id) LEFT JOIN ({NARR}) n USING (claim_id)"""
PASSED = "reason IN ('quantitative_match', 'narrative_quote_match_source', 'narrative_quote_match_claim_text')"


@query("VER-01_verdicts", "claims", "evidence", "selectors", "grid", "notes", sql=f"{CELLS} SELECT claim_id, reason, CASE WHEN {PASSED} THEN 'pass' ELSE 'fail' END AS status FROM ({VERDICTS})")
def verdicts(k, e, s, g, t):
    return V.verdicts(k, e, s, g, _texts(t))


@query("VER-10_set_summary", "claims", "evidence", "selectors", "grid", "notes", sql=f"{CELLS} SELECT set_id, count(*) AS total, count(*) FILTER ({PASSED}) AS passed FROM ({VERDICTS}) JOIN claims ON id = claim_id GROUP BY set_id")
def set_summary(k, e, s, g, t):
    v = V.verdicts(k, e, s, g, _texts(t))
    return k.select(c("id").alias("claim_id"), "set_id").join(v, "claim_id").groupBy("set_id").agg(F.count("*").alias("total"), F.count_if(c("status") == "pass").alias("passed"))


@query("VER-09_diagnostics", "claims", "evidence", "selectors", sql=f"""SELECT claim_id, '{{"missing":"' || missing || '","weak":' || weak || '}}' AS diagnostics FROM ({BOUND})""")
def diagnostics(k, e, s):
    return V.binding(k, e, s).select("claim_id", F.to_json(F.struct("missing", "weak")).alias("diagnostics"))


@query("SNK-06_report", "claims", "evidence", "selectors", sql=f"SELECT '- claim ' || claim_id || ': ' || CASE WHEN missing = '' AND weak = 0 THEN 'bound' ELSE 'unbound (' || missing || ')' END AS line FROM ({BOUND})")
def report(k, e, s):
    return V.binding(k, e, s).select(F.format_string("- claim %d: %s", "claim_id", F.when(c("ok"), "bound").otherwise(F.concat(F.lit("unbound ("), "missing", F.lit(")")))).alias("line"))


@query("VER-04_coordinates", "part", sql="SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 7 WHEN p_partkey % 3 = 0 THEN 1 END AS col FROM part")
def coordinates(p):
    headers = F.array(F.lit("Metric"), F.lit(" FY24 "), F.lit("x"))
    path = F.array(F.lit("a"), F.when(c("p_partkey") % 3 == 0, "fy24").otherwise("nothing"))
    return p.select("p_partkey", V.coordinate(F.when(c("p_partkey") % 4 == 0, 7), headers, path).alias("col"))


@query("TRC-01_claim_counts", "claims", "evidence", "selectors", sql="SELECT k.id, count(DISTINCT e.id) AS evidence, count(s.evidence_id) AS selectors, count(DISTINCT e.resource_id) AS resources FROM claims k LEFT JOIN evidence e ON e.claim_id = k.id LEFT JOIN selectors s ON s.evidence_id = e.id GROUP BY k.id")
def claim_counts(k, e, s):
    n = s.groupBy("evidence_id").agg(F.count("*").alias("n"))
    per = e.join(n, c("id") == c("evidence_id"), "left").groupBy("claim_id").agg(F.count("*").alias("evidence"), F.sum(F.coalesce("n", F.lit(0))).alias("selectors"), F.countDistinct("resource_id").alias("resources"))
    z = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return k.select("id").join(per, c("id") == c("claim_id"), "left").select("id", z("evidence"), z("selectors"), z("resources"))


@query("TRC-02_resource_counts", "evidence", "reference_links", sql="SELECT resource_id, claims, coalesce(refs, 0) AS refs FROM (SELECT resource_id, count(DISTINCT claim_id) AS claims FROM evidence GROUP BY 1) LEFT JOIN (SELECT resource_id, count(DISTINCT cite) AS refs FROM reference_links GROUP BY 1) USING (resource_id)")
def resource_counts(e, l):
    k = e.groupBy("resource_id").agg(F.countDistinct("claim_id").alias("claims"))
    return k.join(l.groupBy("resource_id").agg(F.countDistinct("cite").alias("r")), "resource_id", "left").select("resource_id", "claims", F.coalesce("r", F.lit(0)).alias("refs"))


@query("REG-04_link", "reference_links", "citations", "documents", sql="SELECT l.cite, l.resource_id, CASE WHEN l.cite NOT IN (SELECT cite FROM citations WHERE cite < 30) THEN 'no_citation' WHEN l.resource_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) THEN 'no_resource' ELSE 'linked' END AS status FROM (SELECT DISTINCT cite, resource_id FROM reference_links) l")
def link(l, t, d):
    l = l.select("cite", "resource_id").distinct()
    l = l.join(t.filter("cite < 30").select("cite", F.lit(1).alias("t")), "cite", "left").join(d.filter("doc_id % 3 = 0").select(c("doc_id").alias("resource_id"), F.lit(1).alias("r")), "resource_id", "left")
    return l.select("cite", "resource_id", F.when(c("t").isNull(), "no_citation").when(c("r").isNull(), "no_resource").otherwise("linked").alias("status"))


@query("REG-06_set_title", "resources", sql="SELECT id, nullif(trim(title), '') AS title FROM resources")
def set_title(r):
    return r.select("id", S.blank_to_null(c("title")).alias("title"))


@query("GRF-01_relations", "relations", "propositions", sql="SELECT kind, count(*) AS n, count(DISTINCT source_id) AS sources FROM relations WHERE kind IN ('supports', 'rebuts', 'undercuts', 'qualifies') AND source_id IN (SELECT id FROM propositions WHERE trim(text) <> '') GROUP BY kind")
def relations(r, p):
    p = p.filter(F.trim("text") != "").select(c("id").alias("source_id"))
    return r.filter(c("kind").isin("supports", "rebuts", "undercuts", "qualifies")).join(p, "source_id", "left_semi").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"))


@query("GRF-01_propositions", "propositions", sql="SELECT id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty_payload' END AS reason FROM propositions")
def new_propositions(p):
    return R.propositions(p.withColumnRenamed("text", "payload")).select("id", "reason")


GOOD = "good AS (SELECT id FROM propositions WHERE trim(text) <> ''), checked AS (SELECT a.*, CASE WHEN proposition_id NOT IN (SELECT id FROM good) THEN 'proposition_missing' WHEN evidence_id IS NOT NULL AND evidence_id NOT IN (SELECT id FROM evidence) THEN 'evidence_missing' END AS reason FROM assertions a)"


@query("GRF-01_assertions", "assertions", "propositions", "evidence", sql=f"WITH {GOOD} SELECT id, agent, reason FROM checked")
def checked_assertions(a, p, e):
    return R.assertions(a, p.filter("trim(text) <> ''"), e).select("id", "agent", "reason")


@query("GRF-01_rejected_relations", "relations", sql="SELECT id, kind, CASE WHEN kind NOT IN ('supports', 'rebuts', 'undercuts', 'qualifies') THEN 'unsupported_type' END AS reason FROM relations")
def rejected_relations(r):
    return R.relations(r).select("id", "kind", "reason")


# The SQL bounds the steps; the query goes on until nothing new is found.
@query("GRF-01_asserted_reach", "relations", "assertions", "propositions", "evidence", sql=f"""WITH RECURSIVE {GOOD}, e AS (SELECT DISTINCT source_id, target_id FROM relations WHERE kind IN ('supports', 'qualifies')),
  w AS (SELECT DISTINCT proposition_id AS id, 0 AS hops FROM checked WHERE reason IS NULL AND modality = 'purchase' UNION SELECT e.target_id, w.hops + 1 FROM w JOIN e ON e.source_id = w.id WHERE w.hops < 12) SELECT id, min(hops) AS hops FROM w GROUP BY id""")  # fmt: skip
def asserted_reach(r, a, p, e):
    """What assertions in one mode carry by support and qualification, over any number of relations."""
    good = R.assertions(a, p.filter("trim(text) <> ''"), e).filter("reason IS NULL AND modality = 'purchase'").select(c("proposition_id").alias("id"))
    return R.reached(R.relations(r).filter("reason IS NULL AND kind IN ('supports', 'qualifies')"), good)


@query("GRF-02_reachable", "relations", sql="WITH RECURSIVE w AS (SELECT 1 AS id, 0 AS hops UNION SELECT r.target_id, w.hops + 1 FROM w JOIN relations r ON r.source_id = w.id AND r.kind = 'supports' WHERE w.hops < 3) SELECT id, min(hops) AS hops FROM w GROUP BY id")
def reachable(r, start=1, most=3):
    """Nodes within ``most`` steps of support from one node."""
    return R.reached(r.filter("kind = 'supports'"), r.sparkSession.range(1).select(F.lit(start).cast("long").alias("id")), most)
