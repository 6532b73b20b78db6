"""Queries of joins, latest rows, top-k and set operations."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidara.functions import scalar as S
from evidara.operators.bands import band_counts
from evidara.operators.latest import first_n_by, insert_or_ignore, latest_by, latest_with_ties, page_of, upsert
from evidara.plans.registry import query

c = F.col


@query("SRC-01_point_lookup", "orders", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 100")
def point(o):
    return o.filter(c("o_orderkey") == 100).select("o_orderkey", "o_totalprice")


@query("FLT-01_conjunctive", "lineitem", sql="SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def conjunctive(l, **wanted):
    for k, v in (wanted or {"l_returnflag": "R", "l_linestatus": "F"}).items():
        if v is not None:
            l = l.filter(c(k) == v)
    return l.select("l_orderkey", "l_linenumber")


@query("FLT-03_missing_source", "resources", sql="SELECT id FROM resources WHERE NOT regexp_matches(lower(coalesce(url, '')), '^https?://')")
def missing_source(r):
    return r.filter(~S.is_url(c("url"))).select("id")


@query("FLT-04_in_and_range", "resources", sql="SELECT id, size_bytes FROM resources WHERE lower(media_type) IN ('text/csv', 'text/plain') AND size_bytes >= 2000")
def in_and_range(r):
    return r.filter(F.lower("media_type").isin("text/csv", "text/plain") & (c("size_bytes") >= 2000)).select("id", "size_bytes")


@query("FLT-06_status_sets", "jobs", sql="SELECT job_id, seq, status IN ('done', 'failed', 'skipped') AS terminal, detail LIKE 'step 1%' AS first_steps FROM jobs")
def status_sets(j):
    return j.select("job_id", "seq", c("status").isin("done", "failed", "skipped").alias("terminal"), c("detail").startswith("step 1").alias("first_steps"))


@query("FLT-07_null_guarded", "runs", sql="SELECT id, CASE WHEN resource_id = 7 THEN 0 ELSE 1 END AS rank FROM runs WHERE resource_id = 7 OR (NULL IS NOT NULL AND id = NULL)")
def null_guarded(r, resource=7, run=None):
    hit = c("resource_id") == resource
    if run is not None:
        hit = hit | (c("id") == run)
    return r.filter(hit).select("id", F.when(c("resource_id") == resource, 0).otherwise(1).alias("rank"))


@query("FLT-09_row_has_text", "values_", sql="SELECT id FROM values_ WHERE trim(coalesce(raw, '')) <> ''")
def row_has_text(v):
    return v.filter(S.row_has_text(F.array("raw", F.lit(" ")))).select("id")


@query("JN-01_claim_trace", "claims", "evidence", "selectors", sql="""SELECT k.id AS claim_id, e.id AS evidence_id, e.role, string_agg(s.selector_type, ',' ORDER BY s.ord) AS selectors
FROM claims k JOIN evidence e ON e.claim_id = k.id JOIN selectors s ON s.evidence_id = e.id GROUP BY k.id, e.id, e.role""")  # fmt: skip
def claim_trace(k, e, s):
    sel = s.groupBy("evidence_id").agg(F.array_sort(F.collect_list(F.struct("ord", "selector_type"))).alias("x"))
    e = e.join(k.select(c("id").alias("claim_id")), "claim_id", "left_semi")
    return e.join(sel, c("id") == c("evidence_id")).select("claim_id", c("id").alias("evidence_id"), "role", F.array_join("x.selector_type", ",").alias("selectors"))


@query("JN-02_resource_references", "reference_links", "citations", sql="SELECT l.resource_id, l.cite, count(*) AS n, min(t.title) AS title FROM reference_links l JOIN citations t USING (cite) GROUP BY l.resource_id, l.cite")
def resource_references(l, t):
    return l.join(t.select("cite", "title"), "cite").groupBy("resource_id", "cite").agg(F.count("*").alias("n"), F.min("title").alias("title"))


@query("JN-03_resource_claims", "evidence", "claims", sql="SELECT DISTINCT e.resource_id, k.id AS claim_id FROM evidence e JOIN claims k ON k.id = e.claim_id")
def resource_claims(e, k):
    return e.select("resource_id", "claim_id").distinct().join(k.select(c("id").alias("claim_id")), "claim_id", "left_semi").select("resource_id", "claim_id")


@query("JN-04_citation_trace", "citations", "reference_links", "claims", sql="""SELECT t.cite, t.title, coalesce(r.n, 0) AS resources, coalesce(k.n, 0) AS claims FROM citations t
LEFT JOIN (SELECT cite, count(DISTINCT resource_id) AS n FROM reference_links GROUP BY cite) r USING (cite) LEFT JOIN (SELECT cite, count(*) AS n FROM claims GROUP BY cite) k USING (cite)""")  # fmt: skip
def citation_trace(t, l, k):
    r = l.groupBy("cite").agg(F.countDistinct("resource_id").alias("r"))
    n = k.groupBy("cite").agg(F.count("*").alias("k"))
    return t.join(r, "cite", "left").join(n, "cite", "left").select("cite", "title", F.coalesce("r", F.lit(0)).alias("resources"), F.coalesce("k", F.lit(0)).alias("claims"))


LATEST = "SELECT resource_id, id, created_on, status FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY created_on DESC, id DESC) AS n FROM runs) WHERE n = 1"


@query("WIN-01_latest_run", "runs", sql=LATEST)
def latest_run(r):
    return latest_by(r, ["resource_id"], F.desc("created_on"), F.desc("id")).select("resource_id", "id", "created_on", "status")


@query("JN-05_latest_text", "runs", "notes", sql=f"SELECT l.resource_id, t.text FROM ({LATEST}) l JOIN notes t ON t.id = l.id")
def latest_text(r, t):
    return latest_run(r).join(t, "id").select("resource_id", "text")


@query("JN-06_latest_with_ties", "runs", sql="SELECT resource_id, id FROM (SELECT *, rank() OVER (PARTITION BY resource_id ORDER BY created_on DESC) AS n FROM runs) WHERE n = 1")
def latest_ties(r):
    return latest_with_ties(r, ["resource_id"], F.desc("created_on")).select("resource_id", "id")


@query("JN-07_unindexed_latest", "runs", "evidence", sql=f"SELECT l.resource_id, l.id FROM ({LATEST}) l WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.claim_id = l.id AND e.role = 'value-cell')")
def unindexed(r, e):
    return latest_run(r).join(e.filter("role = 'value-cell'").select(c("claim_id").alias("id")), "id", "left_anti").select("resource_id", "id")


@query("JN-08_two_anti_joins", "customer", "orders", "reference_links", sql="SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM reference_links WHERE reference_id = c_custkey AND resource_id < 5)")
def two_anti(k, o, l):
    k = k.join(o.filter("o_orderstatus = 'F'"), c("c_custkey") == c("o_custkey"), "left_anti")
    return k.join(l.filter("resource_id < 5"), c("c_custkey") == c("reference_id"), "left_anti").select("c_custkey")


@query("JN-09_scalar_latest", "customer", "orders", sql="SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS o_orderkey FROM customer")
def scalar_latest(k, o):
    last = o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return k.join(last, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("JN-10_exists_column", "customer", "orders", sql="SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_text FROM customer")
def exists_column(k, o):
    return k.join(o.select("o_custkey").distinct(), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", c("o_custkey").isNotNull().alias("has_text"))


@query("JN-11_min_per_resource", "resources", "reference_links", sql="SELECT id, min(cite) AS cite FROM resources LEFT JOIN reference_links ON resource_id = id GROUP BY id")
def min_per_resource(r, l):
    return r.select("id").join(l.groupBy("resource_id").agg(F.min("cite").alias("cite")), c("id") == c("resource_id"), "left").select("id", "cite")


@query("JN-12_heading_text", "documents", "lineitem", sql="SELECT doc_id, l_linenumber, substr(text, CAST(l_partkey % 50 AS INTEGER) + 1, 12) AS heading FROM documents JOIN lineitem ON doc_id = l_orderkey")
def heading_text(d, l):
    return d.join(l, c("doc_id") == c("l_orderkey")).select("doc_id", "l_linenumber", F.substring("text", (c("l_partkey") % 50).cast("int") + 1, F.lit(12)).alias("heading"))


@query("JN-13_confirmed_link", "documents", "reference_links", "citations", sql="SELECT doc_id, min(title) AS title FROM documents JOIN reference_links ON doc_id = reference_id JOIN citations USING (cite) GROUP BY doc_id")
def confirmed_link(d, l, t):
    return d.select("doc_id").join(l.select(c("reference_id").alias("doc_id"), "cite"), "doc_id").join(t.select("cite", "title"), "cite").groupBy("doc_id").agg(F.min("title").alias("title"))


@query("JN-15_size_band", "files", "downloads", sql="SELECT f.id, count(*) AS n, min(d.id) AS first FROM files f JOIN downloads d ON d.size BETWEEN f.size * 0.98 AND f.size * 1.02 GROUP BY f.id")
def size_band(f, d):
    return band_counts(f.select("id", "size"), d.select(c("id").alias("did"), c("size").alias("dsize")), "size", "dsize", 0.02, "did").select("id", "n", "first")


@query("JN-16_filename_tiers", "files", "downloads", sql="""SELECT id, did, tier FROM (SELECT *, min(tier) OVER (PARTITION BY id) AS best FROM (SELECT f.id, d.id AS did, CASE WHEN d.size < 0 THEN 2 ELSE 1 END AS tier
  FROM files f JOIN downloads d ON lower(f.filename) = lower(d.filename) WHERE d.size < 0 OR abs(d.size - f.size) <= f.size * 0.05)) WHERE tier = best""")  # fmt: skip
def filename_tiers(f, d):
    """Whether a file has a download of a near size is found among different names and sizes, so only pairs that are results are made, and none is shuffled."""
    d = d.select(c("id").alias("did"), c("size").alias("dsize"), F.lower("filename").alias("name")).filter("dsize IS NOT NULL")
    f = f.select("id", "size", F.lower("filename").alias("name"))
    near = F.abs(c("dsize") - c("size")) <= c("size") * 0.05
    # Buckets of the logarithm as wide as the band; a size of 0 is near to 0 alone, one below to none.
    bucket = lambda x: F.when(x > 0, F.floor(F.log(x.cast("double")) / math.log(1.05 / 0.95))).when(x == 0, -100)
    around = F.sequence(bucket(c("size")) - 1, bucket(c("size")) + 1)
    known = d.filter("dsize >= 0").withColumn("_b", bucket(c("dsize")))
    sizes = f.select("name", "size").distinct().withColumn("_b", F.explode(around))
    some = sizes.join(known.select("name", "_b", "dsize").distinct(), ["name", "_b"]).filter(near).select("name", "size").distinct().withColumn("_some", F.lit(True))
    files = f.join(some, ["name", "size"], "left").withColumn("_first", F.max(F.coalesce("_some", F.lit(False))).over(Window.partitionBy("id")))
    first = files.filter("_first").withColumn("_b", F.explode(around)).join(known, ["name", "_b"]).filter(near)
    second = files.filter("NOT _first").join(d.filter("dsize < 0"), "name")
    return first.select("id", "did", F.lit(1).alias("tier")).unionByName(second.select("id", "did", F.lit(2).alias("tier")))


@query("JN-21_cooccurrence", "downloads", sql="SELECT name, url FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY first) AS n FROM (SELECT lower(filename) AS name, url, min(id) AS first FROM downloads GROUP BY 1, 2)) WHERE n <= 8")
def cooccurrence(d):
    first = d.groupBy(F.lower("filename").alias("name"), "url").agg(F.min("id").alias("first"))
    return first_n_by(first, ["name"], 8, c("first")).select("name", "url")


@query("JN-23_backfill_url", "citations", "reference_links", "resources", sql="""SELECT t.cite, max_by(r.url, (r.imported_on, r.id)) AS url FROM citations t JOIN reference_links l USING (cite) JOIN resources r ON r.id = l.resource_id
WHERE regexp_matches(lower(r.url), '^https?://') GROUP BY t.cite""")  # fmt: skip
def backfill_url(t, l, r):
    r = r.filter(S.is_url(c("url"))).select(c("id").alias("resource_id"), "url", "imported_on")
    return l.join(t.select("cite"), "cite").join(r, "resource_id").groupBy("cite").agg(F.max_by("url", F.struct("imported_on", "resource_id")).alias("url"))


@query("JN-24_image_counts", "lineitem", sql="SELECT l_suppkey, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS active, count(*) FILTER (l_returnflag <> 'R') AS linked FROM lineitem GROUP BY l_suppkey")
def image_counts(l):
    return l.groupBy("l_suppkey").agg(F.count("*").alias("total"), F.count_if(c("l_returnflag") == "R").alias("active"), F.count_if(c("l_returnflag") != "R").alias("linked"))


@query("JN-26_work_list", "resources", sql="SELECT count(*) AS n FROM resources WHERE NOT coalesce(regexp_matches(lower(url), '^https?://'), false)")
def work_list(r):
    return r.filter(~S.is_url(c("url"))).agg(F.count("*").alias("n"))


@query("WIN-02_latest_table", "lineitem", sql="SELECT l_suppkey, l_partkey, max_by(l_orderkey, (l_shipdate, l_orderkey)) AS l_orderkey FROM lineitem GROUP BY l_suppkey, l_partkey")
def latest_table(l):
    return latest_by(l, ["l_suppkey", "l_partkey"], F.desc("l_shipdate"), F.desc("l_orderkey")).select("l_suppkey", "l_partkey", "l_orderkey")


@query("WIN-05_page_of_key", "orders", sql="SELECT count(*) AS rows_before, (count(*) // 25) * 25 AS page_offset FROM orders WHERE o_orderkey < 777")
def page_of_key(o):
    return page_of(o, c("o_orderkey"), c("o_orderkey") == 777, 25)


@query("WIN-06_running_offset", "conversations", sql="SELECT conv_id, turn, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM conversations")
def running_offset(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0)).alias("off"))


@query("WIN-07_look_ahead", "conversations", sql="SELECT conv_id, turn, lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations")
def look_ahead(t):
    return t.select("conv_id", "turn", F.lead(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn")).alias("next"))


@query("WIN-08_first_match", "evidence", sql="SELECT claim_id, min_by(id, ord) AS id FROM evidence WHERE role = 'value-cell' GROUP BY claim_id")
def first_match(e):
    return e.filter("role = 'value-cell'").groupBy("claim_id").agg(F.min_by("id", "ord").alias("id"))


@query("WIN-10_last_events", "jobs", sql="SELECT job_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS n FROM jobs) WHERE n <= 3")
def last_events(j, most=3):
    return first_n_by(j, ["job_id"], most, F.desc("seq")).select("job_id", "seq")


@query("TOP-01_newest", "orders", sql="SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def newest(o):
    return o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey").limit(20)


@query("TOP-02_paging", "orders", sql="SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30")
def paging(o):
    return o.orderBy("o_orderkey").select("o_orderkey").offset(30).limit(10)


@query("TOP-03_ranked_sort", "runs", sql="SELECT id FROM runs ORDER BY CASE WHEN status = 'success' THEN 0 ELSE 1 END, created_on NULLS FIRST, id LIMIT 15")
def ranked_sort(r):
    return r.orderBy(F.when(c("status") == "success", 0).otherwise(1), "created_on", "id").select("id").limit(15)


@query("TOP-04_newest_ascending", "orders", sql="SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20) ORDER BY o_orderdate, o_orderkey")
def newest_ascending(o):
    return o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).orderBy("o_orderdate", "o_orderkey").select("o_orderkey")


@query("TOP-05_claim_next", "jobs", sql="SELECT job_id, seq FROM jobs WHERE status = 'queued' ORDER BY day, seq LIMIT 1")
def claim_next(j):
    return j.filter("status = 'queued'").orderBy("day", "seq").limit(1).select("job_id", "seq")


@query("SET-01_url_union", "resources", sql="""SELECT id, CASE id % 5 WHEN 0 THEN 'https://a.org' || '|https://www.data-board.org/d/' || id || '/' WHEN 1 THEN 'https://a.org|HTTP://Example.org/x?q=' || id ELSE 'https://a.org' END AS urls FROM resources""")
def url_union(r):
    return r.select("id", F.array_join(S.merged_urls(F.array(F.lit("https://a.org;")), F.array("url", F.lit("https://a.org"))), "|").alias("urls"))


@query("SET-02_merge_sources", "downloads", "files", sql="SELECT filename, min(p) AS p FROM (SELECT lower(filename) AS filename, 1 AS p FROM downloads UNION ALL SELECT lower(filename), 2 FROM files) GROUP BY filename")
def merge_sources(d, f):
    return d.select(F.lower("filename").alias("filename"), F.lit(1).alias("p")).unionByName(f.select(F.lower("filename").alias("filename"), F.lit(2).alias("p"))).groupBy("filename").agg(F.min("p").alias("p"))


@query("SET-03_pending", "resources", "runs", sql="SELECT id FROM resources WHERE id NOT IN (SELECT resource_id FROM runs WHERE status = 'success') ORDER BY id LIMIT 50")
def pending(r, runs):
    return r.join(runs.filter("status = 'success'").select(c("resource_id").alias("id")), "id", "left_anti").orderBy("id").select("id").limit(50)


@query("SET-04_first_wins", "lineitem", sql="SELECT l_partkey, l_suppkey, min(l_orderkey * 8 + l_linenumber) AS first FROM lineitem GROUP BY l_partkey, l_suppkey")
def first_wins(l):
    l = l.withColumn("first", c("l_orderkey") * 8 + c("l_linenumber"))
    return latest_by(l, ["l_partkey", "l_suppkey"], c("first")).select("l_partkey", "l_suppkey", "first")


@query("SET-06_page_sets", "lineitem", sql="SELECT l_orderkey, string_agg(p, ',' ORDER BY p) AS pages FROM (SELECT DISTINCT l_orderkey, l_linenumber + 1 AS p FROM lineitem) GROUP BY l_orderkey")
def page_sets(l):
    return l.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(c("l_linenumber") + 1)), ",").alias("pages"))


@query("SNK-02_upsert", "customer", sql="""SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v, CASE WHEN n.k IS NULL THEN 'kept' WHEN o.k IS NULL THEN 'inserted' ELSE 'updated' END AS action
FROM (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey AS k, 'new' AS v FROM customer WHERE c_custkey % 2 = 0) n ON o.k = n.k""")  # fmt: skip
def upsert_query(t):
    row = lambda v: (c("c_custkey").alias("k"), c("c_custkey").alias("id"), v.alias("v"))
    old, new = t.filter("c_custkey % 3 <> 0").select(*row(c("c_name"))), t.filter("c_custkey % 2 = 0").select(*row(F.lit("new")))
    return upsert(old, new, "k").select("k", "v", "action")


@query("SNK-03_insert_or_ignore", "customer", sql="SELECT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900) GROUP BY 1")
def insert_ignore(t):
    k = c("c_nationkey").alias("k")
    return insert_or_ignore(t.filter("c_acctbal < -900").select(k), t.select(k), ["k"])


@query("SNK-04_insert_or_replace", "jobs", sql="SELECT job_id, max(seq) AS seq FROM jobs GROUP BY job_id")
def insert_or_replace(j):
    return latest_by(j, ["job_id"], F.desc("seq")).select("job_id", "seq")
