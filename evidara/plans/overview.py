"""Queries of aggregates: dashboards, integrity and job state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidara.functions import scalar as S
from evidara.operators import models as M
from evidara.operators import progress as P
from evidara.operators import registration as G
from evidara.operators import tables as T
from evidara.operators.latest import latest_by
from evidara.plans.registry import query
from evidara.plans.scalars import MEDIA_SQL

c = F.col


@query("AGG-02_profile", "resources", sql="SELECT coalesce(sum(size_bytes), 0) AS total, coalesce(min(size_bytes), 0) AS least, coalesce(max(size_bytes), 0) AS most, CAST(round_even(avg(size_bytes), 0) AS BIGINT) AS mean FROM resources")
def profile(r):
    z = lambda x: F.coalesce(x, F.lit(0))
    s = "size_bytes"
    return r.agg(z(F.sum(s)).alias("total"), z(F.min(s)).alias("least"), z(F.max(s)).alias("most"), F.bround(F.avg(s), 0).cast("long").alias("mean"))


@query("AGG-03_recency", "resources", sql="SELECT count(*) FILTER (imported_on >= DATE '2024-02-08') AS week, count(*) FILTER (imported_on >= DATE '2024-01-16') AS month, count(*) FILTER (regexp_matches(lower(url), '^https?://')) AS external FROM resources")
def recency(r, today="2024-02-15"):
    ago = lambda d: c("imported_on") >= F.date_sub(F.lit(today).cast("date"), d)
    return r.agg(F.count_if(ago(7)).alias("week"), F.count_if(ago(30)).alias("month"), F.count_if(S.is_url(c("url"))).alias("external"))


@query("AGG-04_coverage", "evidence", "claims", sql="SELECT (SELECT count(DISTINCT claim_id) FROM evidence) AS with_evidence, (SELECT count(DISTINCT set_id) FROM claims) AS sets, (SELECT count(DISTINCT cite) FROM claims) AS cites")
def coverage(e, k):
    a = e.agg(F.countDistinct("claim_id").alias("with_evidence"))
    return a.crossJoin(k.agg(F.countDistinct("set_id").alias("sets"), F.countDistinct("cite").alias("cites")))  # one row each


@query("AGG-05_safe_pct", "claims", sql="SELECT set_id, round(greatest(count(cite), 0) / count(*) * 100, 2) AS pct FROM claims GROUP BY set_id")
def pct(k):
    return k.groupBy("set_id").agg(S.safe_pct(F.count("cite"), F.count("*")).alias("pct"))


@query("AGG-06_documents_by_type", "resources", sql=f"SELECT {MEDIA_SQL} AS label, count(*) AS n, sum(size_bytes) AS bytes FROM (SELECT size_bytes, lower(coalesce(media_type, '')) AS m FROM resources) GROUP BY 1")
def by_type(r):
    return r.groupBy(S.media_label(c("media_type")).alias("label")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")).orderBy(F.desc("n"), F.desc("bytes"), "label")


@query("AGG-07_top_media", "resources", sql="SELECT lower(media_type) AS label, count(*) AS n FROM resources WHERE media_type IS NOT NULL GROUP BY media_type ORDER BY n DESC, media_type LIMIT 8")
def top_media(r):
    n = r.filter(c("media_type").isNotNull()).groupBy("media_type").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "media_type").limit(8).select(F.lower("media_type").alias("label"), "n")


@query("AGG-08_status_histogram", "runs", sql="SELECT lower(status) AS status, count(*) AS n FROM runs GROUP BY 1")
def histogram(r):
    """Grouped by the folded status: labels that differ in case are summed."""
    return r.groupBy(F.lower("status").alias("status")).agg(F.count("*").alias("n"))


@query("AGG-09_daily_counts", "events", sql="SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1")
def daily(e):
    return e.filter(c("ts") >= F.lit("2024-01-10").cast("timestamp")).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("AGG-10_gap_filled", "jobs", sql="""SELECT d.day, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-25', DATE '2024-02-07', INTERVAL 1 DAY)) AS DATE) AS day) d
LEFT JOIN (SELECT day, count(*) AS n FROM jobs WHERE status = 'done' GROUP BY day) USING (day)""")  # fmt: skip
def gap_filled(j, last="2024-02-07", days=14):
    end = F.lit(last).cast("date")
    every = j.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    n = j.filter(c("status") == "done").filter(c("day") > F.date_sub(end, days)).groupBy("day").agg(F.count("*").alias("n"))
    return every.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("AGG-11_queue_pivot", "jobs", sql="SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM jobs")
def queue_pivot(j):
    return j.agg(*[F.count_if(c("status") == s).alias(s) for s in ("queued", "processing", "done", "failed")], F.count("*").alias("total"))


@query("AGG-12_four_keys", "runs", "resources", sql="SELECT r.source, r.lang, x.status, x.parser, count(*) AS n FROM runs x JOIN resources r ON r.id = x.resource_id GROUP BY ALL")
def four_keys(x, r):
    return x.join(r.select(c("id").alias("resource_id"), "source", "lang"), "resource_id").groupBy("source", "lang", "status", "parser").agg(F.count("*").alias("n"))


@query("AGG-13_unbound_claims", "claims", "evidence", sql="SELECT k.id FROM claims k LEFT JOIN evidence e ON e.claim_id = k.id AND e.role = 'value-cell' WHERE claim_type = 'quantitative' GROUP BY k.id HAVING count(e.id) = 0")
def unbound(k, e):
    return k.filter("claim_type = 'quantitative'").join(e.filter("role = 'value-cell'").select(c("claim_id").alias("id")), "id", "left_anti").select("id")


@query("AGG-14_max_per_group", "runs", sql="SELECT resource_id, max(created_on) AS last FROM runs GROUP BY resource_id")
def max_per_group(r):
    return r.groupBy("resource_id").agg(F.max("created_on").alias("last"))


@query("AGG-15_min_text", "customer", sql="SELECT c_nationkey, min(c_name) AS name FROM customer GROUP BY c_nationkey")
def min_text(k):
    return k.groupBy("c_nationkey").agg(F.min("c_name").alias("name"))


@query("AGG-16_run_summary", "runs", sql="SELECT count(*) AS total, count(*) FILTER (status = 'success') AS passed, count(*) FILTER (status <> 'success') AS failed FROM runs")
def run_summary(r):
    return r.agg(F.count("*").alias("total"), F.count_if(c("status") == "success").alias("passed"), F.count_if(c("status") != "success").alias("failed"))


@query("AGG-18_selector_types", "selectors", sql="SELECT evidence_id, count(DISTINCT selector_type) AS n, count(DISTINCT selector_type) < 2 AS weak FROM selectors GROUP BY evidence_id")
def selector_types(s):
    kinds = s.groupBy("evidence_id").agg(F.collect_set("selector_type").alias("kinds"))
    n = F.size("kinds").cast("long")
    return kinds.select("evidence_id", n.alias("n"), (n < 2).alias("weak"))


@query("AGG-19_missing_roles", "evidence", sql="""SELECT claim_id, array_to_string(list_filter(['value-cell', 'row-header', 'column-header', 'caption'], lambda r: NOT list_contains(roles, r)), ',') AS missing
FROM (SELECT claim_id, list(DISTINCT role) AS roles FROM evidence GROUP BY claim_id)""")  # fmt: skip
def missing_roles(e):
    need = F.array(*map(F.lit, ("value-cell", "row-header", "column-header", "caption")))
    return e.groupBy("claim_id").agg(F.array_join(F.array_except(need, F.collect_set("role")), ",").alias("missing"))


@query("AGG-20_summed_timings", "events", sql="SELECT event_type, sum(value) AS a, sum(value * 2) AS b FROM events GROUP BY event_type")
def summed_timings(e):
    m = e.select("event_type", F.explode(F.create_map(F.lit("a"), "value", F.lit("b"), c("value") * 2)))
    return m.groupBy("event_type").pivot("key", ["a", "b"]).agg(F.sum("value"))


@query("AGG-21_ucb", "events", sql="""SELECT event_type, (ok + 1.0) / (n + 2.0) + 0.4 * sqrt(ln(sum(n) OVER () + 1) / n) AS ucb FROM (SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS ok FROM events GROUP BY event_type)""")
def ucb(e):
    n = e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(c("value") > 50).alias("ok"))
    total = e.agg(F.count("*").alias("t"))
    return n.crossJoin(total).select("event_type", ((c("ok") + 1.0) / (c("n") + 2.0) + 0.4 * F.sqrt(F.log(c("t") + 1) / c("n"))).alias("ucb"))  # one row


MODELS = ("click", "error", "purchase", "view", "untried")


# Integers of nanoseconds and tokens are summed exactly; seconds are rounded.
@query("AGG-21_models", "model_attempts", sql=f"""WITH m AS (SELECT unnest({list(MODELS)}) AS model, unnest(range(5)) AS ord), a AS (SELECT model, count(*) AS n, count(*) FILTER (ok) AS good, sum(elapsed) AS s, sum(tokens) FILTER (eval_ns > 0) AS tok, sum(eval_ns) FILTER (eval_ns > 0) AS ns FROM model_attempts GROUP BY model),
  k AS (SELECT m.model, m.ord, coalesce(n, 0) AS attempts, coalesce(good / n, 0.5) AS rate, coalesce(s / n, 999) AS mean, CASE WHEN ns > 0 AND tok > 0 THEN tok / (ns / 1e9) END AS speed, (SELECT count(*) FROM model_attempts) AS total FROM m LEFT JOIN a USING (model))
  SELECT model, attempts, round(rate, 6) AS success_rate, round(mean, 6) AS mean_elapsed, round(speed, 6) AS tokens_per_second, round((rate + 0.05) / greatest(mean, 0.5), 6) AS score,
  CASE WHEN attempts > 0 THEN round((rate + 0.05) / greatest(mean, 0.5) + 0.4 * sqrt(ln(total + 1) / attempts), 6) END AS ucb, ord = 4 AS chosen FROM k""")  # fmt: skip
def models(t):
    listed = t.sparkSession.range(len(MODELS)).select(F.element_at(F.array(*map(F.lit, MODELS)), (c("id") + 1).cast("int")).alias("model"), c("id").alias("ord"))
    known = M.statistics(listed, t)
    picked = F.broadcast(M.choice(known).select("model", F.lit(True).alias("chosen")))
    rounded = [F.round(x, 6).alias(x) for x in ("success_rate", "mean_elapsed", "tokens_per_second", "score", "ucb")]
    return known.join(picked, "model", "left").select("model", "attempts", *rounded, F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query("AGG-22_outcomes", "jobs", sql="SELECT count(*) FILTER (status = 'done' AND detail <> '') AS extracted, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (page IS NULL) AS unpaged, count(*) FILTER (status = 'failed') AS failed FROM jobs")
def outcomes(j):
    return j.agg(F.count_if((c("status") == "done") & (c("detail") != "")).alias("extracted"), F.count_if(c("status") == "skipped").alias("skipped"), F.count_if(c("page").isNull()).alias("unpaged"), F.count_if(c("status") == "failed").alias("failed"))


@query("AGG-23_last_25", "runs", sql="SELECT status, count(*) AS n FROM (SELECT status FROM runs ORDER BY created_on DESC, id DESC LIMIT 25) GROUP BY status")
def last_25(r):
    return r.orderBy(F.desc("created_on"), F.desc("id")).limit(25).groupBy("status").agg(F.count("*").alias("n"))


@query("AGG-24_bbox_union", "lineitem", sql="SELECT l_orderkey, min(l_discount) AS x0, min(l_tax) AS y0, max(l_quantity) AS x1, max(l_extendedprice) AS y1 FROM lineitem GROUP BY l_orderkey")
def bbox_union(l):
    return l.groupBy("l_orderkey").agg(F.min("l_discount").alias("x0"), F.min("l_tax").alias("y0"), F.max("l_quantity").alias("x1"), F.max("l_extendedprice").alias("y1"))


@query("TAB-01_header_row", "sheet_cells", sql=f"""WITH r AS (SELECT table_id, row_index, count(*) FILTER (trim(value) <> '') AS filled, count(DISTINCT CASE WHEN trim(value) <> '' THEN lower(trim(value)) END) AS uniq,
  min(CASE WHEN col_index = 0 THEN lower(trim(value)) END) AS first FROM sheet_cells GROUP BY table_id, row_index),
s AS (SELECT r.table_id, r.row_index, 2.5::DOUBLE * r.filled + 1.1::DOUBLE * r.uniq - CASE WHEN list_bool_or(list_transform({list(S.METADATA_PREFIXES)}, lambda p: starts_with(coalesce(r.first, ''), p))) THEN 3 ELSE 0 END
  + CASE WHEN coalesce(n.filled, 0) >= r.filled THEN 0.5 ELSE 0 END AS score FROM r LEFT JOIN r n ON n.table_id = r.table_id AND n.row_index = r.row_index + 1 WHERE r.filled > 0)
SELECT table_id, row_index AS header FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY round(score, 6) DESC, row_index) AS n FROM s) WHERE n = 1""")  # fmt: skip
def header_row(g):
    scores = T.header_scores(g, S.is_metadata_row)
    return T.header_rows(scores.withColumn("score", F.round("score", 6)))


@query("TAB-02_header_row_sheet", "grid", sql="""WITH r AS (SELECT table_id, row_index, 2.5::DOUBLE * count(*) + 1.1::DOUBLE * count(DISTINCT lower(value)) AS score, count(*) AS filled FROM grid GROUP BY table_id, row_index),
n AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY score DESC, row_index) AS n FROM r)
SELECT table_id, row_index + 1 AS header, filled, score FROM n WHERE n = 1""")  # fmt: skip
def header_row_sheet(g):
    """A sheet's header by its score without a look at the next row, as a row number from 1."""
    r = g.groupBy("table_id", "row_index").agg((2.5 * F.count("value") + 1.1 * F.countDistinct(F.lower("value"))).alias("score"), F.count("value").alias("filled"))
    return latest_by(r, ["table_id"], F.desc("score"), c("row_index")).select("table_id", (c("row_index") + 1).alias("header"), "filled", "score")


@query("HLT-02_bad_json", "events", sql="SELECT event_id FROM events WHERE event_id % 9 = 0")
def bad_json(e):
    text = F.when(c("event_id") % 9 == 0, F.lit("{bad")).otherwise(c("props"))
    return e.filter(F.try_parse_json(text).isNull() & text.isNotNull()).select("event_id")


@query("HLT-04_orphans", "runs", "evidence", sql="SELECT 'failed' AS issue, count(*) AS n FROM runs WHERE status = 'failed' UNION ALL SELECT 'empty', count(*) FROM runs WHERE id NOT IN (SELECT claim_id FROM evidence)")
def orphans(r, e):
    failed = r.filter("status = 'failed'").agg(F.count("*").alias("n")).select(F.lit("failed").alias("issue"), "n")
    return failed.unionAll(r.join(e.select(c("claim_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("empty").alias("issue"), "n"))


@query("HLT-05_overall", "runs", "evidence", sql="SELECT (SELECT count(*) FROM runs WHERE status = 'failed') = 0 AS ok")
def overall(r, e):
    return orphans(r, e).agg((F.count_if((c("issue") == "failed") & (c("n") > 0)) == 0).alias("ok"))


@query("REG-02_duplicate_texts", "documents", sql="SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(d):
    return d.groupBy(S.sha256_text(c("text")).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query("REG-01_register", "documents", sql="SELECT sha256(text) AS digest, min(doc_id) AS id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents WHERE length(text) > 0 GROUP BY 1")
def register(d):
    d = d.filter(F.length("text") > 0)
    return d.groupBy(S.sha256_text(c("text")).alias("digest")).agg(F.min("doc_id").alias("id"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


#: Files that are taken and the addresses of each content, in DuckDB.
TAKEN = r"""raw AS (SELECT *, list_filter(list_transform([u1, u2], lambda x: regexp_replace(regexp_replace(trim(x), '^["''<\[(]+|["''>\])]+$', '', 'g'), '[,;]+$', '')), lambda x: x LIKE 'http%://%') AS us FROM arrivals),
  a AS (SELECT ord, filename, us, sha256(body) AS digest, CASE WHEN body IS NULL THEN 'file_missing' WHEN body = '' THEN 'zero_bytes' WHEN len(us) = 0 THEN 'no_url' END AS reason FROM raw),
  reg AS (SELECT sha256(text) AS digest, id, title, url FROM registered),
  spread AS (SELECT digest, ord, i - 1 AS place, us[i] AS url FROM (SELECT *, unnest(range(1, len(us) + 1)) AS i FROM a WHERE reason IS NULL) UNION ALL SELECT digest, -1, 0, url FROM reg),
  urls AS (SELECT digest, url, min({'o': ord, 'p': place}) AS m FROM spread GROUP BY digest, url)"""


def _ingest(a, r):
    files = a.select("ord", "filename", "body", F.array("u1", "u2").alias("urls"))
    return files, r.select(S.sha256_text(c("text")).alias("digest"), "id", F.array("url").alias("urls"), F.concat(F.lit("old_"), "id").alias("original_filename"), c("title").alias("display_title"))


@query("REG-01_statuses", "arrivals", "registered", sql=f"""WITH {TAKEN} SELECT ord, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN digest IN (SELECT digest FROM reg) OR ord > min(ord) FILTER (reason IS NULL) OVER (PARTITION BY digest) THEN 'duplicate' ELSE 'ingested' END AS status, reason FROM a""")
def ingest_statuses(a, r):
    return G.statuses(*_ingest(a, r))


@query("REG-01_merged_urls", "arrivals", "registered", sql=f"WITH {TAKEN} SELECT digest, url, m.o AS ord, m.p AS place FROM urls")
def ingest_urls(a, r):
    return G.merged_urls(*_ingest(a, r))


@query("REG-01_resources", "arrivals", "registered", sql=f"""WITH {TAKEN}, f AS (SELECT digest, min(ord) AS first, min_by(filename, ord) AS filename, count(*) AS n FROM a WHERE reason IS NULL GROUP BY digest),
  p AS (SELECT digest, min_by(url, m) AS url, count(*) AS n FROM urls GROUP BY digest)
  SELECT digest, coalesce(reg.id, f.first) AS id, reg.id IS NULL AS is_new, coalesce(f.n, 0) AS arrivals, p.url AS download_url, p.n AS n_urls, CASE WHEN reg.id IS NULL THEN f.filename ELSE 'old_' || reg.id END AS original_filename, reg.title AS kept_title
  FROM f FULL JOIN reg USING (digest) JOIN p USING (digest)""")  # fmt: skip
def ingest_resources(a, r):
    out = G.resources(*_ingest(a, r))
    return out.withColumn("kept_title", F.when(c("display_title").startswith("Kept "), c("display_title"))).drop("display_title")


@query("STR-01_progress", "jobs", sql="""SELECT job_id, state, max_by(detail, seq) FILTER (detail <> '') AS detail, max_by(page, seq) FILTER (page IS NOT NULL) AS page, max(seq) AS seq FROM jobs GROUP BY job_id, state""")
def progress(j):
    last = lambda k, where: F.max_by(k, F.when(where, c("seq"))).alias(k)
    got = j.groupBy("job_id", "state").agg(last("detail", c("detail") != ""), last("page", c("page").isNotNull()), F.max("seq").alias("seq"), F.count_if(c("detail") != "").alias("d"), F.count("page").alias("p"))
    return got.select("job_id", "state", F.when(c("d") > 0, c("detail")).alias("detail"), F.when(c("p") > 0, c("page")).alias("page"), "seq")


#: Updates that count, in DuckDB.
COUNTED = """ends AS (SELECT job_id, min({'ts': ts, 'seq': seq}) AS e FROM updates WHERE status IN ('done', 'failed', 'skipped', 'cancelled') GROUP BY job_id),
  u AS (SELECT updates.* REPLACE (trim(stage) AS stage) FROM updates LEFT JOIN ends USING (job_id) WHERE e IS NULL OR {'ts': ts, 'seq': seq} <= e)"""


# The SQL folds a stage's updates one by one.
@query("STR-01_steps", "updates", sql=f"""WITH {COUNTED},
  l AS (SELECT job_id, stage, list({{'state': coalesce(state, 'pending'), 'progress': coalesce(progress, 0), 'detail': detail, 'stats': stats, 'n': CASE WHEN page_count > 0 THEN page_count END,
    'page': CASE WHEN page_current > 0 THEN page_current END, 'preview': preview}} ORDER BY ts, seq) AS xs FROM u WHERE stage <> '' GROUP BY job_id, stage),
  f AS (SELECT job_id, stage, list_reduce(list_prepend({{'state': '', 'progress': 0::BIGINT, 'detail': '', 'stats': '', 'n': NULL::BIGINT, 'page': NULL::BIGINT, 'preview': NULL::VARCHAR}}, xs),
    lambda a, x: {{'state': x.state, 'progress': x.progress, 'detail': CASE WHEN x.detail <> '' THEN x.detail ELSE a.detail END, 'stats': CASE WHEN x.stats <> '' THEN x.stats ELSE a.stats END, 'n': coalesce(x.n, a.n),
    'page': CASE WHEN coalesce(x.page, a.page) IS NOT NULL THEN greatest(1, least(coalesce(x.page, a.page), coalesce(x.n, a.n, x.page, a.page))) END, 'preview': coalesce(x.preview, a.preview)}}) AS s FROM l)
  SELECT job_id, stage, s.state AS state, s.progress AS progress, s.detail AS detail, s.stats AS stats, s.n AS page_count, s.page AS page_current, s.preview AS preview FROM f""")  # fmt: skip
def progress_steps(u):
    return P.steps(u)


@query("STR-01_lines", "updates", sql=f"""WITH {COUNTED} SELECT job_id, last(status ORDER BY ts, seq) AS status, last(detail ORDER BY ts, seq) FILTER (detail <> '') AS status_line,
  last(stats ORDER BY ts, seq) FILTER (stats <> '') AS counters_line, last(preview ORDER BY ts, seq) FILTER (preview <> '' AND stage <> '') AS latest_preview, count(*) FILTER (stage <> '') AS n_events,
  list_extract(list(seq ORDER BY ts, seq) FILTER (stage <> ''), CAST(greatest(1, count(*) FILTER (stage <> '') - 3999) AS BIGINT)) AS first_kept FROM u GROUP BY job_id""")  # fmt: skip
def progress_lines(u):
    return P.lines(u)


@query("STR-02_job_state", "jobs", sql="SELECT job_id, coalesce(min_by(status, seq) FILTER (status IN ('done', 'failed', 'skipped')), max_by(status, seq)) AS status FROM jobs GROUP BY job_id")
def job_state(j):
    """The first terminal status holds; else the last status."""
    ends = c("status").isin("done", "failed", "skipped")
    got = j.groupBy("job_id").agg(F.min_by("status", F.when(ends, c("seq"))).alias("t"), F.count_if(ends).alias("n"), F.max_by("status", "seq").alias("l"))
    return got.select("job_id", F.when(c("n") > 0, c("t")).otherwise(c("l")).alias("status"))


@query("STR-04_retry", "jobs", sql="SELECT job_id, seq, CASE WHEN status = 'skipped' AND detail LIKE 'step%' THEN 'queued' ELSE status END AS status FROM jobs WHERE status <> 'done'")
def retry(j):
    return j.filter("status <> 'done'").select("job_id", "seq", F.when((c("status") == "skipped") & c("detail").startswith("step"), "queued").otherwise(c("status")).alias("status"))


@query("STR-07_windows", "events", sql="SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def windows(e):
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(c("w.start").alias("start"), "event_type", "n", "total")


@query("STR-09_completion", "jobs", sql="""SELECT seq, CASE WHEN status = 'processing' THEN CASE seq % 4 WHEN 0 THEN 'skipped' WHEN 3 THEN NULL ELSE 'cancelled' END END AS ended,
coalesce(CASE WHEN seq % 5 = 0 THEN 'indexed ' || seq END, CASE WHEN detail <> '' THEN detail END, CASE WHEN seq % 2 = 0 THEN state END, 'n/a') AS detail FROM jobs""")  # fmt: skip
def completion(j):
    """What a job's result says of its vectors or text, and how a request ends it: only while it is processed, and by a kill where the action is unknown."""
    status = lambda ok, value: F.struct(F.when(ok, value).alias("status"))
    summary = F.struct(F.when(c("seq") % 5 == 0, F.concat(F.lit("indexed "), "seq")).alias("vector_status"))
    result = F.to_json(F.struct(summary.alias("summary"), status(c("detail") != "", c("detail")).alias("vector"), status(c("seq") % 2 == 0, c("state")).alias("extraction")))
    detail = F.coalesce(*[F.get_json_object(result, p) for p in ("$.summary.vector_status", "$.vector.status", "$.extraction.status")], F.lit("n/a"))
    action = F.lower(F.trim(F.when(c("seq") % 4 == 0, " Skip").when(c("seq") % 4 == 1, "kill").when(c("seq") % 4 == 2, "pause")))
    ended = F.when((c("status") == "processing") & action.isNotNull(), F.when(action == "skip", "skipped").otherwise("cancelled"))
    return j.select("seq", ended.alias("ended"), detail.alias("detail"))

