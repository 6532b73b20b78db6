"""Queries of whole rules: the queue after a restart, index runs, summaries, reconstructed texts, lookups with fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import scalar as S
from evidara.operators import queue as Q
from evidara.operators import segments as G
from evidara.operators import vectors as X
from evidara.operators.latest import insert_or_ignore, latest_by
from evidara.plans.registry import query
from evidara.sources import markup as M

c = F.col


@query("STR-03_recovery", "import_jobs", "staged", sql="""WITH f AS (SELECT *, lower(trim(status)) AS s FROM import_jobs),
  a AS (SELECT *, CASE WHEN s NOT IN ('queued', 'processing', 'done', 'failed', 'skipped', 'cancelled') AND NOT coalesce(finished, false) THEN 'legacy_state' WHEN s = 'processing' AND coalesce(cancel_requested, false) AND lower(coalesce(cancel_action, '')) = 'skip' THEN 'skip_request'
    WHEN s = 'processing' AND coalesce(cancel_requested, false) THEN 'cancel_request' WHEN s = 'processing' THEN 'restart' END AS step FROM f),
  b AS (SELECT a.*, CASE step WHEN 'skip_request' THEN 'skipped' WHEN 'cancel_request' THEN 'cancelled' WHEN 'legacy_state' THEN 'queued' WHEN 'restart' THEN 'queued' ELSE s END AS now, length FROM a LEFT JOIN staged ON staged_path = path),
  g AS (SELECT *, CASE WHEN now = 'queued' THEN CASE WHEN length IS NULL THEN 'staged_missing' WHEN length <= 0 THEN 'staged_empty' END END AS gone FROM b)
  SELECT id, CASE WHEN gone IS NOT NULL THEN 'skipped' ELSE now END AS status, coalesce(gone, step, detail) AS detail, coalesce(finished, false) OR gone IS NOT NULL OR coalesce(step, '') IN ('skip_request', 'cancel_request') AS finished FROM g""")  # fmt: skip
def recovery(jobs, staged):
    return Q.recovered(jobs, staged)


SEARCHED = ("title", "filename", "url", "media_type", "source")


@query("FLT-02_substring_search", "resources", sql=f"SELECT id FROM resources WHERE {' OR '.join(f'''coalesce({x}, '') ILIKE '%e%port%' ''' for x in SEARCHED)}")
def substring_search(r, q="e%port"):
    """Five columns; a per cent sign in the question stands for anything."""
    hit = F.lit(False)
    for x in SEARCHED:
        hit = hit | F.coalesce(x, F.lit("")).ilike(f"%{q}%")
    return r.filter(hit).select("id")


@query("FLT-08_headings", "kinds", sql="SELECT id, kind FROM kinds WHERE kind ILIKE '%title%' OR kind ILIKE '%heading%' OR kind ILIKE '%section%' OR kind ILIKE '%page_header%'")
def headings(k):
    return k.filter(c("kind").rlike("(?i)title|heading|section|page_header"))


@query("AGG-17_extraction_summary", "conversations", "captions", "table_cells", sql=r"""WITH t AS (SELECT conv_id, sum(length(text)) AS chars, sum(len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS words, max(turn) AS page,
    sum(len(list_filter(regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+|$)'), lambda s: trim(s) <> ''))) AS sentences, sum(len(list_filter(string_split_regex(text, '\n\s*\n+'), lambda p: trim(p) <> ''))) AS paragraphs FROM conversations GROUP BY conv_id),
  n AS (SELECT table_id, count(*) AS cells FROM table_cells GROUP BY table_id),
  s AS (SELECT table_id % 100 AS conv_id, count(*) AS tables, sum(2) AS rows, sum(2) AS cols, sum(coalesce(cells, 0)) AS cells, max(table_id % 7) AS page FROM captions LEFT JOIN n USING (table_id) GROUP BY 1)
  SELECT conv_id, chars, words, sentences, paragraphs, coalesce(tables, 0) AS tables, coalesce(rows, 0) AS table_rows, coalesce(cols, 0) AS table_cols, coalesce(s.cells, 0) AS table_cells, greatest(t.page, coalesce(s.page, 0)) + 1 AS pages FROM t LEFT JOIN s USING (conv_id)""")  # fmt: skip
def extraction_summary(t, tables, cells):
    """A conversation is a document, a turn a page; a document's tables are those of its number, on page table_id % 7."""
    text = t.groupBy("conv_id").agg(
        F.sum(F.length("text")).alias("chars"), F.sum(S.word_count(c("text"))).alias("words"), F.sum(F.size(G.sentence_spans(c("text")))).alias("sentences"),
        F.sum(S.paragraph_count(c("text"))).alias("paragraphs"), F.max("turn").alias("page"),
    )
    n = cells.groupBy("table_id").agg(F.count("*").alias("cells"))
    size = lambda *names: F.size(F.array(*names))
    each = tables.join(n, "table_id", "left").select((c("table_id") % 100).alias("conv_id"), (c("table_id") % 7).alias("tpage"), size("r0", "r1").alias("rows"), size("h0", "h1").alias("cols"), F.coalesce("cells", F.lit(0)).alias("cells"))
    sums = each.groupBy("conv_id").agg(F.count("*").alias("tables"), F.sum("rows").alias("table_rows"), F.sum("cols").alias("table_cols"), F.sum("cells").alias("table_cells"), F.max("tpage").alias("tpage"))
    z = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return text.join(sums, "conv_id", "left").select("conv_id", "chars", "words", "sentences", "paragraphs", *map(z, ("tables", "table_rows", "table_cols", "table_cells")), (F.greatest("page", F.coalesce("tpage", F.lit(0))) + 1).alias("pages"))


@query("TXT-15_table_text", "captions", "table_cells", sql=r"""WITH k AS (SELECT *, table_id % 500 AS doc, row_number() OVER (PARTITION BY table_id % 500 ORDER BY table_id) AS i FROM captions),
  r AS (SELECT table_id, row_index, string_agg(value, ' | ' ORDER BY col_index) AS line FROM table_cells GROUP BY table_id, row_index), b AS (SELECT table_id, string_agg(line, chr(10) ORDER BY row_index) AS body FROM r GROUP BY table_id),
  t AS (SELECT doc, i, 'Table ' || i || chr(10) || CASE WHEN caption <> '' THEN caption || chr(10) ELSE '' END || h0 || ' | ' || h1 || chr(10) || CASE WHEN body IS NULL THEN '' ELSE body || chr(10) END AS part FROM k LEFT JOIN b USING (table_id))
  SELECT doc, trim(string_agg(part, chr(10) ORDER BY i), ' ' || chr(10)) AS text FROM t GROUP BY doc""")  # fmt: skip
def table_text(tables, cells):
    """A text for a document that has tables alone: each table's number, caption, header and rows, an empty line behind each."""
    listed = lambda df, key, at, value, sep: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(at, value))).alias("l")).select(*key, F.array_join(f"l.{value}", sep).alias(value))
    rows = listed(cells.select("table_id", "row_index", "col_index", "value"), ["table_id", "row_index"], "col_index", "value", " | ")
    body = listed(rows, ["table_id"], "row_index", "value", "\n").withColumnRenamed("value", "body")
    whole = tables.join(body, "table_id", "left").withColumn("doc", c("table_id") % 500)
    part = F.concat_ws("\n", F.when(c("caption") != "", c("caption")), F.concat_ws(" | ", "h0", "h1"), "body", F.lit(""))
    parts = whole.select("doc", "table_id", part.alias("part")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("table_id", "part"))).alias("l"))
    numbered = F.transform("l", lambda x, i: F.concat(F.lit("Table "), (i + 1).cast("string"), F.lit("\n"), x["part"]))
    return parts.select("doc", F.trim(F.array_join(numbered, "\n"), F.lit(" \n")).alias("text"))


WORK = """WITH l AS (SELECT resource_id, max_by(id, (created_on, id)) AS run_id FROM runs GROUP BY resource_id)
  SELECT r.id, r.imported_on FROM resources r LEFT JOIN l ON l.resource_id = r.id LEFT JOIN (SELECT id FROM notes WHERE id % 3 <> 0) n ON n.id = l.run_id WHERE lower(r.media_type) IN ('text/csv', 'text/plain', 'application/pdf')"""


def _work(r, runs, notes):
    latest = latest_by(runs, ["resource_id"], F.desc("created_on"), F.desc("id")).select(c("resource_id").alias("id"), c("id").alias("run_id"))
    texts = notes.filter("id % 3 <> 0").select(c("id").alias("run_id"), F.lit(True).alias("has_text"))
    return r.filter(F.lower("media_type").isin("text/csv", "text/plain", "application/pdf")).join(latest, "id", "left").join(texts, "run_id", "left")


@query("TXT-16_backfill", "resources", "runs", "notes", sql=f"SELECT id FROM ({WORK} AND l.run_id IS NOT NULL AND n.id IS NULL) ORDER BY imported_on DESC, id LIMIT 30")
def backfill(r, runs, notes, most=30):
    """Resources of a supported type whose latest run has no text, the newest first; how many are taken is the feature."""
    return _work(r, runs, notes).filter("run_id IS NOT NULL AND has_text IS NULL").orderBy(F.desc("imported_on"), "id").select("id").limit(most)


@query("TXT-16_backfill_choices", "resources", "runs", "notes", sql=f"""SELECT id, run_id IS NOT NULL AND text_id IS NULL AS plain, run_id IS NULL OR text_id IS NULL AS with_unextracted, true AS forced
  FROM ({WORK.replace("SELECT r.id, r.imported_on", "SELECT r.id, l.run_id, n.id AS text_id")})""")  # fmt: skip
def backfill_choices(r, runs, notes):
    """Which resources a backfill takes: as it is, with those never extracted, and with force."""
    none = c("has_text").isNull()
    return _work(r, runs, notes).select("id", (c("run_id").isNotNull() & none).alias("plain"), (c("run_id").isNull() | none).alias("with_unextracted"), F.lit(True).alias("forced"))


@query("JN-14_fallback_lookup", "tasks", "catalog", "candidates", "bibs", sql=r"""WITH k AS (SELECT id, known, text, coalesce(trim(source_uri), '') AS url FROM tasks),
  norm AS (SELECT *, regexp_replace(lower(regexp_replace(url, '/+$', '')), '^([a-z]+://)www\.', '\1') AS n FROM k WHERE url <> ''), nb AS (SELECT bib, burl, regexp_replace(lower(regexp_replace(burl, '/+$', '')), '^([a-z]+://)www\.', '\1') AS n FROM bibs),
  hits AS (SELECT id, 1 AS tier, 0.0::DOUBLE AS less, cid AS bib FROM k JOIN catalog USING (text) UNION ALL SELECT id, 2, -score, bib FROM k JOIN candidates ON id = resource_id WHERE score >= 0.8
    UNION ALL SELECT id, 3, 0, bib FROM k JOIN bibs ON url = burl WHERE url <> '' UNION ALL SELECT id, 4, 0, bib FROM norm JOIN nb USING (n))
  SELECT id, tier, bib FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, less, bib) AS i FROM hits) WHERE i = 1""")  # fmt: skip
def fallback_lookup(t, catalog, candidates, bibs):
    """The entry of a resource: by its content, else the best candidate of 0.8 or more, else by its address, else by the address folded."""
    url = F.coalesce(F.trim("source_uri"), F.lit(""))
    fold = lambda x: F.regexp_replace(F.lower(F.regexp_replace(x, "/+$", "")), r"^([a-z]+://)www\.", "$1")
    digest = S.sha256_text(c("text")).alias("h")
    one = t.select("id", digest).join(catalog.select(digest, c("cid").alias("bib")), "h").select("id", F.lit(1).alias("tier"), F.lit(0.0).alias("less"), "bib")
    two = t.select("id").join(candidates.filter("score >= 0.8"), c("id") == c("resource_id")).select("id", F.lit(2), -c("score"), "bib")
    at = t.select("id", url.alias("url")).filter("url <> ''")
    three = at.join(bibs, c("url") == c("burl")).select("id", F.lit(3), F.lit(0.0), "bib")
    four = at.select("id", fold(c("url")).alias("n")).join(bibs.select("bib", fold(c("burl")).alias("n")), "n").select("id", F.lit(4), F.lit(0.0), "bib")
    best = one.unionAll(two).unionAll(three).unionAll(four).groupBy("id").agg(F.min(F.struct("tier", "less", "bib")).alias("b"))
    return best.select("id", "b.tier", "b.bib")


@query("HLT-04_vector_health", "index_runs", "embeddings", sql="""WITH n AS (SELECT (SELECT count(*) FROM index_runs) AS runs, (SELECT count(*) FROM index_runs WHERE status = 'failed') AS failed, (SELECT count(DISTINCT vec_id) FROM embeddings) AS chunks, (SELECT count(*) FROM embeddings WHERE label < 0) AS points)
  SELECT 'failed_runs' AS issue, failed AS n FROM n WHERE failed > 0 UNION ALL SELECT 'chunks_without_points', chunks FROM n WHERE chunks > 0 AND points = 0 UNION ALL SELECT 'runs_without_chunks', runs FROM n WHERE runs > 0 AND chunks = 0""")  # fmt: skip
def vector_health(runs, e):
    return X.health(runs, e.select(c("vec_id").alias("chunk_id")), e.filter("label < 0"))


@query("VEC-09_admission", "index_runs", "runs", sql="""WITH q AS (SELECT id, resource_id, CASE WHEN id % 6 = 0 THEN -id WHEN id % 7 = 0 THEN id + 1 ELSE id END AS extraction_run_id, model, version, backend, id % 11 = 0 AS force FROM index_runs),
  d AS (SELECT DISTINCT resource_id, extraction_run_id, model, version, backend FROM index_runs WHERE status = 'success')
  SELECT q.id, CASE WHEN r.id IS NULL THEN 'failed_run_missing' WHEN r.resource_id <> q.resource_id THEN 'failed_wrong_resource' WHEN d.model IS NOT NULL AND NOT q.force THEN 'skipped' ELSE 'index' END AS status
  FROM q LEFT JOIN runs r ON r.id = q.extraction_run_id LEFT JOIN d ON d.resource_id = q.resource_id AND d.extraction_run_id = q.extraction_run_id AND d.model = q.model AND d.version = q.version AND d.backend = q.backend""")  # fmt: skip
def admission(index_runs, runs):
    asked = F.when(c("id") % 6 == 0, -c("id")).when(c("id") % 7 == 0, c("id") + 1).otherwise(c("id"))
    requests = index_runs.select("id", "resource_id", asked.alias("extraction_run_id"), "model", "version", "backend", (c("id") % 11 == 0).alias("force"))
    return X.admitted(requests, runs, index_runs).select("id", "status")


@query("VEC-11_prune", "embeddings", "index_runs", "tasks", sql="""WITH g AS (SELECT id FROM tasks WHERE id % 3 = 1 AND bytes >= 200), p AS (SELECT vec_id, vec_id % 1000 AS resource_id FROM embeddings)
  SELECT 'points_before' AS what, count(*) AS n FROM p UNION ALL SELECT 'points_after', count(*) FROM p WHERE resource_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'candidates', count(*) FROM g UNION ALL SELECT 'runs_pruned', count(*) FROM index_runs WHERE resource_id IN (SELECT id FROM g)""")  # fmt: skip
def prune(e, runs, t):
    """Counts before and after; a dry run is the first and the candidates alone."""
    resources = t.select("id", F.when(c("id") % 3 == 1, "TEXT/CSV").otherwise("text/html").alias("media_type"), "bytes")
    points = e.select("vec_id", (c("vec_id") % 1000).alias("resource_id"))
    stay, marked = X.pruned(points, runs, resources, ("text/csv",), 200)
    n = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    gone = resources.filter("lower(media_type) = 'text/csv' AND bytes >= 200")
    return n(points, "points_before").unionAll(n(stay, "points_after")).unionAll(n(gone, "candidates")).unionAll(n(marked.filter("status = 'pruned'"), "runs_pruned"))


RULES = [p for _, _, p, _ in G.rules()]


@query("TXT-11_capped", "notes", sql=f"SELECT id, i, ls[i] AS label FROM (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT id, list_concat({', '.join(f'''regexp_extract_all(text, '{p}')''' for p in RULES)})[1:6] AS ls FROM notes))")
def capped(t, most=6):
    """The first annotations of a text by category, then place; the cap is 10 000 in use and 6 here, so that it cuts."""
    found = G.annotations(t, "id", most=most)
    order = F.array_position(F.array(*[F.lit(x) for x in dict.fromkeys(r[1] for r in G.rules())]), c("category"))
    listed = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), F.when(c("category") == "metric", F.array_position(F.array(*map(F.lit, G.TERMS)), F.lower("label"))).alias("term"), "start", "label"))).alias("l"))
    return listed.select("id", F.posexplode("l.label").alias("i", "label")).withColumn("i", c("i") + 1)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
VIEWS = ("claims", "evidence", "selectors", "runs", "citations", "reference_links", "propositions", "relations", "assertions", "index_runs", "import_jobs")


@query("AGG-01_table_counts", *TABLES, *VIEWS, sql=" UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in (*TABLES, *VIEWS)))
def table_counts(*tables):
    """Rows of each of 25 tables; counts of stored tables come from the files' footers."""
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n") for name, t in zip((*TABLES, *VIEWS), tables)]
    return reduce(DataFrame.unionAll, counts)


@query("SRC-18_grid_to_table", "sheet_cells", sql=r"""WITH w AS (SELECT table_id, max(col_index) AS w FROM sheet_cells GROUP BY table_id), full_ AS (SELECT table_id, row_index, row_number() OVER (PARTITION BY table_id ORDER BY row_index) - 1 AS i FROM sheet_cells GROUP BY table_id, row_index HAVING bool_or(trim(value) <> '')),
  d AS (SELECT table_id, i, unnest(range(0, w + 1)) AS col, row_index FROM full_ JOIN w USING (table_id)), v AS (SELECT d.table_id, i, col, coalesce(trim(value), '') AS value FROM d LEFT JOIN sheet_cells s ON s.table_id = d.table_id AND s.row_index = d.row_index AND s.col_index = d.col)
  SELECT table_id, string_agg(value, '|' ORDER BY col) FILTER (i = 0) AS col_headers, coalesce(string_agg(value, '|' ORDER BY i) FILTER (i > 0 AND col = 0), '') AS row_headers,
  coalesce(string_agg((i - 1) || ',' || col || ',' || value, '|' ORDER BY i, col) FILTER (i > 0), '') AS cells FROM v GROUP BY table_id""")  # fmt: skip
def grid_to_table(cells):
    """A table record: the first row with a value is the header, the first cell of each later one its row header; blank rows go, cells are trimmed."""
    width = cells.groupBy("table_id").agg(F.max("col_index").alias("w"))
    value = F.struct("col_index", F.trim("value").alias("value"))
    rows = cells.groupBy("table_id", "row_index").agg(F.map_from_entries(F.collect_list(value)).alias("m"), F.bool_or(F.trim("value") != "").alias("full")).filter("full")
    dense = F.transform(F.sequence(F.lit(0), c("w")), lambda i: F.coalesce(F.try_element_at(c("m"), i), F.lit("")))
    rows = rows.join(width, "table_id").select("table_id", "row_index", dense.alias("row"))
    listed = rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_index", "row"))).alias("l")).select("table_id", c("l.row").alias("rows"))
    body = F.slice("rows", 2, F.size("rows"))
    line = lambda row, i: F.array_join(F.transform(row, lambda x, j: F.concat(i.cast("string"), F.lit(","), j.cast("string"), F.lit(","), x)), "|")
    return listed.select("table_id", F.array_join(F.get("rows", F.lit(0)), "|").alias("col_headers"), F.array_join(F.transform(body, lambda r: F.get(r, F.lit(0))), "|").alias("row_headers"), F.array_join(F.transform(body, line), "|").alias("cells"))


# Basenames that say nothing of a file.
JUNK = (
    "", "download", "index.php", "file.php", "display.aspx", "view", "get", "dl", "f.txt", "document", "file", "attachment", "index.html", "index.htm",
    "default.aspx", "default.php",
)


@query("JN-20_junk_exclusion", "probes", "stored_files", sql=f"""WITH n AS (SELECT url, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$')) AS b, lower(regexp_extract(disposition, 'filename="([^"]+)"', 1)) AS d FROM probes WHERE url <> ''),
  s AS (SELECT lower(name) AS name, path FROM stored_files), k AS (SELECT url, CASE WHEN b <> '' AND b NOT IN {JUNK} AND b IN (SELECT name FROM s) THEN b WHEN d <> '' AND d NOT IN {JUNK} THEN d END AS name FROM n)
  SELECT path, count(DISTINCT url) AS urls, min(url) AS first FROM k JOIN s USING (name) GROUP BY path""")  # fmt: skip
def junk_exclusion(p, f):
    """Addresses of each stored file by the address's basename; where that says nothing or no file has it, by the name that the server gave.

    Addresses are counted by name, so a file and an address are paired only where files of several names share a path.
    """
    files = f.select(F.lower("name").alias("name"), "path")
    usable = lambda x: F.when(~x.isin(*JUNK), x)
    named = p.filter("url <> ''").select("url", usable(S.url_basename(c("url"))).alias("b"), usable(F.lower(S.disposition_filename(c("disposition")))).alias("d"))
    known = files.select(c("name").alias("b"), F.lit(True).alias("known")).distinct()
    keyed = named.join(known, "b", "left").select("url", F.when(c("known"), c("b")).otherwise(c("d")).alias("name"))
    keyed = keyed.filter("name IS NOT NULL").distinct()
    counts = keyed.groupBy("name").agg(F.count("*").alias("urls"), F.min("url").alias("first"))
    paths = files.filter("name IS NOT NULL").groupBy("path").agg(F.min("name").alias("name"), F.max("name").alias("last"))
    one = paths.filter("name = last").join(counts, "name").select("path", "urls", "first")
    several = files.join(paths.filter("name <> last").select(c("path").alias("_path")), c("path").eqNullSafe(c("_path")), "left_semi")
    several = several.join(keyed, "name").groupBy("path").agg(F.count_distinct("url").alias("urls"), F.min("url").alias("first"))
    return one.unionByName(several)


@query("SRC-25_local_copies", "tasks", "listing", sql="""WITH m AS (SELECT t.id, l.real, l.path, l.root, l.depth FROM tasks t JOIN listing l ON l.name = t.filename AND l.length = t.size WHERE t.filename <> '' AND (l.kind = 'deep' OR l.depth = 1))
  SELECT id, real, min_by(path, (root, depth, path)) AS path FROM m GROUP BY id, real""")  # fmt: skip
def local_copies(t, listing):
    """Files of a resource's exact name and size: right below the shallow folders, anywhere below the deep ones; each real file once, as it was met first."""
    seen = listing.filter("kind = 'deep' OR depth = 1")
    both = t.filter("filename <> ''").select("id", c("filename").alias("name"), c("size").alias("length")).join(seen, ["name", "length"])
    return both.groupBy("id", "real").agg(F.min(F.struct("root", "depth", "path")).alias("m")).select("id", "real", "m.path")


@query("TAB-05_profile_lifecycle", "resources", "runs", sql="""WITH t AS (SELECT id, coalesce(lower(media_type) IN ('text/csv', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'), false) AS sheet, id % 17 = 0 AS missing, id % 19 = 0 AS broken, id % 4 = 0 AS force FROM resources)
  SELECT t.id, CASE WHEN NOT sheet THEN 'skipped' WHEN NOT force AND d.id IS NOT NULL THEN 'reused' WHEN missing THEN 'failed' WHEN broken THEN 'failed' ELSE 'profiled' END AS action, CASE WHEN sheet AND NOT force AND d.id IS NOT NULL THEN d.id END AS run_id,
  CASE WHEN sheet AND (force OR d.id IS NULL) THEN CASE WHEN missing THEN 'file_missing' WHEN broken THEN 'unreadable' END END AS error FROM t LEFT JOIN (SELECT resource_id, max_by(id, (created_on, id)) AS id FROM runs WHERE status = 'success' GROUP BY resource_id) d ON d.resource_id = t.id""")  # fmt: skip
def profile_lifecycle(r, runs):
    """What profiling does with each resource: no table, the last success unless it is forced, a missing or unreadable file, a profile."""
    done = latest_by(runs.filter("status = 'success'"), ["resource_id"], F.desc("created_on"), F.desc("id")).select(c("resource_id").alias("id"), c("id").alias("run_id"))
    t = r.select("id", F.coalesce(F.lower("media_type").isin(*S.SHEET_MEDIA), F.lit(False)).alias("sheet"), (c("id") % 17 == 0).alias("missing"), (c("id") % 19 == 0).alias("broken"), (c("id") % 4 == 0).alias("force"))
    reuse = c("sheet") & ~c("force") & c("run_id").isNotNull()
    error = F.when(c("sheet") & ~reuse, F.when(c("missing"), "file_missing").when(c("broken"), "unreadable"))
    action = F.when(~c("sheet"), "skipped").when(reuse, "reused").when(error.isNotNull(), "failed").otherwise("profiled")
    return t.join(done, "id", "left").select("id", action.alias("action"), F.when(reuse, c("run_id")).alias("run_id"), error.alias("error"))


@query("VEC-10_backfill", "runs", "notes", "index_runs", sql="""WITH l AS (SELECT resource_id, max_by(id, (created_on, id)) AS run_id FROM runs WHERE status = 'success' GROUP BY resource_id)
  SELECT l.resource_id, l.run_id, CASE WHEN n.id IS NULL THEN 'no_text' WHEN d.run IS NOT NULL THEN 'skipped' ELSE 'index' END AS action FROM l LEFT JOIN (SELECT id FROM notes WHERE id % 3 <> 0) n ON n.id = l.run_id
  LEFT JOIN (SELECT DISTINCT extraction_run_id AS run FROM index_runs WHERE status = 'success') d ON d.run = l.run_id""")  # fmt: skip
def vector_backfill(runs, notes, index_runs):
    """The latest successful run of each resource and what indexing does with it."""
    latest = latest_by(runs.filter("status = 'success'"), ["resource_id"], F.desc("created_on"), F.desc("id")).select("resource_id", c("id").alias("run_id"))
    texts = notes.filter("id % 3 <> 0").select(c("id").alias("run_id"), F.lit(True).alias("text"))
    done = index_runs.filter("status = 'success'").select(c("extraction_run_id").alias("run_id"), F.lit(True).alias("done")).distinct()
    both = latest.join(texts, "run_id", "left").join(done, "run_id", "left")
    return both.select("resource_id", "run_id", F.when(c("text").isNull(), "no_text").when(c("done"), "skipped").otherwise("index").alias("action"))


@query("CLM-02_claim_sets", "claims", sql="""SELECT set_id, set_id >= 25 AS created, count(*) AS n FROM claims GROUP BY set_id""")
def claim_sets(k):
    """Sets below 25 are there; those that claims name beside them are made. Claims are counted by set."""
    there = k.filter("set_id < 25").select("set_id").distinct()
    made = insert_or_ignore(there, k.select("set_id"), ["set_id"]).select("set_id", F.lit(True).alias("created"))
    return k.groupBy("set_id").agg(F.count("*").alias("n")).join(made, "set_id", "left").select("set_id", F.coalesce("created", F.lit(False)).alias("created"), "n")


@query("BND-01_bind", "evidence", "claims", "selectors", "resources", sql="""WITH s AS (SELECT evidence_id, ord, CASE WHEN evidence_id % 23 = 0 AND ord = 2 THEN ' ' WHEN evidence_id % 29 = 0 AND ord = 1 THEN '' ELSE selector_type END AS kind FROM selectors),
  b AS (SELECT evidence_id, min(ord) FILTER (trim(kind) = '') AS bad, count(*) AS n FROM s GROUP BY evidence_id),
  k AS (SELECT e.id, CASE WHEN e.claim_id % 31 = 0 THEN 'claim_missing' WHEN e.resource_id NOT IN (SELECT id FROM resources) THEN 'resource_missing' WHEN b.n IS NULL THEN 'no_selector' WHEN b.bad IS NOT NULL THEN 'selector_without_type' END AS reason, b.bad FROM evidence e LEFT JOIN b ON b.evidence_id = e.id)
  SELECT k.id, reason, coalesce(reason, 'selector_without_type') = 'selector_without_type' AS item_kept, reason IS NULL AS bound, CASE WHEN coalesce(reason, 'selector_without_type') = 'selector_without_type' THEN (count(s.ord) FILTER (k.bad IS NULL OR s.ord < k.bad)) ELSE 0 END AS selectors_kept
  FROM k LEFT JOIN s ON s.evidence_id = k.id GROUP BY k.id, reason, k.bad""")  # fmt: skip
def bind(e, claims, s, resources):
    """Binding of each evidence: claim and resource must be there, a selector too; one without a type stops the binding, but the item and the selectors before it stay."""
    kind = F.when((c("evidence_id") % 23 == 0) & (c("ord") == 2), " ").when((c("evidence_id") % 29 == 0) & (c("ord") == 1), "").otherwise(c("selector_type"))
    kinds = s.select("evidence_id", "ord", kind.alias("kind"))
    kinds = kinds.withColumn("bad", F.min(F.when(S.blank_to_null(c("kind")).isNull(), c("ord"))).over(Window.partitionBy("evidence_id")))
    n = kinds.groupBy("evidence_id").agg(F.count("*").alias("n"), F.count_if(c("bad").isNull() | (c("ord") < c("bad"))).alias("good"), F.max("bad").alias("bad"))
    known = claims.filter("id % 31 <> 0").select(c("id").alias("claim_id"), F.lit(True).alias("k"))
    there = resources.select(c("id").alias("resource_id"), F.lit(True).alias("r"))
    both = e.join(known, "claim_id", "left").join(there, "resource_id", "left").join(n, c("id") == c("evidence_id"), "left")
    reason = F.when(c("k").isNull(), "claim_missing").when(c("r").isNull(), "resource_missing").when(c("n").isNull(), "no_selector").when(c("bad").isNotNull(), "selector_without_type")
    kept = F.coalesce(reason, F.lit("selector_without_type")) == "selector_without_type"
    return both.select("id", reason.alias("reason"), kept.alias("item_kept"), reason.isNull().alias("bound"), F.when(kept, F.coalesce("good", F.lit(0))).otherwise(0).alias("selectors_kept"))


@query("SNK-09_migration_counts", "embeddings", sql="""WITH s AS (SELECT vec_id AS id, CASE WHEN vec_id % 41 = 0 THEN 3 ELSE len(embedding) END AS d FROM embeddings WHERE vec_id % 3 <> 0), t AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 2 = 0),
  e AS (SELECT count(DISTINCT id) AS n FROM (SELECT id FROM s WHERE d = 64 UNION ALL SELECT id FROM t))
  SELECT (SELECT count(*) FROM s) AS read, (SELECT count(*) FROM s WHERE d <> 64) AS rejected, (SELECT count(*) FROM t) AS before, e.n AS after, e.n AS expected, true AS ok FROM e""")  # fmt: skip
def migration(e):
    vector = F.when(c("vec_id") % 41 == 0, F.slice("embedding", 1, 3)).otherwise(c("embedding"))
    source = e.filter("vec_id % 3 <> 0").select(c("vec_id").alias("id"), vector.alias("vector"))
    return X.migrated(source, e.filter("vec_id % 2 = 0").select(c("vec_id").alias("id"), c("embedding").alias("vector")), 64)[1]


CURRENCY = next(p for n, _, p, _ in G.PATTERNS if n == "currency")


@query("TXT-14_dump", "runs", "notes", "grid", sql=rf"""WITH g AS (SELECT table_id AS id, count(DISTINCT (row_index, col_index)) AS cells, string_agg(DISTINCT CAST(row_index % 4 AS VARCHAR), ',' ORDER BY CAST(row_index % 4 AS VARCHAR)) AS pages FROM grid GROUP BY table_id)
  SELECT r.id, r.status, r.parser, n.text, CASE WHEN g.id IS NULL THEN 0 ELSE 1 END AS tables, coalesce(cells, 0) AS cells, coalesce(pages, '') AS pages_with_tables, coalesce(len(regexp_extract_all(n.text, '[^.!?
]+(?:[.!?]+|$)')), 0) + CASE WHEN n.id IS NULL THEN 0 ELSE 1 END AS segments,
  coalesce(len(regexp_extract_all(n.text, '{CURRENCY}')), 0) AS annotations FROM runs r LEFT JOIN notes n USING (id) LEFT JOIN g USING (id)""")  # fmt: skip
def dump(r, notes, g):
    """All that a run has: its text, tables, cells, pages with tables, segments (the document and its sentences) and annotations."""
    pages = F.array_join(F.array_sort(F.collect_set((c("row_index") % 4).cast("string"))), ",")
    tables = g.groupBy(c("table_id").alias("id")).agg(F.lit(1).alias("tables"), F.count_distinct("row_index", "col_index").alias("cells"), pages.alias("pages"))
    notes = M.dealt(notes.select("id", "text"), "id")
    texts = notes.select("id", "text", (F.size(G.sentence_spans(c("text"))) + 1).alias("segments"), F.size(G.matches(c("text"), CURRENCY)).cast("long").alias("annotations"))
    both = r.join(texts, "id", "left").join(tables, "id", "left")
    z = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return both.select("id", "status", "parser", "text", z("tables"), z("cells"), F.coalesce("pages", F.lit("")).alias("pages_with_tables"), z("segments"), z("annotations"))
