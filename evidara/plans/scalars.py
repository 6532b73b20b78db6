"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import scalar as S
from evidara.operators.citations import allocated
from evidara.plans.registry import query

c = F.col
NUM = r"CASE WHEN regexp_full_match(t, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN CAST(t AS DOUBLE) END"


@query("FN-01_parse_numeric", "values_", sql=f"""SELECT id, CASE WHEN trim(raw) LIKE '(%' AND trim(raw) LIKE '%)' THEN -({NUM}) ELSE {NUM} END AS value
FROM (SELECT id, raw, trim(regexp_replace(trim(raw), '[,£$mM()]', '', 'g')) AS t FROM values_)""")  # fmt: skip
def parse_numeric(v):
    return v.select("id", S.parse_numeric(c("raw")).alias("value"))


@query("FN-02_tolerance", "lineitem", sql="""SELECT l_orderkey, l_linenumber, abs(l_extendedprice - l_extendedprice * (1 + l_discount * 1e-12)) <= 1e-9 AS same FROM lineitem""")
def tolerance(l):
    return l.select("l_orderkey", "l_linenumber", S.nearly_equal(c("l_extendedprice"), c("l_extendedprice") * (1 + c("l_discount") * 1e-12)).alias("same"))


@query("FN-03_optional", "values_", sql="SELECT id, nullif(trim(raw), '') AS s, CASE WHEN regexp_full_match(trim(raw), '[+-]?[0-9]+') THEN CAST(trim(raw) AS BIGINT) END AS n FROM values_")
def optional(v):
    return v.select("id", S.blank_to_null(c("raw")).alias("s"), S.optional_number(c("raw"), "bigint").alias("n"))


@query("FN-04_cite_key", "customer", sql="SELECT c_custkey, lower(trim(' ' || c_name || ' ')) AS key FROM customer")
def cite_key(t):
    return t.select("c_custkey", S.cite_key(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("key"))


@query("FN-05_cite_id", "customer", sql="""WITH h AS (SELECT c_custkey, sha256(lower(trim(c_name)) || ':0') AS h FROM customer),
v AS (SELECT c_custkey, CAST((CAST(('0x' || substr(h, 1, 10)) AS HUGEINT) * 1099511627776 + CAST(('0x' || substr(h, 11, 10)) AS HUGEINT)) % 14776336 AS BIGINT) AS v FROM h)
SELECT c_custkey, array_to_string(list_transform([238328, 3844, 62, 1], lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', CAST(floor(v / d) AS BIGINT) % 62 + 1, 1)), '') AS cite FROM v""")  # fmt: skip
def cite_id(t):
    return t.select("c_custkey", S.cite_id(c("c_name")).alias("cite"))


@query("FN-06_cite_id_probing", "customer")
def cite_id_probing(t):
    t = t.select("c_custkey", S.cite_key(c("c_name")).alias("key"))
    return t.join(allocated(t), "key", "left").select("c_custkey", "cite")


@query("FN-07_sha256", "documents", sql="SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256(t):
    return t.select("doc_id", S.sha256_text(c("text")).alias("digest"))


@query("FN-08_uuid5", "customer", sql="""SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex((CAST(('0x' || substr(h, 17, 2)) AS INTEGER) & 63) + 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS uuid
  FROM (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer)""")  # fmt: skip
def uuid5(t):
    return t.select("c_custkey", S.uuid5_url(c("c_name")).alias("uuid"))


@query("FN-11_url_candidate", "resources", sql="""SELECT id, CASE WHEN regexp_matches(lower(b), '^https?://') THEN b END AS url
FROM (SELECT id, regexp_replace(regexp_replace(trim('<' || url || '>,'), '^["''<\\[(]+|["''>\\])]+$', '', 'g'), '[,;]+$', '') AS b FROM resources)""".replace("\\\\", "\\"))  # fmt: skip
def url_candidate(t):
    return t.select("id", S.url_candidate(F.concat(F.lit("<"), "url", F.lit(">,"))).alias("url"))


@query("FN-13_reserved_host", "resources", sql="""SELECT id, coalesce(h IN ('localhost', 'example.com', 'example.org', 'example.net', '127.0.0.1') OR h LIKE '%.localhost' OR h LIKE '%.example' OR h LIKE '%.invalid' OR h LIKE '%.test' OR h LIKE '%.example.com' OR h LIKE '%.example.org', false) AS reserved
FROM (SELECT id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www[.]', '') AS h FROM resources)""")  # fmt: skip
def reserved(t):
    return t.select("id", S.is_reserved_host(S.url_host(c("url"))).alias("reserved"))


@query("FN-14_url_key", "resources", sql="""SELECT id, regexp_replace(regexp_extract(lower(rtrim(trim(url), '/')), '^([a-z][a-z0-9+.-]*://[^/?#]*[^?#]*)', 1), '^([a-z0-9+.-]*://)www[.]', '\\1') AS key FROM resources""".replace("\\\\", "\\"))
def url_key(t):
    return t.select("id", S.url_key(c("url")).alias("key"))


@query("FN-15_domain", "resources", sql="SELECT id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www[.]', '') AS host FROM resources")
def domain(t):
    return t.select("id", S.url_host(c("url")).alias("host"))


@query("FN-16_url_basename", "downloads", sql="SELECT id, lower('A B+' || (id % 700) || '.pdf') AS name FROM downloads")
def basename(t):
    return t.select("id", S.url_basename(F.concat(F.lit("https://h.org/f/A%20B+"), c("id") % 700, F.lit(".pdf/?x=1"))).alias("name"))


@query("FN-17_content_disposition", "downloads", sql="SELECT id, CASE id % 4 WHEN 0 THEN 'a b.pdf' WHEN 1 THEN filename WHEN 2 THEN filename END AS name FROM downloads")
def disposition(t):
    text = F.when(c("id") % 4 == 0, F.lit("attachment; filename*=UTF-8''a%20b.pdf")).when(c("id") % 4 == 1, F.concat(F.lit('attachment; filename="'), "filename", F.lit('"'))).when(c("id") % 4 == 2, F.concat(F.lit("inline; filename="), "filename"))
    return t.select("id", S.disposition_filename(text).alias("name"))


@query("FN-18_doi", "notes", sql="SELECT id, 'https://doi.org/10.1234/ab.' || id AS doi FROM notes")
def doi(t):
    return t.select("id", S.doi_url(S.first_doi(c("text"))).alias("doi"))


@query("FN-19_urls_in_text", "notes", sql="SELECT id, 'https://example.org/o/' || id || ' http://b.net/' || (id % 3) AS urls FROM notes")
def urls_in_text(t):
    return t.select("id", F.array_join(S.urls_in_text(c("text")), " ").alias("urls"))


@query("FN-22_clean_title", "resources", sql="""SELECT id, CASE id % 6 WHEN 0 THEN 'annual report ' || (2000 + id % 24) WHEN 1 THEN 'budget ' || id WHEN 2 THEN 'notes' WHEN 3 THEN 'policy ' || id ELSE '' END AS title FROM resources""")
def clean_title(t):
    return t.select("id", S.clean_title(c("filename")).alias("title"))


@query("FN-23_year_label", "notes", sql="SELECT id, CASE WHEN id % 2 = 0 THEN '2021/22' ELSE '199' || (id % 10) END AS year FROM notes")
def year(t):
    return t.select("id", S.year_label(F.concat(F.lit("199"), c("id") % 10), F.when(c("id") % 2 == 0, F.lit("report 2021/22 x"))).alias("year"))


@query("FN-24_document_type", "resources", sql="""SELECT id, CASE id % 6 WHEN 0 THEN 'Annual Report' WHEN 1 THEN 'Budget' WHEN 3 THEN 'Policy' ELSE 'Document' END AS kind FROM resources""")
def document_type(t):
    return t.select("id", S.document_type(S.clean_title(c("filename"))).alias("kind"))


@query("FN-25_org_label", "resources", sql="""SELECT id, CASE id % 5 WHEN 0 THEN 'Data Board' WHEN 1 THEN 'Example' ELSE
  CASE id % 6 WHEN 0 THEN 'Annual Report ' || (2000 + id % 24) WHEN 1 THEN 'Budget ' || id WHEN 2 THEN 'Notes' WHEN 3 THEN 'Policy ' || id ELSE '' END END AS org FROM resources""")  # fmt: skip
def org(t):
    return t.select("id", S.org_label(c("url"), c("filename")).alias("org"))


KIND_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, '{n}')" for n in needles) + f" THEN '{label}'" for label, needles in S.DOCUMENT_TYPES) + " ELSE 'Document' END"


@query("FN-26_human_title", "resources", sql=rf"""WITH b AS (SELECT id, CASE id % 6 WHEN 0 THEN 'annual report ' || (2000 + id % 24) WHEN 1 THEN 'budget ' || id WHEN 2 THEN 'notes' WHEN 3 THEN 'policy ' || id ELSE '' END AS hint,
    CASE id % 5 WHEN 0 THEN 'Data Board' WHEN 1 THEN 'Example' ELSE CASE id % 6 WHEN 0 THEN 'Annual Report ' || (2000 + id % 24) WHEN 1 THEN 'Budget ' || id WHEN 2 THEN 'Notes' WHEN 3 THEN 'Policy ' || id ELSE '' END END AS org, left(coalesce(text, ''), 12000) AS t FROM resources),
  k AS (SELECT *, lower(hint || ' ' || t) AS low, regexp_extract_all(hint || ' ' || t, '{S.YEAR}', 1) AS ys FROM b),
  y AS (SELECT *, {KIND_SQL} AS kind, coalesce(list_sort(list_transform(range(1, len(ys) + 1), lambda i: {{'s': CASE WHEN contains(ys[i], '/') THEN -1 ELSE 0 END, 'l': -length(ys[i]), 'i': i, 'y': ys[i]}}))[1].y, '') AS year FROM k)
  SELECT id, CASE WHEN org <> '' AND year <> '' THEN org || ' - ' || kind || ' - ' || year WHEN org <> '' THEN org || ' - ' || kind WHEN hint <> '' THEN hint ELSE 'Document ' || left(CAST(id AS VARCHAR), 8) END AS title FROM y""")  # fmt: skip
def human_title(t):
    return t.select("id", S.human_title(c("filename"), c("url"), c("text"), c("id").cast("string")).alias("title"))


@query("FN-27_garbage_token", "part", sql="""SELECT p_partkey, 'tmp' || p_partkey || 'x' AS token, true AS bad FROM part""")
def garbage(t):
    tok = F.concat(F.lit("tmp"), "p_partkey", F.lit("x"))
    return t.select("p_partkey", tok.alias("token"), S.garbage_token(tok).alias("bad"))


@query("FN-32_snippet", "documents", sql="""SELECT doc_id, (CASE WHEN a > 0 THEN '…' ELSE '' END) || trim(substr(text, a + 1, b - a)) || (CASE WHEN b < length(text) THEN '…' ELSE '' END) AS snippet
FROM (SELECT doc_id, text, greatest(least(doc_id % 300, length(text)) - 44, 0) AS a, least(least(doc_id % 300 + 10, length(text)) + 44, length(text)) AS b FROM documents)""")  # fmt: skip
def snippet(t):
    return t.select("doc_id", S.snippet(c("text"), (c("doc_id") % 300).cast("int"), F.lit(10)).alias("snippet"))


@query("FN-33_preview", "documents", sql=r"""SELECT doc_id, CASE WHEN length(f) > 80 THEN rtrim(substr(f, 1, 79)) || '…' ELSE f END AS p FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)""")
def preview(t):
    return t.select("doc_id", S.preview(c("text"), 80).alias("p"))


@query("FN-35_clamp_span", "lineitem", sql="""SELECT l_orderkey, l_linenumber, CASE WHEN b > a THEN a END AS a, CASE WHEN b > a THEN b END AS b FROM (SELECT l_orderkey, l_linenumber,
  greatest(0, least(l_partkey % 70 - 10, 50)) AS a, greatest(0, least(l_partkey % 40 + 20, 50)) AS b FROM lineitem)""")  # fmt: skip
def clamp(t):
    s = S.clamp_span(c("l_partkey") % 70 - 10, c("l_partkey") % 40 + 20, F.lit(50))
    return t.select("l_orderkey", "l_linenumber", s["start"].alias("a"), s["end"].alias("b"))


@query("FN-36_normal_bbox", "lineitem", sql="""SELECT l_orderkey, l_linenumber, least(l_quantity, l_discount * 300) AS x0, greatest(l_quantity, l_discount * 300) AS x1, least(l_tax, l_discount) AS y0, greatest(l_tax, l_discount) AS y1 FROM lineitem""")
def bbox(t):
    b = S.normal_bbox(c("l_quantity"), c("l_tax"), c("l_discount") * 300, c("l_discount"))
    return t.select("l_orderkey", "l_linenumber", *[b[k].alias(k) for k in ("x0", "x1", "y0", "y1")])


@query("FN-37_column_name", "part", sql=r"SELECT p_partkey, lower(trim(regexp_replace('  ' || p_type || '  X ', '\s+', ' ', 'g'))) AS name FROM part")
def column_name(t):
    return t.select("p_partkey", S.column_name(F.concat(F.lit("  "), "p_type", F.lit("  X "))).alias("name"))


@query("FN-38_distinct_columns", "part", sql="SELECT p_partkey, p_brand || ',column_2,' || lower(p_brand) || '_2,x' AS names FROM part")
def distinct_columns(t):
    return t.select("p_partkey", F.array_join(S.distinct_columns(F.array("p_brand", F.lit(" "), F.lower("p_brand"), F.lit("x"))), ",").alias("names"))


@query("FN-39_metadata_row", "part", sql="SELECT p_partkey, p_partkey % 3 = 0 AS meta FROM part")
def metadata_row(t):
    return t.select("p_partkey", S.is_metadata_row(F.when(c("p_partkey") % 3 == 0, F.lit(" Data Source: x")).otherwise("UKPRN")).alias("meta"))


@query("FN-40_a1_column", "part", sql="SELECT p_partkey, p_partkey % 26 + 26 * (p_partkey % 20 + 1) AS col FROM part")
def a1(t):
    letter = lambda n: F.char(n + 65)
    return t.select("p_partkey", S.a1_column(F.concat(letter(c("p_partkey") % 20), letter(c("p_partkey") % 26), F.lit("12"))).cast("long").alias("col"))


@query("FN-41_token_estimate", "documents", sql="SELECT doc_id, CAST(greatest(1, floor(length(text) / 4)) AS BIGINT) AS n FROM documents")
def tokens(t):
    return t.select("doc_id", S.token_estimate(c("text")).alias("n"))


@query("FN-42_text_counts", "documents", sql=r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS words, len(list_filter(string_split_regex(text, '\n\s*\n+'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g')) <> '')) AS paragraphs,
  len(list_filter(regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+|$)'), lambda s: trim(s) <> '')) AS sentences FROM documents""")  # fmt: skip
def counts(t):
    return t.select("doc_id", S.word_count(c("text")).alias("words"), S.paragraph_count(c("text")).alias("paragraphs"), S.sentence_count(c("text")).alias("sentences"))


@query("FN-43_json_length", "events", sql="SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 0 END AS n FROM events")
def json_length(t):
    return t.select("event_id", S.json_length(F.when(c("event_id") % 3 == 0, F.lit("[1,2,3]")).when(c("event_id") % 3 == 1, F.lit("{bad"))).alias("n"))


@query("FN-44_settings", "values_", sql="""SELECT id, CASE WHEN id % 4 = 0 THEN true WHEN id % 4 = 1 THEN false ELSE id % 4 = 2 END AS flag,
CASE WHEN regexp_full_match(trim(raw), '[+-]?[0-9]+') THEN greatest(CAST(trim(raw) AS BIGINT), 0) ELSE 7 END AS n FROM values_""")  # fmt: skip
def settings(v):
    word = F.when(c("id") % 4 == 0, " Yes").when(c("id") % 4 == 1, "OFF ").when(c("id") % 4 == 2, "maybe")
    return v.select("id", F.when(c("id") % 4 == 2, S.flag(word, True)).otherwise(S.flag(word, False)).alias("flag"), S.natural(c("raw"), 7).alias("n"))


@query("FN-44_short_text", "documents", sql="""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN length(t) <= 600 THEN t ELSE regexp_replace(left(t, 599), '\\s+$', '') || '…' END AS short FROM t""")  # fmt: skip
def short_text(d):
    return d.select("doc_id", S.short_text(c("text")).alias("short"))


@query("FN-45_epochs", "events", sql="""SELECT event_id, make_timestamp(event_id * 1000000 + 1700000000000000) AS chrome, make_timestamp((978307200 + event_id) * 1000000) AS mac FROM events""")
def epochs(t):
    return t.select("event_id", S.chrome_time(c("event_id") * 1_000_000 + 1_700_000_000_000_000 + 11_644_473_600_000_000).cast("timestamp_ntz").alias("chrome"), S.mac_time(c("event_id")).cast("timestamp_ntz").alias("mac"))


@query("SNK-07_archive_path", "documents", sql="SELECT doc_id, 'sha256/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h || '.txt' AS path FROM (SELECT doc_id, sha256(text) AS h FROM documents)")
def archive(t):
    return t.select("doc_id", S.archive_path(S.sha256_text(c("text")), F.lit(".txt")).alias("path"))


MEDIA_SQL = """CASE WHEN m LIKE 'application/pdf%' THEN 'PDF' WHEN m LIKE 'image/%' THEN 'Image' WHEN m IN ('application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', 'text/csv') THEN 'Spreadsheet / CSV'
  WHEN m LIKE 'text/html%' THEN 'HTML' WHEN m = 'application/json' THEN 'Structured Text' WHEN m LIKE 'text/%' THEN 'Plain Text' ELSE 'Other' END"""


@query("PRJ-02_media_label", "resources", sql=f"SELECT id, {MEDIA_SQL} AS label FROM (SELECT id, lower(coalesce(media_type, '')) AS m FROM resources)")
def media_label(t):
    return t.select("id", S.media_label(c("media_type")).alias("label"))


SHEET_SQL = "(m IN ('text/csv', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet') OR id % 6 = 1)"
DOC_SQL = "(m IN ('application/pdf', 'application/json', 'text/html', 'text/plain') OR id % 6 IN (0, 2, 3, 4))"


@query("PRJ-03_ingestion_policy", "resources", sql=f"""SELECT id, CASE WHEN {SHEET_SQL} THEN 'structured_data' WHEN {DOC_SQL} THEN 'narrative_document' ELSE 'other' END AS kind,
  {DOC_SQL} AND NOT {SHEET_SQL} AS extract, {DOC_SQL} AND NOT {SHEET_SQL} AS vector FROM (SELECT id, lower(coalesce(media_type, '')) AS m FROM resources)""")  # fmt: skip
def policy(t):
    p = S.ingestion_policy(c("media_type"), c("filename"))
    return t.select("id", p["kind"].alias("kind"), p["extract"].alias("extract"), p["vector"].alias("vector"))


@query("PRJ-04_viewer_kind", "resources", sql="""SELECT id, CASE WHEN m = 'application/pdf' OR id % 6 IN (0, 4) THEN 'pdf' WHEN m LIKE 'image/%' THEN 'image'
  WHEN m IN ('text/csv', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet') OR id % 6 = 1 THEN 'table' WHEN m LIKE 'text/%' OR id % 6 IN (2, 3) THEN 'text' WHEN m = 'application/json' THEN 'structured' ELSE 'binary' END AS kind
  FROM (SELECT id, lower(coalesce(media_type, '')) AS m FROM resources)""")  # fmt: skip
def viewer(t):
    return t.select("id", S.viewer_kind(c("media_type"), c("filename")).alias("kind"))


@query("PRJ-05_data_format", "resources", sql="""SELECT id, CASE WHEN m = 'text/csv' THEN 'csv' WHEN id % 6 = 1 OR m LIKE '%spreadsheetml%' THEN 'xlsx' WHEN id % 6 IN (0, 4) THEN 'pdf' WHEN id % 6 = 2 THEN 'txt' WHEN id % 6 = 3 THEN 'md' ELSE 'unknown' END AS format
  FROM (SELECT id, lower(coalesce(media_type, '')) AS m FROM resources)""")  # fmt: skip
def data_format(t):
    return t.select("id", S.data_format(c("media_type"), c("filename")).alias("format"))


@query("FLT-05_useless_title", "resources", sql="SELECT id FROM resources WHERE trim(coalesce(title, '')) = '' OR lower(title) LIKE 'untitled%'")
def useless(t):
    return t.filter(S.useless_title(c("title"))).select("id")
