"""Queries of sources, titles, table profiles and vector upkeep."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType

from evidara.functions import scalar as S
from evidara.operators import segments as G
from evidara.operators import tables as T
from evidara.operators import similar as A
from evidara.operators.bands import nearest_interval
from evidara.operators.latest import first_n_by, latest_by, upsert
from evidara.operators.recovery import outside
from evidara.operators.rounds import kept
from evidara.operators.steps import in_steps
from evidara.plans.registry import query
from evidara.sources import markup as M
from evidara.sources.claims import BibEntries, claims_markdown, csv_rows

c = F.col


@query("SRC-03_claim_csv", "orders", sql="""SELECT o_orderkey, 'narrative' AS claim_type, 'order "' || o_orderkey || '",' || chr(10) || 'open' AS narrative_text, trim(o_orderpriority) AS value_raw FROM orders
UNION ALL SELECT o_orderkey, 'quantitative', '', '' FROM orders WHERE o_orderkey % 3 = 0""")  # fmt: skip
def claim_csv(o):
    """Claim files with quoted line ends and quotes, blank rows, cells that are missing and cells too many."""
    quoted = F.concat(F.lit('"order ""'), c("o_orderkey"), F.lit('"",\nopen"'))
    second = F.when(c("o_orderkey") % 3 == 0, "quantitative\n").otherwise("\n")
    body = F.concat(F.lit(" claim_type,narrative_text , value_raw\n narrative ,"), quoted, F.lit(", "), "o_orderpriority", F.lit(" ,surplus\n\n"), second)
    row = o.select("o_orderkey", F.explode(csv_rows(body)).alias("r"))
    return row.select("o_orderkey", *[c("r")[name].alias(name) for name in ("claim_type", "narrative_text", "value_raw")])


@query("SRC-05_claim_markdown", "orders", sql="""SELECT 'order ' || o_orderkey AS narrative_text, CASE WHEN o_orderkey % 2 = 0 THEN 'Ab' || (10 + o_orderkey % 90) END AS cite FROM orders WHERE o_orderkey % 3 > 0""")
def claim_markdown(o):
    dash = F.when(c("o_orderkey") % 3 > 0, "- ").otherwise("")
    cite = F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit(" [@Ab"), 10 + c("o_orderkey") % 90, F.lit("]"))).otherwise("")
    return claims_markdown(o.select(F.concat(dash, F.lit("order "), "o_orderkey", cite).alias("value")))


@query("SRC-06_bibtex", "customer", sql="SELECT 'article' AS entry_type, 'Key' || c_custkey AS cite_key, c_name AS title FROM customer")
def bibtex(k):
    text = F.concat(F.lit("@Article{Key"), "c_custkey", F.lit(", title={"), "c_name", F.lit("}, year = 1999}"))
    return k.select(text.alias("t")).lateralJoin(BibEntries(c("t").outer())).select("entry_type", "cite_key", c("fields")["title"].alias("title"))


@query("SRC-08_html", "pages")
def html(p):
    return p.select("page_id", M.parse(F.lit("html"), F.encode("html", "UTF-8")).alias("p")).select("page_id", F.length("p.text").alias("chars"), F.size("p.tables").alias("tables"), "p.error")


@query("SRC-07_csv", "customer", sql="SELECT c_custkey, 'name | value' || chr(10) || c_name || ' | ' || c_custkey AS text FROM customer")
def csv(k):
    body = F.concat(F.lit("name;value\n"), "c_name", F.lit(";"), "c_custkey", F.lit("\n"))
    return k.select("c_custkey", M.parse(F.lit("csv"), F.encode(body, "UTF-8")).alias("p")).select("c_custkey", "p.text")


@query("SRC-09_xml", "customer", sql="SELECT c_custkey, c_name || chr(10) || 'x' AS text FROM customer")
def xml(k):
    body = F.concat(F.lit("<a><b>"), "c_name", F.lit("</b><table><tr><td>x</td></tr></table></a>"))
    return k.select("c_custkey", M.parse(F.lit("xml"), F.encode(body, "UTF-8")).alias("p")).select("c_custkey", "p.text")


@query("SRC-11_latin1", "customer", sql="SELECT c_custkey, 'é' || c_custkey || chr(10) || c_name AS text, 0 AS tables FROM customer")
def latin1(k):
    """Files of the old Word format without a converter: every byte is a letter, and there are no tables."""
    body = F.encode(F.concat(F.lit("é"), "c_custkey", F.lit("\n"), "c_name"), "ISO-8859-1")
    return k.select("c_custkey", M.parse(M.parser_of(F.lit("application/msword"), F.lit(".DOC")), body).alias("p")).select("c_custkey", "p.text", F.size("p.tables").alias("tables"))


@query("SRC-16_pipe_tables", "customer", sql="SELECT c_custkey, 'Item,Value|Cash,' || c_custkey AS cells FROM customer")
def pipe_tables(k):
    body = F.concat(F.lit("Table 1\n| Item | Value |\n|---|---:|\n| Cash | "), "c_custkey", F.lit(" |\n\nend"))
    t = k.select("c_custkey", M.parse(F.lit("markdown"), F.encode(body, "UTF-8")).alias("p")).select("c_custkey", F.col("p.tables")[0].alias("t"))
    return t.select("c_custkey", F.array_join(F.transform("t", lambda r: F.array_join(r, ",")), "|").alias("cells"))


@query("SRC-19_dispatch", "resources", sql="""SELECT id, CASE WHEN m = 'text/csv' THEN 'csv' WHEN m = 'text/plain' OR id % 6 IN (2, 3) THEN 'markdown' WHEN m = 'text/html' THEN 'html' WHEN id % 6 = 1 THEN 'xlsx' END AS parser
FROM (SELECT id, lower(coalesce(media_type, '')) AS m FROM resources)""")  # fmt: skip
def dispatch(r):
    return r.select("id", M.parser_of(c("media_type"), S.suffix(c("filename"))).alias("parser"))


@query("SRC-22_catalog", "citations", "reference_links", sql="SELECT cite, count(*) AS links FROM citations JOIN reference_links USING (cite) GROUP BY cite")
def catalog(t, l):
    return l.join(t.select("cite"), "cite").groupBy("cite").agg(F.count("*").alias("links"))


@query("SRC-23_table_page", "nation", sql="SELECT n_nationkey, n_name, (SELECT count(*) FROM nation) AS total FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 5")
def table_page(n):
    total = n.agg(F.count("*").alias("total"))
    return n.orderBy("n_nationkey").offset(5).limit(10).crossJoin(total).select("n_nationkey", "n_name", "total")  # one row


LISTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
COLUMNS_OF = "(SELECT string_agg(column_name, ',' ORDER BY column_index) FROM (SELECT DISTINCT column_name, column_index FROM duckdb_columns() WHERE table_name = '{0}'))"


@query("SRC-23_table_list", *LISTED, sql=" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, {COLUMNS_OF.format(t)} AS columns FROM {t}" for t in LISTED))
def table_list(*tables):
    """Each table with its rows and its columns in their order; counts come from the files' footers."""
    listed = [t.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(",".join(t.columns)).alias("columns")) for name, t in zip(LISTED, tables)]
    return reduce(DataFrame.unionAll, listed)


def serialised(spans):
    """The spans of each table in the old form, in their order."""
    quoted = F.replace("text", F.lit("'"), F.lit("\\'"))
    cell = F.format_string(
        "TableCell(bbox=BoundingBox(l=%s, t=%s, r=%s, b=%s, coord_origin=<CoordOrigin.TOPLEFT: 'TOPLEFT'>), row_span=%d, col_span=%d, start_row_offset_idx=%d, "
        "end_row_offset_idx=%d, start_col_offset_idx=%d, end_col_offset_idx=%d, text='%s', column_header=False, row_header=False, row_section=False)",
        *[c(x).cast("string") for x in ("x0", "y0", "x1", "y1")], c("row_end") - c("row_start"), c("col_end") - c("col_start"), "row_start", "row_end", "col_start", "col_end", quoted,
    )
    order = F.struct("ln", "row_start", "row_end", "col_start", "col_end", "text", "x0", "y0", "x1", "y1")
    listed = spans.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), cell.alias("cell")))).alias("cells"))
    return listed.select("table_id", F.concat(F.lit("["), F.array_join("cells.cell", ", "), F.lit("]")).alias("raw"))


FILLED = """o AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY ln, row_start, row_end, col_start, col_end, text, x0, y0, x1, y1) AS ord FROM cell_spans),
  size AS (SELECT table_id, greatest(max(row_end), any_value(CASE WHEN table_id % 5 = 0 THEN 9 ELSE 0 END)) AS n_rows, max(col_end) AS n_cols FROM o GROUP BY table_id),
  places AS (SELECT table_id, ord, trim(text) AS text, unnest(range(row_start, row_end)) AS row, col_start, col_end FROM o WHERE trim(text) <> ''),
  grid_ AS (SELECT table_id, row, col, min_by(text, ord) AS value FROM (SELECT *, unnest(range(col_start, col_end)) AS col FROM places) GROUP BY table_id, row, col)"""


def _legacy(spans):
    cells = kept(T.serialised_cells(serialised(spans)))
    said = spans.filter("table_id % 5 = 0").select("table_id", F.lit(9).alias("num_rows"), F.lit(None).cast("int").alias("num_cols")).distinct()
    size = T.sizes(cells, said)
    return cells, size, T.filled(cells, size)


@query("SRC-24_legacy_cells", "cell_spans", sql=f"WITH {FILLED} SELECT table_id, row - 1 AS row_index, col AS col_index, value FROM grid_ WHERE row > 0")
def legacy_cells(spans):
    """Cells out of a serialised form by patterns; of spans that overlap the first value stays."""
    return T.repaired_cells(_legacy(spans)[2])


@query("SRC-24_legacy_headers", "cell_spans", sql=f"""WITH {FILLED}, box AS (SELECT table_id, min(CAST(x0 AS DOUBLE)) AS x0, min(CAST(y0 AS DOUBLE)) AS y0, max(CAST(x1 AS DOUBLE)) AS x1, max(CAST(y1 AS DOUBLE)) AS y1 FROM cell_spans GROUP BY table_id),
  tops AS (SELECT table_id, string_agg(coalesce(value, 'C' || (i + 1)), '|' ORDER BY i) AS cols FROM (SELECT table_id, unnest(range(0, n_cols)) AS i FROM size) LEFT JOIN (SELECT table_id, col AS i, value FROM grid_ WHERE row = 0) USING (table_id, i) GROUP BY table_id),
  sides AS (SELECT table_id, string_agg(coalesce(value, 'R' || i), '|' ORDER BY i) AS rows FROM (SELECT table_id, unnest(range(1, n_rows)) AS i FROM size) LEFT JOIN (SELECT table_id, row AS i, value FROM grid_ WHERE col = 0) USING (table_id, i) GROUP BY table_id)
  SELECT table_id, cols, rows, x0, y0, x1, y1 FROM tops JOIN sides USING (table_id) JOIN box USING (table_id) WHERE table_id IN (SELECT table_id FROM grid_ WHERE row > 0)""")  # fmt: skip
def legacy_headers(spans):
    found = T.repaired_headers(*_legacy(spans))
    return found.select("table_id", F.array_join("col_headers", "|").alias("cols"), F.array_join("row_headers", "|").alias("rows"), "x0", "y0", "x1", "y1")


@query("FLT-10_row_filters", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE trim(l_returnflag) = 'A' AND trim(l_linestatus) = 'F'")
def row_filters(l):
    return l.filter((F.trim("l_returnflag") == "A") & (F.trim("l_linestatus") == "F")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("PRJ-01_rename", "orders", sql="SELECT o_orderkey AS id, o_totalprice AS amount FROM orders")
def rename(o):
    return o.select(c("o_orderkey").alias("id"), c("o_totalprice").alias("amount"))


def printed(df, size, name):
    return df.select("*", A.fingerprint(c("text")).alias(name)).withColumn(size, c(size).cast("long")).drop("text")


@query("JN-17_text_similarity", "resources", "notes")
def text_similarity(r, t, least=0.70):
    """Pairs of near sizes whose fingerprints are alike; without a fingerprint all pairs of near sizes, the ratio null."""
    left = kept(printed(r.select("id", c("size_bytes").alias("size"), "text"), "size", "a"))
    right = kept(printed(t.select(c("id").alias("nid"), (F.length("text") * 10).alias("rsize"), "text"), "rsize", "b"))
    found = A.alike(left, right, least)
    return found.join(left, ["size", "a"]).join(right, ["rsize", "b"]).select("id", "nid", "ratio")


def _copies(d):
    left = kept(printed(d.select("doc_id", c("n_chars").alias("size"), "text"), "size", "a"))
    return left, left.select(c("doc_id").alias("other"), c("size").alias("rsize"), c("a").alias("b"))


@query("JN-17_similar_documents", "documents")
def similar_documents(d, least=0.70):
    """Each document's number of other documents of a near size that read alike, and the smallest of them."""
    left, right = _copies(d)
    return A.counts(kept(A.alike(left, right, least, same=True)), left, "doc_id")


PRINT_SQL = r"left(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\pL\pN_\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g'), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), 600)"


# How many pairs of different fingerprints the bounds leave; those behind the last one go to the matcher.
@query("JN-17_pairs_tested", "documents", sql=rf"""WITH p AS (SELECT DISTINCT n_chars AS size, {PRINT_SQL} AS f FROM documents WHERE n_chars > 0),
  k AS (SELECT size, f, length(f) AS n, list_append(list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789 ', ''), lambda x: n - length(replace(f, x, ''))), length(regexp_replace(f, '[a-z0-9 ]+', '', 'g'))) AS counts FROM p),
  band AS (SELECT a.n AS na, b.n AS nb, list_sum(list_transform(list_zip(a.counts, b.counts), lambda z: least(z[1], z[2]))) AS common FROM k a JOIN k b ON b.size BETWEEN a.size * 0.98 AND a.size * 1.02 WHERE a.n > 0 AND least(a.n, b.n) * 2.0 / (a.n + b.n) >= 0.7)
  SELECT 'length' AS bound, count(*) AS n FROM band UNION ALL SELECT 'characters', count(*) FROM band WHERE common * 2.0 / (na + nb) >= 0.7""")  # fmt: skip
def pairs_tested(d, least=0.70):
    n = A.tested(*_copies(d), least)
    return n.select(F.expr("stack(2, 'length', length, 'characters', characters) AS (bound, n)"))


@query("JN-19_nearest_interval", "lineitem", sql="""WITH p AS (SELECT DISTINCT l_orderkey AS d, l_partkey AS a, l_partkey + 5 AS b FROM lineitem), i AS (SELECT DISTINCT l_orderkey AS d, l_suppkey * 20 AS s, l_suppkey * 20 + 10 AS e, l_linenumber AS page FROM lineitem)
SELECT d, "start", "end", page FROM (SELECT p.d, a AS "start", b AS "end", page, row_number() OVER (PARTITION BY p.d, a, b ORDER BY CASE WHEN s < b AND e > a THEN 0 ELSE 1 END, CASE WHEN s < b AND e > a THEN e - s ELSE greatest(a - e, s - b) END, abs(s + e - a - b), s, e, page) AS n
FROM p JOIN i ON p.d = i.d) WHERE n = 1""")  # fmt: skip
def nearest(l):
    p = l.select(c("l_orderkey").alias("d"), c("l_partkey").alias("start"), (c("l_partkey") + 5).alias("end")).distinct()
    i = l.select(c("l_orderkey").alias("d"), (c("l_suppkey") * 20).alias("s"), (c("l_suppkey") * 20 + 10).alias("e"), c("l_linenumber").cast("long").alias("page")).distinct()
    return nearest_interval(p, i, "d")


@query("JN-22_claim_cells", "claims", "grid", sql="SELECT k.id, g.row_index, g.col_index, min(g.value) AS value FROM claims k JOIN grid g ON g.table_id = k.id GROUP BY ALL")
def claim_cells(k, g):
    return g.join(k.select(c("id").alias("table_id")), "table_id", "left_semi").groupBy(c("table_id").alias("id"), "row_index", "col_index").agg(F.min("value").alias("value"))


@query("WIN-03_latest_identity", "lineitem", sql="SELECT l_partkey, l_suppkey, l_returnflag, max(l_shipdate) AS last FROM lineitem GROUP BY ALL")
def latest_identity(l):
    return latest_by(l, ["l_partkey", "l_suppkey", "l_returnflag"], F.desc("l_shipdate")).select("l_partkey", "l_suppkey", "l_returnflag", c("l_shipdate").alias("last"))


@query("WIN-04_ties", "lineitem", sql="SELECT l_suppkey, count(*) AS n FROM (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r = 1 GROUP BY l_suppkey")
def ties(l):
    r = F.rank().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_quantity")))
    return l.withColumn("r", r).filter("r = 1").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("WIN-09_order_index", "documents", sql=r"SELECT doc_id, i - 1 AS order_index, length(s[i]) AS n FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+|$)'), lambda s: trim(s) <> '') AS s FROM documents))")
def order_index(d):
    return G.sentences(d, "doc_id").select("doc_id", "order_index", (c("end") - c("start")).alias("n"))


@query("TOP-07_cap_per_group", "downloads", sql="SELECT user, count(*) AS n FROM (SELECT url_host AS user, row_number() OVER (PARTITION BY url_host ORDER BY id) AS r FROM (SELECT id, split_part(url, '/', 3) AS url_host FROM downloads)) WHERE r <= 8 GROUP BY user")
def cap_per_group(d):
    d = d.select("id", F.split_part("url", F.lit("/"), F.lit(3)).alias("user"))
    r = F.row_number().over(Window.partitionBy("user").orderBy("id"))
    return d.withColumn("r", r).filter("r <= 8").groupBy("user").agg(F.count("*").alias("n"))


@query("SET-05_union_first_seen", "downloads", sql="SELECT url, min(id) AS first FROM downloads GROUP BY url")
def first_seen(d):
    half = d.filter("id % 2 = 0").unionByName(d.filter("id % 2 = 1"))
    return half.groupBy("url").agg(F.min("id").alias("first"))


@query("SNK-05_reference_upsert", "customer", sql="SELECT c_custkey AS cite, CASE WHEN c_custkey % 3 = 0 THEN 'updated' ELSE 'inserted' END AS action, c_custkey AS id FROM customer")
def reference_upsert(k):
    row = lambda df: df.select(c("c_custkey").alias("cite"), c("c_custkey").alias("id"), "c_name")
    return upsert(row(k.filter("c_custkey % 3 = 0")), row(k), "cite").select("cite", "action", "id")


@query("FN-09_canonical_digest", "customer", sql="SELECT c_custkey, sha256(c_custkey || chr(1) || c_name || chr(1) || coalesce(c_mktsegment, '')) AS digest FROM customer")
def canonical_digest(k):
    return k.select("c_custkey", F.sha2(F.concat_ws("\u0001", c("c_custkey").cast("string"), "c_name", F.coalesce("c_mktsegment", F.lit(""))), 256).alias("digest"))


@query("FN-10_table_identity", "grid", sql="SELECT table_id, 'sha256:' || sha256(string_agg(lower(trim(value)), '|' ORDER BY col_index, value)) AS identity FROM grid WHERE row_index = 0 GROUP BY table_id")
def table_identity(g):
    """Headers alone, folded: tables that differ in other cells share it."""
    head = g.filter("row_index = 0").groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col_index", "value"))).alias("h"))
    return head.select("table_id", F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform("h", lambda x: F.lower(F.trim(x["value"]))), "|"), 256)).alias("identity"))


@query("FN-12_url_list", "downloads", sql="SELECT id, url || ' https://z.org' AS urls FROM downloads")
def url_list(d):
    text = F.when(c("id") % 2 == 0, F.concat(F.lit('["'), "url", F.lit('", "https://z.org"]'))).otherwise(F.concat("url", F.lit("; https://z.org")))
    as_json = F.from_json(text, "array<string>")
    urls = F.when(text.startswith("["), as_json).otherwise(F.split(text, r"[;\n]\s*"))
    return d.select("id", F.array_join(S.merged_urls(urls), " ").alias("urls"))


TERMS_SQL = r"""array_to_string(list_filter(string_split_regex(regexp_replace(array_to_string(CASE WHEN len(list_filter(ls[1:60], lambda x: length(x) >= 30 AND NOT (upper(x) = x AND lower(x) <> x) AND lower(x) NOT LIKE 'page %'
  AND NOT regexp_full_match(x, '[\d\s.]+'))) > 0 THEN list_filter(ls[1:60], lambda x: length(x) >= 30 AND NOT (upper(x) = x AND lower(x) <> x) AND lower(x) NOT LIKE 'page %' AND NOT regexp_full_match(x, '[\d\s.]+'))[1:3] ELSE ls[1:3] END, ' '),
  '[^a-zA-Z0-9\s\-_/]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)[1:14], ' ')"""
LINES_SQL = r"list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query("FN-20_query_terms", "documents", sql=f"SELECT doc_id, {TERMS_SQL} AS terms FROM (SELECT doc_id, {LINES_SQL} AS ls FROM documents)")
def query_terms(d):
    return d.select("doc_id", S.query_terms(c("text")).alias("terms"))


@query("FN-21_web_queries", "resources", sql=rf"""WITH h AS (SELECT id, CASE WHEN id % 7 = 0 THEN '10.1234/x' || id END AS doi, coalesce(trim(title), '') AS title, CASE WHEN id % 2 = 0 THEN 'Smith' ELSE '' END AS author,
    trim(regexp_replace(regexp_replace(coalesce(regexp_extract(filename, '[^/]*$'), ''), '(.)\.[^.]*$', '\1'), '[_-]', ' ', 'g')) AS stem, {TERMS_SQL} AS terms FROM (SELECT *, {LINES_SQL} AS ls FROM resources)),
  q AS (SELECT id, list_filter(list_transform([coalesce(doi, ''), CASE WHEN title <> '' AND author <> '' THEN title || ' ' || author ELSE '' END, title, CASE WHEN stem <> '' THEN stem || ' ' || title ELSE '' END,
    CASE WHEN terms <> '' THEN title || ' ' || terms ELSE '' END], lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS q FROM h)
  SELECT id, array_to_string(list_filter(q, lambda x, i: list_position(list_transform(q, lambda y: lower(y)), lower(x)) = i)[1:4], '|') AS queries FROM q""")  # fmt: skip
def web_queries(r):
    doi = F.when(c("id") % 7 == 0, F.concat(F.lit("10.1234/x"), "id"))
    author = F.when(c("id") % 2 == 0, "Smith")
    return r.select("id", F.array_join(S.web_queries(doi, c("title"), author, c("filename"), S.query_terms(c("text"))), "|").alias("queries"))


@query("FN-28_title_rejection", "resources", sql="SELECT id, CASE WHEN coalesce(trim(title), '') = '' THEN 'blank' WHEN lower(title) LIKE 'untitled%' THEN 'useless' ELSE 'ok' END AS reason FROM resources")
def title_rejection(r):
    garbage = F.exists(F.split(S.text_or_empty(c("title")), r"\s+"), S.garbage_token)
    return r.select("id", F.when(F.trim(S.text_or_empty(c("title"))) == "", "blank").when(S.useless_title(c("title")), "useless").when(garbage, "garbage").otherwise("ok").alias("reason"))


@query("FN-29_titles", "part", sql="""WITH raw AS (SELECT p_partkey, unnest([p_name || '..', '  ' || p_type || chr(9) || p_brand, 'untitled ' || p_partkey, p_name, repeat(p_name || '  ', 12), p_brand || ' .', NULL, p_type, 'no. ' || p_size, p_brand, p_type || ' ' || p_size]) AS t,
  generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11], 1) AS i FROM part),
cut AS (SELECT p_partkey, i, left(rtrim(trim(regexp_replace(t, '\\s+', ' ', 'g')), '.'), 90) AS t FROM raw),
once AS (SELECT p_partkey, t, min(i) AS i FROM cut WHERE t <> '' AND NOT starts_with(lower(t), 'untitled') GROUP BY p_partkey, t),
n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS n FROM once)
SELECT p_partkey, string_agg(t, '|' ORDER BY n) AS titles FROM n WHERE n <= 6 GROUP BY p_partkey""")  # fmt: skip
def titles(p):
    given = F.array(
        F.concat("p_name", F.lit("..")), F.concat(F.lit("  "), "p_type", F.lit("\t"), "p_brand"), F.concat(F.lit("untitled "), "p_partkey"), c("p_name"), F.repeat(F.concat("p_name", F.lit("  ")), 12),
        F.concat("p_brand", F.lit(" .")), F.lit(None), c("p_type"), F.concat(F.lit("no. "), "p_size"), c("p_brand"), F.concat("p_type", F.lit(" "), "p_size"))
    return p.select("p_partkey", F.array_join(S.good_titles(given), "|").alias("titles"))


@query("FN-30_stem", "files", sql="SELECT id, 'file ' || (id % 600) AS stem FROM files")
def stem(f):
    return f.select("id", S.clean_title(c("filename")).alias("stem"))


@query("FN-31_title_payload", "part", sql="SELECT p_partkey, p_name AS best FROM part")
def title_payload(p):
    reply = F.concat(F.lit("Sure! "), F.to_json(F.struct(c("p_name").alias("best_title"))), F.lit(" done"))
    return p.select("p_partkey", F.get_json_object(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "$.best_title").alias("best"))


@query("FN-34_page_index", "lineitem", sql="SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber WHEN l_linenumber % 3 = 1 THEN l_linenumber - 1 END AS page FROM lineitem")
def page_index(l):
    attrs = F.when(c("l_linenumber") % 3 == 0, F.concat(F.lit('{"page_index":'), "l_linenumber", F.lit("}"))).when(c("l_linenumber") % 3 == 1, F.concat(F.lit('{"prov":[{"page_no":'), "l_linenumber", F.lit("}]}"))).otherwise("{}")
    zero = F.get_json_object(attrs, "$.page_index").try_cast("int")
    one = F.get_json_object(attrs, "$.prov[0].page_no").try_cast("int") - 1
    return l.select("l_orderkey", "l_linenumber", F.coalesce(F.when(zero >= 0, zero), F.when(one >= 0, one)).alias("page"))


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@query("FN-46_sha1", "documents", sql=f"""SELECT doc_id, list_aggregate(list_transform(range(0, 32), lambda i: substr('{BASE32}',
  CAST((CAST(('0x' || substr(h, CAST(i // 8 * 10 + 1 AS BIGINT), 10)) AS BIGINT) >> CAST(35 - i % 8 * 5 AS INTEGER)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS digest FROM (SELECT doc_id, sha1(text) AS h FROM documents)""")  # fmt: skip
def sha1(d):
    """SHA-1 in base 32: of each 10 hexadecimal digits (40 bits) eight letters of 5 bits."""
    part = lambda i: F.conv(F.substring("h", i // 8 * 10 + 1, 10), 16, 10).cast("long")
    letters = [F.substring(F.lit(BASE32), (F.shiftright(part(i), 35 - i % 8 * 5).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(32)]
    return d.select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("h")).select("doc_id", F.concat(*letters).alias("digest"))


@query("FN-47_page_urls", "pages", sql="SELECT page_id, 'https://site.org/' || page_id AS urls FROM pages")
def page_urls(p):
    body = F.concat(F.lit('<html><head><link rel="canonical" href="https://site.org/'), "page_id", F.lit('"><base href="/x"></head>'), "html")
    return p.select("page_id", F.array_join(M.page_urls(body), " ").alias("urls"))


@query("TXT-02_windowed_scan", "documents", sql=r"SELECT doc_id, len(regexp_extract_all(text, '\d{4,}')) AS n FROM documents")
def windowed_scan(d):
    """Whole texts of any length are scanned; texts of one window give the same as a windowed scan."""
    return d.select("doc_id", F.size(G.matches(c("text"), r"\d{4,}")).alias("n"))


@query("TXT-04_segments", "documents", sql=r"SELECT doc_id, 1 + len(list_filter(regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+|$)'), lambda s: trim(s) <> '')) AS n FROM documents")
def segments(d):
    root = d.select("doc_id", F.lit("layout:document").alias("kind"), F.lit(0).alias("start"), F.length("text").alias("end"))
    every = root.unionByName(G.sentences(d, "doc_id").select("doc_id", F.lit("structure:sentence").alias("kind"), "start", "end")).dropDuplicates()
    return every.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("TAB-03_profile", "lineitem", sql="""WITH f AS (SELECT l_suppkey, CASE WHEN trim(l_comment) = '' THEN NULL ELSE l_comment END AS note, l_returnflag, CAST(l_orderkey AS VARCHAR) AS key, l_orderkey, l_linenumber,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_returnflag, l_comment) AS n FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_linenumber % 7 = 0 THEN ' ' ELSE l_linestatus END AS l_comment FROM lineitem))
SELECT l_suppkey, count(*) AS observed, 'key|flag|note' AS columns, string_agg(key || '|' || l_returnflag || '|' || coalesce(note, ''), chr(10) ORDER BY n) FILTER (WHERE n <= 40) AS sample FROM f GROUP BY l_suppkey""")  # fmt: skip
def table_profile(l, rows=40):
    """A profile of each supplier's lines as a table: non-blank rows observed, columns, the first 40 rows as sampled maps."""
    note = F.when(c("l_linenumber") % 7 == 0, " ").otherwise(c("l_linestatus"))
    cells = F.create_map(F.lit("key"), c("l_orderkey").cast("string"), F.lit("flag"), c("l_returnflag"), F.lit("note"), F.when(F.trim(note) != "", note))
    row = l.select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", note.alias("note"), cells.alias("cells"))
    row = row.filter(F.exists(F.map_values("cells"), lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""))
    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_returnflag", "note"))
    first = row.withColumn("n", n).filter(c("n") <= rows).groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("n", F.array_join(F.transform(F.array(F.lit("key"), F.lit("flag"), F.lit("note")), lambda k: F.coalesce(F.element_at("cells", k), F.lit(""))), "|").alias("row")))).alias("s"))
    seen = row.groupBy("l_suppkey").agg(F.count("*").alias("observed"))
    return seen.join(first, "l_suppkey").select("l_suppkey", "observed", F.lit("key|flag|note").alias("columns"), F.array_join("s.row", "\n").alias("sample"))


@query("REG-05_primary_url", "tasks", sql=r"""WITH given AS (SELECT id, known, source_uri, CASE id % 4 WHEN 0 THEN ' https://new.org/' || id || ' ' WHEN 1 THEN 'doi 10.1234/X' || id || '.' WHEN 2 THEN 'nothing' END AS raw FROM tasks),
  chosen AS (SELECT *, CASE WHEN regexp_matches(lower(trim(raw)), '^https?://') THEN trim(raw) WHEN raw LIKE '%10.1234/%' THEN 'https://doi.org/' || lower(regexp_extract(raw, '10\.1234/X\d+')) END AS url FROM given)
  SELECT id, url AS primary_url, CASE WHEN url IS NULL THEN 'no_url_or_doi' END AS reason, CASE WHEN url IS NOT NULL THEN array_to_string(list_filter(list_distinct_ordered, lambda u: u IS NOT NULL), ' ') END AS urls
  FROM (SELECT *, [k, CASE WHEN s IS DISTINCT FROM k THEN s END, CASE WHEN url IS DISTINCT FROM k AND url IS DISTINCT FROM s THEN url END] AS list_distinct_ordered
    FROM (SELECT *, CASE WHEN regexp_matches(lower(trim(known)), '^https?://') THEN trim(known) END AS k, CASE WHEN regexp_matches(lower(trim(source_uri)), '^https?://') THEN trim(source_uri) END AS s FROM chosen))""")  # fmt: skip
def primary_url(t):
    """A new primary address: an address or a DOI made one; it counts as primary although it stands last in the merged list."""
    raw = F.when(c("id") % 4 == 0, F.concat(F.lit(" https://new.org/"), "id", F.lit(" "))).when(c("id") % 4 == 1, F.concat(F.lit("doi 10.1234/X"), "id", F.lit("."))).when(c("id") % 4 == 2, "nothing")
    url = F.coalesce(F.when(S.is_url(F.trim(raw)), F.trim(raw)), S.doi_url(S.first_doi(raw)))
    urls = F.when(url.isNotNull(), F.array_join(outside(F.array("known", "source_uri", url)), " "))
    return t.select("id", url.alias("primary_url"), F.when(url.isNull(), "no_url_or_doi").alias("reason"), urls.alias("urls"))


@query("REG-07_source_detail", "tasks", "runs", "notes", "citations", "reference_links", sql=r"""WITH latest AS (SELECT resource_id, max_by(id, (created_on, id)) AS run_id FROM runs WHERE id IN (SELECT id FROM notes) GROUP BY resource_id),
  refs AS (SELECT resource_id, l.reference_id, l.cite, title, row_number() OVER (PARTITION BY resource_id ORDER BY l.reference_id) AS n FROM reference_links l JOIN citations USING (cite))
  SELECT t.id, CASE WHEN regexp_matches(lower(trim(known)), '^https?://') THEN trim(known) END AS primary_url, array_to_string(list_filter([CASE WHEN regexp_matches(lower(trim(known)), '^https?://') THEN trim(known) END,
    CASE WHEN regexp_matches(lower(trim(source_uri)), '^https?://') AND trim(source_uri) IS DISTINCT FROM trim(known) THEN trim(source_uri) END], lambda u: u IS NOT NULL), ' ') AS candidates,
  coalesce(r.refs, '') AS refs, latest.run_id, left(n.text, 4000) AS preview, length(n.text) AS char_count
  FROM tasks t LEFT JOIN latest ON latest.resource_id = t.id LEFT JOIN notes n ON n.id = latest.run_id
  LEFT JOIN (SELECT resource_id, string_agg(reference_id || ':' || cite || ':' || title, '|' ORDER BY n) AS refs FROM refs WHERE n <= 100 GROUP BY resource_id) r ON r.resource_id = t.id""")  # fmt: skip
def source_detail(t, runs, notes, cites, links):
    """A source with its addresses, the primary one first, its first 100 references and the latest text's beginning."""
    texts = notes.select(c("id").alias("run_id"), c("text").alias("said"))
    latest = latest_by(runs.select("resource_id", c("id").alias("run_id"), "created_on").join(texts.select("run_id"), "run_id"), ["resource_id"], F.desc("created_on"), F.desc("run_id"))
    refs = first_n_by(links.join(cites.select("cite", "title"), "cite"), ["resource_id"], 100, c("reference_id"))
    line = F.struct("reference_id", F.concat_ws(":", "reference_id", "cite", "title").alias("line"))
    refs = refs.groupBy("resource_id").agg(F.array_sort(F.collect_list(line)).alias("refs"))
    primary = F.when(S.is_url(F.trim("known")), F.trim("known"))
    shown = t.join(latest.select(c("resource_id").alias("id"), "run_id"), "id", "left").join(texts, "run_id", "left").join(refs.withColumnRenamed("resource_id", "id"), "id", "left")
    return shown.select(
        "id", primary.alias("primary_url"), F.array_join(outside(F.array("known", "source_uri")), " ").alias("candidates"), F.coalesce(F.array_join("refs.line", "|"), F.lit("")).alias("refs"),
        "run_id", F.substring("said", 1, 4000).alias("preview"), F.length("said").alias("char_count"),
    )


@query("VER-05_first_cell", "grid", sql="SELECT table_id, row_index, col_index, min(value) AS value FROM grid WHERE col_index = 1 GROUP BY ALL")
def first_cell(g):
    return g.filter("col_index = 1").groupBy("table_id", "row_index", "col_index").agg(F.min("value").alias("value"))


@query("TRC-03_citation_counts", "claims", "reference_links", sql="SELECT k.cite, count(DISTINCT k.id) AS claims, count(DISTINCT l.reference_id) AS refs FROM claims k JOIN reference_links l USING (cite) GROUP BY k.cite")
def citation_counts(k, l):
    a = k.filter(c("cite").isNotNull()).groupBy("cite").agg(F.countDistinct("id").alias("claims"))
    return a.join(l.groupBy("cite").agg(F.countDistinct("reference_id").alias("refs")), "cite")


@query("HLT-03_unbound", "claims", "evidence", sql="SELECT id FROM claims WHERE claim_type = 'quantitative' AND id NOT IN (SELECT claim_id FROM evidence)")
def unbound(k, e):
    return k.filter("claim_type = 'quantitative'").join(e.select(c("claim_id").alias("id")), "id", "left_anti").select("id")


@F.arrow_udf(ArrayType(FloatType()))
def hash_embedding(texts: pa.Array) -> pa.Array:
    """A stand-in without a model: signed counts of hashed words in 64 places, of length 1."""
    import xxhash

    def some(texts: list) -> pa.Array:
        out = np.zeros((len(texts), 64), np.float32)
        for v, t in zip(out, texts):
            for w in (t or "").lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                v[h % 64] += 1 if h >> 63 else -1
            v /= max(float(np.linalg.norm(v)), 1e-9)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * 64), pa.array(out.reshape(-1)))

    return in_steps(texts, some)


@query("VEC-06_embedding", "documents")
def embedding(d):
    """The vectors themselves, of length 1; SQL has no such hash, so tests/test_whole.py computes them again."""
    return d.filter(F.trim("text") != "").select("doc_id", hash_embedding("text").alias("embedding"))


@query("VEC-09_index_idempotence", "runs", sql="SELECT id, CASE WHEN n > 1 THEN 'skipped' ELSE 'indexed' END AS action FROM (SELECT id, row_number() OVER (PARTITION BY resource_id, status, parser ORDER BY created_on, id) AS n FROM runs)")
def index_idempotence(r):
    n = F.row_number().over(Window.partitionBy("resource_id", "status", "parser").orderBy("created_on", "id"))
    return r.withColumn("n", n).select("id", F.when(c("n") > 1, "skipped").otherwise("indexed").alias("action"))


@query("VEC-12_upsert_points", "embeddings", sql="""SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS label, CASE WHEN vec_id % 5 <> 0 THEN 'kept' WHEN vec_id % 2 = 0 THEN 'updated' ELSE 'inserted' END AS action
FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 5 = 0""")  # fmt: skip
def upsert_points(e):
    """Points of a batch replace those of the same id and come beside the others."""
    old, new = e.filter("vec_id % 2 = 0").select("vec_id", "label"), e.filter("vec_id % 5 = 0").select("vec_id", (c("label") + 100).alias("fresh"))
    both = old.withColumn("had", F.lit(True)).join(new.withColumn("new", F.lit(True)), "vec_id", "full")
    action = F.when(c("new").isNull(), "kept").when(c("had").isNull(), "inserted").otherwise("updated")
    return both.select("vec_id", F.coalesce("fresh", "label").alias("label"), action.alias("action"))
