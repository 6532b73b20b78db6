"""The evidence model over the driver's tables: views in SQL that both Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Views by name. Dates are plain days; text is built from numbers, so both engines make the same.
FRAMES = {
    "resources": """SELECT doc_id AS id, source, lang, n_chars AS size_bytes, text,
  CASE doc_id % 9 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html' WHEN 2 THEN 'text/csv' WHEN 3 THEN 'Application/PDF' WHEN 4 THEN 'text/plain'
    WHEN 5 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN 6 THEN 'image/png' WHEN 7 THEN 'application/json' ELSE NULL END AS media_type,
  CASE doc_id % 6 WHEN 0 THEN 'annual_report-' || (2000 + doc_id % 24) || '.pdf' WHEN 1 THEN 'upload:budget_' || doc_id || '.XLSX' WHEN 2 THEN 'notes.txt' WHEN 3 THEN 'a/b/policy-' || doc_id || '.md'
    WHEN 4 THEN '3f95fe1e-0b7c-4c55-9d5e-aaaaaaaaaaaa.pdf' ELSE NULL END AS filename,
  CASE doc_id % 5 WHEN 0 THEN 'https://www.data-board.org/d/' || doc_id || '/' WHEN 1 THEN 'HTTP://Example.org/x?q=' || doc_id WHEN 2 THEN 'file:///tmp/' || doc_id WHEN 3 THEN '' ELSE NULL END AS url,
  CASE doc_id % 4 WHEN 0 THEN 'Untitled 3' WHEN 1 THEN '' WHEN 2 THEN 'Report ' || doc_id ELSE NULL END AS title,
  CAST('2024-01-01' AS DATE) + CAST(doc_id % 45 AS INTEGER) AS imported_on FROM documents""",
    "runs": """SELECT o_orderkey AS id, o_custkey AS resource_id, CAST(o_orderdate AS DATE) AS created_on,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'Running' END AS status, o_orderpriority AS parser FROM orders""",
    "grid": """SELECT l_orderkey AS table_id, l_suppkey AS resource_id, l_linenumber - 1 AS row_index, CAST(l_partkey % 3 AS INTEGER) AS col_index,
  CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)) AS value FROM lineitem""",
    "claims": """SELECT o_orderkey AS id, o_custkey % 50 AS set_id, CASE WHEN o_orderkey % 5 = 0 THEN 'narrative' WHEN o_orderkey % 97 = 1 THEN 'other' ELSE 'quantitative' END AS claim_type,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS subject, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'total' END AS predicate,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'Total of order ' || o_orderkey END AS narrative_text,
  CASE o_orderkey % 7 WHEN 0 THEN '(' || (o_orderkey % 50) || ')' WHEN 1 THEN '£' || (o_orderkey % 50) || 'm' WHEN 2 THEN NULL WHEN 3 THEN ' ' WHEN 4 THEN (o_orderkey % 50) || '%' ELSE (o_orderkey % 50) || '' END AS value_raw,
  CASE WHEN o_orderkey % 7 = 2 AND o_orderkey % 2 = 0 THEN CAST(o_orderkey % 50 AS DOUBLE) END AS value_parsed,
  CASE WHEN o_orderkey % 4 = 0 THEN 'GBP' END AS currency, CASE WHEN o_orderkey % 6 = 0 THEN 1000 END AS scale_factor,
  CASE WHEN o_orderkey % 8 = 0 THEN '2022/23' END AS period, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 40 END AS cite FROM orders""",
    "evidence": """SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS claim_id, min(l_suppkey) AS resource_id, l_linenumber AS ord,
  CASE l_linenumber % 5 WHEN 1 THEN 'value-cell' WHEN 2 THEN 'row-header' WHEN 3 THEN 'column-header' WHEN 4 THEN 'caption' ELSE 'quote' END AS role, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "selectors": """SELECT id AS evidence_id, claim_id, 1 AS ord, CASE WHEN role = 'quote' THEN 'TextQuoteSelector' ELSE 'TableAddressSelector' END AS selector_type,
    claim_id AS table_id, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE ord - 1 END AS row_index, CAST(l_partkey % 3 AS INTEGER) AS col_index,
    CASE WHEN l_partkey % 5 = 0 THEN 'USD' WHEN l_partkey % 5 = 1 THEN 'GBP' END AS currency, CASE WHEN l_partkey % 7 = 0 THEN 1 END AS scale_factor,
    CASE WHEN l_partkey % 6 = 0 THEN '2021/22' END AS period, 'order ' || claim_id AS exact FROM evidence WHERE l_partkey % 9 <> 0
  UNION ALL SELECT id, claim_id, 2, 'PageGeometrySelector', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM evidence WHERE l_partkey % 3 <> 0""",
    "citations": "SELECT c_custkey % 40 AS cite, min(c_custkey) AS reference_id, min(c_name) AS title FROM customer GROUP BY c_custkey % 40",
    "reference_links": "SELECT DISTINCT c_custkey % 40 AS cite, c_custkey AS reference_id, c_nationkey AS resource_id FROM customer",
    "downloads": """SELECT event_id AS id, 'File_' || (event_id % 500) || '.pdf' AS filename, 'https://host' || user_id || '.org/f/' || (event_id % 700) AS url,
  CASE WHEN event_id % 17 = 0 THEN -1 ELSE CAST(1000 + event_id % 5000 AS BIGINT) END AS size, CAST(ts AS DATE) AS day FROM events""",
    "files": """SELECT doc_id AS id, 'file_' || (doc_id % 600) || '.PDF' AS filename, CAST(900 + n_chars % 5200 AS BIGINT) AS size, CAST('2024-01-10' AS DATE) + CAST(doc_id % 20 AS INTEGER) AS day FROM documents""",
    "saved": """SELECT doc_id AS id, CASE WHEN doc_id % 40 = 39 THEN '' ELSE 'file_' || (doc_id % 600) || CASE doc_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.csv' ELSE '' END END AS filename, CAST(900 + n_chars % 700 AS BIGINT) AS size,
  CASE doc_id % 7 WHEN 0 THEN 'file:///home/u/' || doc_id || '.pdf' WHEN 1 THEN 'https://src.org/' || doc_id WHEN 2 THEN '' END AS source_uri, CAST('2024-01-10' AS DATE) + CAST(doc_id % 20 AS INTEGER) AS day FROM documents""",
  "history": """SELECT event_id AS did, CASE WHEN event_id % 13 = 0 THEN '/home/u/' || (event_id % 997) || '.pdf' WHEN event_id % 13 = 1 THEN NULL ELSE '/tmp/File_' || (event_id % 500) || CASE event_id % 2 WHEN 0 THEN '.pdf' ELSE '.CSV' END END AS path,
  'https://host' || user_id || '.org/f/' || (event_id % 300) AS url, CASE WHEN event_id % 17 = 0 THEN -1 ELSE CAST(900 + event_id % 700 AS BIGINT) END AS size, CAST(ts AS DATE) + CAST(event_id % 25 AS INTEGER) AS day FROM events""",
  "tasks": """SELECT doc_id AS id, text, n_chars AS bytes, doc_id % 61 <> 7 AS has_file, CASE WHEN doc_id % 4 = 0 THEN ' https://old.org/' || (doc_id % 5) || ' ' WHEN doc_id % 4 = 1 THEN 'ftp://old' END AS known,
  CASE doc_id % 3 WHEN 0 THEN 'file_' || (doc_id % 600) || '.pdf' WHEN 1 THEN 'Page ' || doc_id || '.html' ELSE 'copy_' || (doc_id % 300) END AS filename, CAST(900 + n_chars % 9000 AS BIGINT) AS size,
  CASE doc_id % 8 WHEN 0 THEN 'HTTPS://src.org/' || doc_id WHEN 1 THEN 'file:///home/u/' || doc_id || '.pdf' WHEN 2 THEN '' END AS source_uri, CAST('2024-01-10' AS DATE) + CAST(doc_id % 20 AS INTEGER) AS day FROM documents""",
  "catalog": "SELECT doc_id AS cid, text, 'https://catalog.org/' || doc_id AS url FROM documents WHERE doc_id % 29 = 0",
  "again": "SELECT doc_id AS aid, text, n_chars AS abytes, 'https://again.org/' || doc_id AS url FROM documents WHERE doc_id % 31 = 1",
  "discovery": """SELECT p_partkey AS pid, 'FILE_' || (p_partkey % 600) || '.pdf' AS pname, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE CAST(900 + p_partkey % 700 AS BIGINT) END AS psize, 'https://found.org/' || p_partkey AS url FROM part WHERE p_partkey % 5 = 0""",
  "attributes": """SELECT c_custkey AS rid, CASE WHEN c_custkey % 2 = 0 THEN 'archive' ELSE 'source' END AS place, CASE c_custkey % 11 WHEN 0 THEN '["https://j.org/' || c_custkey || '", "none", "https://j.org/2"]' WHEN 1 THEN 'https://x.org/' || c_custkey || '; https://y.org/1'
  ELSE 'no address' END AS body FROM customer""",
  "copies": """SELECT doc_id AS copy_id, 'Copy_' || (doc_id % 300) AS cname, CAST(900 + n_chars % 9000 AS BIGINT) AS csize, CASE WHEN doc_id % 2 = 0 THEN 'https://copy.org/' || doc_id ELSE '' END AS body FROM documents WHERE doc_id % 9 IN (2, 5)""",
  "linked": """SELECT c_custkey % 700 AS rid, c_custkey AS ref, CASE c_custkey % 9 WHEN 0 THEN 'https://ref.org/' || c_custkey WHEN 1 THEN 'no url' END AS url, CASE WHEN c_custkey % 9 IN (1, 2) THEN '10.1234/R.' || c_custkey END AS doi FROM customer""",
    "cell_spans": """SELECT l_orderkey AS table_id, l_linenumber AS ln, CAST(l_linenumber % 4 AS INTEGER) AS row_start, CAST(l_linenumber % 4 + 1 + l_partkey % 3 AS INTEGER) AS row_end, CAST(l_suppkey % 3 AS INTEGER) AS col_start,
  CAST(l_suppkey % 3 + 1 + l_partkey % 2 AS INTEGER) AS col_end, CASE l_partkey % 10 WHEN 0 THEN ' ' WHEN 1 THEN 'it''s, ' || l_partkey || ' (a)' ELSE ' v' || l_partkey END AS text,
  (l_partkey % 90 - 9) || '' AS x0, (l_suppkey % 70) || '.25' AS y0, (l_partkey % 90 + 30) || '.5' AS x1, (l_suppkey % 70 + 12) || '' AS y1 FROM lineitem""",
    "sheet_cells": """SELECT l_orderkey AS table_id, l_linenumber AS row_index, CAST(l_partkey % 4 AS INTEGER) AS col_index, min(CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN ' Data Source: ' || l_suppkey
  WHEN l_linenumber = 2 AND l_orderkey % 5 = 0 THEN 'Licence' WHEN l_suppkey % 9 = 0 THEN ' ' WHEN l_suppkey % 9 = 1 THEN 'Same' WHEN l_suppkey % 9 = 2 THEN 'same ' ELSE 'v' || l_partkey END) AS value FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey % 4""",
    "captions": """SELECT o_orderkey AS table_id, CASE o_orderkey % 3 WHEN 0 THEN ' Orders ' || o_orderpriority WHEN 1 THEN '' END AS caption, 'Total' AS h0, CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE ' Year ' END AS h1,
  CASE WHEN o_orderkey % 4 = 0 THEN 'row ' || o_custkey ELSE ' ' END AS r0, 'second' AS r1 FROM orders""",
    "table_cells": """SELECT l_orderkey AS table_id, CAST(l_linenumber - 1 AS INTEGER) AS row_index, CAST(l_partkey % 3 AS INTEGER) AS col_index, max(CASE WHEN l_partkey % 7 = 0 THEN ' ' WHEN l_partkey % 50 = 1 THEN repeat('long value ' || l_suppkey || ', ', 150) ELSE ' v' || l_partkey END) AS value
  FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY l_orderkey, l_linenumber, l_partkey % 3""",
    "images": """SELECT l_orderkey AS doc, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp, CAST(l_partkey % 700 + 1 AS DOUBLE) AS width, CAST(l_suppkey * 8 % 900 + 1 AS DOUBLE) AS height, l_partkey * 3 % 2000 + 1 AS source_width, l_suppkey * 40 % 3000 + 1 AS source_height,
  l_partkey % 120 AS page_text FROM lineitem""",
    "model_attempts": """SELECT event_type AS model, value > 50 AS ok, value / 10 AS elapsed, event_id % 400 AS tokens, CASE WHEN event_id % 6 = 0 THEN 0 ELSE event_id % 1000 * 1000000 END AS eval_ns FROM events WHERE event_type <> 'signup'""",
    "probes": """SELECT event_id AS id, 'https://h' || user_id || '.org/a/' || CASE event_id % 6 WHEN 0 THEN 'Download' WHEN 1 THEN 'Doc_' || (event_id % 400) || '.PDF?v=2' WHEN 2 THEN 'none_' || event_id || '.pdf' WHEN 3 THEN '' ELSE 'doc_' || (event_id % 300) || '.pdf' END AS url,
  CASE event_id % 4 WHEN 0 THEN 'attachment; filename="Doc_' || (event_id % 200) || '.pdf"' WHEN 1 THEN 'attachment; filename="F.txt"' ELSE '' END AS disposition FROM events""",
    "stored_files": "SELECT 'doc_' || (doc_id % 350) || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.PDF' END AS name, 'dl/' || doc_id AS path FROM documents",
    "listing": """SELECT doc_id AS n, 'r' || (doc_id % 4) AS root, CASE WHEN doc_id % 4 < 2 THEN 'shallow' ELSE 'deep' END AS kind, doc_id % 3 + 1 AS depth, CASE doc_id % 3 WHEN 0 THEN 'file_' || (doc_id % 600) || '.pdf' WHEN 1 THEN 'Page ' || doc_id || '.html' ELSE 'copy_' || (doc_id % 300) END AS name,
  'r' || (doc_id % 4) || '/p/' || doc_id AS path, 'real/' || (doc_id % 450) AS real, CAST(900 + n_chars % 9000 AS BIGINT) AS length FROM documents""",
    "import_jobs": """SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN ' Queued ' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'processing' WHEN 3 THEN 'running' WHEN 4 THEN 'done' WHEN 5 THEN 'failed' WHEN 6 THEN 'processing ' WHEN 7 THEN 'old' ELSE 'queued' END AS status,
  'was ' || event_type AS detail, event_id % 9 IN (4, 5) OR event_id % 27 = 7 AS finished, event_id % 4 = 1 AS cancel_requested, CASE event_id % 12 WHEN 1 THEN 'SKIP' WHEN 5 THEN 'kill' END AS cancel_action, 'in/' || (event_id % 1000) AS staged_path FROM events""",
    "staged": "SELECT 'in/' || doc_id AS path, CASE WHEN doc_id % 8 = 0 THEN 0 ELSE n_chars END AS length FROM documents WHERE doc_id % 5 <> 2 AND doc_id < 1000",
    "kinds": """SELECT l_orderkey AS id, CASE l_linenumber WHEN 1 THEN 'layout:Title' WHEN 2 THEN 'layout:paragraph' WHEN 3 THEN 'layout:section_header' WHEN 4 THEN 'layout:PAGE_HEADER' WHEN 5 THEN 'structure:sentence' WHEN 6 THEN 'sub-heading 2' END AS kind FROM lineitem""",
    "candidates": "SELECT c_custkey % 1200 AS resource_id, c_custkey AS bib, CAST(c_custkey % 11 AS DOUBLE) / 10 AS score FROM customer",
    "bibs": """SELECT s_suppkey AS bib, CASE s_suppkey % 3 WHEN 0 THEN 'HTTPS://src.org/' || (s_suppkey * 8) WHEN 1 THEN 'https://www.src.org/' || (s_suppkey * 8) || '/' ELSE 'https://other.org/' || s_suppkey END AS burl FROM supplier""",
    "index_runs": """SELECT o_orderkey AS id, o_custkey AS resource_id, o_orderkey AS extraction_run_id, 'm' || (o_orderkey % 2) AS model, 'v1' AS version, 'local' AS backend, CASE o_orderkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'success' END AS status FROM orders""",
    "jobs": """SELECT user_id * 10 + event_id % 7 AS job_id, event_id AS seq, event_type AS state, value, CAST(ts AS DATE) AS day,
  CASE event_type WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'queued' END AS status,
  CASE WHEN event_id % 3 = 0 THEN 'step ' || (event_id % 50) ELSE '' END AS detail, CASE WHEN event_id % 4 = 0 THEN event_id % 90 END AS page FROM events""",
    "updates": """SELECT user_id AS job_id, event_id AS seq, ts, CASE WHEN event_id % 97 = 0 THEN 'done' WHEN event_id % 131 = 0 THEN 'failed' ELSE 'processing' END AS status,
  CASE event_id % 5 WHEN 0 THEN ' extract ' WHEN 1 THEN 'extract' WHEN 2 THEN 'vectors' WHEN 3 THEN NULL ELSE 'import' END AS stage,
  CASE event_id % 4 WHEN 1 THEN 'active' WHEN 2 THEN 'waiting' WHEN 3 THEN 'completed' END AS state, event_id % 130 - 10 AS progress,
  CASE WHEN event_id % 3 = 0 THEN 'step ' || (event_id % 50) ELSE '' END AS detail, CASE WHEN event_id % 4 = 1 THEN (event_id % 77) || ' rows' END AS stats,
  CASE WHEN event_id % 6 = 0 THEN event_id % 40 - 3 END AS page_count, CASE WHEN event_id % 4 = 2 THEN event_id % 60 - 5 END AS page_current,
  CASE WHEN event_id % 10 = 3 OR event_id % 10 = 6 THEN 'page ' || (event_id % 30) END AS preview FROM events""",
    "assertions": """SELECT event_id AS id, event_id % 2600 AS proposition_id, 'agent ' || user_id AS agent, event_type AS modality, CASE event_id % 4 WHEN 0 THEN event_id * 8 + 1 WHEN 1 THEN event_id % 700 * 8 + 2 END AS evidence_id FROM events""",
    "arrivals": """SELECT doc_id AS ord, CASE WHEN doc_id % 53 = 0 THEN NULL WHEN doc_id % 47 = 0 THEN '' ELSE text END AS body, 'report_' || doc_id || '.pdf' AS filename,
  CASE doc_id % 5 WHEN 0 THEN ' <https://a.org/' || (doc_id % 7) || '> ' WHEN 1 THEN NULL WHEN 2 THEN 'ftp://x' ELSE 'https://a.org/' || (doc_id % 3) || ';' END AS u1,
  CASE WHEN doc_id % 3 = 0 THEN 'https://b.org/' || doc_id WHEN doc_id % 3 = 1 THEN 'https://a.org/1' END AS u2 FROM documents""",
    "registered": """SELECT text, min(doc_id) + 1000000 AS id, CASE WHEN min(doc_id) % 2 = 0 THEN 'Kept ' || min(doc_id) END AS title, 'https://old.org/' || min(doc_id) AS url FROM documents WHERE doc_id % 10 = 3 GROUP BY text""",
    "propositions": "SELECT p_partkey AS id, CASE WHEN p_partkey % 20 = 0 THEN ' ' ELSE p_name END AS text FROM part",
    "relations": """SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS source_id, l_suppkey AS target_id,
  CASE l_linenumber % 5 WHEN 0 THEN 'supports' WHEN 1 THEN 'rebuts' WHEN 2 THEN 'undercuts' WHEN 3 THEN 'qualifies' ELSE 'mentions' END AS kind FROM lineitem""",
    "values_": """SELECT o_orderkey AS id, CASE o_orderkey % 12 WHEN 0 THEN '(3.4)' WHEN 1 THEN '£' || (o_orderkey % 99) || '.4m' WHEN 2 THEN '1,' || (100 + o_orderkey % 800) WHEN 3 THEN '-5' WHEN 4 THEN '(-5)'
  WHEN 5 THEN '12%' WHEN 6 THEN '' WHEN 7 THEN NULL WHEN 8 THEN ' $7.25 ' WHEN 9 THEN '€4' WHEN 10 THEN 'n/a' ELSE (o_orderkey || '') END AS raw FROM orders""",
    "notes": """SELECT o_orderkey AS id, 'FY' || (1990 + o_orderkey % 30) || ' revenue was £' || (o_orderkey % 900 + 100) || ',' || (o_orderkey % 900 + 100) || '.26 on 199' || (o_orderkey % 10) || '-10-03 [' || (o_orderkey % 20) || '] (Smith, 19' || (o_orderkey % 90 + 10)
  || '). Cash flow and net Income rose! See https://example.org/o/' || o_orderkey || '. and 10.1234/ab.' || o_orderkey || ', or http://b.net/' || (o_orderkey % 3) || ' too' AS text FROM orders""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _needed(body: str, known: set[str]) -> list[str]:
    return [n for n in FRAMES if n not in known and re.search(rf"\b{n}\b", body)]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a table of the folder as a DataFrame; nothing is registered in the catalogue."""
    if name not in FRAMES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = FRAMES[name].replace("VARCHAR(20)", "STRING")
    used = [t for t in [*TABLES, *FRAMES] if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    args = {}
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        args[t] = frame(spark, sf_dir, t)
    return spark.sql(sql, **args) if args else spark.sql(sql)


def with_frames(body: str) -> str:
    """DuckDB SQL: ``body`` with the views that it names before it."""
    chosen: list[str] = []
    todo = _needed(body, set())
    while todo:
        n = todo.pop()
        if n not in chosen:
            chosen.append(n)
            todo += _needed(re.sub(r"'[^']*'", "", FRAMES[n]), {n})
    ordered = [n for n in FRAMES if n in chosen]
    body = body.strip()
    if not ordered:
        return body
    views = ", ".join(f"{n} AS ({FRAMES[n]})" for n in ordered)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views}, {body[15:]}"
    return f"WITH {views}" + (", " + body[5:] if body[:5].upper() == "WITH " else " " + body)
