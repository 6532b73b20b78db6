"""Queries of segments, annotations, chunks, tables and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidara.functions import scalar as S
from evidara.operators import pages as P
from evidara.operators import segments as G
from evidara.operators import tables as T
from evidara.plans.registry import query
from evidara.sources import markup as M

c = F.col


def _one(name: str, category: str):
    """The annotations of one category with their places; in SQL a label's place is the length of what stands before it."""
    pattern = next(p for n, _, p, _ in G.PATTERNS if n == category)
    sql = f"""SELECT id, labels[i] AS label, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(labels[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT id, labels, gaps, unnest(range(1, len(labels) + 1)) AS i FROM (SELECT id, regexp_extract_all(text, '{pattern}') AS labels, string_split_regex(text, '{pattern}') AS gaps FROM notes))"""

    @query(name, "notes", sql=sql)
    def run(t):
        return G.annotations(t, "id", category=category).select("id", "label", c("start").cast("long").alias("start"))


_one("TXT-05_currency", "currency")
_one("TXT-06_quantity", "quantity")
_one("TXT-07_date", "date")
_one("TXT-08_citation", "citation-marker")
_one("TXT-09_period", "period")


@query("TXT-10_terms", "notes", sql=f"SELECT id, lower(unnest(regexp_extract_all(text, '(?i)\\b' || term || '\\b'))) AS label FROM notes, (SELECT unnest({list(G.TERMS)}) AS term)")
def terms(t):
    return G.annotations(t, "id", category="metric").select("id", F.lower("label").alias("label"))


@query("TXT-11_offsets", "notes", sql="SELECT id, 'provenance' AS layer, 0 AS start, length(text) AS stop, sha256(text) AS digest, 1.0::DOUBLE AS confidence FROM notes")
def offsets(t):
    """The annotation that spans the whole text, with the digest of what its offsets give."""
    whole = t.select("id", "text", F.lit("provenance").alias("layer"), F.lit(0).alias("start"), F.length("text").cast("long").alias("stop"))
    return whole.select("id", "layer", "start", "stop", F.sha2(F.expr("substring(text, start + 1, CAST(stop - start AS INT))"), 256).alias("digest"), F.lit(1.0).alias("confidence"))


@query("TXT-01_sentences", "documents", sql=r"""SELECT doc_id, len(s) AS n, list_sum(list_transform(s, lambda x: length(x))) AS chars FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+|$)'), lambda s: trim(s) <> '') AS s FROM documents) WHERE len(s) > 0""")
def sentences(d):
    return G.sentences(d, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(c("end") - c("start")).alias("chars"))


@query("TXT-03_paragraphs", "documents", sql=r"SELECT doc_id, len(list_filter(string_split_regex(text, '\n\s*\n+'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g')) <> '')) AS n FROM documents")
def paragraphs(d):
    return d.select("doc_id", S.paragraph_count(c("text")).alias("n"))


#: Layout blocks in DuckDB, from a table p (k, text): pieces between empty lines belong together up to one that ends in a character that isn't blank. (Paragraphs of one character, which the tables lack, would go on.)
BLOCKS = r"""cut AS (SELECT k, string_split_regex(text, '\n\s*\n') AS ps, list_prepend('', regexp_extract_all(text, '\n\s*\n')) AS gs FROM p WHERE length(text) > 0),
  pieces AS (SELECT k, i, ps[i] AS piece, sum(length(ps[i]) + length(gs[i])) OVER w AS stop, coalesce(sum(CASE WHEN regexp_matches(ps[i], '\S$') THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp
    FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM cut) WINDOW w AS (PARTITION BY k ORDER BY i)),
  blocks AS (SELECT k, 'paragraph' AS kind, grp AS order_index, min(stop - length(regexp_replace(piece, '^\s+', ''))) FILTER (piece <> '' AND NOT regexp_full_match(piece, '\s*')) AS start, max(stop) AS stop
    FROM pieces GROUP BY k, grp HAVING bool_or(regexp_matches(piece, '\S$'))
    UNION ALL SELECT k, 'document', NULL, 0, length(text) FROM p WHERE length(text) > 0)"""


@query("TXT-03_layout_blocks", "documents", sql=f"""WITH p AS (SELECT doc_id AS k, text FROM documents), {BLOCKS} SELECT k AS doc_id, kind, order_index, start, stop FROM blocks""")
def layout_blocks(d):
    return G.layout_blocks(d, "doc_id").withColumnRenamed("end", "stop")


@query("TXT-12_page_merge", "conversations", sql="SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS pages FROM conversations GROUP BY conv_id")
def page_merge(t):
    return P.merged(t, "conv_id", "turn")


# The SQL cuts the spans from the merged text, the query from each page: they agree if the spans are rebased rightly.
@query("TXT-12_rebased_spans", "conversations", sql=f"""WITH p AS (SELECT (conv_id, turn) AS k, text FROM conversations), {BLOCKS},
  whole AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
  pages AS (SELECT conv_id, turn, row_number() OVER w - 1 AS page_index, coalesce(sum(coalesce(length(text), 0) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, page_index, kind, CAST(off + start AS BIGINT) AS start, CAST(off + stop AS BIGINT) AS stop, md5(substring(whole.text, CAST(off + start + 1 AS BIGINT), CAST(stop - start AS BIGINT))) AS cut
  FROM blocks JOIN pages ON k = (conv_id, turn) JOIN whole USING (conv_id)""")  # fmt: skip
def rebased_spans(t):
    blocks = G.layout_blocks(t, "conv_id", "turn").join(t.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    blocks = blocks.withColumn("cut", F.md5(F.substring("text", c("start") + 1, c("end") - c("start")))).drop("text")
    return P.rebased(blocks, t, "conv_id", "turn").select("conv_id", "page_index", "kind", c("start").cast("long").alias("start"), c("end").cast("long").alias("stop"), "cut")


# Runs 5, 10, ... are asked for under ids that no run has; texts and segments of some runs are away.
@query("TXT-13_incomplete", "runs", "notes", sql=r"""SELECT w.id, CASE WHEN r.id IS NULL THEN 'run_missing' WHEN lower(r.status) <> 'success' THEN 'run_status=' || r.status WHEN t.id IS NULL THEN 'document_text_missing'
  WHEN length(t.text) > 0 AND w.id % 7 = 0 THEN 'segments_missing_for_nonempty_text' END AS reason
  FROM (SELECT CASE WHEN id % 5 = 0 THEN -id ELSE id END AS id FROM runs) w LEFT JOIN runs r USING (id) LEFT JOIN (SELECT * FROM notes WHERE id % 4 <> 0) t USING (id)""")  # fmt: skip
def incomplete(r, t):
    wanted = r.select(F.when(c("id") % 5 == 0, -c("id")).otherwise(c("id")).alias("id"))
    segments = G.sentences(t.filter("id % 7 <> 0"), "id")
    return P.incomplete(wanted, r, t.filter("id % 4 <> 0").select("id", F.length("text").alias("n_chars")), segments)


CURRENCY = next(p for n, _, p, _ in G.PATTERNS if n == "currency")


def _sums(rows: str, *fields: str) -> str:
    """In DuckDB, count and sums of the hashes of rows by id."""
    line = " || chr(1) || ".join(f"coalesce(CAST({f} AS VARCHAR), chr(2))" for f in fields)
    part = lambda i: f"CAST(sum(CAST('0x' || substr(h, {i}, 15) AS HUGEINT)) AS VARCHAR)"
    return f"SELECT id, count(*) || ':' || {part(1)} || ':' || {part(16)} AS d FROM (SELECT id, sha256({line}) AS h FROM ({rows})) GROUP BY id"


@query("TXT-13_digest", "runs", "notes", "grid", sql=rf"""WITH cells AS ({_sums("SELECT table_id AS id, * FROM grid", "row_index", "col_index", "value")}),
  m AS (SELECT id, regexp_extract_all(text, '{CURRENCY}') AS labels, string_split_regex(text, '{CURRENCY}') AS gaps FROM notes),
  a AS (SELECT id, labels[i] AS label, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(labels[1:i - 1], lambda x: length(x))), 0) AS start FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM m)),
  marks AS ({_sums("SELECT id, label, CAST(start AS BIGINT) AS start, CAST(start + length(label) AS BIGINT) AS stop FROM a", "start", "stop", "label")}),
  s AS (SELECT id, regexp_extract_all(text, '[^.!?
]+(?:[.!?]+|$)') AS ss FROM notes),
  segs AS ({_sums("SELECT id, i - 1 AS i, length(ss[i]) AS n FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM s)", "i", "n")})
  SELECT r.id, sha256(coalesce(sha256(n.text), '-') || '|' || coalesce(cells.d, '-') || '|' || coalesce(segs.d, '-') || '|' || coalesce(marks.d, '-')) AS digest
  FROM runs r LEFT JOIN notes n USING (id) LEFT JOIN cells USING (id) LEFT JOIN segs USING (id) LEFT JOIN marks USING (id)""")  # fmt: skip
def output_digest(r, t, g):
    t = M.dealt(t.select("id", "text"), "id")
    cells = g.select(c("table_id").alias("id"), "row_index", "col_index", "value")
    segments = G.sentences(t, "id").select("id", "order_index", (c("end") - c("start")).alias("n"))
    return P.payload_digest(r, "id", t, cells=cells, segments=segments, annotations=G.annotations(t, "id", category="currency").select("id", "start", "end", "label"))


#: Spans of sentences in DuckDB: a sentence's place is the length of what stands before it, sentences and gaps. A line break at the text's end belongs to none.
SENTENCES = r"""pieces AS (SELECT doc_id, regexp_extract_all(t, '[^.!?\n]+(?:[.!?]+|$)') AS labels, string_split_regex(t, '[^.!?\n]+(?:[.!?]+|$)') AS gaps, text
    FROM (SELECT doc_id, text, regexp_replace(text, '\n$', '') AS t FROM documents)),
  placed AS (SELECT doc_id, labels[i] AS label, sum(length(labels[i]) + length(gaps[i])) OVER (PARTITION BY doc_id ORDER BY i) AS stop
    FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM pieces)),
  spans AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY stop) AS k, CAST(stop - length(label) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop
    FROM placed WHERE regexp_matches(label, '[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'))"""


# The last sentence within 1100 of a start is a range lookup; the starts that are reached follow by recursion.
@query("VEC-01_sentence_windows", "documents", sql=f"""WITH RECURSIVE {SENTENCES},
  fits AS (SELECT a.doc_id, a.k, a.start, greatest(a.k, b.k) AS j FROM spans a ASOF LEFT JOIN (SELECT doc_id, k, stop - 1100 AS least FROM spans) b ON a.doc_id = b.doc_id AND a.start >= b.least),
  steps AS (SELECT f.doc_id, f.k, f.start, e.stop, CASE WHEN f.j > f.k AND e.stop - e.start >= 180 THEN f.k + 1 ELSE f.j + 1 END AS next, f.j < count(*) OVER (PARTITION BY f.doc_id) AS more
    FROM fits f JOIN spans e ON e.doc_id = f.doc_id AND e.k = f.j),
  reached AS (SELECT doc_id, k, start, stop, next, more FROM steps WHERE k = 1
    UNION ALL SELECT s.doc_id, s.k, s.start, s.stop, s.next, s.more FROM reached r JOIN steps s ON s.doc_id = r.doc_id AND s.k = r.next WHERE r.more),
  windows AS (SELECT doc_id, k, start, stop, 1540 AS most FROM reached
    UNION ALL SELECT doc_id, 1, 0, length(text), 1100 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM spans) AND text IS NOT NULL),
  parts AS (SELECT *, unnest(range(0, CASE WHEN stop - start <= most THEN 1 ELSE CAST(ceil((stop - start - 1100) / 920) AS BIGINT) + 1 END)) AS i FROM windows),
  chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS chunk, start + i * 920 AS start, CASE WHEN stop - start <= most THEN stop ELSE least(start + i * 920 + 1100, stop) END AS "end" FROM parts)
  SELECT c.* FROM chunks c JOIN documents d USING (doc_id) WHERE trim(substring(d.text, c.start + 1, c."end" - c.start), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''""")  # fmt: skip
def sentence_windows(d):
    return G.sentence_windows(d, "doc_id")


@query("VEC-02_fixed_windows", "documents", sql="SELECT doc_id, i * 920 AS start, least(i * 920 + 1100, n) AS stop FROM (SELECT doc_id, length(text) AS n, unnest(range(0, CAST(greatest(ceil((length(text) - 1100) / 920), 0) AS BIGINT) + 1)) AS i FROM documents)")
def fixed_windows(d):
    w = d.select("doc_id", F.explode(G.split_windows(F.length("text"), 1100, 180)).alias("w"))
    return w.select("doc_id", c("w.start").cast("long").alias("start"), c("w.end").cast("long").alias("stop"))


@query("VEC-03_max_windows", "documents", sql="""SELECT doc_id, CASE WHEN n > 1540 THEN i * 920 ELSE 0 END AS start, CASE WHEN n > 1540 THEN least(i * 920 + 1100, n) ELSE n END AS stop
FROM (SELECT doc_id, n, unnest(range(0, CASE WHEN n > 1540 THEN CAST(ceil((n - 1100) / 920) AS BIGINT) + 1 ELSE 1 END)) AS i FROM (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0))""")  # fmt: skip
def max_windows(d):
    """The hard maximum over the largest windows there are, whole texts."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))
    w = d.select("doc_id", F.explode(G.cap_windows(whole)).alias("w"))
    return w.select("doc_id", c("w.start").cast("long").alias("start"), c("w.end").cast("long").alias("stop"))


@query("VEC-04_row_chunks", "captions", "table_cells", sql=r"""WITH v AS (SELECT table_id, row_index, col_index, trim(value) AS value FROM table_cells WHERE trim(value) <> ''),
  lines AS (SELECT table_id, row_index, string_agg(coalesce(nullif(trim(CASE col_index WHEN 0 THEN h0 WHEN 1 THEN h1 END), ''), 'col_' || col_index) || ': ' || value, chr(10) ORDER BY col_index) AS body FROM v JOIN captions USING (table_id) GROUP BY table_id, row_index),
  lead AS (SELECT *, CASE WHEN caption <> '' THEN 'Table: ' || trim(caption) || chr(10) ELSE '' END || 'Table ID: ' || table_id || chr(10) AS head FROM captions),
  texts AS (SELECT table_id, row_index, 'table_row' AS kind, trim(head || CASE WHEN trim(CASE row_index WHEN 0 THEN r0 WHEN 1 THEN r1 END) <> '' THEN 'Row: ' || trim(CASE row_index WHEN 0 THEN r0 WHEN 1 THEN r1 END) || chr(10) ELSE '' END || body) AS t FROM lines JOIN lead USING (table_id)
    UNION ALL SELECT table_id, NULL, 'table_summary', trim(head || 'Columns: ' || array_to_string(list_filter([h0, h1], lambda x: trim(x) <> ''), ', ')) FROM lead WHERE table_id NOT IN (SELECT table_id FROM v)),
  parts AS (SELECT *, unnest(range(0, CASE WHEN length(t) > 1540 THEN CAST(ceil((length(t) - 1100) / 920) AS BIGINT) + 1 ELSE 1 END)) AS part FROM texts)
  SELECT table_id, row_index, kind, part, CASE WHEN length(t) > 1540 THEN trim(substring(t, part * 920 + 1, 1100)) ELSE t END AS text FROM parts""")  # fmt: skip
def row_chunks(t, cells):
    return T.row_chunks(t.select("table_id", "caption", F.array("h0", "h1").alias("col_headers"), F.array("r0", "r1").alias("row_headers")), cells)


@query("VEC-05_chunk_identity", "documents", sql="SELECT doc_id, 'sha256:' || sha256('{\"resource\":' || doc_id || ',\"text\":\"' || sha256(text) || '\"}') AS chunk_id FROM documents")
def chunk_identity(d):
    return d.select("doc_id", F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(c("doc_id").alias("resource"), F.sha2("text", 256).alias("text"))), 256)).alias("chunk_id"))


@query("VEC-07_top_k", "embeddings", sql="SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * 8.0) AS s FROM (SELECT *, list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS q FROM embeddings WHERE label = 3)) ORDER BY s DESC, vec_id LIMIT 10")
def vector_top_k(e):
    return G.top_k(e, [1.0 if i % 2 == 0 else -1.0 for i in range(64)], 10, label=3).select("vec_id", F.round("score", 6).alias("score"))


@query("VEC-08_dimensions", "embeddings", sql="SELECT len(embedding) AS dims, count(*) AS n FROM embeddings GROUP BY 1")
def dimensions(e):
    return e.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))


@query("TAB-06_cell_lookup", "lineitem", sql="SELECT l_suppkey, min_by(l_quantity, l_orderkey * 8 + l_linenumber) AS value FROM (SELECT l_suppkey, l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY ALL) GROUP BY l_suppkey")
def cell_lookup(l):
    """First row, in file order, that passes all filters."""
    l = l.filter((F.trim("l_returnflag") == "R") & (F.trim("l_linestatus") == "F"))
    return l.groupBy("l_suppkey").agg(F.min(F.struct((c("l_orderkey") * 8 + c("l_linenumber")).alias("at"), "l_quantity")).alias("m")).select("l_suppkey", c("m.l_quantity").alias("value"))


#: Dots an inch that an image is cut down to.
MOST_DPI = 140.0


@query("SRC-26_image_rules", "images", sql="""WITH i AS (SELECT *, width * height / (595.0::DOUBLE * 842) AS ratio, width * 25.4::DOUBLE / 72 >= 20 AND height * 25.4::DOUBLE / 72 >= 20 AS large FROM images),
  v AS (SELECT *, CASE WHEN NOT large THEN 'too_small' WHEN ratio <= 0.02 THEN 'too_little_of_page' WHEN ratio > 0.9 OR ratio > 0.65 AND page_text < 50 THEN 'page_scan' END AS skipped, source_width / width * 72 > 140 OR source_height / height * 72 > 140 AS dense FROM i)
  SELECT doc, n, part, supp, skipped, CASE WHEN skipped IS NULL THEN CASE WHEN dense THEN greatest(1, CAST(round_even(width / 72 * 140, 0) AS BIGINT)) ELSE source_width END END AS out_width,
  CASE WHEN skipped IS NULL THEN CASE WHEN dense THEN greatest(1, CAST(round_even(height / 72 * 140, 0) AS BIGINT)) ELSE source_height END END AS out_height FROM v""")  # fmt: skip
def image_rules(i):
    """Why an image isn't taken, or the size in pixels that it is stored in."""
    ratio, mm = c("width") * c("height") / (595.0 * 842), lambda x: c(x) * 25.4 / 72
    skipped = (
        F.when((mm("width") < 20) | (mm("height") < 20), "too_small").when(ratio <= 0.02, "too_little_of_page")
        .when((ratio > 0.90) | ((ratio > 0.65) & (c("page_text") < 50)), "page_scan")
    )
    dense = (c("source_width") / c("width") * 72 > MOST_DPI) | (c("source_height") / c("height") * 72 > MOST_DPI)
    pixels = lambda side: F.when(skipped.isNull(), F.when(dense, F.greatest(F.lit(1).cast("long"), F.bround(c(side) / 72 * MOST_DPI).cast("long"))).otherwise(c(f"source_{side}")))
    return i.select("doc", "n", "part", "supp", skipped.alias("skipped"), pixels("width").alias("out_width"), pixels("height").alias("out_height"))
