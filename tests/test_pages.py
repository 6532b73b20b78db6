"""Pages, paragraphs, digests and repaired tables against plain loops."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from evidara.operators import pages as P
from evidara.operators import segments as G
from evidara.operators import tables as T


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "bc. ", "\n", "\n\n", " ", "\n \n", "é", "\t"]) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_paragraphs_are_those_of_the_pattern():
    fixed = re.compile(r"\S(?:.*?\S)?(?:(?=\n\s*\n)|\Z)", re.DOTALL)
    for t in [*texts(3000), "", " ", "one", "a \n\nb", "a\n\nb ", "\n\na\n \n\nb\n", "a\n\n\n\nb c\n\n"]:
        assert G.scan_paragraphs(t) == [m.span() for m in fixed.finditer(t)], repr(t)
    long = "word " * 300_000 + "\n"
    assert G.scan_paragraphs(long) == [] and G.scan_paragraphs(long + "\nx") == [(0, len(long) + 2)]


def test_rebased_spans_cut_the_same_text(spark):
    rng = random.Random(4)
    pages = [(d, p, t) for d in range(5) for p, t in zip(sorted(rng.sample(range(1, 90), 30)), texts(30, d))] + [(9, 1, None), (9, 2, "x"), (9, 5, ""), (9, 7, "end")]
    df = spark.createDataFrame(pages, "doc int, page int, text string").repartition(4)
    whole = {}
    for d, p, t in sorted(pages, key=lambda r: r[:2]):
        whole.setdefault(d, []).append((p, t or ""))
    merged = {d: "\n\n".join(t for _, t in ps) for d, ps in whole.items()}
    assert {r["doc"]: r["text"] for r in P.merged(df, "doc", "page").collect()} == merged
    spans = [(d, p, a, b) for d, p, t in pages for a, b in ((0, len(t or "")), (-3, 2), (1, 10**6), (2, 1))]
    of = {(d, p): t or "" for d, p, t in pages}
    order = {d: [p for p, _ in ps] for d, ps in whole.items()}
    saved, P.BLOCK = P.BLOCK, 8
    try:
        got = P.rebased(spark.createDataFrame([*spans, (5, 1, 0, 1)], "doc int, page int, start int, end int"), df, "doc", "page").collect()
    finally:
        P.BLOCK = saved
    assert len(got) == len(spans)
    cut = sorted((r["doc"], r["page"], r["page_index"], merged[r["doc"]][r["start"] : r["end"]]) for r in got)
    want = sorted((d, p, order[d].index(p), of[d, p][max(0, a) : max(0, a, b)]) for d, p, a, b in spans)
    assert cut == want
    assert P.placed(df.limit(0), "doc", "page").count() == 0


def test_running_totals_by_blocks(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.randrange(100)) for k in "ab" for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    for block in (1, 7, 1024):
        got = {(r["k"], r["at"]): r["t"] for r in P.running_total(df, "k", "at", F.col("v"), "t", block).collect()}
        assert got == {(k, i): sum(v for q, j, v in rows if q == k and j < i) for k, i, _ in rows}


def test_digests_know_rows_but_no_order(spark):
    runs = spark.range(4)
    text = spark.createDataFrame([(0, "t"), (1, "t"), (2, "u")], "id long, text string")
    rows = [(0, "a", 1), (0, "b", None), (0, "b", None), (1, "b", None), (1, "a", 1), (1, "b", None), (2, "a", 1)]
    part = spark.createDataFrame(rows, "id long, x string, n int")
    digest = lambda p, **more: {r["id"]: r["digest"] for r in P.payload_digest(runs, "id", text, part=p, **more).collect()}
    first = digest(part)
    assert first == digest(part.repartition(7).orderBy(F.rand(3))) and first[0] == first[1] != first[2] and len(set(first.values())) == 3
    assert digest(part.filter("x = 'a'"))[0] != first[0] and digest(part.distinct())[0] != first[0]
    assert digest(part.withColumn("x", F.concat("x", F.lit("\u0001"))))[0] != first[0]
    none = P.incomplete(spark.range(5), spark.createDataFrame([(0, "Success"), (1, "failed"), (2, "success"), (3, "success")], "id long, status string"),
                        spark.createDataFrame([(0, 5), (1, 5), (3, 5)], "id long, n_chars int"), spark.createDataFrame([(0, 1), (0, 2)], "id long, k int"))
    assert {r["id"]: r["reason"] for r in none.collect()} == {0: None, 1: "run_status=failed", 2: "document_text_missing", 3: "segments_missing_for_nonempty_text", 4: "run_missing"}


def test_tables_from_serialised_cells(spark):
    rng = random.Random(8)
    made, raws = {}, []
    for t in range(25):
        cells = []
        for _ in range(rng.randrange(1, 9)):
            a, x = rng.randrange(5), rng.randrange(4)
            text = rng.choice(["", " ", "it's", "a, b) text='x", "two\nlines", "v%d" % rng.randrange(9)])
            cells.append((a, a + rng.randrange(4), x, x + rng.randrange(3), text, [rng.randrange(-9, 90), rng.randrange(90) + 0.5, rng.randrange(90), rng.randrange(90)]))
        made[t] = cells
        raws.append((t, "[" + ", ".join(
            "TableCell(bbox=BoundingBox(l=%s, t=%s, r=%s, b=%s, coord_origin=<C.T: 'T'>), row_span=1, start_row_offset_%s=%d, end_row_offset_idx=%d, start_col_offset_idx=%d, end_col_offset_index=%d, text='%s', column_header=True, row_header=false)"
            % (*box, rng.choice(("idx", "index")), a, b, x, y, text.replace("'", "\\'")) for a, b, x, y, text, box in cells) + "]"))
    raws += [(98, "TableCell(bbox=None, text='no box', column_header=True"), (99, None)]
    cells = T.serialised_cells(spark.createDataFrame(raws, "table_id int, raw string"))
    said = spark.createDataFrame([(3, 12, None), (4, None, 7), (5, 1, 1)], "table_id int, num_rows int, num_cols int")
    size = T.sizes(cells, said)
    grid = T.filled(cells, size)
    got = {(r["table_id"], r["row_index"], r["col_index"]): r["value"] for r in T.repaired_cells(grid).collect()}
    heads = {r["table_id"]: (r["col_headers"], r["row_headers"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in T.repaired_headers(cells, size, grid).collect()}
    want, tops = {}, {}
    for t, cs in made.items():
        n, m = max(max(x[1] for x in cs), 12 * (t == 3)), max(max(x[3] for x in cs), 7 * (t == 4))
        if not n or not m:
            continue
        g = [[""] * m for _ in range(n)]
        for a, b, x, y, text, _ in cs:
            if text.strip(" "):
                a0, x0 = max(0, min(n - 1, a)), max(0, min(m - 1, x))
                for i in range(a0, max(a0 + 1, min(n, b))):
                    for j in range(x0, max(x0 + 1, min(m, y))):
                        g[i][j] = g[i][j] or text.strip(" ")
        body = {(t, i - 1, j): g[i][j] for i in range(1, n) for j in range(m) if g[i][j]}
        want |= body
        if body:
            boxes = [x[5] for x in cs]
            tops[t] = ([v or f"C{j + 1}" for j, v in enumerate(g[0])], [g[i][0] or f"R{i}" for i in range(1, n)], *[f(b[k] for b in boxes) for f, k in ((min, 0), (min, 1), (max, 2), (max, 3))])
    assert got == want and heads == tops and len(tops) > 10
