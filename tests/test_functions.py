from __future__ import annotations

import io
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from evidara.functions import scalar as S
from evidara.operators import segments as G
from evidara.operators.bands import nearest_interval
from evidara.sources import claims as C
from evidara.sources import markup as M
from evidara.streaming import windows as W


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ("string",) * 9))) if values else spark.range(1)
    return df.select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("raw, value", [("(3.4)", -3.4), ("£3.4m", 3.4), ("1,234", 1234), ("-5", -5), ("(-5)", 5), ("12%", None), ("", None), (None, None), ("€4", None)])
def test_numbers(spark, raw, value):
    assert one(spark, S.parse_numeric(F.lit(raw).cast("string"))) == value


def test_identities(spark):
    assert one(spark, S.cite_id(F.lit("tracekey"))) == "cFZ8"
    assert one(spark, S.uuid5_url(F.lit("hello"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "hello"))
    assert one(spark, S.cite_id(F.lit("tracekey"), 1)) != "cFZ8"


def test_titles(spark):
    lit = F.lit
    assert one(spark, S.human_title(lit("annual-report_2023.pdf"), lit("https://www.some-board.org/x"), lit("Annual report for 2023/24"), lit("id"))) == "Some Board - Annual Report - 2023/24"
    assert one(spark, S.human_title(lit("3f95fe1e-0b7c-4c55-9d5e-aaaaaaaaaaaa.pdf"), lit(None).cast("string"), lit(""), lit("3f95fe1e-0b7c"))) == "Document 3f95fe1e"


def test_windows_of_sentences(spark):
    # Fixed cases: the survey's two lists of sentences and their windows.
    spans = [(0, 400), (401, 800), (801, 1000), (1001, 1500), (1501, 2900), (2901, 3000)]
    assert G.greedy_windows(spans, 1100, 180) == [(0, 1000), (401, 1500), (801, 1500), (1001, 1500), (1501, 2900), (2901, 3000)]
    spans = [(0, 100), (101, 200), (201, 1000), (1001, 1050), (1051, 1090), (1091, 2000), (2001, 2100)]
    assert G.greedy_windows(spans, 1100, 180) == [(0, 1090), (1091, 2100)]
    assert [a for a, _ in G.greedy_windows([(i * 200, i * 200 + 199) for i in range(12)], 1100, 180)] == [0, 200, 400, 600, 800, 1000, 1200, 1400]
    assert G.fixed_windows(0, 2500, 1100, 180) == [(0, 1100), (920, 2020), (1840, 2500)] == [tuple(w) for w in one(spark, G.split_windows(F.lit(2500), 1100, 180))]
    assert G.greedy_windows([], 1100, 180) == [] and G.fixed_windows(5, 9, 300, 0) == [(5, 9)]


def test_offsets_are_code_points(spark):
    got = one(spark, G.matches(F.lit("a😀 12345 é 67890"), r"\d{4,}"))
    assert [tuple(m) for m in got] == [(3, 8, "12345"), (11, 16, "67890")]


def test_nearest_interval_against_brute_force(spark):
    points = [(d, s, s + 3) for d in (1, 2) for s in range(0, 60, 7)]
    spans = [(1, 5, 9, 1), (1, 20, 40, 2), (1, 30, 33, 3), (2, 50, 55, 4), (2, 2, 4, 5)]
    p = spark.createDataFrame(points, "d long, start long, end long")
    i = spark.createDataFrame(spans, "d long, s long, e long, page long")
    got = {(r["d"], r["start"]): r["page"] for r in nearest_interval(p, i, "d", cell=8).collect()}

    def best(d, a, b):
        own = [x for x in spans if x[0] == d]
        mid = lambda x: abs(x[1] + x[2] - a - b)
        over = [x for x in own if x[1] < b and x[2] > a]
        if over:
            return min(over, key=lambda x: (x[2] - x[1], mid(x), x))[3]
        return min(own, key=lambda x: (max(a - x[2], x[1] - b), mid(x), x))[3]

    assert got == {(d, a): best(d, a, b) for d, a, b in points}


def test_markup():
    text, tables = M.html("<h1>Report</h1><p>x  y</p><table><tr><th>Metric</th><th>Value</th></tr><tr><td></td><td></td></tr><tr><td>Cash</td><td>5631</td></tr></table>")
    assert text.startswith("Report\nx y") and tables == [[["Metric", "Value"], ["Cash", "5631"]]]
    assert M.markdown("| a | b |\n|---|---:|\n| 1 | 2 |\n\nx")[1] == [[["a", "b"], ["1", "2"]]]
    assert M.delimiter("a;b;c\n1;2;3\n") == ";" and M.a1("AB12") == 27
    assert M.csv_text("a,b\n1,2\n")[0] == "a | b\n1 | 2"
    assert M.canonical_urls('<link rel="canonical" href="https://a.org/x"><meta property="og:url" content="https://a.org/x"><base href="/no">') == ["https://a.org/x"]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Metric</t></si><si><t>Cash</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="B2"><v>5631</v></c></row></sheetData></worksheet>')
    assert M.xlsx(buf.getvalue())[1] == [[["Metric", "Cash"], ["", "5631"]]]


def test_broken_files_are_rows(spark):
    df = spark.createDataFrame([("xml", b"<a><b>x</b></a>"), ("xml", b"<a"), ("none", b""), ("html", None)], "kind string, content binary")
    got = [r["p"] for r in df.select(M.parse("kind", "content").alias("p")).collect()]
    assert got[0]["text"] == "x" and got[1]["error"].startswith("ParseError") and got[2]["error"] == got[3]["error"] == "unsupported"


def test_claim_sources(spark):
    lines = spark.createDataFrame([("- A claim [@Ab12]",), ("- plain",), ("no item",), ("- ",)], "value string")
    assert [tuple(r) for r in C.claims_markdown(lines).collect()] == [("A claim", "Ab12"), ("plain", None)]
    entries = list(C.bib_entries('@Book{k1, title={A {B} c}, Year = 1999, note="x, y"} @misc{k2,}'))
    assert [e[:3] for e in entries] == [("book", "k1", {"title": "A {B} c", "year": "1999", "note": "x, y"}), ("misc", "k2", {})]
    for bad in ("@a{k, x={1}", "@a{k}", "@a{ , x=1}"):
        with pytest.raises(ValueError):
            list(C.bib_entries(bad))


def test_streaming_activity(spark, tmp_path):
    kind = "ts timestamp, event_type string"
    spark.sql("SELECT timestamp'2024-01-01 01:00:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp'2024-01-01 02:00:00', 'a' UNION ALL SELECT timestamp'2024-01-05 00:00:00', 'b'").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = W.activity(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("activity_out").start()
    q.processAllAvailable()
    q.stop()
    assert [(str(r["start"])[:10], r["event_type"], r["n"]) for r in spark.table("activity_out").collect()] == [("2024-01-01", "a", 2)]


def test_points_without_overlap_are_looked_up_in_one_pass(spark):
    from tests.shuffles import shuffled_rows

    p = spark.range(2000).selectExpr("id % 9 AS d", "id * 10 AS start", "id * 10 + 5 AS end")
    i = spark.range(100).selectExpr("id % 8 AS d", "id * 200 + 6 AS s", "id * 200 + 9 AS e", "id AS page")
    found = nearest_interval(p, i, "d")
    assert found.count() == 2000 and found.filter("page IS NULL").count() == 222  # one group has no interval
    # By cells, as they are, and once by group: some 4100 rows, 6200 with a window for each side.
    rows = shuffled_rows(found)
    assert rows < 5000
