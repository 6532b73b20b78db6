"""Files on disk: scans, claim files, structured tables, archives and batches that are resumed."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from evidara.operators.citations import import_summary
from evidara.operators.integrity import archive_issues
from evidara.plans import registry
from evidara.sources import markup as M
from evidara.sources.claims import claims_csv, claims_json, csv_rows
from evidara.sources.sheets import sheet_profiles, table_rows
from evidara.streaming.resume import append, ingest

registry.load()


def zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook(*sheets: str) -> bytes:
    names = "".join(f'<sheet name="S{i}" r:id="r{i}"/>' for i in range(len(sheets)))
    targets = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
    parts = {f"xl/worksheets/s{i}.xml": s for i, s in enumerate(sheets)}
    return zipped({"xl/workbook.xml": f'<w xmlns:r="r">{names}</w>', "xl/_rels/workbook.xml.rels": f"<R>{targets}</R>", **parts})


def test_scan_takes_known_suffixes_below_the_folder(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("x.PDF", "a/y.md", "a/b/z.epub", "a/b/no.exe", "none"):
        (tmp_path / name).write_text("t")
    found = M.files(spark, str(tmp_path)).select("path", "suffix").collect()
    assert sorted((r["path"].rpartition("/")[2], r["suffix"]) for r in found) == [("x.PDF", ".pdf"), ("y.md", ".md"), ("z.epub", ".epub")]


def test_claim_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text(' claim_type ,narrative_text\n narrative ,"two\nlines, ""quoted"""\nquantitative,\n')
    rows = claims_csv(spark, str(tmp_path / "c.csv")).collect()
    assert [tuple(r) for r in rows] == [("narrative", 'two\nlines, "quoted"'), ("quantitative", "")]
    texts = ['a , b\r\n 1 ,"x\n""y"" "\r\n\r\n2\r\n3,4,5', "a,b", "", None]
    found = spark.createDataFrame(list(enumerate(texts)), "id int, value string").select("id", csv_rows("value").alias("r")).collect()
    assert {r["id"]: r["r"] for r in found} == {0: [{"a": "1", "b": 'x\n"y"'}, {"a": "2", "b": ""}, {"a": "3", "b": "4"}], 1: [], 2: [], 3: []}
    texts = ['[{"t":"a"},{"t":"b"}]', ' {"claims":[{"t":"c"}]}', "[]", "{bad", '{"other":1}', "[1", None]
    got = claims_json(spark.createDataFrame(list(enumerate(texts)), "id int, value string"), "t string").collect()
    assert sorted((r["id"], r["t"], r["error"] is not None) for r in got if r["t"]) == [(0, "a", False), (0, "b", False), (1, "c", False)]
    assert sorted(r["id"] for r in got if r["error"]) == [3, 4, 5, 6]


def test_parsers_of_packages():
    t = "<w:r><w:t>{}</w:t></w:r>"
    body = f'<d xmlns:w="w"><w:p>{t.format("Hel")}{t.format("lo")}</w:p><w:tbl><w:tr><w:tc><w:p>{t.format("x")}</w:p></w:tc></w:tr><w:tr><w:tc/></w:tr></w:tbl></d>'
    assert M.docx(zipped({"word/document.xml": body})) == ("Hel lo\nx", [[["x"]]])
    slides = {f"ppt/slides/slide{n}.xml": f"<s><t>{n}</t><t> </t></s>" for n in (2, 10, 1)}
    assert M.pptx(zipped(slides)) == ("1\n\n10\n\n2", [])
    assert M.bundle(zipped({"b.xml": "<a>", "c.xml": "<a>c <b>d</b></a>", "a.htm": "<p>e", "d.txt": "f"})) == ("e\n\nc d", [])
    sheet = '<s><row r="3"><c r="C3"><v>q</v></c></row><row r="1"><c r="A1"><v>p</v></c></row></s>'
    assert M.xlsx(zipped({"xl/worksheets/s.xml": sheet}))[1] == [[["p", "", ""], ["", "", "q"]]]


def test_tables_of_odd_files(spark):
    sheet = '<s><row><c r="A1"><v>a</v></c><c r="B1"><v>A</v></c><c r="C1"><v>a_2</v></c></row>' + "<row><c><v>1</v></c><c><v>1</v></c></row>" * 3 + "<row><c><v> </v></c></row></s>"
    files = [
        (1, "xlsx", workbook(sheet, "<s/>", "<s><row r='7'/></s>")), (2, "xlsx", b"no zip"), (3, "csv", None), (4, "ods", b""), (5, "csv", b""), (6, "csv", "a|b\r\n1|\"x\n|y\"\r\n".encode("utf-8-sig")),
        (7, "xlsx", zipped({"xl/other.xml": "<a/>"})), (None, "csv", b"k,v\n\xff,2\n"),
    ]
    rows = table_rows(spark.createDataFrame(files, "id long, format string, content binary"), batch=2).cache()
    assert {r["id"] for r in rows.filter("error IS NOT NULL").collect()} == {2, 3, 4}
    cells = {(r["id"], r["row"]): r["cells"] for r in rows.filter("seq > 0").collect()}
    assert cells[6, 1] == {1: "a", 2: "b"} and cells[6, 2] == {1: "1", 2: "x\n|y"} and cells[None, 2] == {1: "�", 2: "2"}
    p = {r["sheet"]: r for r in sheet_profiles(rows.filter("id = 1"), samples=2).collect()}
    assert p["S0"]["columns"] == ["a", "A_2", "a_2"] and (p["S0"]["header"], p["S0"]["observed"], p["S0"]["truncated"]) == (0, 3, False)
    assert p["S0"]["sampled"] == [{"a": "1", "A_2": "1", "a_2": ""}] * 2
    assert (p["S1"]["header"], p["S1"]["columns"], p["S1"]["observed"]) == (None, [], 0)
    assert (p["S2"]["header"], p["S2"]["columns"], p["S2"]["observed"]) == (6, [], 0)
    assert {r["truncated"] for r in sheet_profiles(rows.filter("id = 1 AND sheet = 'S0'"), max_rows=5).collect()} == {True}
    assert not sheet_profiles(rows.limit(0)).collect()


def test_plain_packages_are_read_and_written_without_zipfile(monkeypatch):
    """Rows and faults are those of ``zipfile``, also of packages with changed, lost and added bytes."""
    import random

    from evidara.sources import sheets as S

    sheet = "<s>" + "".join(f'<row><c r="B1" t="s"><v>0</v></c><c><v>{k} é</v></c></row>' for k in range(9)) + "</s>"
    members = {
        "xl/workbook.xml": '<w xmlns:r="r"><sheets><sheet name="A" r:id="a"/></sheets></w>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="a" Target="worksheets/s.xml"/></R>',
        "xl/sharedStrings.xml": "<t><si><t>one</t></si></t>", "xl/worksheets/s.xml": sheet,
    }

    def made(names, texts, kind) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", kind) as z:
            for name, text in zip(names, texts):
                info = zipfile.ZipInfo(name)
                info.compress_type = kind
                z.writestr(info, text)
        return out.getvalue()

    stored, packed = (made(members, members.values(), k) for k in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED))
    for names, texts in ((list(members), list(members.values())), ([], []), (["d/", "é"], ["", "x"]), (["a"], ["ü" * 9000])):
        assert S.zipped(names, texts) == made(names, texts, zipfile.ZIP_STORED)

    class Plain(S.Package):
        """All through zipfile."""

        _directory = staticmethod(lambda data: None)

    def rows(data, kind):
        monkeypatch.setattr(S, "Package", kind)
        try:
            return list(S.workbook_rows(data))
        except Exception as e:  # noqa: BLE001
            return f"{type(e).__name__}: {e}"

    rng, fast, faults = random.Random(7), S.Package, 0
    for k in range(1500):
        data = bytearray(rng.choice((stored, packed)))
        at = rng.randrange(len(data))
        match k % 4:
            case 0 | 1:
                data[at] = rng.randrange(256)
            case 2:
                del data[at : at + rng.randrange(1, 9)]
            case 3:
                data[at:at] = bytes(rng.randrange(1, 9))
        want = rows(bytes(data), Plain)
        assert rows(bytes(data), fast) == want
        faults += isinstance(want, str)
    assert 500 < faults < 1500
    monkeypatch.setattr(S.Package, "zip", None)
    assert rows(stored, fast) == rows(packed, fast) == [(0, "A", 0, None, None), *[(0, "A", n, n, {2: f"{n - 1} é"}) for n in range(1, 10)]]


def test_archive_on_disk(spark, tmp_path):
    for name in ("good", "changed"):
        (tmp_path / f"{name}.txt").write_text(name)
    at = f"file:{tmp_path}"
    digest = hashlib.sha256(b"good").hexdigest()
    rows = [(1, f"{at}/good.txt", digest.upper()), (2, f"{at}/changed.txt", digest), (3, f"{at}/gone.txt", digest), (4, None, digest), (5, f"{at}/good.txt", None)]
    issues = archive_issues(spark.createDataFrame(rows, "id int, path string, digest string"), M.files(spark, str(tmp_path)))
    assert sorted((r["id"], r["issue"]) for r in issues.collect()) == [(2, "digest_mismatch"), (3, "missing"), (4, "missing"), (5, "digest_mismatch")]


def test_import_of_nothing_and_of_repeats(spark):
    keys = spark.createDataFrame([("k",)], "key string")
    entries = spark.createDataFrame([(" K ",), ("k",), ("new",), ("New",), (None,)], "cite_key string")
    assert tuple(import_summary(entries, keys, keys.limit(0)).first()) == (4, 1, 2, 2)
    assert tuple(import_summary(entries.limit(0), keys, keys).first()) == (0, 0, 0, 0)


def test_batch_is_resumed(spark, tmp_path):
    source, target, state = (tmp_path / n for n in ("in", "out", "state"))
    source.mkdir()
    for i in range(5):
        (source / f"{i}.html").write_text(f"<p>page {i}")
    (source / "bad.docx").write_bytes(b"no zip")
    run = lambda: ingest(spark, str(source), str(target), str(state), per_batch=4)
    assert run() == 2 and run() == 0
    (source / "late.csv").write_text("a,b\n1,2\n")
    assert run() == 1
    rows = spark.read.parquet(f"{target}/rows").collect()
    assert len(rows) == 7 and sum(r["error"] is not None for r in rows) == 1
    assert {r["text"] for r in rows if r["path"].endswith(("3.html", "late.csv"))} == {"page 3", "a | b\n1 | 2"}
    log = [json.loads(r["value"]) for r in spark.read.text(f"{target}/log").select("value").collect()]
    assert sorted(r["status"] for r in log) == ["failed"] + ["ok"] * 6
    append(spark.range(2), str(tmp_path / "t"))
    append(spark.range(2, 3), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).agg(F.sum("id")).first()[0] == 3


def test_long_work_on_rows_is_dealt_to_all_tasks(spark):
    """A table in one file of one group of rows would be one task."""
    for name in ("SRC-10_docx", "SRC-12_xlsx", "SRC-13_pptx", "SRC-14_odf", "SRC-15_bundle", "SRC-20_csv_rows"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4, name


def test_workbooks_are_dealt_and_read_once(spark):
    from tests.shuffles import shuffled_rows

    assert registry.QUERIES["SRC-21_sheet_rows"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
    profile = registry.QUERIES["TAB-04_sheet_profile"](spark, "/root/testdata/sf0.001")
    assert str(profile._jdf.queryExecution().optimizedPlan()).count("MapInPandas") == 1
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    orders = lines.select("l_orderkey").distinct().count()
    # The lines, then the rows of two sheets an order with their first ones: once each.
    assert shuffled_rows(profile) <= 2 * lines.count() + 6 * orders


def test_a_part_that_breaks_off_gives_the_rows_before():
    import io
    import zipfile

    from evidara.sources import sheets

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("s.xml", '<sheet><row r="3"><c r="B3"><v>1</v></c></row><row><c><v>2</v></c></row><row')
    with zipfile.ZipFile(out) as z:
        rows = sheets.sheet_rows(z, "s.xml", [])
        assert next(rows) == (1, 3, {2: "1"}) and next(rows) == (2, 2, {1: "2"})
        with pytest.raises(Exception):
            next(rows)
