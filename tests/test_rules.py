"""Rules of tables, models, the queue and index runs on small fixtures against plain loops."""

from __future__ import annotations

import math
import random

from evidara.functions import scalar as S
from evidara.operators import models as M
from evidara.operators import queue as Q
from evidara.operators import tables as T
from evidara.operators import vectors as X
from evidara.plans.whole import junk_exclusion
from tests.shuffles import shuffled_rows


def test_header_is_the_row_of_the_best_score(spark):
    rng = random.Random(1)
    cells, want = [], {}
    for t in range(40):
        rows = {}
        for i in sorted(rng.sample(range(8), rng.randrange(1, 7))):
            rows[i] = {j: rng.choice(["", " ", "a", "A ", "b", "Title of x", "c%d" % j]) for j in sorted(rng.sample(range(5), rng.randrange(1, 6)))}
            cells += [(t, i, j, v) for j, v in rows[i].items()]
        best = None
        for i, row in rows.items():
            full = [v.strip(" ") for v in row.values() if v.strip(" ")]
            if full:
                ahead = len([v for v in rows.get(i + 1, {}).values() if v.strip(" ")])
                score = 2.5 * len(full) + 1.1 * len({v.lower() for v in full}) + 0.5 * (ahead >= len(full)) - 3 * row.get(0, "").strip(" ").lower().startswith(S.METADATA_PREFIXES)
                if best is None or round(score, 6) > best[0]:
                    best = (round(score, 6), i)
        if best:
            want[t] = best[1]
    df = spark.createDataFrame(cells, "table_id int, row_index int, col_index int, value string")
    scores = T.header_scores(df, S.is_metadata_row)
    from pyspark.sql import functions as F

    assert {r["table_id"]: r["header"] for r in T.header_rows(scores.withColumn("score", F.round("score", 6))).collect()} == want
    assert T.header_rows(T.header_scores(df.limit(0), S.is_metadata_row)).count() == 0


def test_row_chunks_of_odd_tables(spark):
    tables = [(1, " Cap ", ["Year", " "], ["first", ""]), (2, None, ["A", "", "B"], []), (3, "", [], []), (4, "Long", ["H"], ["r"])]
    cells = [(1, 0, 0, "x"), (1, 0, 1, " y "), (1, 0, 5, "z"), (1, 1, 0, "  "), (1, 2, 0, "last"), (2, 0, 0, " "), (4, 0, 0, "w " * 1500), (9, 0, 0, "no table"), (1, -1, 0, "no row")]
    got = {}
    df = T.row_chunks(spark.createDataFrame(tables, "table_id int, caption string, col_headers array<string>, row_headers array<string>"), spark.createDataFrame(cells, "table_id int, row_index int, col_index int, value string"))
    for r in df.orderBy("table_id", "row_index", "part").collect():
        got.setdefault((r["table_id"], r["row_index"], r["kind"]), []).append(r["text"])
    assert got.pop((1, 0, "table_row")) == ["Table: Cap\nTable ID: 1\nRow: first\nYear: x\ncol_1: y\ncol_5: z"]
    assert got.pop((1, 2, "table_row")) == ["Table: Cap\nTable ID: 1\nYear: last"]
    assert got.pop((2, None, "table_summary")) == ["Table ID: 2\nColumns: A, B"] and got.pop((3, None, "table_summary")) == ["Table ID: 3"]
    whole = "Table: Long\nTable ID: 4\nRow: r\nH: " + ("w " * 1500).strip()
    assert got.pop((4, 0, "table_row")) == [whole[a : a + 1100].strip() for a in (0, 920, 1840, 2760)][: math.ceil((len(whole) - 1100) / 920) + 1] and not got


def test_models(spark):
    listed = spark.createDataFrame([("a", 0), ("b", 1), ("new", 2), ("newer", 3)], "model string, ord int")
    tries = [("a", True, 2.0, 100, 10**9), ("a", False, 4.0, 50, 0), ("b", True, 0.1, 10, 10**8), ("other", True, 1.0, 1, 1)]
    df = spark.createDataFrame(tries, "model string, ok boolean, elapsed double, tokens long, eval_ns long")
    known = {r["model"]: r for r in M.statistics(listed, df).collect()}
    assert known["a"]["success_rate"] == 0.5 and known["a"]["mean_elapsed"] == 3.0 and known["a"]["tokens_per_second"] == 100 and abs(known["a"]["score"] - 0.55 / 3) < 1e-12
    assert abs(known["b"]["score"] - 1.05 / 0.5) < 1e-12 and abs(known["b"]["ucb"] - (2.1 + 0.4 * math.sqrt(math.log(5)))) < 1e-12
    assert (known["new"]["success_rate"], known["new"]["mean_elapsed"], known["new"]["ucb"]) == (0.5, 999.0, None)
    assert M.choice(M.statistics(listed, df)).head()[0] == "new" and M.choice(M.statistics(listed.filter("ord < 2"), df)).head()[0] == "b"
    assert M.choice(M.statistics(listed, df.limit(0))).head()[0] == "a"


def test_queue_after_a_restart(spark):
    kind = "id int, status string, detail string, finished boolean, cancel_requested boolean, cancel_action string, staged_path string"
    rows = [
        (1, " Queued", "d", None, None, None, "ok"), (2, "PROCESSING", "d", None, False, None, "ok"), (3, "processing", "d", None, True, " skip", "ok"), (4, "processing", "d", None, True, "SKIP", "gone"),
        (5, "odd", "d", None, None, None, "ok"), (6, "odd", "d", True, None, None, "gone"), (7, "done", "d", True, None, None, "gone"), (8, "queued", "d", None, None, None, "empty"), (9, "queued", None, None, None, None, None), (10, "odd", "d", False, None, None, "gone"),
    ]
    got = {r["id"]: tuple(r)[1:] for r in Q.recovered(spark.createDataFrame(rows, kind), spark.createDataFrame([("ok", 5), ("empty", 0)], "path string, length long")).collect()}
    assert got == {
        1: ("queued", "d", False), 2: ("queued", "restart", False), 3: ("cancelled", "cancel_request", True), 4: ("skipped", "skip_request", True), 5: ("queued", "legacy_state", False),
        6: ("odd", "d", True), 7: ("done", "d", True), 8: ("skipped", "staged_empty", True), 9: ("skipped", "staged_missing", True), 10: ("skipped", "staged_missing", True),
    }


def test_index_runs(spark):
    same = ("m", "v", "b")
    runs = spark.createDataFrame([(1, 10, *same, "success"), (1, 10, *same, "failed"), (2, 20, *same, "failed")], "resource_id long, extraction_run_id long, model string, version string, backend string, status string")
    asked = spark.createDataFrame([(1, 10, *same, False), (1, 10, *same, True), (2, 20, *same, False), (2, 10, *same, False), (3, 99, *same, True), (1, 10, "other", "v", "b", False)], "resource_id long, extraction_run_id long, model string, version string, backend string, force boolean")
    got = [(r["resource_id"], r["extraction_run_id"], r["model"], r["force"], r["status"]) for r in X.admitted(asked, spark.createDataFrame([(10, 1), (20, 2)], "id long, resource_id long"), runs).collect()]
    assert sorted(got) == sorted([(1, 10, "m", False, "skipped"), (1, 10, "m", True, "index"), (2, 20, "m", False, "index"), (2, 10, "m", False, "failed_wrong_resource"), (3, 99, "m", True, "failed_run_missing"), (1, 10, "other", False, "index")])
    points = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (2, [2.0, 2.0]), (2, [1.0, 9.0])], "id long, vector array<double>")
    after, counts = X.migrated(points, spark.createDataFrame([(2, [0.0, 0.0]), (3, [5.0, 5.0])], "id long, vector array<double>"), 2)
    assert {r["id"]: r["vector"] for r in after.collect()} == {1: [1.0, 2.0], 2: [1.0, 9.0], 3: [5.0, 5.0]} and tuple(counts.head()) == (4, 1, 2, 3, 3, True)
    again, _ = X.migrated(points, after, 2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, after.collect()))
    none = spark.createDataFrame([], "chunk_id long")
    assert [tuple(r) for r in X.health(runs, none, none).collect()] == [("runs_without_chunks", 3), ("failed_runs", 2)]
    assert X.health(runs.limit(0), none, none).count() == 0


def test_addresses_of_files_are_counted_by_name(spark):
    """300 files and 300 addresses of a name are 90 000 pairs, which are not shuffled; a path of two names has the addresses of both."""
    probes = spark.range(400).selectExpr("'https://h' || id || '.org/' || IF(id < 300, 'A.pdf', 'b.pdf') AS url", "'' AS disposition")
    files = spark.range(300).selectExpr("IF(id % 2 = 0, 'a.pdf', 'A.PDF') AS name", "'p' || id AS path").union(spark.sql("SELECT * FROM VALUES ('b.pdf', 'p7'), ('c.pdf', 'p8') AS t(name, path)"))
    found = junk_exclusion(probes, files)
    assert shuffled_rows(found) < 20_000
    urls = {r["path"]: (r["urls"], r["first"]) for r in found.collect()}
    assert urls == {f"p{i}": (400 if i == 7 else 300, "https://h0.org/A.pdf") for i in range(300)}


def test_files_of_one_name_make_no_pairs_but_results(spark):
    """Sizes of 0, unknown and negative ones, ids that recur, and a name that everything shares."""
    from evidara.plans import matching
    from tests.shuffles import shuffled_rows

    sizes = [0, 1, 19, 20, 21, 95, 100, 104, 105, 106, 2000, -3, None]
    files = [(i, s, "A.pdf") for i, s in enumerate(sizes)] + [(3, 5000, "b.pdf"), (3, 100, "a.PDF"), (None, 100, "c"), (None, 7000, "b.pdf"), (9, 9, None)]
    downs = [(100 + i, s, n) for i, s in enumerate(sizes) for n in ("a.pdf", "B.pdf")] + [(200, -1, "c"), (201, 7001, "b.pdf"), (202, -1, None)]
    both = [(i, d, 2 if t < 0 else 1) for i, s, n in files for d, t, m in downs if n and m and n.lower() == m.lower() and t is not None and (t < 0 or s is not None and abs(t - s) <= s * 0.05)]
    want = sorted((r for r in both if r[2] == min(x[2] for x in both if x[0] == r[0])), key=repr)
    got = matching.filename_tiers(spark.createDataFrame(files, "id int, size long, filename string"), spark.createDataFrame(downs, "id int, size long, filename string"))
    assert sorted(map(tuple, got.collect()), key=repr) == want and {r[2] for r in want} == {1, 2}
    f, d = spark.range(300).selectExpr("id", "1000 + id % 7 AS size", "'x' AS filename"), spark.range(300).selectExpr("id", "1000 AS size", "'X' AS filename")
    pairs = matching.filename_tiers(f, d)
    assert pairs.count() == 90_000 and shuffled_rows(pairs) < 10_000
