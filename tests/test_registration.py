"""Registering files one by one against the joins, and checks and reach of the graph."""

from __future__ import annotations

import hashlib
import random

from evidara.operators import graph as R
from evidara.operators import registration as G


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_files_one_by_one(spark):
    rng = random.Random(3)
    urls = ["https://a.org/1", " <https://a.org/1> ", "https://b.org/2;", "ftp://no", "", None, "HTTP://C.org", "https://d.org/x,"]
    clean = {" <https://a.org/1> ": "https://a.org/1", "https://b.org/2;": "https://b.org/2", "https://d.org/x,": "https://d.org/x"}
    files = [(i, f"f{i}.pdf", rng.choice((None, "", "one", "two", "three", "four", f"own {i}")), [rng.choice(urls) for _ in range(rng.randrange(4))]) for i in range(80)]
    registry = [(sha("two"), 1000, ["https://old.org", "https://b.org/2"], "old.pdf", "Old title"), (sha("gone"), 1001, ["https://gone.org"], "gone.pdf", None)]
    held = {d: {"id": i, "urls": list(u), "new": False, "name": n, "title": t, "n": 0} for d, i, u, n, t in registry}
    status = {}
    for i, name, body, us in files:
        good = list(dict.fromkeys(clean.get(u, u) for u in us if u and clean.get(u, u).lower().startswith("http")))
        if not body or not good:
            status[i] = ("rejected", "file_missing" if body is None else "zero_bytes" if body == "" else "no_url")
            continue
        status[i] = ("duplicate" if sha(body) in held else "ingested", None)
        r = held.setdefault(sha(body), {"id": i, "urls": [], "new": True, "name": name, "title": None, "n": 0})
        r["urls"] = list(dict.fromkeys([*r["urls"], *good]))
        r["n"] += 1
    f = spark.createDataFrame(files, "ord long, filename string, body string, urls array<string>").repartition(3)
    known = spark.createDataFrame(registry, "digest string, id long, urls array<string>, original_filename string, display_title string")
    assert {r["ord"]: (r["status"], r["reason"]) for r in G.statuses(f, known).collect()} == status
    listed = {}
    for r in G.merged_urls(f, known).orderBy("digest", "ord", "place").collect():
        listed.setdefault(r["digest"], []).append(r["url"])
    assert listed == {d: r["urls"] for d, r in held.items()}
    got = {r["digest"]: r for r in G.resources(f, known).collect()}
    assert set(got) == set(held)
    for d, r in held.items():
        g = got[d]
        assert (g["id"], g["is_new"], g["arrivals"], g["download_url"], g["n_urls"], g["original_filename"]) == (r["id"], r["new"], r["n"], r["urls"][0], len(r["urls"]), r["name"])
        assert g["display_title"] == "Old title" if r["title"] else g["display_title"]
    assert G.resources(f.limit(0), known.limit(0)).count() == 0 and G.statuses(f.limit(0), known).count() == 0


def test_graph_checks_and_reach(spark):
    p = R.propositions(spark.createDataFrame([(1, '{"a":1}'), (2, " "), (3, None), (4, "{ }"), (5, "{}")], "id long, payload string"))
    assert {r["id"]: r["reason"] for r in p.collect()} == {1: None, 2: "empty_payload", 3: "empty_payload", 4: "empty_payload", 5: "empty_payload"}
    rows = spark.createDataFrame([(1, 1, None), (2, 9, None), (3, 1, 7), (4, 1, 8), (5, None, None)], "id long, proposition_id long, evidence_id long")
    one = lambda i: spark.createDataFrame([(i,)], "id long")
    assert {r["id"]: r["reason"] for r in R.assertions(rows, one(1), one(7)).collect()} == {1: None, 2: "proposition_missing", 3: None, 4: "evidence_missing", 5: "proposition_missing"}
    kinds = spark.createDataFrame([(1, "supports"), (2, "Supports"), (3, None)], "id long, kind string")
    assert {r["id"]: r["reason"] for r in R.relations(kinds).collect()} == {1: None, 2: "unsupported_type", 3: "unsupported_type"}
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(25)] + [(25, 0), (40, 40), (3, 50)] + [(rng.randrange(60, 90), rng.randrange(60, 90)) for _ in range(40)]
    hops, front = {0: 0, 61: 0}, [0, 61]
    while front:
        new = []
        for x in front:
            for a, b in edges:
                if a == x and b not in hops:
                    hops[b] = hops[x] + 1
                    new.append(b)
        front = new
    got = R.reached(spark.createDataFrame(edges * 2, "source_id long, target_id long"), spark.createDataFrame([(0,), (61,), (0,)], "id long"))
    assert {r["id"]: r["hops"] for r in got.collect()} == hops and max(hops.values()) >= 25
