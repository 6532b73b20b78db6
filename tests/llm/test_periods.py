"""Periodic runs against a plain search of all lags."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from evidara.llm import periods, registry


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            length = e - s + q
            if e > s and length >= max(6, 4 * q):
                smaller = any(all(w[i] == w[i + p] for i in range(s, s + length - p)) for p in range(1, q))
                if not smaller:
                    out.append((s, length, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(w, found):
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    return [x for i, x in enumerate(w) if i not in gone]


def test_runs_of_random_texts():
    rng = random.Random(3)
    seen = 0
    for _ in range(1500):
        n, k = rng.randrange(0, 90), rng.choice((1, 2, 2, 3, 30))
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4)):  # planted runs, some within others
            p, at = rng.randrange(1, 14), rng.randrange(n + 1)
            unit = [rng.randrange(k) for _ in range(p)]
            if rng.random() < 0.3:
                unit = (unit * 5)[: p + 3]
            w[at:at] = (unit * 9)[: rng.randrange(1, 7 * p + 1)]
        got = periods.runs(np.array(w, np.int64))
        assert got == plain_runs(w), w
        assert [w[i] for i in np.flatnonzero(~periods.repeated(got, len(w)))] == plain_collapse(w, got)
        seen += len(got)
    assert seen > 2000


def test_planes_find_every_stretch_of_every_lag():
    rng = np.random.default_rng(1)
    for _ in range(200):
        ids = rng.integers(0, rng.integers(1, 5), rng.integers(2, 80)) * 1000 + 7
        lag, least = int(rng.integers(1, len(ids))), int(rng.integers(1, 9))
        same = [*(ids[:-lag] == ids[lag:]), False]
        want, start = [], None
        for i, x in enumerate(same):
            if x and start is None:
                start = i
            if not x and start is not None:
                want += [(start, i - start)] if i - start >= least else []
                start = None
        first, m = periods.Planes(ids).stretches(lag, least)
        assert list(zip(first.tolist(), m.tolist())) == want


def test_long_texts_take_no_quadratic_time():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 5000, 400_000)
    ids[100_000:300_000] = ids[100_000 + np.arange(200_000) % 37_123]  # five and a bit times
    ids[50_000:60_000] = 3
    ids[10:34] = np.array([1, 2, 1] * 8)
    found = periods.runs(ids)
    assert {(10, 24, 3), (50_000, 10_000, 1), (100_000, 200_000, 37_123)} <= {(s, m, q) for s, m, q in found} and len(found) < 10
    assert periods.runs(np.zeros(500_000, np.int64)) == [(0, 500_000, 1)]
    assert periods.runs(np.arange(300_000) % 7)[0] == (0, 300_000, 7)


def test_odd_tables(spark):
    kind = "doc_id long, text string, Runs int, kept int"
    rows = [(1, "a b c", 1, 5), (None, "x " * 6, 1, 6), (2, None, 1, 7), (3, "", 1, 8), (4, " \n\t", 1, 9), (5, "p q r " * 4 + "z", 1, 10), (5, "p q r " * 4 + "z", 1, 10), (6, "é " * 30_000 + "end", 1, 11)]
    got = periods.periodic_runs(spark.createDataFrame(rows, kind))
    assert got.columns == ["doc_id", "text", "kept", "n_words", "runs", "collapsed"]
    by = {(r["doc_id"], r["kept"]): (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()}
    assert by[1, 5] == (3, [], "a b c") and by[None, 6] == (6, [(0, 6, 1)], "x")
    assert by[2, 7] == by[3, 8] == by[4, 9] == (0, [], "")
    assert by[5, 10] == (13, [(0, 12, 3)], "p q r z") and got.count() == len(rows)
    assert by[6, 11] == (30_001, [(0, 30_000, 1)], "é end")
    assert periods.periodic_runs(spark.createDataFrame([], kind)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_registered_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in registry.QUERIES["op12_periodic_runs"](spark, sf).collect()}
    planted = 0
    for doc_id, text in docs:
        w = [x.decode() for x in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if n > 3000:
            w = None  # too slow for the plain search
        elif h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if w is None:
            continue
        found = plain_runs(w)
        planted += bool(found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (best[1] * 1000 // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(plain_collapse(w, found)).encode()).hexdigest()
    assert planted > 5 and len(got) == len(docs)
