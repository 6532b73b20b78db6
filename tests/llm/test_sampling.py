"""Bounds of the samples that fit models, on tables where rows share ids, repeat, or are long."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from evidara.llm import sampling, secrets, toxicity


def rows(spark, ids, texts):
    return spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)


def total(df):
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"), F.count_distinct("text").alias("d")).head()
    return r["n"], r["b"] or 0, r["d"]


@pytest.mark.parametrize("one_id", [1, 2, 3, 7, None])
def test_rows_that_share_an_id_are_drawn_one_by_one(spark, one_id):
    texts = [f"line {i} " + ("password = hunter%d" % i if i % 2 else "plain words") for i in range(3000)]
    docs = rows(spark, [one_id] * 3000, texts)
    n, size, different = total(secrets.draw_texts(docs, most=100, most_bytes=256_000))
    assert n == different == 100 and size <= 256_000
    n, size, _ = total(secrets.draw_texts(docs, most=1000, most_bytes=8_000))
    assert 100 < n < 1000 and size <= 8_000
    labels = spark.createDataFrame([(one_id, 1)], "doc_id long, toxic int")
    n, size, _ = total(toxicity.draw_sample(docs, labels, most=100))
    assert n == (0 if one_id is None or zlib.crc32(b"%d" % one_id) % 4 == 2 else 100)


def test_equal_rows_are_one(spark):
    docs = rows(spark, [5] * 4000 + list(range(10, 60)), ["same token = abcdef123"] * 4000 + [f"other {i}" for i in range(50)])
    n, _, different = total(secrets.draw_texts(docs, most=200))
    assert n == different == 51


def test_bytes_are_a_hard_bound_and_long_texts_stay_out(spark):
    docs = rows(spark, range(40), ["x" * 5000] * 20 + ["y%d " % i * 10 for i in range(20)])
    n, size, _ = total(secrets.draw_texts(docs, most=100, most_bytes=1000))
    assert 0 < n < 20 and size <= 1000
    ids = [i for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    got = toxicity.draw_sample(rows(spark, ids, ["word " * (i + 1) for i in ids]), labels, most=50, most_bytes=20_000)
    n, size, _ = total(got)
    assert 0 < n <= 50 and size <= 20_000 and got.columns == ["doc_id", "text", "toxic"]


def test_nothing_to_draw(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.draw_texts(none).count() == 0
    assert toxicity.draw_sample(none, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), most=5).count() == 0
    assert sampling.limit(spark.createDataFrame([(1, 100), (2, 100)], "h long, size int"), 5, 99) is None
    assert sampling.limit(spark.createDataFrame([(1, 50), (2, 50), (2, 50), (3, 1)], "h long, size int"), 5, 100) == 2


def test_planted_texts_are_whole(monkeypatch):
    seen = []
    monkeypatch.setattr(secrets, "plant", lambda t, *_: seen.append(len(t)) or (t, []))
    secrets.fit(["a line of words\n" * 4000, "b"], rounds=1)
    assert max(seen) == 64_000


def test_workers_give_freed_memory_back():
    """Small objects that a long-lived object pins in the heap: their pages go back to the system."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
from evidara.llm import words
rss = lambda: int(open('/proc/self/statm').read().split()[1]) * 4096 >> 20
many = [bytes(600) for _ in range(300_000)]
last = bytes(600)
full = rss()
many = None
words.give_back()
assert full - rss() > 100, (full, rss())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent.parent)
