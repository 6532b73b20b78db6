"""The stages in order, each on what the one before kept, and each on odd tables."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline as P
from evidara.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, kind=KIND):
    return spark.createDataFrame(rows, kind)


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, len(text) if text is not None else None)


def test_stages(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "mix"]
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in P.STAGES:
        before = docs
        docs = scratch.keep(stage(spark, docs, SF), name)
        sizes.append(docs.count())
        assert docs.columns[:5] == P.DOCUMENT
        if name not in ("line_dedup", "mix"):
            assert sizes[-1] <= sizes[-2] and docs.join(before, "doc_id", "left_anti").count() == 0
    assert sizes[2] == sizes[1] > 0.8 * sizes[0] and sizes[5] > 0


def test_near_stage_keeps_one_of_a_group(spark):
    text = " ".join("w%d" % i for i in range(80))
    rows = [row(3, text), row(1, text + " z"), row(1, text + " z"), (None, "alone", None, None, None), row(7, ""), row(8, None)]
    got = P.drop_near(spark, table(spark, rows), SF)
    assert sorted((r["doc_id"] or -1) for r in got.collect()) == [-1, 1, 7, 8]


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_no_rows_and_clashing_columns(spark, name, stage):
    assert stage(spark, table(spark, []), SF).count() == 0
    more = KIND + ", Toxicity int, _id int, tie int, n_lines int, SIZE int, target int, copies int, h int"
    rows = [(*row(i, f"plain words of row number {i} and a few more of them here"), 1, 2, 3, 4, 5, 6, 7, 8) for i in range(4)]
    got = stage(spark, table(spark, rows, more), SF)
    assert got.columns[:5] == P.DOCUMENT and got.count() >= 1


def test_toxicity_stage_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").select("doc_id"), "doc_id").limit(4)
    toxic = [tuple(r) for r in docs.select(P.DOCUMENT).collect()]
    odd = [row(None, None), row(None, ""), row(5, " \n "), row(6, "calm words here."), row(6, "calm words here."), row(7, "calm words " * 40_000)]
    got = Counter((r["doc_id"], r["text"]) for r in P.drop_toxic(spark, table(spark, [*toxic, *toxic, *odd]), SF).collect())
    assert all(got[x[0], x[1]] == odd.count(x) for x in odd)
    assert all(got.get((x[0], x[1]), 0) in (0, 2) for x in toxic) and sum((x[0], x[1]) in got for x in toxic) < len(toxic)


def test_line_stage_on_odd_rows(spark):
    rows = [row(i % 3, f"keep {i}\n  Same LINE \n") for i in range(9)] + [row(None, "same line"), row(None, None), row(1, ""), row(2, "x\n" * 50_000)]
    got = P.drop_lines(spark, table(spark, rows), SF).collect()
    assert len(got) == len(rows)
    texts = Counter(r["text"] for r in got)
    assert texts["keep 4\n"] == 1 and texts[""] == 3 and not any("line" in t.lower() for t in texts) and texts["x\n" * 50_000] == 1
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_leak_stage_on_odd_rows(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").head()["text"]
    rows = [row(1, f"before it {item} behind it"), row(1, f"before it {item} behind it"), row(None, item), row(2, "w " * 100_000 + item), row(3, None), row(None, ""), row(4, "few words"), row(4, "few words"), row(5, "clean words " * 50_000)]
    got = Counter((r["doc_id"], r["text"]) for r in P.drop_leaks(spark, table(spark, rows), SF).collect())
    assert got == Counter((r[0], r[1]) for r in rows[4:])


def test_mix_stage_on_odd_rows(spark):
    rows = [row(i, "one two three", "ab"[i % 2]) for i in range(40)] + [row(7, "one two three", "b")] * 3 + [row(None, "four five", None), row(90, None), row(91, " "), row(92, "w " * 5000, "a")]
    got = P.mix_sources(spark, table(spark, rows), SF).collect()
    sizes, taken, targets = Counter(), Counter(), {}
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    for r in got:
        assert r["size"] == len(r["text"].split()) > 0 and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["size"]
        targets[r["source"]] = r["target"]
    copies = Counter((r["doc_id"], r["text"], r["source"]) for r in got)
    held = Counter((r[0], r[1], r[3]) for r in rows)
    assert all(n <= 3 * held[x] for x, n in copies.items())
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values()) + 1 and all(taken[s] <= 3 * sizes[s] for s in taken)
    numbered = Counter((r["doc_id"], r["text"], r["source"], r["copy"]) for r in got)
    assert max(numbered.values()) == 1
