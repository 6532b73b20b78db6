"""Progress of jobs: batch folds against the stream, with late updates, and what the stream remembers."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from evidara.operators import progress as P
from evidara.plans.frames import frame
from evidara.streaming import progress as W

SF = "/root/testdata/sf0.001"
KIND = "job_id long, seq long, ts timestamp, status string, stage string, state string, progress long, detail string, stats string, page_count long, page_current long, preview string"


def made(spark, *rows):
    """Updates (job, minute, status, stage, fields)."""
    from datetime import datetime, timedelta

    names = [x.split()[0] for x in KIND.split(", ")]
    out = []
    for i, (job, minute, status, stage, more) in enumerate(rows):
        base = {"job_id": job, "seq": i, "ts": datetime(2024, 1, 1) + timedelta(minutes=minute), "status": status, "stage": stage}
        out.append(tuple((base | more).get(n) for n in names))
    return spark.createDataFrame(out, KIND)


def replay(spark, tmp_path, files, late, remember=86_400):
    """Rows that the stream puts out over files of updates, one file a batch; the state folder."""
    for i, part in enumerate(files):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
        for file in (tmp_path / "in" / f"{i:03d}").glob("part-*"):
            os.utime(file, (1e9 + i, 1e9 + i))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = []
    out = W.progress(spark, stream, late, remember).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
    query = out.foreachBatch(lambda rows, n: got.extend(r.asDict() for r in rows.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    return got, str(tmp_path / "state")


def test_fold_of_steps(spark):
    p = "processing"
    rows = [
        (1, 0, p, " parse ", {"page_current": 10, "detail": "a", "preview": "x"}),
        (1, 1, p, "parse", {"page_count": 5, "stats": "s"}),
        (1, 2, p, "parse", {"page_count": 8, "detail": "", "state": "active", "progress": 40}),
        (1, 3, p, "parse", {"page_count": -1, "page_current": 0}),
        (1, 4, p, "other", {"page_count": 3, "page_current": 9}),
        (1, 5, p, None, {"detail": "no stage", "preview": "lost"}),
        (1, 6, "failed", "parse", {"stats": "t"}),
        (1, 7, p, "parse", {"detail": "too late", "page_current": 1}),
        (2, 0, p, "", {}),
    ]
    u = made(spark, *rows)
    got = {(r["job_id"], r["stage"]): tuple(r)[2:] for r in P.steps(u).collect()}
    assert got == {(1, "parse"): ("pending", 0, "a", "t", 8, 5, "x"), (1, "other"): ("pending", 0, "", "", 3, 3, None)}
    lines = {r["job_id"]: tuple(r)[1:] for r in P.lines(u).collect()}
    assert lines == {1: ("failed", "no stage", "t", "x", 6, 0), 2: ("processing", None, None, None, 0, None)}
    assert P.recent(u, 2).filter("job_id = 1").count() == 2 and P.steps(u.limit(0)).count() == 0


def test_stream_with_late_updates_is_the_batch(spark, tmp_path):
    rng = random.Random(5)
    every = frame(spark, SF, "updates").withColumn("job_id", F.col("job_id") % 12)
    every = spark.createDataFrame(every.select([x.split()[0] for x in KIND.split(", ")]).collect(), KIND)
    order = every.select("seq", F.unix_millis("ts").alias("ms")).orderBy("ts").collect()
    # Each update comes up to 20 hours after its time; a day's updates are a file.
    at = {r["seq"]: int((r["ms"] - order[0]["ms"] + rng.random() * 20 * 3_600_000) // 86_400_000) for r in order}
    days = spark.createDataFrame(list(at.items()), "seq long, day int")
    parts = [every.join(days.filter(F.col("day") == d), "seq").select(every.columns) for d in sorted(set(at.values()))]
    moved = sum(at[x["seq"]] > at[y["seq"]] for x, y in zip(order, order[1:]))
    ends = [made(spark, (-1, 60 * 24 * n, "processing", "end", {})) for n in (90, 91, 92)]
    got, state = replay(spark, tmp_path, parts + ends, "2 days", remember=10 * 365 * 86_400)
    assert moved > 20 and len(got) > 100

    names = ["state", "progress", "detail", "stats", "page_count", "page_current", "preview"]
    last = {(r["job_id"], r["stage"]): tuple(r["stage_state" if n == "state" else n] for n in names) for r in got if r["stage"]}
    last.pop((-1, "end"), None)
    assert last == {(r["job_id"], r["stage"]): tuple(r[n] for n in names) for r in P.steps(every).collect()}
    names = ["status", "status_line", "counters_line", "latest_preview", "n_events", "first_kept"]
    last = {r["job_id"]: tuple(r[n] for n in names) for r in got if r["job_id"] >= 0}
    batch = {r["job_id"]: tuple(r[n] for n in names) for r in P.lines(every).collect()}
    assert last == batch
    # Jobs that ended hold a line alone.
    ended = {j for j, r in batch.items() if r[0] in P.TERMINAL}
    held = lambda name: {r[0] for r in spark.read.format("statestore").option("stateVarName", name).load(state).select("key.job_id").collect()}
    assert ended and not held("steps") & ended and not held("ring") & ended and ended <= held("lines")


def test_nothing_is_remembered_for_ever(spark, tmp_path):
    p, day = "processing", 24 * 60
    files = [
        made(spark, (1, 0, p, "a", {"detail": "x"}), (1, 1, "done", "a", {}), (2, 0, p, "b", {})),
        made(spark, (1, 2 * 60, p, "a", {"detail": "ignored"})),
        made(spark, (3, 10 * day, p, "c", {})),
        made(spark, (3, 20 * day, p, "c", {})),
        made(spark, (3, 30 * day, p, "c", {})),
    ]
    got, state = replay(spark, tmp_path, files, "1 hour")
    assert [(r["status"], r["stage"], r["detail"]) for r in got if r["job_id"] == 1] == [("done", "a", "x")]
    held = {r[0] for r in spark.read.format("statestore").option("stateVarName", "lines").load(state).select("key.job_id").collect()}
    assert held == {2, 3}


def test_ring_keeps_the_last_events(spark, tmp_path, monkeypatch):
    rows = [(1, i, "processing", "a", {}) for i in range(25)]
    u = made(spark, *rows)
    assert sorted(r["seq"] for r in P.recent(u, 10).collect()) == list(range(15, 25))
    step = None
    for r in u.orderBy("seq").collect():
        step = W.fold_step(step, r)
    assert step == ("pending", 0, "", "", None, None, None)
