"""Progress of jobs: what each stage and job shows after all of its updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
# States after which updates of a job are ignored, and the events that a job keeps.
TERMINAL = ("done", "failed", "skipped", "cancelled")
RING = 4000


def at() -> Column:
    """An update's place in its job."""
    return F.struct("ts", "seq")


def counted(updates: DataFrame) -> DataFrame:
    """Updates of each job up to its first terminal one, by (ts, seq)."""
    ends = updates.filter(c("status").isin(*TERMINAL)).groupBy("job_id").agg(F.min(at()).alias("_end"))
    return updates.join(ends, "job_id", "left").filter(c("_end").isNull() | (at() <= c("_end"))).drop("_end")


def last(value: Column, counts: Column) -> Column:
    """The latest value of the rows that count; null without one."""
    return F.max(F.when(counts, F.struct(at().alias("at"), value.alias("value"))))["value"]


def steps(updates: DataFrame) -> DataFrame:
    """(job_id, stage, state, progress, detail, stats, page_count, page_current, preview) of each stage of each job.

    Blank details and stats, missing previews and numbers of pages that aren't positive carry the last ones on. A page is held to
    the number of pages known when it came, and to each number that came later: so to the least of them, and to 1 at least.
    Rows without a stage belong to none.
    """
    u = counted(updates).withColumn("stage", F.trim("stage")).filter("stage <> ''")
    full = lambda k: c(k).isNotNull() & (c(k) != "")
    key = ["job_id", "stage"]
    shown = u.groupBy(key).agg(
        last(F.coalesce("state", F.lit("pending")), F.lit(True)).alias("state"), last(F.coalesce("progress", F.lit(0)), F.lit(True)).alias("progress"),
        F.coalesce(last(c("detail"), full("detail")), F.lit("")).alias("detail"), F.coalesce(last(c("stats"), full("stats")), F.lit("")).alias("stats"),
        last(c("page_count"), c("page_count") > 0).alias("page_count"), last(c("preview"), full("preview")).alias("preview"),
        F.max(F.when(c("page_current") > 0, F.struct(at().alias("at"), c("page_current").alias("page")))).alias("current"),
    )
    bounds = u.filter("page_count > 0").select(*key, "ts", "seq", "page_count").join(shown.filter("current IS NOT NULL").select(*key, c("current.at").alias("at")), key)
    bounds = bounds.groupBy(key).agg(last(c("page_count"), at() <= c("at")).alias("then"), F.min(F.when(at() > c("at"), c("page_count"))).alias("later"))
    page = F.greatest(F.lit(1), F.least("current.page", "then", "later"))
    return shown.join(bounds, key, "left").select(*key, "state", "progress", "detail", "stats", "page_count", F.when(c("current").isNotNull(), page).alias("page_current"), "preview")


def lines(updates: DataFrame) -> DataFrame:
    """(job_id, status, status_line, counters_line, latest_preview, n_events, first_kept) of each job.

    Events are the updates with a stage; the last RING of them are kept, from sequence number ``first_kept`` on.
    """
    u = counted(updates).withColumn("stage", F.trim("stage"))
    full = lambda k: c(k).isNotNull() & (c(k) != "")
    shown = u.groupBy("job_id").agg(
        last(c("status"), F.lit(True)).alias("status"), last(c("detail"), full("detail")).alias("status_line"), last(c("stats"), full("stats")).alias("counters_line"),
        last(c("preview"), full("preview") & full("stage")).alias("latest_preview"), F.count_if(full("stage")).alias("n_events"),
    )
    return shown.join(recent(u).groupBy("job_id").agg(F.min(at())["seq"].alias("first_kept")), "job_id", "left")


def recent(updates: DataFrame, most: int = RING) -> DataFrame:
    """The latest events of each job, ``most`` at most; Spark cuts to that many a task before the shuffle."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("seq")))
    return updates.filter("trim(stage) <> ''").withColumn("_rank", rank).filter(c("_rank") <= most).drop("_rank")
