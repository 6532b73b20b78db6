"""Index runs of vectors: what a run would do, what pruning removes, and what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
IDENTITY = ("resource_id", "extraction_run_id", "model", "version", "backend")


def admitted(requests: DataFrame, extractions: DataFrame, runs: DataFrame) -> DataFrame:
    """``requests`` (IDENTITY and force) with status: failed_run_missing, failed_wrong_resource, skipped (a success of the same identity is there, unless force), or index.

    ``extractions`` (id, resource_id), ``runs`` (IDENTITY, status).
    """
    owner = extractions.select(c("id").alias("extraction_run_id"), c("resource_id").alias("_owner"))
    done = runs.filter("status = 'success'").select(*IDENTITY, F.lit(True).alias("_done")).distinct()
    both = requests.join(owner, "extraction_run_id", "left").join(done, list(IDENTITY), "left")
    status = (
        F.when(c("_owner").isNull(), "failed_run_missing").when(c("_owner") != c("resource_id"), "failed_wrong_resource")
        .when(c("_done") & ~c("force"), "skipped").otherwise("index")
    )
    return both.select(*requests.columns, status.alias("status"))


def pruned(points: DataFrame, runs: DataFrame, resources: DataFrame, media: tuple[str, ...], least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(points that stay, runs with the status pruned where theirs go): points of resources (id, media_type, bytes) of these types and sizes go."""
    gone = resources.filter(F.lower("media_type").isin(*media) & (c("bytes") >= least_bytes)).select(c("id").alias("resource_id"))
    marked = runs.join(gone.distinct().withColumn("_gone", F.lit(True)), "resource_id", "left")
    return points.join(gone, "resource_id", "left_anti"), marked.withColumn("status", F.when(c("_gone"), "pruned").otherwise(c("status"))).drop("_gone")


def health(runs: DataFrame, chunks: DataFrame, points: DataFrame) -> DataFrame:
    """(issue, n) of what holds: runs_without_chunks (no chunk at all), failed_runs, chunks_without_points (no point at all). One row of counts is the input."""
    n = runs.agg(F.count(F.lit(1)).alias("runs"), F.count_if(c("status") == "failed").alias("failed"))
    n = n.crossJoin(chunks.agg(F.count_distinct("chunk_id").alias("chunks"))).crossJoin(points.agg(F.count(F.lit(1)).alias("points")))  # one row each
    issue = lambda where, name, count: F.when(where, F.struct(F.lit(name).alias("issue"), c(count).alias("n")))
    listed = F.array(
        issue((c("runs") > 0) & (c("chunks") == 0), "runs_without_chunks", "runs"), issue(c("failed") > 0, "failed_runs", "failed"),
        issue((c("chunks") > 0) & (c("points") == 0), "chunks_without_points", "chunks"),
    )
    return n.select(F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("i")).select("i.*")


def migrated(source: DataFrame, target: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """(the target's points after the source's have been written over them, counts): both (id, vector).

    Points of another dimension are not written. Of points that share an id the smallest vector is; writing the same
    points again changes nothing. Counts: read, rejected, before, after, expected (ids of both together) and ok.
    """
    fits = source.filter(F.size("vector") == dims).groupBy("id").agg(F.min("vector").alias("vector"))
    after = target.join(fits.select("id"), "id", "left_anti").unionByName(fits)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = n(source, "read").crossJoin(n(source.filter(F.size("vector") != dims), "rejected")).crossJoin(n(target, "before")).crossJoin(n(after, "after"))  # one row each
    counts = counts.crossJoin(target.select("id").union(fits.select("id")).agg(F.count_distinct("id").alias("expected")))
    return after, counts.withColumn("ok", c("after") == c("expected"))
