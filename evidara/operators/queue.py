"""The import queue after a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
# States of a job.
STATES = ("queued", "processing", "done", "failed", "skipped", "cancelled")


def recovered(jobs: DataFrame, staged: DataFrame) -> DataFrame:
    """(id, status, detail, finished) of each job (id, status, detail, finished, cancel_requested, cancel_action, staged_path).

    In this order: states are trimmed and lower-cased; unknown ones that haven't finished are queued; processing jobs whose
    skip or cancellation was asked for end so, other processing ones are queued; then queued jobs whose staged file
    (``staged``: path, length) is missing or empty are skipped. ``finished`` says whether a job has an end; one that ends here gets it.
    """
    folded = jobs.withColumn("s", F.lower(F.trim("status")))
    stuck = ~c("s").isin(*STATES) & ~F.coalesce(c("finished"), F.lit(False))
    asked = (c("s") == "processing") & F.coalesce(c("cancel_requested"), F.lit(False))
    skip = F.lower(F.coalesce("cancel_action", F.lit(""))) == "skip"
    to = lambda state, why: F.struct(F.lit(state).alias("to"), F.lit(why).alias("why"))
    step = (
        F.when(stuck, to("queued", "legacy_state")).when(asked & skip, to("skipped", "skip_request"))
        .when(asked, to("cancelled", "cancel_request")).when(c("s") == "processing", to("queued", "restart"))
    )
    first = folded.withColumn("step", step).withColumns({"now": F.coalesce("step.to", "s"), "why": F.coalesce("step.why", "detail")})
    files = staged.select(c("path").alias("staged_path"), "length")
    both = first.join(files, "staged_path", "left")
    gone = F.when(c("now") == "queued", F.when(c("length").isNull(), "staged_missing").when(c("length") <= 0, "staged_empty"))
    ended = c("finished") | gone.isNotNull() | c("step.to").isin("skipped", "cancelled")
    return both.select("id", F.when(gone.isNotNull(), "skipped").otherwise(c("now")).alias("status"), F.coalesce(gone, "why").alias("detail"), F.coalesce(ended, F.lit(False)).alias("finished"))
