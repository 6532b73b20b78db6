"""What is known of models after their attempts, and which to try next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
# Prior success, seconds of an untried model, weight of exploration.
PRIOR, UNTRIED_SECONDS, EXPLORE = 0.5, 999.0, 0.4


def statistics(models: DataFrame, attempts: DataFrame) -> DataFrame:
    """(model, ord, attempts, success_rate, mean_elapsed, tokens_per_second, score, ucb) of each of ``models`` (model, ord).

    ``attempts``: (model, ok, elapsed, tokens, eval_ns). Tokens a second are those of all attempts that have a duration over
    their durations. The score is success over time; ucb adds what an often tried model lacks, and is null for one without attempts.
    """
    timed = c("eval_ns") > 0
    per = attempts.groupBy("model").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("successes"), F.sum("elapsed").alias("elapsed"), F.sum(F.when(timed, c("tokens"))).alias("tokens"), F.sum(F.when(timed, c("eval_ns"))).alias("ns")
    )
    total = F.broadcast(attempts.agg(F.count(F.lit(1)).alias("total")))  # one row
    known = models.join(per, "model", "left").crossJoin(total).withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    tried = c("attempts") > 0
    rate = F.when(tried, c("successes") / c("attempts")).otherwise(PRIOR)
    mean = F.when(tried, c("elapsed") / c("attempts")).otherwise(UNTRIED_SECONDS)
    score = (rate + 0.05) / F.greatest(mean, F.lit(0.5))
    speed = F.when((c("ns") > 0) & (c("tokens") > 0), c("tokens") / (c("ns") / 1e9))
    ucb = F.when(tried, score + EXPLORE * F.sqrt(F.log(c("total") + 1) / c("attempts")))
    return known.select("model", "ord", "attempts", rate.alias("success_rate"), mean.alias("mean_elapsed"), speed.alias("tokens_per_second"), score.alias("score"), ucb.alias("ucb"))


def choice(known: DataFrame) -> DataFrame:
    """(model): the first model without attempts, else that of the greatest ucb, the first of equal ones."""
    return known.agg(F.min_by("model", F.struct(c("ucb").isNotNull(), -F.coalesce("ucb", F.lit(0.0)), "ord")).alias("model"))
