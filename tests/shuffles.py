"""Counts what a query's exchanges write."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled_rows(df: DataFrame) -> int:
    """Runs the query and adds up the rows that its exchanges have written."""
    df.collect()

    def walk(node) -> int:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        metric = node.metrics().get("shuffleRecordsWritten")
        own = metric.get().value() if metric.isDefined() else 0
        below = node.children()
        return own + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())
