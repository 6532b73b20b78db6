"""Archived files against the digests that were recorded for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def archive_issues(resources: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, issue) of the resources whose file is missing or has another SHA-256.

    resources: (id, path, digest); files: (path, content). Files are digested where they are read, so contents aren't
    shuffled. A null content counts as missing, a null digest as another one; of files with one path any that agrees will do.
    """
    held = files.select("path", F.sha2("content", 256).alias("digest")).filter("digest IS NOT NULL").distinct()
    there = held.select("path", F.lit(True).alias("there")).distinct()
    both = resources.select("id", "path", F.lower("digest").alias("digest")).join(there, "path", "left")
    both = both.join(held.withColumn("same", F.lit(True)), ["path", "digest"], "left")
    issue = F.when(F.col("there").isNull(), "missing").when(F.col("same").isNull(), "digest_mismatch")
    return both.select("id", "path", issue.alias("issue")).filter("issue IS NOT NULL")
