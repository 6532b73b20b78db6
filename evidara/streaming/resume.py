"""Batches of files that can be resumed: a file stream whose checkpoint is the state of what has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.sources.markup import parse, parser_of

LISTED = "path string, modificationTime timestamp, length long, content binary"


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a table of Parquet files."""
    rows.write.mode("append").parquet(path)


def ingest(spark: SparkSession, folder: str, target: str, state: str, per_batch: int = 25) -> int:
    """Parses the files below a folder that no earlier run with this state has parsed; returns the batches written.

    ``target/rows/batch=N`` holds path, length, text, tables and error, ``target/log/batch=N`` a line of JSON for each
    file. A batch of ``per_batch`` files is written under its number, so one that is repeated after a failure replaces
    itself. A file that is gone before it is read isn't marked, and is taken when it is there again.
    """
    read = spark.readStream.format("binaryFile").schema(LISTED).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    parsed = read.select("path", "length", parse(parser_of(F.lit(None).cast("string"), suffix), F.col("content")).alias("p")).select("path", "length", "p.*")
    written = []

    def write(rows: DataFrame, number: int) -> None:
        at = f"{target}/rows/batch={number}"
        rows.write.mode("overwrite").parquet(at)
        log = spark.read.schema(rows.schema).parquet(at).select("path", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error", F.length("text").alias("chars"))
        log.coalesce(1).write.mode("overwrite").json(f"{target}/log/batch={number}")  # at most per_batch lines
        written.append(number)

    stream = parsed.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    stream.awaitTermination()
    return len(written)
