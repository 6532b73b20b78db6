"""Levelled, immutable, sorted runs in hash buckets: what the log-structured indexes are stored in."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidara.llm.scratch import filesystem


def bucket_count(spark: SparkSession, rows: int, per_bucket: int = 500_000) -> int:
    """About ``per_bucket`` rows a bucket, but no more buckets than shuffle partitions; those where partitions stay as they are."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = spark.conf.get("spark.sql.adaptive.enabled", "true") == spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true") == "true"
    return min(parts, max(2, rows // per_bucket)) if merged else parts


class SortedRuns:
    """Runs of rows with equal columns, each a table of ``buckets`` files by the hash of ``keys`` and sorted by them.

    Runs of one index meet bucket by bucket: joins by the keys need no shuffle. When a level has ``fan_in`` runs, they are
    merged into one of the next level, so a row is rewritten once a level. A list of the runs is written after each change under a new number, so a reader sees the runs before or after it and a lost driver
    leaves an index that opens; ``open`` goes on where another session stopped.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int, *, fan_in: int = 2):
        self.spark, self.folder, self.keys, self.buckets, self.fan_in = spark, folder.rstrip("/"), keys, buckets, max(2, fan_in)
        self.levels: list[list[str]] = [[]]
        self.columns = ""
        self.version = 0
        self._names: dict[str, str] = {}
        self._fs, self._path = filesystem(spark, self.folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SortedRuns:
        fs, path = filesystem(spark, folder)
        numbers = [int(s.getPath().getName()[5:-5]) for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("list-")]
        kept = json.loads(spark.read.text(f"{folder}/list-{max(numbers)}.json", wholetext=True).head()[0])
        index = cls(spark, folder, kept["keys"], kept["buckets"], fan_in=kept["fan_in"])
        index.levels, index.columns, index.version = kept["levels"], kept["columns"], max(numbers)
        return index

    def _table(self, run: str) -> str:
        """The run's name in this session's catalogue, under which its buckets are known."""
        if run not in self._names:
            name = f"evidara_{run}"
            by = ", ".join(f"`{k}`" for k in self.keys)
            self.spark.sql(f"CREATE TABLE `{name}` ({self.columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'")
            self._names[run] = name
        return self._names[run]

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(self._table(r)) for level in self.levels for r in level]

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows in the runs' buckets."""
        return rows.repartition(self.buckets, *self.keys)

    def write(self, rows: DataFrame) -> str:
        """A run of rows that are in the runs' buckets. It counts as soon as ``push`` has it."""
        run = f"run_{uuid.uuid4().hex[:16]}"
        self.columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        out = rows.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("compression", "zstd").option("path", f"{self.folder}/{run}")
        out.saveAsTable(f"evidara_{run}")
        self._names[run] = f"evidara_{run}"
        return run

    def push(self, run: str, merged: Callable[[list[DataFrame]], DataFrame]) -> None:
        """Takes in a run and compacts the levels that are full; ``merged`` gives the rows of several runs, in their buckets."""
        self.levels[0].append(run)
        level, gone = 0, []
        while len(self.levels[level]) >= self.fan_in:
            old = self.levels[level]
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self.write(merged([self.spark.table(self._table(r)) for r in old])))
            self.levels[level] = []
            gone += old
            level += 1
        self._list()
        self._forget(gone)

    def _list(self) -> None:
        self.version += 1
        body = json.dumps({"keys": self.keys, "buckets": self.buckets, "fan_in": self.fan_in, "columns": self.columns, "levels": self.levels})
        draft = self._path(f"{self.folder}/.list-{self.version}.json")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(body.encode()))
        stream.close()
        self._fs.rename(draft, self._path(f"{self.folder}/list-{self.version}.json"))
        self._fs.delete(self._path(f"{self.folder}/list-{self.version - 2}.json"), False)

    def _forget(self, runs: list[str]) -> None:
        for r in runs:
            if r in self._names:
                self.spark.sql(f"DROP TABLE IF EXISTS `{self._names.pop(r)}`")
            self._fs.delete(self._path(f"{self.folder}/{r}"), True)

    def close(self) -> None:
        """Takes the runs out of the catalogue; their files stay."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        self._names = {}

    def drop(self) -> None:
        """Removes the index."""
        self.close()
        self._fs.delete(self._path(self.folder), True)
