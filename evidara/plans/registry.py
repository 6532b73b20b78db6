"""Queries by name, each with the SQL that it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidara.plans.frames import frame, with_frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *frames: str, sql: str | None = None):
    """Registers a function of DataFrames (one for each name in ``frames``) as a query over a folder."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[frame(spark, sf_dir, n) for n in frames])
        if sql is not None:
            ORACLES[name] = with_frames(sql)
        return f

    return add


def load() -> None:
    from evidara.plans import evidence, files, matching, more, overview, recovery, scalars, texts, whole  # noqa: F401
