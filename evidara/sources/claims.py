"""Claims and references from CSV, JSON, Markdown and BibTeX."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from itertools import zip_longest

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, MapType, StringType


def claims_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed text under trimmed names, blanks for what is missing; quoted fields may hold line ends."""
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return read.select(*[F.trim(F.coalesce(f"`{c}`", F.lit(""))).alias(c.strip()) for c in read.columns])


@F.pandas_udf(ArrayType(MapType(StringType(), StringType())))
def csv_rows(texts: pd.Series) -> pd.Series:
    """The rows of each CSV text under its header, names and values trimmed; what is missing is blank, cells beyond the header and blank rows go."""

    def rows(text: str | None) -> list[dict[str, str]]:
        header, *body = [r for r in csv.reader(io.StringIO(text or "", newline="")) if r] or [[]]
        return [{name.strip(): value.strip() for name, value in zip_longest(header, r[: len(header)], fillvalue="")} for r in body]

    return texts.map(rows)


def claims_json(texts: DataFrame, schema: str) -> DataFrame:
    """Claims of each text (value): the fields of ``schema`` and error.

    A text is a list of claims or an object with a list ``claims``; any other gives one row with its error.
    """
    as_list = F.from_json("value", f"array<struct<{schema}>>")
    as_object = F.from_json("value", f"claims array<struct<{schema}>>")["claims"]
    found = F.when(F.ltrim("value").startswith("["), as_list).otherwise(as_object)
    error = F.when(F.col("found").isNull(), "expected a list or an object with a list of claims")
    others = [c for c in texts.columns if c != "value"]
    rows = texts.withColumn("found", found).select(*others, error.alias("error"), F.explode_outer("found").alias("c"))
    # An empty list has no claims and no error.
    return rows.filter(F.col("c").isNotNull() | F.col("error").isNotNull()).select(*others, "c.*", "error")


def claims_markdown(lines: DataFrame) -> DataFrame:
    """(narrative_text, cite) of each line (value) that begins with '- '; four characters after the last @ are a citation."""
    item = F.trim(F.expr("substring(value, 3)"))
    tail = F.trim(F.regexp_replace(F.regexp_extract(item, r"@([^@]*)$", 1), r"[\])]+$", ""))
    cited = F.length(tail) == 4
    text = F.trim(F.when(cited, F.regexp_replace(item, r"\s*[\[(]?@[^@]*$", "")).otherwise(item))
    return lines.filter(F.col("value").startswith("- ")).select(text.alias("narrative_text"), F.when(cited, tail).alias("cite")).filter("narrative_text <> ''")


def bib_entries(text: str) -> Iterator[tuple[str, str, dict[str, str], str]]:
    """(type, key, fields, raw) of each entry; braces must balance, a key must be there."""
    at = 0
    while (m := re.compile(r"@\s*([A-Za-z]+)\s*\{").search(text, at)) is not None:
        depth, end = 1, m.end()
        while end < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        if depth:
            raise ValueError(f"unbalanced braces in the entry at {m.start()}")
        key, comma, rest = text[m.end() : end - 1].partition(",")
        if not comma or not key.strip():
            raise ValueError(f"no key in the entry at {m.start()}")
        yield m[1].lower(), key.strip(), dict(_fields(rest)), text[m.start() : end]
        at = end


def _fields(body: str) -> Iterator[tuple[str, str]]:
    at = 0
    while (m := re.compile(r"\s*,?\s*([A-Za-z][\w-]*)\s*=\s*").match(body, at)) is not None:
        i = m.end()
        if i < len(body) and body[i] == "{":
            depth, end = 1, i + 1
            while end < len(body) and depth:
                depth += {"{": 1, "}": -1}.get(body[end], 0)
                end += 1
            value, at = body[i + 1 : end - 1], end
        elif i < len(body) and body[i] == '"':
            end = body.find('"', i + 1)
            end = len(body) if end < 0 else end
            value, at = body[i + 1 : end], end + 1
        else:
            end = re.compile(r"[^,]*").match(body, i).end()
            value, at = body[i:end], end
        yield m[1].lower(), " ".join(value.split())


@udtf(returnType="entry_type string, cite_key string, fields map<string,string>, raw string")
class BibEntries:
    """Table function: the entries of a BibTeX text."""

    def eval(self, text: str):
        if text:
            yield from bib_entries(text)
