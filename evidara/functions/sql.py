"""Scalar functions under names in SQL: temporary functions of the session, inlined by Spark like the expressions that they are.

Functions of lists aren't here: Spark can't read the text that it writes for their lambdas.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evidara.functions import scalar as S

PREFIX = "evd_"
#: Types of the arguments; those not listed take texts.
TYPES = {
    "archive_path": "string, string", "chrome_time": "bigint", "clamp_span": "int, int, int", "mac_time": "double", "nearly_equal": "double, double",
    "normal_bbox": "double, double, double, double", "safe_pct": "bigint, bigint", "snippet": "string, int, int",
}
#: Functions of texts alone, with their number of arguments.
TEXT = {
    "cite_id": 1, "cite_key": 1, "clean_title": 1, "column_name": 1, "data_format": 2, "disposition_filename": 1, "doi_url": 1, "first_doi": 1, "garbage_token": 1, "is_metadata_row": 1,
    "is_reserved_host": 1, "is_url": 1, "json_length": 1, "media_label": 1, "optional_number": 1, "parse_numeric": 1, "parseable": 2, "sha256_text": 1, "short_text": 1, "suffix": 1,
    "token_estimate": 1, "url_basename": 1, "url_candidate": 1, "url_host": 1, "url_key": 1, "useless_title": 1, "uuid5_url": 1, "viewer_kind": 2, "word_count": 1,
}


def register_functions(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Registers every function of TYPES and TEXT as prefix + name, and returns these names."""
    made = []
    for name, kinds in {**{k: ", ".join(["string"] * n) for k, n in TEXT.items()}, **TYPES}.items():
        kinds = kinds.split(", ")
        given = [f"a{i}" for i in range(len(kinds))]
        empty = spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {k}) AS {g}" for g, k in zip(given, kinds)))
        column = empty.select(getattr(S, name)(*map(F.col, given)).alias("x"))
        body = column._jdf.queryExecution().analyzed().projectList().head().child().sql()
        arguments = ", ".join(f"{g} {k}" for g, k in zip(given, kinds))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {column.dtypes[0][1]} RETURN {body}")
        made.append(prefix + name)
    return made
