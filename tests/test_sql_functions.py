"""The functions in SQL give what the expressions give."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import scalar as S
from evidara.functions import sql as Q

TEXTS = [
    None, "", " ", "(3.4)", "£1,200.5m", "https://www.Example.org/a/B%20c.pdf?x=1", " <HTTP://x.org/y>;", "10.1234/AB.c, doi", "Annual report for 2023/24", "a_b-c.PDF", "FY 2019: rose. Fell!\n\nNew it's\n",
    "3f95fe1e-0b7c-4c55-9d5e-aaaaaaaaaaaa.pdf", "attachment; filename=\"q.pdf\"", "text/csv", "Application/PDF", "AB12", "[1, 2]", "localhost", "Licence: x", "The quick brown fox jumped over https://a.org/1. and http://b.org",
]
VALUES = {
    "string": TEXTS, "bigint": [None, 0, -3, 13_300_000_000_000_000], "int": [None, 0, -2, 5, 40], "double": [None, 0.0, -1.5, 2.0, 700_000_000.0],
}


def test_every_function(spark):
    made = Q.register_functions(spark)
    assert len(made) == len({*Q.TYPES, *Q.TEXT}) > 35
    for full in made:
        name = full[len(Q.PREFIX) :]
        kinds = Q.TYPES.get(name, ", ".join(["string"] * Q.TEXT.get(name, 1))).split(", ")
        pools = [VALUES[k] for k in kinds]
        rows = [tuple(p[(i * (j + 1) + j) % len(p)] for j, p in enumerate(pools)) for i in range(max(map(len, pools)) * 2)]
        given = [f"a{i}" for i in range(len(kinds))]
        df = spark.createDataFrame(rows, ", ".join(f"{g} {k}" for g, k in zip(given, kinds)))
        both = df.select(F.expr(f"{full}({', '.join(given)})").alias("got"), getattr(S, name)(*map(F.col, given)).alias("want"))
        for r in both.collect():
            assert repr(r["got"]) == repr(r["want"]), (name, r)
