"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Below this many sources the table of targets is broadcast (some 100 bytes each); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Documents of each source, about, that are held back to settle the residuals of the rest.
RESERVE = 256
#: Rows of one repeated row that one step deals out.
DEALT = 4096
#: Fractions nearer to a whole number than this count as whole.
EPS = 1e-9


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """sizes: (source, size, m), m rows each. Returns (source, source_size, n, target); n is the source's number of documents.

    Sources by code point, null last, take ``weights`` in turn and share the sum of all sizes. A target stops at
    ``most`` times its source's size and the excess is shared again by weight: the level L at which the sum of
    min(weight * L, cap) is the whole. Sources in the order of cap / weight are full as long as the level that the rest
    would reach lies above that ratio, so prefix sums give L in one pass. The window has one row a source.
    """
    total = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    caps = total.select("source", "source_size", "n", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double").alias("w"), (F.col("source_size") * F.lit(most)).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    found = caps.withColumn("level", level).withColumn("full", F.col("cap") / F.col("w") <= F.col("level"))
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), "level")))
    open_level = found.withColumn("l", rest.over(everything)["level"])
    return open_level.select("source", "source_size", "n", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("l")).alias("target"))


def _settled(state: Column, unit: Column, seed: int) -> Column:
    """One step of dependent rounding: moves mass between the state's open unit and the next one until one is whole.

    What one gives times its size is what the other gets times its own, so the sum of size * p stays; which way it
    goes is drawn so that the expectation of each p stays.
    """
    a, b = state["open"], unit
    u = F.pmod(F.xxhash64(F.lit(seed), a["tie"], b["tie"], a["size"]), F.lit(1 << 30)) / float(1 << 30)
    wa, wb = a["size"].cast("double"), b["size"].cast("double")
    # up: a gains x, b loses x * wa / wb; down: the other way. In words:
    up = F.least((1.0 - a["p"]) * wa, b["p"] * wb)
    down = F.least(a["p"] * wa, (1.0 - b["p"]) * wb)
    move = F.when(u < down / (up + down), up).otherwise(-down)
    pa, pb = a["p"] + move / wa, b["p"] - move / wb
    whole = lambda p: F.when(p < EPS, 0.0).when(p > 1 - EPS, 1.0).otherwise(p)
    a2, b2 = a.withField("p", whole(pa)), b.withField("p", whole(pb))
    both = F.array(a2, b2)
    closed = lambda x: (x["p"] == 0.0) | (x["p"] == 1.0)
    done = F.filter(both, closed)
    left = F.filter(both, lambda x: ~closed(x))
    return F.struct(F.concat(state["done"], done).alias("done"), F.get(left, F.lit(0)).alias("open"))


def _repaired(done: Column, missing: Column, one: str) -> Column:
    """Settled units with a few turned over, the largest that fit first, until the words ``missing`` (or, below 0, too many) are made up."""

    def turn(s, x):
        u, e = x["u"], s["e"]
        size = u["size"].cast("double")
        add, cut = (e >= size) & (u["p"] == 0.0), (-e >= size) & (u["p"] == 1.0)
        e2 = F.when(add, e - size).when(cut, e + size).otherwise(e)
        p2 = F.when(add, 1.0).when(cut, 0.0).otherwise(u["p"])
        return F.struct(F.concat(s["out"], F.array(u.withField("p", p2))).alias("out"), e2.alias("e"))

    ordered = F.array_sort(F.transform(done, lambda u: F.struct((-u["size"]).alias("large"), u["tie"].alias("tie"), u.alias("u"))))
    return F.aggregate(ordered, F.struct(F.array().cast(f"array<{one}>").alias("out"), missing.cast("double").alias("e")), turn)["out"]


def _rounds(units: DataFrame, scratch: Scratch, seed: int, fan: int) -> DataFrame:
    """units: (source, kind, size, p, copies, extra, m, doc_id, tie, last) with 0 < p < 1, one for each tie. Returns them with p of 0 or 1.

    A reduction tree. On each level, units of one source and one class of size meet in groups of about ``fan`` by a
    prefix of their hash; a group settles all its units but one, whose residual goes up. The prefix loses log2(fan)
    bits a level. What is left of each class then meets the units held back for it (``last``, a few hundred a source), the
    largest first: large residuals are settled against ever smaller documents, so the last residual is a small one.
    """
    reserve = units.filter("last").drop("last")
    units = units.filter("NOT last").drop("last")
    n = units.count()
    step = int(math.log2(fan))
    bits = max(0, math.ceil(math.log2(max(1, n) / fan)))
    out = None
    unit = ["size", "p", "copies", "extra", "m", "doc_id", "tie"]
    kind = units.schema["doc_id"].dataType.simpleString()
    one = f"struct<size:bigint,p:double,copies:bigint,extra:bigint,m:bigint,doc_id:{kind},tie:bigint>"
    levels = [*range(bits, 0, -step), 0, None]
    for level in levels:
        if level is None:
            units = units.unionByName(reserve)
        keys = [F.col("source")] if level is None else [F.col("source"), F.col("kind"), F.shiftrightunsigned("tie", 64 - level).alias("g") if level else F.lit(0).cast("long").alias("g")]
        group = units.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("large"), "tie", F.struct(*unit).alias("u")))).alias("us"))
        start = F.struct(F.lit(None).cast(f"array<{one}>").alias("done"), F.lit(None).cast(one).alias("open"))
        start = start.withField("done", F.array().cast(f"array<{one}>"))

        def merge(s, x):
            first = F.struct(s["done"].alias("done"), x["u"].alias("open"))
            return F.when(s["open"].isNull(), first).otherwise(_settled(s, x["u"], seed))

        group = group.withColumn("s", F.aggregate("us", start, merge))
        ended = level is None
        last = F.when(F.col("s.open").isNull(), F.array().cast(f"array<{one}>")).otherwise(F.array("s.open"))
        if ended:  # a last residual alone is drawn by itself
            draw = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("s.open.tie"), F.col("source")), F.lit(1 << 30)) / float(1 << 30)
            drawn = F.transform(last, lambda x: x.withField("p", F.when(draw < x["p"], 1.0).otherwise(0.0)))
            missing = F.coalesce((F.get(last, F.lit(0))["p"] - F.get(drawn, F.lit(0))["p"]) * F.get(last, F.lit(0))["size"], F.lit(0.0))
            group = group.withColumn("s", F.struct(_repaired(F.col("s.done"), missing, one).alias("done"), F.col("s.open").alias("open")))
            last = drawn
        more = [] if ended else ["kind"]
        flat = group.select("source", *more, F.explode(F.concat("s.done", last)).alias("x")).select("source", *more, "x.*")
        flat = scratch.keep(flat, f"level{level}")
        closed = flat.filter((F.col("p") == 0) | (F.col("p") == 1)).select("source", *unit)
        out = closed if out is None else out.unionByName(closed)
        if not ended:
            units = flat.filter((F.col("p") > 0) & (F.col("p") < 1))
    return out


def tie() -> Column:
    """A hash of a document's id, source and text, for draws and to find its row again."""
    return F.xxhash64("doc_id", "source", F.md5("text"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 17, fan: int = 32) -> DataFrame:
    """How often the mix takes each document: (doc_id, size, source_size, target, taken, tie).

    size is the number of words (null text: 0); taken is size times a whole number of copies, at most ``most`` (a whole
    number) of them. A source's rate is target / source_size; each of its documents gets the whole part of it, and the
    fractions are settled by dependent rounding, which keeps the taken words of the source at its target but for the
    last residual. Every row counts, also when rows repeat (equal rows may differ in copies). Draws are hashes of the
    documents and ``seed``, so runs agree whatever the partitions. Documents without words take 0; a null source is a
    source, a null doc_id an id. An empty table gives an empty table; other columns are ignored.

    Text is read once, for the sizes; the tree moves ids only, in groups of about ``fan`` units however large a source.
    Equal rows are counted before the tree: m rows with the fraction p each are floor(m * p) whole ones and one unit
    with the rest, so a row that repeats a million times is one unit like any other; they are dealt out again at the end.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    sizes = docs.select("doc_id", "source", size.alias("size"), tie().alias("tie")).groupBy("tie", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m"))
    sizes = scratch.keep(sizes, "sizes")
    goals = scratch.keep(targets(sizes, weights=weights, most=most), "targets")
    if goals.count() <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    both = sizes.withColumnRenamed("source", "s").join(goals, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(rate + EPS)
    part = F.when(F.col("size") > 0, F.greatest(rate - base, F.lit(0.0)) * F.col("m")).otherwise(0.0)
    extra = F.floor(part + EPS)
    left = F.greatest(part - extra, F.lit(0.0))
    last = F.pmod(F.xxhash64(F.lit(seed), "tie"), F.lit(1 << 30)) * F.col("n") < F.lit(RESERVE << 30)
    planned = both.select(
        "doc_id", "source", "size", "tie", "m", base.cast("long").alias("copies"), extra.cast("long").alias("extra"), F.when(left > EPS, left).otherwise(0.0).alias("p"),
        F.floor(F.log2(F.greatest("size", F.lit(1))) * 4).cast("int").alias("kind"), last.alias("last"),
    )
    planned = scratch.keep(planned, "planned")
    settled = _rounds(planned.filter("p > 0"), scratch, seed, fan)
    done = settled.unionByName(planned.filter("p = 0").drop("kind", "last"))
    # Rows that repeat come back in two steps, so that no array is long.
    done = done.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / DEALT) - 1)).alias("c"))
    done = done.select("*", F.explode(F.sequence(F.col("c") * DEALT + 1, F.least("m", (F.col("c") + 1) * DEALT))).alias("i"))
    more = (F.col("i") <= F.col("extra") + F.col("p").cast("long")).cast("long")
    done = done.select("doc_id", "source", "size", "tie", (F.col("size") * (F.col("copies") + more)).alias("taken"))
    return done.withColumnRenamed("source", "s").join(goals, F.col("s").eqNullSafe(F.col("source"))).select("doc_id", "size", "source_size", "target", "taken", "tie")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and the words taken of it; cases as ``mix`` states them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).drop("tie")
