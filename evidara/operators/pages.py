"""Pages put together to documents: running offsets, spans and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: What stands between two pages.
BREAK = "\n\n"
#: Pages of one document that one window orders; longer documents are summed by blocks first.
BLOCK = 1024


def running_total(rows: DataFrame, key: str, at: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the key with a smaller ``at`` (whole numbers; equal ones are summed in any order).

    Blocks of ``at`` are summed first, then a window runs over a document's blocks and one over each block's rows: no task
    has more of a document than a block's rows, or one row for each of its blocks.
    """
    cut = rows.withColumn("_block", F.floor(c(at) / block)).withColumn("_value", value)
    sums = cut.groupBy(key, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(key, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    both = cut.join(sums, [key, "_block"])
    return both.withColumn(name, c("_before") + F.coalesce(F.sum("_value").over(inner), F.lit(0))).drop("_block", "_value", "_before")


def placed(pages: DataFrame, key: str, at: str) -> DataFrame:
    """``pages`` (key, at, text) with ``page_index`` (from 0) and ``offset``, the page's place in the merged text; a null text is empty."""
    counted = running_total(pages, key, at, F.lit(1), "page_index")
    return running_total(counted, key, at, F.coalesce(F.length("text"), F.lit(0)) + len(BREAK), "offset")


def merged(pages: DataFrame, key: str, at: str) -> DataFrame:
    """(key, text, pages): the texts in order with BREAK between them."""
    listed = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return listed.select(key, F.array_join("p.text", BREAK).alias("text"), F.size("p").alias("pages"))


def rebased(spans: DataFrame, pages: DataFrame, key: str, at: str) -> DataFrame:
    """``spans`` (key, at, start, end, ...) on pages as spans of the merged text, with ``page_index``.

    Spans are held to their page: start to 0 at least, end to the start and the page's end. Blocks, segments and annotations
    alike; spans of pages that aren't there go.
    """
    p = placed(pages, key, at).select(key, at, "page_index", "offset", F.coalesce(F.length("text"), F.lit(0)).alias("_n"))
    start = F.greatest(F.lit(0), c("start"))
    both = spans.join(p, [key, at]).withColumn("_end", F.least(F.greatest(start, c("end")), c("_n")))
    return both.withColumns({"start": c("offset") + start, "end": c("offset") + c("_end")}).drop("_n", "_end", "offset")


def set_digest(rows: DataFrame, key: str, name: str, *fields: Column) -> DataFrame:
    """(key, name): number of rows and sums of two parts of their SHA-256, in any order and however the rows are dealt.

    Fields are joined by U+0001, a null is U+0002. Sums are made in each task before the shuffle.
    """
    line = F.concat_ws("\u0001", *[F.coalesce(f.cast("string"), F.lit("\u0002")) for f in fields])
    part = lambda i: F.conv(F.substring("_h", i, 15), 16, 10).cast("decimal(20,0)")
    hashed = rows.select(key, F.sha2(line, 256).alias("_h")).select(key, part(1).alias("_a"), part(16).alias("_b"))
    sums = hashed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    return sums.select(key, F.concat_ws(":", "n", "a", "b").alias(name))


def payload_digest(runs: DataFrame, key: str, text: DataFrame, **parts: DataFrame) -> DataFrame:
    """(key, digest) of each run: SHA-256 of the digest of its text (key, text) and of the ``set_digest`` of each part; a part without rows counts as empty."""
    out = runs.select(key).join(text.select(key, F.sha2("text", 256).alias("_text")), key, "left")
    for name, rows in parts.items():
        out = out.join(set_digest(rows, key, name, *[c(x) for x in rows.columns if x != key]), key, "left")
    return out.select(key, F.sha2(F.concat_ws("|", *[F.coalesce(c(x), F.lit("-")) for x in ("_text", *parts)]), 256).alias("digest"))


def incomplete(wanted: DataFrame, runs: DataFrame, texts: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, reason) of each wanted run: run_missing, run_status=..., document_text_missing, segments_missing_for_nonempty_text, or null if it is complete.

    ``runs`` (id, status), ``texts`` (id, n_chars), ``segments`` (id, ...): only whether one is there counts.
    """
    both = wanted.select("id").join(runs.select("id", "status"), "id", "left").join(texts.select("id", "n_chars", F.lit(True).alias("_text")), "id", "left")
    both = both.join(segments.select("id", F.lit(True).alias("_some")).distinct(), "id", "left")
    return both.select(
        "id", F.when(c("status").isNull(), "run_missing").when(F.lower("status") != "success", F.concat(F.lit("run_status="), "status")).when(c("_text").isNull(), "document_text_missing")
        .when((c("n_chars") > 0) & c("_some").isNull(), "segments_missing_for_nonempty_text").alias("reason"),
    )
