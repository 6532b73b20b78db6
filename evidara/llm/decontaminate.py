"""Benchmark decontamination by size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.lines import LOWER, UPPER
from evidara.llm.scratch import Scratch

#: Smallest and largest number of shingles of each partition of the items, and how many hits in its sketch an item needs
#: to become a candidate. The sketch holds as many more minima as an item may miss, so no item that is contained is lost;
#: an item of 24 shingles or fewer is its own sketch.
PARTITIONS = ((1, 24, 24), (25, 48, 16), (49, 96, 16), (97, 192, 24), (193, None, 40))
#: Shingles of sketches or of items that are broadcast at most (24 bytes each); larger tables are joined by shuffle.
BROADCAST_SHINGLES = 1_000_000


def words_of(text: Column) -> Column:
    """Words between space and the bytes 09 to 0D, A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_words(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, w). The generator is a barrier: merged projections would split the text again for every shingle."""
    return df.select(*keys, F.explode(F.array(words_of(F.col("text")))).alias("w"))


def shingles(words: Column, k: int) -> Column:
    """Hashes of the runs of k words. ``words`` as of ``with_words``."""
    n = F.size(words) - (k - 1)
    run = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), run)).otherwise(F.array().cast("array<bigint>"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SHINGLES else df


def contained(docs: DataFrame, items: DataFrame, *, k: int = 5, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): documents that hold at least ``share`` of an item's distinct k-word shingles.

    docs: (doc_id, text); items: (item_id, text). An item's sketch is the shingles with the smallest hashes, a uniform
    sample; how many of them a document holds estimates the containment, however long the document is. Items are
    partitioned by size: the hits that a sketch asks for grow with the item, and it holds as many shingles more as the
    share lets an item miss, so a document that holds the item always has those hits. A partition's items are not tried
    on documents with fewer shingles than the share asks for. Candidates are then verified on all shingles of the item.

    Items of fewer than k words have no shingle and are found nowhere, documents of fewer words hold none; null texts
    count as empty, rows with the same id as one text of all their shingles. Ids that are null are left out. Empty
    tables give an empty table. Extra columns are ignored.

    Document shingles stay in their task while the benchmark's sketches are within a stated bound; beyond it the
    two are shuffled by shingle.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    item_words = with_words(items.filter("item_id IS NOT NULL"), "item_id")
    of_items = item_words.select("item_id", F.explode(F.array_distinct(shingles(F.col("w"), k))).alias("s")).distinct()
    grouped = of_items.groupBy("item_id").agg(F.array_sort(F.collect_list("s")).alias("all")).withColumn("n_item", F.size("all"))
    grouped = scratch.keep(grouped, "items")
    percent = round(share * 100)
    # A document that holds the item misses at most so many of its shingles, and so at most as many of its sketch.
    missed = F.floor(F.col("n_item") * (100 - percent) / 100).cast("int")
    hits_asked = F.coalesce(*[F.when(F.col("n_item").between(lo, hi or 1 << 30), F.lit(m)) for lo, hi, m in PARTITIONS])
    sketch_size = F.least(hits_asked + missed, F.col("n_item"))
    # The smallest of a second hash: xxhash64 of the shingle, so that the order has nothing to do with the join key.
    order = F.array_sort(F.transform("all", lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("s"))))
    sketches = grouped.select("item_id", "n_item", sketch_size.alias("m"), (sketch_size - missed).alias("asked"), order.alias("o"))
    sketches = sketches.select("item_id", "n_item", "asked", F.explode(F.slice("o", 1, F.col("m"))).alias("x")).select("item_id", "n_item", "asked", F.col("x.s").alias("s"))
    sketches = scratch.keep(sketches, "sketches")
    n_sketch = sketches.count()

    doc_words = with_words(docs.filter("doc_id IS NOT NULL"), "doc_id")
    of_docs = doc_words.select("doc_id", shingles(F.col("w"), k).alias("ss")).select("doc_id", F.size("ss").alias("n_doc"), F.explode("ss").alias("s"))
    # The distinct sketch shingles find the few document shingles that matter; (document, shingle) pairs are then distinct.
    seen = sketches.select("s").distinct()
    hits = of_docs.join(_small(seen, n_sketch), "s", "left_semi").groupBy("doc_id", "s").agg(F.sum("n_doc").alias("n_doc"))
    hits = scratch.keep(hits, "hits")
    found = hits.join(_small(sketches, n_sketch), "s").filter(F.col("n_doc") * 100 >= F.col("n_item") * percent)
    candidates = found.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("c"), F.first("asked").alias("asked"), F.first("n_item").alias("n_item"))
    candidates = candidates.filter(F.col("c") >= F.greatest(F.lit(1), F.col("asked"))).select("doc_id", "item_id", "n_item")
    candidates = scratch.keep(candidates, "candidates")

    # Verification: the candidate items' full shingles against the candidate documents'.
    wanted = grouped.join(candidates.select("item_id").distinct(), "item_id", "left_semi").select("item_id", F.explode("all").alias("s"))
    wanted = scratch.keep(wanted, "wanted")
    n_wanted = wanted.count()
    close = docs.filter("doc_id IS NOT NULL").select("doc_id", "text").join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    close = with_words(close, "doc_id").select("doc_id", F.explode(F.array_distinct(shingles(F.col("w"), k))).alias("s"))
    held = close.join(_small(wanted, n_wanted), "s").select("doc_id", "item_id", "s").distinct()
    shared = held.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    sure = shared.join(candidates, ["doc_id", "item_id"]).filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return sure.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), "n_shared")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contained(docs, items)


def _sql_shingles(table: str, key: str) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s FROM (
      SELECT {key}, w, unnest(range(1, len(w) - 3)) AS i FROM (
        SELECT {key}, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table} WHERE {key} IS NOT NULL))"""


OP3_SQL = f"""
WITH i AS ({_sql_shingles("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
d AS (SELECT * FROM ({_sql_shingles("documents", "doc_id")}) WHERE s IN (SELECT s FROM i))
SELECT doc_id, item_id, any_value(n_item) AS n_item, count(*) AS n_shared
FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) * 100 >= any_value(n_item) * 80
"""
