"""Substring de-duplication over a log-structured index of window fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm import words
from evidara.llm.runs import SortedRuns, bucket_count
from evidara.llm.scratch import Scratch, free_names, others

TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Stands for a null doc_id, which so comes before any other.
NULL_ID = -(1 << 63)


def slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) of x[i : i + n] for every i that has n values to come."""
    out, have = x, 1
    while have < n:
        more = min(have, n - have)
        out = pick(out[: len(out) - more], out[more:])
        have += more
    return out


def grams(texts: pa.Array, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, of each gram from a word on, smallest gram hash of each window, is there a whole window, text and place of each word).

    Grams without enough words have TOP, windows too.
    """
    flat, counts = words.split(texts)
    h = words.hash_words(flat)
    starts, owner, place = words.spread(counts)
    left = counts[owner] - place
    whole = left >= window
    g = np.full(len(h), TOP)
    g[: max(0, len(h) - gram + 1)] = words.rolling(h, gram, 0x9E3779B97F4A7C15)
    g[left < gram] = TOP
    wide = slide(np.concatenate([g, np.full(window - gram, TOP)]), window - gram + 1, np.minimum)
    return h, g, np.where(whole, wide, TOP), whole, owner, place


def anchors(g: np.ndarray, least: np.ndarray, whole: np.ndarray, reach: int) -> np.ndarray:
    """Positions of grams that are the smallest of some window. What a window picks depends on its words alone."""
    most = slide(np.concatenate([np.zeros(reach - 1, np.uint64), np.where(whole, least, np.uint64(0))]), reach, np.maximum)
    return np.flatnonzero((g == most) & (g != TOP) & (most != 0))


class FingerprintIndex:
    """Places (fp, id, h, pos) of window fingerprints, in levelled runs sorted by fingerprint.

    A fingerprint is the smallest hash among a window's grams, so equal windows have equal ones, and neighbours mostly
    share theirs. Runs are immutable; a batch's run is merge-joined with each older one, bucket by bucket, which tells
    the fingerprints that occur again; levels are compacted by rewriting them. The index lives in a folder and
    outlives a session: ``FingerprintIndex(SortedRuns.open(spark, folder))`` goes on.
    """

    def __init__(self, runs: SortedRuns, *, window: int = 20, gram: int = 8):
        self.runs, self.window, self.gram = runs, window, gram

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        return self.runs.dealt(reduce(DataFrame.unionAll, runs))

    def marked(self, repeated: DataFrame) -> DataFrame:
        """(id, h, pos) of the places of the fingerprints ``repeated``: merge joins with each run in its buckets."""
        dealt = self.runs.dealt(repeated)
        return reduce(DataFrame.unionAll, [run.join(dealt, "fp").select("id", "h", "pos") for run in self.runs.tables()])

    def add(self, keyed: DataFrame, before=None) -> DataFrame:
        """keyed: (id, h, text). Adds their places and returns the fingerprints that occur again, here or in older runs.

        ``before``, if given, is called with these fingerprints while the index still holds the older runs alone.
        """
        old = self.runs.tables()
        written = self.runs.write(self.runs.dealt(anchor_places(keyed, self.window, self.gram)))
        # Sums by fingerprint stay in their buckets, so that a passage that many documents share is one row from here on.
        run = self.runs.spark.table(self.runs._table(written)).groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
        again = run.filter("n > 1").select("fp")
        for o in old:
            again = again.unionAll(run.filter("n = 1").select("fp").join(o.select("fp"), "fp", "left_semi"))
        again = Scratch(self.runs.spark, "again").keep(self.runs.dealt(again).distinct(), "fingerprints")
        if before is not None and old:
            before(again)
        self.runs.push(written, self.merged)
        return again


def anchor_places(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """(fp, id, h, pos) of the anchors of each row of keyed (id, h, text)."""

    def pick(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            for part in words.steps(rows):
                _, g, least, whole, owner, place = grams(part.column("text"), window, gram)
                at = anchors(g, least, whole, window - gram + 1)
                who = pa.array(owner[at])
                yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), part.column("id").take(who), part.column("h").take(who), pa.array(place[at].astype(np.int32))], names=["fp", "id", "h", "pos"])

    return keyed.select("id", "h", "text").mapInArrow(pick, "fp long, id long, h long, pos int")


def with_keys(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with a key for each document before its columns: id, and h, which tells rows of one doc_id apart by their text (else 0)."""
    doc_id, text = docs.columns[0], docs.columns[1]
    ident = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    twice = scratch.keep(docs.groupBy(ident.alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("twice")), "twice")
    if twice.isEmpty():
        return docs.select(ident.alias("id"), F.lit(0).cast("long").alias("h"), *docs.columns)
    keyed = docs.select(ident.alias("id"), *docs.columns)
    h = F.when(F.col("twice").isNotNull(), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())).otherwise(F.lit(0))
    return keyed.join(twice, F.col("id") == F.col("twice"), "left").select("id", h.alias("h"), *docs.columns)


def _starts_to_cut(keyed: DataFrame, where: DataFrame, scratch: Scratch, window: int, gram: int) -> DataFrame:
    """(id, h, starts) of the windows that also start earlier, [-1] for a whole text. keyed: (gen, id, h, text); where: (gen, id, h, at)."""
    key = ["gen", "id", "h"]
    normal = F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    digests = keyed.select(*key, normal.alias("t")).select(*key, F.xxhash64("t").alias("d1"), F.xxhash64(F.lit(1), "t").alias("d2"), (F.regexp_count("t", F.lit(" ")) + 1).alias("n"))
    digests = scratch.keep(digests.filter(F.col("n") >= window).drop("n"), "digests")
    first = digests.groupBy("d1", "d2").agg(F.min(F.struct(*key)).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    first = scratch.keep(first, "first")
    copies = scratch.keep(digests.join(first, ["d1", "d2"]).filter(F.struct(*key) > F.col("first")).select(*key).distinct(), "copies")
    where = where.join(copies, key, "left_anti")
    scratch.drop(digests)

    def verify(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            for part in words.steps(rows):
                h, g, least, whole, owner, _ = grams(part.column("text"), window, gram)
                starts = np.searchsorted(owner, np.arange(part.num_rows))
                lists = part.column("at")
                marked = np.repeat(starts, lists.value_lengths().to_numpy(zero_copy_only=False)) + lists.flatten().to_numpy(zero_copy_only=False)
                f = np.full(len(g), TOP)
                f[marked] = g[marked]
                f = slide(np.concatenate([f, np.full(window - gram, TOP)]), window - gram + 1, np.minimum)
                s = np.flatnonzero(whole & (f == least) & (least != TOP))
                one, two = words.rolling(h, window, 0xD6E8FEB86659FD93), words.rolling(words.mix(h, 1), window, 0xA0761D6478BD642F)
                hashes = [pa.array(one[s].view(np.int64)), pa.array((two[s] >> np.uint64(32)).astype(np.uint32).view(np.int32))] if len(s) else [pa.array([], pa.int64()), pa.array([], pa.int32())]
                who = pa.array(owner[s])
                yield pa.RecordBatch.from_arrays([*hashes, *(part.column(c).take(who) for c in key), pa.array((s - starts[owner[s]]).astype(np.int32))], names=["w", "v", *key, "pos"])

    windows = scratch.keep(keyed.join(where, key).mapInArrow(verify, "w long, v int, gen int, id long, h long, pos int"), "windows")
    earliest = windows.groupBy("w", "v").agg(F.min(F.struct(*key, "pos")).alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    earliest = scratch.keep(earliest, "earliest")
    later = windows.join(earliest, ["w", "v"]).filter(F.struct(*key, "pos") > F.col("first"))
    gone = later.groupBy(*key).agg(F.collect_set("pos").alias("starts")).unionByName(copies.withColumn("starts", F.array(F.lit(-1))))
    gone = scratch.keep(gone, "gone")
    scratch.drop(windows, earliest)
    return gone


def _cut(docs: DataFrame, gone: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """docs with the words away that the windows at ``starts`` cover, n_words and n_removed."""
    columns = others(docs, "n_words", "n_removed")
    at = free_names(docs, "id", "h", "starts")

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            for part in words.steps(rows):
                kept, total, removed = [], [], []
                for text, starts in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column(at[2]).to_pylist()):
                    ws = (text or b"").split()
                    total.append(len(ws))
                    if starts == [-1]:
                        ws = []
                    elif starts:
                        edge = np.zeros(len(ws) + window + 1, np.int32)
                        np.add.at(edge, np.array(starts), 1)
                        np.add.at(edge, np.array(starts) + window, -1)
                        ws = [w for w, c in zip(ws, np.cumsum(edge).tolist()) if not c]
                    removed.append(total[-1] - len(ws))
                    kept.append(b" ".join(ws))
                new = {"text": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
                names = [*columns, "n_words", "n_removed"]
                yield pa.RecordBatch.from_arrays([new.get(c) if c in new else part.column(c) for c in names], names=names)

    schema = docs.select(columns).schema.add("n_words", "long").add("n_removed", "long")
    keyed = with_keys(docs.select("doc_id", "text", *[c for c in columns if c not in ("doc_id", "text")]).toDF("doc_id", "text", *[f"c{i}" for i in range(len(columns) - 2)]), scratch)
    named = keyed.toDF(at[0], at[1], "doc_id", "text", *[c for c in columns if c not in ("doc_id", "text")])
    marks = gone.select(F.col("id").alias(at[0]), F.col("h").alias(at[1]), F.col("starts").alias(at[2]))
    return named.join(marks, at[:2], "left").select(*columns, at[2]).mapInArrow(cut, schema)


def remove_repeats(docs: DataFrame, *, window: int = 20, gram: int = 8, batches: int = 4, fan_in: int = 3) -> DataFrame:
    """``docs`` with ``text`` as its kept words joined by single spaces, and n_words and n_removed.

    A word goes if a window of ``window`` consecutive words that covers it also starts earlier: in a document with a
    smaller doc_id, or earlier in the same one. Windows are judged on the texts as they come in.

    1. Each window's fingerprint is the smallest hash among its grams of ``gram`` words: about 2 places in
       window - gram + 2 words find every repeat. Batches in the order of doc_id go through a ``FingerprintIndex``.
    2. Windows whose fingerprint occurs again are verified by a 96-bit hash of all their words: the earliest place of
       each stays, the others go. Documents that repeat an earlier one as a whole are settled by their digest alone.

    A null doc_id counts as the smallest. Rows with equal doc_ids and different texts are documents of their own, in
    the order of a hash of the text; rows equal in both are one document, and each of them comes back cut alike. A
    null or empty text has no words. An empty table gives an empty one. n_words and n_removed are replaced where they
    exist, in whatever case; all other columns pass through.

    Hot passages: fingerprints are counted with map-side sums where they lie, and places are joined to their firsts in
    plain joins of stored tables, which Spark splits where a key is hot. The places of one fingerprint share a bucket of
    each run, though, so a passage that very many documents hold makes that bucket's task long.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    keyed = with_keys(docs.select("doc_id", "text"), scratch).select("id", "h", "text")
    bounds = keyed.select(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).head()[0] if batches > 1 else None
    edges = [None, *sorted(set(bounds or [])), None]
    runs = SortedRuns(spark, f"{scratch.root}/runs", ["fp"], bucket_count(spark, keyed.count() * 100), fan_in=fan_in)
    try:
        index = FingerprintIndex(runs, window=window, gram=gram)
        again = []
        for low, high in zip(edges, edges[1:]):
            batch = keyed
            batch = batch if low is None else batch.filter(F.col("id") > low)
            again.append(index.add(batch if high is None else batch.filter(F.col("id") <= high)))
        where = index.marked(reduce(DataFrame.unionAll, again).distinct()).groupBy("id", "h").agg(F.collect_set("pos").alias("at"))
        where = scratch.keep(where.select(F.lit(0).alias("gen"), "id", "h", "at"), "where")
    finally:
        runs.drop()
    gone = _starts_to_cut(keyed.select(F.lit(0).alias("gen"), "id", "h", "text"), where, scratch, window, gram)
    return _cut(docs, gone, scratch, window)


def remove_known(docs: DataFrame, index: FingerprintIndex, history: DataFrame) -> DataFrame:
    """``remove_repeats`` of a new batch against all that the index holds, and adds the batch to it.

    history: (doc_id, text) of the documents that went into the index, as they came in; all of them count as earlier
    than the batch. Only those that share a fingerprint with the batch are read as text again. Nulls, ties, repeated
    rows and empty tables as there.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "batch")
    new = with_keys(docs.select("doc_id", "text"), scratch).select("id", "h", "text")
    past = with_keys(history.select("doc_id", "text"), scratch).select("id", "h", "text")
    older: list[DataFrame] = []
    at = lambda places, gen: places.groupBy("id", "h").agg(F.collect_set("pos").alias("at")).select(F.lit(gen).alias("gen"), "id", "h", "at")
    repeated = index.add(new, lambda again: older.append(scratch.keep(at(index.marked(again), 0), "older")))
    where = at(anchor_places(new, index.window, index.gram).join(repeated, "fp"), 1)
    both = new.select(F.lit(1).alias("gen"), "id", "h", "text")
    if older:
        where = where.unionAll(older[0])
        both = both.unionAll(past.select(F.lit(0).alias("gen"), "id", "h", "text"))
    gone = _starts_to_cut(both, scratch.keep(where, "where"), scratch, index.window, index.gram)
    return _cut(docs, gone.filter("gen = 1"), scratch, index.window)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: words, words removed, digest of the rest; cases as ``remove_repeats`` states them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, window=20).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM v),
f AS (SELECT h, min((doc_id, i)) AS f FROM h GROUP BY h HAVING count(*) > 1),
g AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS k FROM h JOIN f USING (h) WHERE (doc_id, i) > f.f) GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, w, gone FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(
  CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(gone, j)) END, ' ')) AS kept_sha256 FROM k
"""
