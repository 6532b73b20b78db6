"""Line de-duplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm import words
from evidara.llm.runs import SortedRuns, bucket_count
from evidara.llm.scratch import Scratch, free_names, others

UPPER, LOWER, SPACE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " \t\n\x0b\x0c\r"
#: Keys of common lines that are sent to every task (16 bytes each); more of them are joined by shuffle.
BROADCAST_KEYS = 100_000


def line_keys(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(code of each line's key, lines of each text, digest of each distinct key, has that key enough code points).

    A key is the line without white space at its ends, A-Z lower-cased; a digest has 128 bits, so that two lines of a
    very large corpus don't meet by chance. A null text is one empty line.
    """
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    coded = pc.ascii_lower(pc.ascii_trim(lists.flatten(), characters=SPACE)).dictionary_encode()
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    long = pc.greater_equal(pc.utf8_length(coded.dictionary), min_chars).to_numpy(zero_copy_only=False)
    digests = [xxhash.xxh3_128_digest(k) for k in coded.dictionary.cast(pa.binary()).to_pylist()]
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts, digests, long


def _pairs(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
    return pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))


def distinct_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(others, a, b) of each distinct key of each row of rows (text, others): the digest as two longs."""
    more = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in more)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in words.steps(batch):
                codes, counts, digests, long = line_keys(part.column("text"), min_chars)
                at = np.unique((np.repeat(np.arange(len(counts)), counts) * len(digests) + codes)[long[codes]])
                a, b = _pairs(digests)
                code, who = pa.array(at % max(len(digests), 1)), pa.array(at // max(len(digests), 1))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(who) for c in more), a.take(code), b.take(code)], names=[*more, "a", "b"])

    return rows.mapInArrow(run, f"{kinds}, a long, b long")


class LineRuns:
    """How many documents hold each line, as levelled sorted runs of (a, b, n) by the line's digest.

    A batch's counts are merge-joined with each run, bucket by bucket: keys that the runs already show at ``enough``
    documents go (the anti-join), the rest is added as a run of its own. The history itself isn't shuffled, neither here
    nor when runs are compacted or asked for what is frequent.
    """

    def __init__(self, runs: SortedRuns, enough: int):
        self.runs, self.enough = runs, enough

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        """Sums over runs by merge joins: two bucketed tables meet without a shuffle (a union would lose their buckets)."""
        n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
        return reduce(lambda x, y: x.join(y.withColumnRenamed("n", "m"), ["a", "b"], "full").select("a", "b", n.alias("n")), runs)

    def frequent(self) -> DataFrame:
        """Keys (a, b) of at least ``enough`` documents."""
        return self.merged(self.runs.tables()).filter(F.col("n") >= self.enough).select("a", "b")

    def add(self, lines: DataFrame) -> None:
        """lines: a row (a, b) for each document and each distinct line of it."""
        batch = self.runs.dealt(lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
        known = F.lit(0)
        for i, old in enumerate(self.runs.tables()):
            batch = batch.join(old.withColumnRenamed("n", f"n{i}"), ["a", "b"], "left")
            known = known + F.coalesce(f"n{i}", F.lit(0))
        self.runs.push(self.runs.write(batch.filter(known < self.enough).select("a", "b", "n")), self.merged)


def drop_common_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """``docs`` with ``text`` cleaned and two more columns, ``n_lines`` (before) and ``n_dropped``.

    Lines whose key (see ``line_keys``) has ``min_chars`` code points and stands in ``min_docs`` documents go
    everywhere. Every row counts as one document, also when rows repeat; a null doc_id is as good as any. Null and
    empty texts are one empty line; a cleaned null text is empty. Nothing is decided by order, so there are no ties. An
    empty table gives an empty table; columns of other names pass through, whatever they are (``n_lines`` and
    ``n_dropped`` are replaced, in whatever case).

    Line keys are distinct within a document before they are counted with map-side sums, so a line that a third of the
    documents hold is one row a task. Up to BROADCAST_KEYS common keys (counted first) go to the tasks and text stays
    where it is; beyond, text crosses the network once, by a key that is nearly unique.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    columns = others(docs, "n_lines", "n_dropped")
    held = docs.select("text", F.pmod(F.xxhash64("text"), F.lit(batches)).cast("int").alias("batch"))
    held = scratch.hold(distinct_lines(held, min_chars))
    runs = SortedRuns(spark, f"{scratch.root}/runs", ["a", "b"], bucket_count(spark, held.count()), fan_in=fan_in)
    try:
        index = LineRuns(runs, min_docs)
        for batch in range(batches):
            index.add(held.filter(F.col("batch") == batch).select("a", "b"))
        frequent = scratch.keep(index.frequent(), "frequent")
    finally:
        runs.drop()
        scratch.release()

    if frequent.count() <= BROADCAST_KEYS:
        found = frequent.toArrow()
        both = np.stack([found[c].to_numpy() for c in "ab"], axis=1).astype(">i8").tobytes()
        common = spark.sparkContext.broadcast(frozenset(both[i : i + 16] for i in range(0, len(both), 16)))
        rows, gone = docs.select(*columns), None
    else:
        r1, r2, gone = free_names(docs, "r1", "r2", "gone")
        row = [F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(7), "text", "doc_id")]
        marks = distinct_lines(docs.select("text", row[0].alias(r1), row[1].alias(r2)), min_chars).join(frequent, ["a", "b"], "left_semi")
        # A set, so that rows that repeat have one entry.
        marks = scratch.keep(marks.groupBy(r1, r2).agg(F.collect_set(F.struct("a", "b")).alias("s")).select(r1, r2, F.col("s.a").alias(gone), F.col("s.b").alias(f"{gone}2")), "marks")
        rows, common = docs.select(*columns, row[0].alias(r1), row[1].alias(r2)).join(marks, [r1, r2], "left").select(*columns, gone, f"{gone}2"), None

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in words.steps(batch):
                text = pc.fill_null(part.column("text"), "")
                codes, counts, digests, long = line_keys(text, min_chars)
                ends = np.cumsum(counts)
                if common is not None:
                    marked = long & np.fromiter((d in common.value for d in digests), bool, len(digests))
                    drop = marked[codes]
                else:
                    drop = np.zeros(len(codes), bool)
                    for i, (a, b) in enumerate(zip(part.column(gone).to_pylist(), part.column(f"{gone}2").to_pylist())):
                        if a:
                            mine = {np.array(p, ">i8").tobytes() for p in zip(a, b)}
                            span = slice(ends[i] - counts[i], ends[i])
                            drop[span] = [long[c] and digests[c] in mine for c in codes[span]]
                dropped = np.add.reduceat(drop.astype(np.int64), ends - counts)
                kept = text.cast(pa.binary()).to_pylist()
                for i in np.flatnonzero(dropped):
                    kept[i] = b"\n".join(x for x, d in zip(kept[i].split(b"\n"), drop[ends[i] - counts[i] : ends[i]]) if not d)
                new = {"text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(counts), "n_dropped": pa.array(dropped)}
                names = [*columns, "n_lines", "n_dropped"]
                yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(c) for c in names], names=names)

    return rows.mapInArrow(cut, docs.select(columns).schema.add("n_lines", "long").add("n_dropped", "long"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: lines before, lines dropped, digest of the rest; cases as ``drop_common_lines`` states them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_common_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY r, doc_id
"""
