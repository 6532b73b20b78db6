"""MinHash near-duplicates: banded candidates checked by odd sketches, then on the full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm import words
from evidara.llm.runs import bucket_count
from evidara.llm.scratch import Scratch
from evidara.llm.substrings import NULL_ID

ROWS, BANDS = 5, 48
SAMPLES = ROWS * BANDS
BITS = 1024
#: Bits of the parity of a whole set, by which candidates are ruled out without error.
WHOLE_BITS = 2048
#: Members of a bucket that one task compares at a time with as many others.
BLOCK = 2048


def tolerated(share: float) -> int:
    """Differing bits up to which a pair is verified: those of a similarity 5.5 standard errors of the samples below ``share``."""
    low = max(0.0, share - 5.5 * math.sqrt(share * (1 - share) / SAMPLES))
    return math.ceil(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - low) / BITS)))


def shingle_hashes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct shingle of each text, its text, digests of the word sequences as two arrays); texts lower-cased A-Z."""
    flat, counts = words.split(pc.ascii_lower(pc.fill_null(texts, "")))
    h = words.hash_words(flat)
    starts, owner, place = words.spread(counts)
    left = counts[owner] - place
    full = words.rolling(h, k, 0x9E3779B97F4A7C15)
    at = np.flatnonzero(left[: len(full)] >= k)
    hashes, of = full[at], owner[at]
    for i in np.flatnonzero((counts > 0) & (counts < k)):  # the whole sequence is one shingle
        n = int(counts[i])
        hashes = np.append(hashes, words.rolling(h[starts[i] : starts[i] + n], n, 0x9E3779B97F4A7C15))
        of = np.append(of, i)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    digest = []
    for salt in (1, 2):
        part = words.mix(h + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), salt)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(part, dtype=np.uint64)])
        digest.append(words.mix(sums[starts + counts] - sums[starts], salt) + counts.astype(np.uint64))
    return hashes[new], of[new], digest[0], digest[1]


def samples(hashes: np.ndarray, owner: np.ndarray, n: int, t: int = SAMPLES) -> np.ndarray:
    """n x t MinHash samples; any two sets agree in a sample with the probability of their similarity.

    Fast similarity sketching: in round i every element draws one of the t samples and a value; a sample takes its
    smallest value of the first round that reaches it. Round t + j gives all elements to sample j. A set is done when
    each sample has a value, after about t log t draws instead of t for each element.
    """
    out = np.zeros((n, t), np.uint64)
    missing = np.full(n, t)
    missing[np.bincount(owner, minlength=n) == 0] = 0
    filled = np.zeros((n, t), bool)
    for r in range(2 * t):
        alive = missing[owner] > 0
        if not alive.all():
            hashes, owner = hashes[alive], owner[alive]
        if not len(owner):
            break
        v = words.mix(hashes, r + 101)
        slot = (v % np.uint64(t)).astype(np.int64) if r < t else np.full(len(v), r - t)
        cell = owner * t + slot
        free = ~filled.ravel()[cell]
        cell, v = cell[free], v[free]
        if not len(cell):
            continue
        order = np.lexsort((v, cell))
        cell, v = cell[order], v[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        cell, v = cell[first], v[first]
        out.ravel()[cell] = words.mix(v, r + 1)
        filled.ravel()[cell] = True
        missing -= np.bincount(cell // t, minlength=n)
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    """n x BANDS keys, each of ROWS samples and the band's number."""
    out = np.zeros((len(s), BANDS), np.uint64)
    for j in range(ROWS):
        out = words.mix(out ^ s[:, j::ROWS], j + 1)
    return words.mix(out + np.arange(BANDS, dtype=np.uint64), 9)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """n x BITS / 64 words: bit h(i, sample i) is turned over for each i, so equal samples cancel in the xor of two sketches."""
    n, t = s.shape
    bit = (words.mix(s + np.arange(t, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 77) % np.uint64(BITS)).astype(np.int64)
    parity = np.zeros((n, BITS), np.uint8)
    np.bitwise_xor.at(parity, (np.repeat(np.arange(n), t), bit.ravel()), 1)
    return np.packbits(parity, axis=1, bitorder="little").view("<u8")


def whole_parity(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """n x WHOLE_BITS / 64 words: the odd sketch of all shingles. Two of them never differ in more bits than the sets in elements."""
    bit = (words.mix(hashes, 55) % np.uint64(WHOLE_BITS)).astype(np.int64)
    parity = np.zeros(n * WHOLE_BITS, np.uint8)
    np.bitwise_xor.at(parity, owner * WHOLE_BITS + bit, 1)
    return np.packbits(parity.reshape(n, WHOLE_BITS), axis=1, bitorder="little").view("<u8")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(id, d1, d2, n, bands, sketch, whole) of each row of (id, text); bands and sketches of a text without words say nothing."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            for part in words.steps(rows, limit=1 << 20, rows=500):  # a few MB of arrays each, however large the batch
                hashes, of, d1, d2 = shingle_hashes(part.column("text"), k)
                n = part.num_rows
                s = samples(hashes, of, n)
                cols = [part.column("id"), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(np.bincount(of, minlength=n).astype(np.int64)), _lists(band_keys(s)), _lists(odd_sketch(s)), _lists(whole_parity(hashes, of, n))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "d1", "d2", "n", "bands", "sketch", "whole"])

    return docs.select("id", "text").mapInArrow(run, "id long, d1 long, d2 long, n long, bands array<bigint>, sketch array<bigint>, whole array<bigint>")


def _set(text: bytes, k: int) -> frozenset:
    w = text.lower().split()
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def similar(pairs: DataFrame, texts: DataFrame, k: int, share: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have ``share`` or more in common, counted on the words themselves."""
    percent = round(share * 100)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        size = 0

        def of(key: int, text: bytes) -> frozenset:
            nonlocal size
            got = held.get(key)
            if got is None or got[0] != text:
                if size > 200_000:
                    held.clear()
                    size = 0
                got = held[key] = (text, _set(text, k))
                size += len(got[1])
            return got[1]

        for rows in source:
            for part in words.steps(rows, "ta", 8 << 20):
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                ta, tb = (part.column(c).cast(pa.binary()) for c in ("ta", "tb"))
                good = []
                for i in range(part.num_rows):
                    x, y = of(a[i], ta[i].as_py()), of(b[i], tb[i].as_py())
                    both = len(x & y)
                    if both * 100 >= percent * (len(x) + len(y) - both):
                        good.append(i)
                yield part.take(pa.array(good, pa.int64())).select(["a", "b"])

    ta, tb = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(tb, "b").join(ta, "a").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) of the ids in edges (a, b): the smallest id that each reaches.

    Smallest labels of neighbours, then a jump to the label's own label, until nothing changes. Steps read and write
    stored tables, so an executor's loss costs a step at most, and joins are plain ones that split hot keys.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "label", F.lit(None).cast("long").alias("old"))
        near = near.unionAll(labels.select("id", "label", F.col("label").alias("old")))
        step = scratch.keep(near.groupBy("id").agg(F.min("label").alias("label"), F.min("old").alias("old")), "step")
        far = step.select(F.col("id").alias("label"), F.col("label").alias("far"))
        jumped = scratch.keep(step.join(far, "label", "left").select("id", F.coalesce("far", "label").alias("label"), "old"), "labels")
        scratch.drop(step, labels)
        labels = jumped
        if labels.filter("label <> old").isEmpty():
            scratch.drop(both)
            return labels.select("id", "label")


def _block_pairs(limit: int, share: float, every: bool):
    """For the members of two blocks of a bucket: candidate pairs of different components.

    Pairs are within ``limit`` bits by their samples' odd sketches, and by those of the whole sets differ in no more
    bits than sets of the similarity ``share`` in elements, (a + b)(1 - share) / (1 + share).

    every: all of them, each only in the bucket of the smallest key that the two share. Else the nearest three
    partners of each member that isn't in the largest component.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        same = key[1] == key[2]
        pdf = pdf.drop_duplicates(["id", "block"])
        one = pdf if same else pdf[pdf["block"] == key[1]]
        two = pdf if same else pdf[pdf["block"] == key[2]]
        sketch = lambda x, name: np.array(x[name].tolist(), dtype=np.int64).reshape(len(x), -1).view(np.uint64)
        sides = [(one, two)] if same else [(one, two), (two, one)]
        if every:
            sides = sides[:1]
        a_out, b_out = [], []
        largest = pdf["label"].mode().iloc[0]
        for left, right in sides:
            left = left[left["label"] != largest] if not every or same or largest not in set(left["label"]) else left
            if not len(left) or not len(right):
                continue
            ls, rs, lw, rw = sketch(left, "sketch"), sketch(right, "sketch"), sketch(left, "whole"), sketch(right, "whole")
            l_lab, r_lab, l_id, r_id, l_n, r_n = (x.to_numpy() for x in (left["label"], right["label"], left["id"], right["id"], left["n"], right["n"]))
            if every:
                l_bands, r_bands = (np.array(x["bands"].tolist(), dtype=np.int64) for x in (left, right))
            for at in range(len(left)):
                d = np.bitwise_count(rs ^ ls[at]).sum(1)
                ok = np.flatnonzero((d <= limit) & (r_lab != l_lab[at]))
                if len(ok):
                    d = np.bitwise_count(rw[ok] ^ lw[at]).sum(1)
                    near = d * (1 + share) <= (r_n[ok] + l_n[at]) * (1 - share) + 1e-6
                    ok, d = ok[near], d[near]
                if every and len(ok):
                    common = np.where(r_bands[ok] == l_bands[at], l_bands[at], np.iinfo(np.int64).max).min(1)
                    ok = ok[common == key[0]]
                elif len(ok) > 3:
                    ok = ok[np.argsort(d, kind="stable")[:3]]
                a_out.append(np.full(len(ok), l_id[at]))
                b_out.append(r_id[ok])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_out, b_out))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def near_duplicates(docs: DataFrame, *, k: int = 5, share: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text).

    Documents are linked if their sets of distinct k-word shingles (A-Z lower-cased; the whole sequence if it has fewer
    words) have a Jaccard similarity of ``share`` or more. component_id is the smallest doc_id that a document reaches
    by links, kept marks that document. Null, empty and wordless texts have no shingle and no link. A null doc_id
    counts as the smallest and comes back as null. Rows with equal doc_ids are one document with the links of each of
    its texts. An empty table gives an empty table; other columns are ignored.

    1. Equal word sequences are one class, and only its smallest doc_id goes on: a class of any size is one text.
    2. Texts that share a band of MinHash samples are candidates (missed at a similarity of 0.8: 5 in 10^9). Each is
       tried with the smallest of its bucket first; pairs whose odd sketches say so are verified on the words.
    3. Buckets that then still hold several components: each member with its nearest three by sketch.
    4. What is left after that: all pairs of different components that the sketches admit. Groups of near copies are
       one component by then, so they aren't paired out, but no link is given up: every candidate pair is either
       verified, ruled out by its sketches, or within one component.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), "text")
    limit = tolerated(share)
    # Dealt by id once: later joins of signatures by id find them in place and move the other side alone.
    parts = bucket_count(docs.sparkSession, rows.count(), 4000)
    sig = scratch.hold(signatures(rows, k).repartition(parts, "id"))
    classes = sig.filter("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    classes = classes.filter("rep < last").drop("last")
    member = sig.join(classes, ["d1", "d2"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    member = scratch.keep(member, "members")
    copies = member.filter("id <> rep").select("id", F.col("rep").alias("other"))
    reps = sig.filter("n > 0").join(copies.select("id").distinct().repartition(parts, "id"), "id", "left_anti")

    keys = reps.select("id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    held = scratch.hold(keys.join(buckets, "key").select("key", "id", "hub", "c"))
    sketches = reps.select("id", "n", "bands", "sketch", "whole")

    def admitted(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that their samples' odd sketches don't rule out."""
        one, two = (sketches.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
        bits = sum((F.bit_count(F.get(F.col("sa"), F.lit(i)).bitwiseXOR(F.get(F.col("sb"), F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
        return scratch.keep(pairs.repartition(parts, "b").join(two, "b").join(one, "a").filter(bits <= limit).select("a", "b"), "near")

    def verified(pairs: DataFrame) -> DataFrame:
        ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        # Durable: to verify the pairs again would move their texts again.
        return scratch.keep(similar(pairs, rows.join(ids, "id", "left_semi"), k, share), "links")

    stars = scratch.keep(held.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    links, tried = verified(admitted(stars)), stars
    labels = components(links, scratch)
    open_buckets = held.filter("c > 2").select("key", "id", "c")
    for every in (False, True):
        now = open_buckets.join(labels, "id", "left").select("key", "id", "c", F.coalesce("label", "id").alias("label"))
        now = scratch.keep(now, "open")
        mixed = now.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
        mixed = scratch.keep(mixed, "mixed")
        if mixed.isEmpty():
            break
        open_buckets = scratch.keep(now.join(mixed, "key", "left_semi").select("key", "id", "c", "label"), "open")
        blocks = F.ceil(F.col("c") / BLOCK).cast("int")
        dealt = open_buckets.repartition(parts, "id").join(sketches if every else sketches.drop("bands"), "id").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        pairs = dealt.groupBy("key", "i", "j").applyInPandas(_block_pairs(limit, share, every), "a long, b long").distinct()
        pairs = scratch.keep(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        open_buckets = open_buckets.drop("label")
        if pairs.isEmpty():
            continue
        tried = tried.unionAll(pairs)
        links = links.unionAll(verified(pairs))
        labels = components(links, scratch)
    scratch.release()

    # A rep's label is the smallest of the reps that it reaches; each rep is the smallest of its class.
    out = member.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n", F.coalesce("label", "rep").alias("component"))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(back("id").alias("doc_id"), F.col("n").alias("n_shingles"), back("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: shingles, component, kept; two-word shingles and 80 %, cases as ``near_duplicates`` states them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, k=2, share=0.8)


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
t AS (SELECT s.doc_id, g, n FROM s JOIN n USING (doc_id)),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id AS id, doc_id AS top FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.top)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(top) AS component_id, doc_id = min(top) AS kept FROM r JOIN documents ON doc_id = id LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
