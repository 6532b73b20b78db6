"""Spelling variants: words one edit apart meet on hashes of themselves less one letter."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import words
from evidara.llm.scratch import Scratch

#: A to Z and a to z; the letters from U+00C0 to U+00FF are 0xC3 and one more byte in UTF-8.
ASCII_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Hash of each letter, and the base of the polynomials with its inverse modulo 2^64.
LETTER = words.mix(np.arange(1, 257, dtype=np.uint64), 11)
BASE = 0x9E3779B97F4A7C15
INVERSE = np.uint64(pow(BASE, -1, 1 << 64))
KEYS = "key long, start int, stop int, id long"
#: An ``alter`` gets (distinct runs, run of each pair, row of each pair, doc_ids) and gives the words that replace pairs, by pair.
Alter = Callable[[list[bytes], np.ndarray, np.ndarray, list], dict[int, bytes]]


# -- words and their numbers ---------------------------------------------------------
def letter_runs(texts: pa.Array, least: int) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of [A-Za-z\\u00C0-\\u00FF] of ``least`` code points or more, A-Z lower-cased, and the text of each."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    base, end = int(offsets[0]), int(offsets[-1])
    if end == base:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    data, offsets = np.frombuffer(raw.buffers()[2], np.uint8)[base:end], offsets - base
    lead = data == 0xC3
    letter = ASCII_LETTER[data] | lead
    letter[1:] |= lead[:-1]
    starts, ends = letter.copy(), letter.copy()
    starts[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # where one text ends and another starts
    starts[inner], ends[inner - 1] = letter[inner], letter[inner - 1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    long = (b - a) - (leads[b] - leads[a]) >= least
    a, b = a[long], b[long]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[a] += 1
    edge[b] -= 1
    flat = LOWER[data[np.cumsum(edge[:-1], dtype=np.int8) > 0]]
    at = np.concatenate([[0], np.cumsum(b - a)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(a), pa.py_buffer(at), pa.py_buffer(flat)), np.searchsorted(offsets, a, side="right") - 1


def count_words(docs: DataFrame, least_chars: int, least_count: int, alter: Alter | None = None) -> DataFrame:
    """(word, n) of the words with so many code points and occurrences over all rows."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in words.steps(batch, limit=8 << 20):
                found, owner = letter_runs(part.column("text"), least_chars)
                coded = found.dictionary_encode()
                codes, kinds = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
                word, n = coded.dictionary, np.bincount(codes, minlength=kinds)
                if alter and kinds:
                    pair, times = np.unique(owner * kinds + codes, return_counts=True)
                    distinct = word.cast(pa.binary()).to_pylist()
                    new = alter(distinct, pair % kinds, pair // kinds, part.column("doc_id").to_pylist())
                    at = np.fromiter(new, np.int64, len(new))
                    np.subtract.at(n, pair[at] % kinds, times[at])
                    word = pa.concat_arrays([word, pa.array(list(new.values()), pa.binary()).cast(pa.string())])
                    n = np.concatenate([n, times[at]])
                keep = (n > 0) & (pc.utf8_length(word).to_numpy(zero_copy_only=False) >= least_chars)
                yield pa.RecordBatch.from_arrays([word.filter(pa.array(keep)), pa.array(n[keep].astype(np.int64))], names=["word", "n"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# -- deletion keys -------------------------------------------------------------------
def letters(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (all below 256) of all words in order, and each word's number of them."""
    raw = found.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    lead = data == 0xC3
    points = data + np.concatenate([[0], lead[:-1] * 64]).astype(np.uint8)
    before = np.concatenate([[0], np.cumsum(~lead)])
    return points[~lead], np.diff(before[offsets - offsets[0]])


def deletion_keys(points: np.ndarray, lens: np.ndarray, key_bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, start, stop, key) for each word itself (start and stop -1) and for each text that a word is without one letter.

    Deleting any of a row of equal letters gives one text, so a row from start to stop (inclusive) has one entry. A word's
    hash is the sum of LETTER[c_k] * BASE^k. Sums up to and behind a place are the hashes of prefix and suffix, and the hash
    without the place is prefix + suffix / BASE: a few steps a letter, whatever the word's length.
    """
    starts = np.cumsum(lens) - lens
    owner = np.repeat(np.arange(len(lens)), lens)
    pos = np.arange(len(points)) - starts[owner]
    power = np.full(int(lens.max(initial=1)) + 1, BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    term = LETTER[points] * power[pos]
    upto = np.cumsum(term)
    before = (upto - term)[starts] if len(starts) else upto[:0]
    whole = upto[starts + lens - 1] - before
    first = np.ones(len(points), bool)
    first[1:] = (points[1:] != points[:-1]) | (pos[1:] == 0)
    at = np.flatnonzero(first)
    mine = owner[at]
    key = (upto - term)[at] - before[mine] + INVERSE * (whole[mine] - (upto[at] - before[mine]))
    last = np.append(at[1:], len(points)) - 1
    key = words.mix(np.concatenate([whole, key]), 12) >> np.uint64(64 - key_bits)
    itself = np.full(len(lens), -1)
    return np.concatenate([np.arange(len(lens)), mine]), np.concatenate([itself, pos[at]]), np.concatenate([itself, pos[last]]), key


def deletions(vocabulary: DataFrame, key_bits: int) -> DataFrame:
    """(key, start, stop, id) of each word of ``vocabulary`` (id, word)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in words.steps(batch, "word", 1 << 20):
                who, start, stop, key = deletion_keys(*letters(part.column("word")), key_bits)
                columns = [key.view(np.int64), start.astype(np.int32), stop.astype(np.int32), part.column("id").to_numpy()[who]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "start", "stop", "id"])

    return vocabulary.select("id", "word").mapInArrow(run, KEYS)


def dealt(rows: DataFrame, *then: object) -> DataFrame:
    """Rows by the key's leading bits, each partition sorted by key (a radix sort of longs), then as named."""
    return rows.repartition(F.shiftrightunsigned("key", 48)).sortWithinPartitions("key", *then)


def by_key(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a key ends. Words that share a key are few: a letter more or another letter at one of its places."""
    held: list[pa.RecordBatch] = []
    for batch in source:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = batch.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or held[0].column("key")[0].as_py() != keys[-1]:
            rest = batch.slice(cut)
            held[-1] = batch.slice(0, cut)
            yield pa.concat_batches(held)
            held = [rest]
    if held:
        yield pa.concat_batches(held)


def shared(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key another row has."""
    for batch in by_key(source):
        key = batch.column("key").to_numpy()
        same = key[1:] == key[:-1]
        yield batch.filter(pa.array(np.append(same, False) | np.insert(same, 0, False)))


def groups(key: np.ndarray, start: np.ndarray, word: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows in order, group of each) of equal texts: the words, or the words without their letter at start. Equal keys of different texts are told apart."""
    group = np.cumsum(np.insert(key[1:] != key[:-1], 0, False))
    text = [w if p < 0 else w[:p] + w[p + 1 :] for w, p in zip(word, start.tolist())]
    head = np.searchsorted(group, np.arange(group[-1] + 1))
    odd = {int(g) for g, t, s in zip(group, text, head[group].tolist()) if t != text[s]}
    if not odd:
        return np.arange(len(key)), group
    names: dict[tuple, int] = {}
    group = np.array([names.setdefault((g, t if g in odd else ""), len(names)) for g, t in zip(group.tolist(), text)])
    order = np.argsort(group, kind="stable")
    return order, group[order]


def links(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, near, form_n, form): so many near words of a word, and the best of them; a word's rows add up to its near words.

    Rows come by key, falling n and word. Words of one text that hold their extra letter at one place differ by that letter: each has
    all others of the place as near words, the best being the first or, for the first, the second. Two words share one
    place at most, and it is an end of one's row of letters; so a row counts at the ends that lie in it. A word that is the
    text itself is a letter short of all others of the group. No pairs within a group are made.
    """
    for batch in by_key(source):
        order, group = groups(batch.column("key").to_numpy(), batch.column("start").to_numpy(), batch.column("word").to_pylist())
        ids, n = batch.column("id").to_numpy()[order], batch.column("n").to_numpy()[order]
        start, stop = (batch.column(c).to_numpy()[order].astype(np.int64) for c in ("start", "stop"))
        own = np.full(group[-1] + 1, -1)
        own[group[start < 0]] = np.flatnonzero(start < 0)
        longer = np.flatnonzero((start >= 0) & (own[group] >= 0))
        shorter = own[group[longer]]

        with_letter = np.flatnonzero(start >= 0)
        width = int(stop.max(initial=0)) + 1
        low, high = (group[with_letter] * width + x[with_letter] for x in (start, stop))
        ends = np.unique(np.concatenate([low, high]))
        a, b = np.searchsorted(ends, low), np.searchsorted(ends, high, side="right")
        row = np.repeat(with_letter, b - a)
        place = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a) - a, b - a)
        sort = np.argsort(place, kind="stable")
        row, place = row[sort], place[sort]
        size, head = np.bincount(place, minlength=len(ends))[place], np.searchsorted(place, place)
        at = np.flatnonzero(size > 1)
        best = row[np.where(head[at] == at, at + 1, head[at])]

        to = np.concatenate([row[at], longer, shorter])
        near = np.concatenate([size[at] - 1, np.ones(2 * len(longer), np.int64)]).astype(np.int64)
        best = np.concatenate([best, shorter, longer])
        columns = [pa.array(ids[to]), pa.array(near), pa.array(n[best]), batch.column("word").take(pa.array(order[best]))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "near", "form_n", "form"])


def spelling_variants(docs: DataFrame, *, least_chars: int = 5, least_count: int = 3, times: int = 2, alter: Alter | None = None, key_bits: int = 64) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``docs`` (doc_id, text).

    Words are maximal runs of [A-Za-z\\u00C0-\\u00FF], A-Z lower-cased, of ``least_chars`` code points and ``least_count`` occurrences (n). Two are near if one letter inserted, deleted or replaced makes one the other;
    n_near counts a word's near words. form: its near word of greatest n (ties: smallest in code-point order) if that n, form_n, is ``times`` its own or more, else both are null. root: where the forms lead, the word itself without a form.

    Every row counts, also when rows repeat; null and empty texts have no words, an empty table gives an empty table, other columns aren't read. A run may have any length.
    ``alter`` may replace runs of a document before they are counted (a null doc_id is handed on as None).

    Counts are summed in each step and task before the shuffle, so a frequent word is one row a task. A word of L letters takes L + 1 rows of 24 bytes by key at most; only rows whose key another word has meet their words again, where the texts are compared.
    No group is large: the words of a key differ at one place. ``key_bits`` is for tests (few bits make keys collide).
    """
    if times < 2:
        raise ValueError("a form must be twice as frequent at least, else forms may lead in a circle")
    spark = docs.sparkSession
    scratch = Scratch(spark, "spelling")
    vocabulary = count_words(docs, least_chars, least_count, alter).withColumn("id", F.monotonically_increasing_id())
    vocabulary = scratch.keep(vocabulary, "vocabulary")  # ids hold from here on
    rows = dealt(deletions(vocabulary, key_bits)).mapInArrow(shared, KEYS)
    rows = dealt(rows.join(vocabulary, "id"), F.desc("n"), "word").select("key", "start", "stop", "id", "n", "word")
    found = rows.mapInArrow(links, "id long, near long, form_n long, form string")
    found = found.groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    enough = -F.col("best.less") >= F.col("n") * times
    out = vocabulary.join(found, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )
    out = scratch.keep(out, "forms")

    # Counts double at least with each form, so a chain is short; each round doubles how far a root is looked up.
    roots = scratch.keep(out.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.keep(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if new.filter("moved").isEmpty():
            break
        roots = new.select("word", "root")
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def drop_letters(distinct: list[bytes], run: np.ndarray, row: np.ndarray, doc_ids: list) -> dict[int, bytes]:
    """The query's planted variants: a run of a document loses a letter if 97 divides the crc32 h of "doc_id:run", the one at h modulo its length; rows without doc_id lose none."""
    starts = [zlib.crc32(b"%d:" % i) if i is not None else None for i in doc_ids]
    none = {k for k, s in enumerate(starts) if s is None}
    h = np.fromiter(map(zlib.crc32, map(distinct.__getitem__, run.tolist()), ((starts[r] or 0) for r in row.tolist())), np.int64, len(run))
    out = {}
    for p in np.flatnonzero(h % 97 == 0).tolist():
        if row[p] not in none:
            word = distinct[run[p]].decode()
            at = int(h[p]) % len(word)
            out[p] = (word[:at] + word[at + 1 :]).encode()
    return out


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their forms and roots; cases are those of ``spelling_variants`` and ``drop_letters``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(docs, alter=drop_letters)
