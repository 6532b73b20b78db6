"""Runs of repeating words: lags are tested on big-integer bit planes of word ids."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidara.llm import words
from evidara.llm.scratch import others

#: A run has this many words and repeats its period this often, at least.
LEAST_WORDS, LEAST_TIMES = 6, 4


def bits(at: int, n: int) -> np.ndarray:
    """Places of the ones among the n lowest bits."""
    raw = np.frombuffer(at.to_bytes((n + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, count=n, bitorder="little"))


class Planes:
    """Word ids of a text as big integers: bit i of plane k is bit k of the i-th word's id."""

    def __init__(self, ids: np.ndarray):
        _, ids = np.unique(ids, return_inverse=True)
        self.n = len(ids)
        self.planes = [
            int.from_bytes(np.packbits((ids >> k) & 1, bitorder="little").tobytes(), "little")
            for k in range(int(ids.max(initial=0)).bit_length())
        ]

    def stretches(self, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(first place, number of places) of all stretches of ``least`` places or more whose words recur ``lag`` words on."""
        differs = 0
        for plane in self.planes:
            differs |= plane ^ (plane >> lag)
        same = ~differs & ((1 << (self.n - lag)) - 1)
        # After each step a bit stands where so many places from it on are ones; the number doubles up to ``least``.
        have = 1
        while have < least and same:
            step = min(have, least - have)
            same &= same >> step
            have += step
        if not same:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, last = bits(same & ~(same << 1), self.n), bits(same & ~(same >> 1), self.n)
        return first, last - first + least


def primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def unexplained(at: np.ndarray, lag: np.ndarray, known: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hits whose words [at, at + lag) are in no known run of a period that divides the lag.

    Two runs of one period share fewer words than it, so the last run that starts before a hit is the one to look at.
    """
    by: dict[int, list[tuple[int, int]]] = {}
    for start, length, period in known:
        by.setdefault(period, []).append((start, start + length))
    for period, spans in by.items():
        if not len(at):
            break
        starts, ends = np.array(sorted(spans)).T
        k = np.searchsorted(starts, at, side="right") - 1
        inside = (lag % period == 0) & (k >= 0) & (at + lag <= ends[k])
        at, lag = at[~inside], lag[~inside]
    return at, lag


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period.

    A run of period q has equal words q apart at 3q consecutive places or more (one place per word that has a word q
    later). Such a stretch holds a whole block [j, j + b) of places for some multiple j of b, if b <= 1.5 q. So lags of
    an octave [2^e, 2^(e+1)) are looked at in anchors j, 1.5 * 2^e apart: a lag without an anchor whose words recur has
    no run. For the lags that are left, the stretches come from the planes of the whole text. This takes about n log n steps for
    all lags and n / 30 for each that is left, where every lag would take n^2 / 120 a plane.

    A hit of lag q whose words lie within a known run of a period that divides q belongs to that run (q equal words
    of it fix all others), so texts that only repeat don't ask for each multiple of their period.
    """
    n, out, planes = len(ids), [], None
    octave = 1
    while LEAST_TIMES * octave <= n:
        block = max(1, 3 * octave // 2)
        top = min(2 * octave, n // LEAST_TIMES + 1)
        lags = np.arange(octave, top)
        anchors = np.arange(0, n - octave - block + 1, block)
        # Rows of anchors at a time, so that a very long text needs little memory.
        hit_at, hit_lag = [], []
        rows = max(1, (1 << 20) // len(lags))
        for a in range(0, len(anchors), rows):
            j = anchors[a : a + rows, None]
            there = j + lags + block <= n
            hit = there & (ids[j] == ids[np.minimum(j + lags, n - 1)])
            where, which = np.nonzero(hit)
            at, lag = anchors[a + where], lags[which]
            for t in (block - 1, block // 2, block // 4, 3 * block // 4, block // 8, 1):
                if t < block and len(at):
                    still = ids[at + t] == ids[at + t + lag]
                    at, lag = at[still], lag[still]
            hit_at.append(at)
            hit_lag.append(lag)
        at, lag = np.concatenate(hit_at or [lags[:0]]), np.concatenate(hit_lag or [lags[:0]])
        if len(at):
            at, lag = unexplained(at, lag, out)
        for q in np.unique(lag).tolist():
            planes = planes or Planes(ids)
            for s, m in zip(*planes.stretches(q, max(LEAST_WORDS - q, (LEAST_TIMES - 1) * q))):
                s, m = int(s), int(m)
                # The period is the smallest unless the first q words repeat a shorter one.
                if not any(np.array_equal(ids[s : s + q], ids[s + q // p : s + q + q // p]) for p in primes(q)):
                    out.append((s, m + q, q))
        octave *= 2
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Is a word in any run behind that run's first period?"""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def periodic_runs(docs: DataFrame, change: Callable[[np.ndarray, object], np.ndarray] | None = None) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period by start and period) and collapsed (words left, joined by a space).

    A run is a stretch of consecutive words with smallest period q and a length of max(6, 4 q) or more that no
    neighbouring word extends; runs may overlap. A word goes if any run holds it behind that run's first q words. Words
    compare byte by byte. Null, empty and wordless texts have no words, no runs and an empty collapsed text. Rows count by
    themselves, so repeats and ids play no part; there are no ties. An empty table gives an empty table. Other columns
    pass through; n_words, runs and collapsed are replaced, in whatever case.

    ``change`` (word codes, doc_id) may rearrange a text's words before. A row is worked on where it is read, without a
    shuffle; memory goes with a step of text and the longest text.
    """
    columns = others(docs, "n_words", "runs", "collapsed")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in words.steps(batch):
                flat, counts = words.split(part.column("text"))
                coded = flat.dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                ids = part.column("doc_id").to_pylist() if change else [None] * part.num_rows
                found, kept, left = [], [], np.zeros(part.num_rows, np.int64)
                for i, (end, n) in enumerate(zip(np.cumsum(counts).tolist(), counts.tolist())):
                    own = codes[end - n : end]
                    if change:
                        own = change(own, ids[i])
                    found.append(runs(own))
                    kept.append(own[~repeated(found[-1], n)] if found[-1] else own)
                    left[i] = len(kept[-1])
                chosen = coded.dictionary.take(pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32)), chosen)
                new = {
                    "n_words": pa.array(counts),
                    "runs": pa.array([[{"start": s, "length": m, "period": q} for s, m, q in x] for x in found], kind),
                    "collapsed": pc.binary_join(lists, " "),
                }
                names = [*columns, *new]
                yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(c) for c in names], names=names)

    new = StructType.fromDDL("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return docs.mapInArrow(run, StructType([*docs.select(columns).schema, *new]))


def repeat_tail(codes: np.ndarray, doc_id: object) -> np.ndarray:
    """The query's planted runs: in texts whose id has a crc32 that 10 divides, words from one on repeat; others stay, as does a null id's."""
    n = len(codes)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return codes
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = codes.copy()
    out[a:] = codes[a + np.arange(n - a) % p]
    return out


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of runs, the longest one, digests of all runs and of the collapsed text.

    Cases are those of ``periodic_runs``; texts get the runs of ``repeat_tail`` first. Without a run the longest one's columns are null.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs, repeat_tail)
    # The greatest by length, then the smallest start and period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"), "collapsed").select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("best.length * 1000 div -best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
