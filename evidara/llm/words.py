"""Words of Arrow batches: runs of anything but space and the bytes 09 to 0D."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one step holds as words at a time; a longer text makes a step of its own.
STEP_BYTES = 2 << 20
#: The C library's call that gives free pages back; None where it has none.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system, as workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of about ``limit`` bytes of ``column`` and ``rows`` rows at most, each of one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(size, before + limit, side="right"))))
        yield batch.slice(at, end - at)
        at = end
    give_back()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and the number of words of each text (a null has none)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    lens = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])
    ends = np.cumsum(lens)
    counts = before[ends] - before[ends - lens]
    return flat.filter(pa.array(full)), counts


def encode(words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """The words as positions in the list of the distinct ones."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary()).to_pylist()


def hash_distinct(distinct: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in distinct), np.uint64, len(distinct))


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; the same on every machine."""
    codes, distinct = encode(words)
    return hash_distinct(distinct, seed)[codes] if len(distinct) else np.zeros(0, np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers without visible structure (xor-shift-multiply rounds)."""
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of the k hashes from each position on; positions with fewer than k to come are dropped."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, b = hashes[:n].copy(), np.uint64(base | 1)
    for j in range(1, k):
        out *= b
        out += hashes[j : j + n]
    return mix(out, k)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each text, text of each word, and place of each word in its text."""
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    return starts, owner, np.arange(int(counts.sum())) - np.repeat(starts, counts)
