"""Token ids in binary files: bit or byte planes of fixed-size blocks, each compressed, behind an index of the blocks."""

from __future__ import annotations

import functools
import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import words
from evidara.llm.scratch import Scratch, filesystem

MAGIC = b"IDPLANE1"
#: Ids of a block; a reader decodes whole blocks.
BLOCK = 1 << 16
#: Text that is cut into pieces at once, and pieces whose ids a worker keeps.
STEP_BYTES, KNOWN_PIECES = 4 << 20, 400_000
#: Letters and digits, and marks that end a run of them (' may start a token with the letters behind it).
WORD = np.array([chr(i).isascii() and chr(i).isalnum() for i in range(256)])
MARK = np.array([33 <= i < 127 and not chr(i).isalnum() and chr(i) != "'" for i in range(256)])
MANIFEST = "part int, file string, n_docs long, n_ids long, n_blocks long, n_bytes long"


# -- texts to ids ------------------------------------------------------------------
def _ink(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes start a character that surely isn't white space, and which end one: printable ASCII and U+00C0 to U+00FF."""
    plain = (data > 32) & (data < 127)
    lead = data == 0xC3
    end = plain.copy()
    end[1:] |= lead[:-1]
    return plain | lead, end


def pieces(texts: pa.Array, whole: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts in order, number of pieces of each text).

    A text is cut before a space or line break behind ink (see ``_ink``), behind a line break between ink, and before a mark
    other than ' behind a letter or digit. Byte-level pre-tokenisers end a token at these places and never look back, so the
    ids of the pieces are those of the text. Texts marked in ``whole`` are one piece.
    """
    raw = texts.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    base, end = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(raw.buffers()[2], np.uint8)[base:end] if end > base else np.zeros(0, np.uint8)
    offsets = offsets - base
    first, last = _ink(data)
    starts = np.zeros(len(data) + 1, bool)
    starts[1:-1] = last[:-1] & (((data == 32) | (data == 10))[1:] | WORD[data[:-1]] & MARK[data[1:]])
    starts[2:-1] |= last[:-2] & (data[1:-1] == 10) & first[2:]
    for i in np.flatnonzero(whole) if whole is not None else ():
        starts[offsets[i] : offsets[i + 1]] = False
    starts[offsets[:-1]] = True  # also of an empty text, where the next text starts or all ends
    at = np.flatnonzero(starts[:-1])
    out = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data))
    return out, np.diff(np.searchsorted(at, offsets))


class Encoder:
    """Ids of texts by a byte-level tokenizer file; a piece that recurs is encoded once a step, the first KNOWN_PIECES or so once a worker.

    Distinct pieces that start with ink, or a space and ink, and end in ink are encoded as the lines of texts of about ROW
    bytes: a line break between them is always one id. As each id stands for as many bytes as its entry in the vocabulary
    has letters, the running sum of bytes tells where a piece's ids end. The few other pieces are encoded one by one.
    """

    ROW = 1 << 16

    def __init__(self, path: str, end: int, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.tokenizer.encode_special_tokens = not special
        self.special = list(self.tokenizer.get_added_tokens_decoder().values()) if special else []
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token)
        self.known, self.flat, self.sizes = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def distinct(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each)."""
        raw = found.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8) if len(raw) else np.zeros(0, np.uint8)
        first, last = _ink(data)
        a, b = offsets[:-1], offsets[1:]
        regular = last[b - 1] & (first[a] | (data[a] == 32) & (b - a > 1) & first[np.minimum(a + 1, b - 1)])
        counts = np.zeros(len(found), np.int64)
        ids = []
        sizes = (b - a)[regular] + 1  # with the line break
        row = np.cumsum(sizes) // self.ROW
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]]) if len(row) else [0]
        listed = found.filter(pa.array(regular)).to_pylist()
        for x, y, encoded in zip(cuts[:-1], cuts[1:], self.encoded(["\n".join(listed[x:y]) for x, y in zip(cuts[:-1], cuts[1:])])):
            behind = np.cumsum(self.size[encoded])
            # Places of the ids behind each piece's last; the line break's id is left out.
            ends = np.searchsorted(behind, np.cumsum(sizes[x:y]) - 1) + 1
            keep = np.ones(len(encoded), bool)
            keep[ends[:-1]] = False
            counts[np.flatnonzero(regular)[x:y]] = np.diff(ends, prepend=-1) - 1
            ids.append(encoded[keep])
        odd = self.encoded(found.filter(pa.array(~regular)).to_pylist())
        counts[~regular] = [len(x) for x in odd]
        # Regular pieces first; then each piece's ids are taken from there.
        flat = np.concatenate([*ids, *odd, np.zeros(0, np.uint32)])
        order = np.concatenate([np.flatnonzero(regular), np.flatnonzero(~regular)])
        starts = np.empty(len(found), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return flat[ragged(starts, counts)], counts

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text's followed by the end id; number of ids of each text with it)."""
        # A special string isn't cut.
        whole = [pc.match_substring(texts, t.content).fill_null(False).to_numpy(zero_copy_only=False) for t in self.special]
        cut, counts = pieces(texts, np.logical_or.reduce(whole) if whole else None)
        coded = cut.dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.known)
        new = coded.dictionary.filter(known.is_null())
        flat, size = self.distinct(new)
        # Where each distinct piece's ids stand: known ones, new ones, and the end id as one more piece behind each text.
        place = known.fill_null(0).to_numpy().astype(np.int64)
        place[known.is_null().to_numpy(zero_copy_only=False)] = np.arange(len(new)) + len(self.known)
        every, sizes = np.concatenate([self.flat, flat, np.array([self.end], np.uint32)]), np.concatenate([self.sizes, size, [1]])
        codes = np.insert(place[coded.indices.to_numpy(zero_copy_only=False)], np.cumsum(counts), len(sizes) - 1)
        n = sizes[codes]
        before, last = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(counts + 1)])
        if len(self.known) < KNOWN_PIECES:
            self.known, self.flat, self.sizes = pa.concat_arrays([self.known, new]), every[:-1], sizes[:-1]
        return every[ragged((np.cumsum(sizes) - sizes)[codes], n)], np.diff(before[last])


@functools.lru_cache(1)
def encoder(path: str, end: int, special: bool) -> Encoder:
    """The worker's encoder; it lives on from task to task."""
    return Encoder(path, end, special)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... up to counts[0] of them, then from starts[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


# -- the file format ---------------------------------------------------------------
def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block, lowest first, up to the highest that isn't empty: bit k of all ids, or byte k of all ids."""
    top = int(ids.max(initial=0)).bit_length()
    if kind == "bit":
        return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little").tobytes() for k in range(top)]
    return [np.ascontiguousarray(ids.astype("<u4").view(np.uint8)[k::4]).tobytes() for k in range((top + 7) // 8)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        part = np.unpackbits(raw, count=n, bitorder="little") if kind == "bit" else raw
        out |= part.astype(np.uint32) << np.uint32(k if kind == "bit" else 8 * k)
    return out


class Writer:
    """A file: magic, blocks, footer (zipped arrays), the footer's length and magic again.

    The footer has each block's place, number of ids, sizes of its planes and crc32 (of its ids as little-endian 32-bit
    integers), and each document's id (and whether it is null) and number of ids. Nothing of a file is held but the
    block that fills and the footer.
    """

    def __init__(self, out, kind: str, block: int):
        self.out, self.kind, self.block = out, kind, block
        self.rest: list[np.ndarray] = []
        self.n_rest = self.n_ids = 0
        self.places, self.counts, self.sizes, self.crcs = [len(MAGIC)], [], [], []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.zip = zstandard.ZstdCompressor(level=3)
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids, nulls, lens))
        self.n_ids += len(ids)
        while self.n_rest + len(ids) >= self.block:
            cut = self.block - self.n_rest
            self._flush(np.concatenate([*self.rest, ids[:cut]]))
            self.rest, self.n_rest, ids = [], 0, ids[cut:]
        self.rest.append(ids.copy())
        self.n_rest += len(ids)

    def _flush(self, ids: np.ndarray) -> None:
        packed = [self.zip.compress(p) for p in to_planes(ids, self.kind)]
        self.out.write(b"".join(packed))
        self.places.append(self.places[-1] + sum(map(len, packed)))
        self.counts.append(len(ids))
        self.sizes.append([len(p) for p in packed] + [0] * (32 - len(packed)))
        self.crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))

    def close(self) -> tuple[int, int, int, int]:
        """Numbers of documents, ids, blocks and bytes."""
        if self.n_rest:
            self._flush(np.concatenate(self.rest))
        doc_ids, nulls, lens = (np.concatenate(x) for x in zip(*self.docs))
        footer = io.BytesIO()
        np.savez_compressed(
            footer, kind=np.array(self.kind), places=np.array(self.places, np.uint64), counts=np.array(self.counts, np.uint32),
            sizes=np.array(self.sizes, np.uint32).reshape(-1, 32), crcs=np.array(self.crcs, np.uint32), doc_ids=doc_ids.astype(np.int64), nulls=nulls.astype(bool), lens=lens.astype(np.int64),
        )
        raw = footer.getvalue()
        self.out.write(raw + struct.pack("<Q", len(raw)) + MAGIC)
        return len(lens), self.n_ids, len(self.counts), self.places[-1] + len(raw) + 16


class Reader:
    """Random access to a file of ``Writer``; only blocks that are asked for are read."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 16)
        tail = source.read(16)
        source.seek(0)
        if tail[8:] != MAGIC or source.read(8) != MAGIC:
            raise ValueError("not a file of id planes")
        length = struct.unpack("<Q", tail[:8])[0]
        source.seek(size - 16 - length)
        with np.load(io.BytesIO(source.read(length))) as kept:
            self.kind, self.places, self.counts, self.sizes, self.crcs = str(kept["kind"]), kept["places"].astype(np.int64), kept["counts"].astype(np.int64), kept["sizes"], kept["crcs"]
            self.doc_ids, self.nulls, self.lens = kept["doc_ids"], kept["nulls"], kept["lens"]
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])
        self.unzip = zstandard.ZstdDecompressor()

    def block(self, k: int) -> np.ndarray:
        self.source.seek(int(self.places[k]))
        raw, at, planes = self.source.read(int(self.places[k + 1] - self.places[k])), 0, []
        for n in self.sizes[k][self.sizes[k] > 0]:
            planes.append(self.unzip.decompress(raw[at : at + int(n)]))
            at += int(n)
        ids = from_planes(planes, int(self.counts[k]), self.kind)
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.crcs[k]:
            raise ValueError(f"block {k} is damaged")
        return ids

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop (exclusive), numbered within the file."""
        first, last = np.searchsorted(self.firsts, start, side="right") - 1, np.searchsorted(self.firsts, stop, side="left")
        parts = [self.block(k) for k in range(int(first), int(last))] if stop > start else []
        return np.concatenate(parts)[start - self.firsts[first] : stop - self.firsts[first]] if parts else np.zeros(0, np.uint32)

    def stream(self) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(document, some of its ids, are these its last) in order, a block at a time."""
        ends, d, done = np.cumsum(self.lens), 0, 0
        for k in range(len(self.counts)):
            ids, at = self.block(k), 0
            while at < len(ids):
                take = min(int(ends[d]) - done, len(ids) - at)
                done, at = done + take, at + take
                yield d, ids[at - take : at], done == ends[d]
                d += done == ends[d]


# -- Spark -------------------------------------------------------------------------
def open_folder(spark: SparkSession, folder: str) -> str:
    """The folder's full address for readers in Python workers (local, HDFS, S3, GCS or Azure paths)."""
    fs, path = filesystem(spark, folder)
    at = fs.makeQualified(path(folder)).toString()
    return "file://" + at[5:] if at.startswith("file:/") and not at.startswith("file://") else at


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, *, end: int = 0, kind: str = "bit", block: int = BLOCK, special: bool = True) -> DataFrame:
    """Writes the ids of documents (doc_id, text) in ascending doc_id and returns the manifest, a row for each file.

    Files hold consecutive ranges of doc_id; ``part`` orders them. Each text's ids are followed by ``end``; null and
    empty texts give ``end`` alone. A null doc_id comes first; rows that share one are in the order of a hash of their
    text. ``kind`` is "bit" or "byte" planes; ``special``: the tokenizer's special strings in a text count as such tokens.
    An empty table gives no files. Other columns are not read.

    Rows are dealt by ranges of doc_id, then by hash and row, so no id or text makes a large file. A task streams its rows
    into a file under a name of its own; the manifest, which Spark commits, names the files of the tasks that succeeded,
    so what a lost or repeated task has left is never read.
    """
    spark = docs.sparkSession
    fs, path = filesystem(spark, folder)
    fs.mkdirs(path(folder))
    at = open_folder(spark, folder)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = out = name = None
        encode = encoder(tokenizer, end, special)
        for batch in source:
            for part in words.steps(batch, limit=STEP_BYTES):
                if writer is None:
                    store, root = pyarrow.fs.FileSystem.from_uri(at)
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
                    out = store.open_output_stream(f"{root}/{name}")
                    writer = Writer(out, kind, block)
                ids, lens = encode(part.column("text"))
                who = part.column("doc_id")
                writer.add(who.fill_null(0).to_numpy(zero_copy_only=False), who.is_null().to_numpy(zero_copy_only=False), lens, ids)
        if writer is not None:
            figures = writer.close()
            out.close()
            row = {"part": [TaskContext.get().partitionId()], "file": [name], **{k: [v] for k, v in zip(("n_docs", "n_ids", "n_blocks", "n_bytes"), figures)}}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("file", pa.string()), *((k, pa.int64()) for k in list(row)[2:])]))

    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _read(spark: SparkSession, folder: str, each, schema: str) -> DataFrame:
    """Rows that ``each`` (reader, id before the file) yields as batches, a task for each file; the list of files is known to all tasks."""
    at, files, before = open_folder(spark, folder), [], 0
    for r in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("part").collect():  # as many rows as files
        files.append((r["file"], before))
        before += r["n_ids"]
    known = spark.sparkContext.broadcast(files)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(at)
        for batch in source:
            for k in batch.column(0).to_pylist():
                name, first = known.value[k]
                with store.open_input_file(f"{root}/{name}") as f:
                    yield from each(Reader(f), first)

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, schema)


def _batches(rows: Iterator[tuple], reader: Reader, first: int, name: str, kind: pa.DataType, weight) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, start, n_tokens, name) of rows (document, value), small enough by ``weight``."""
    starts = first + np.cumsum(reader.lens) - reader.lens
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        d = np.array([x[0] for x in held])
        ids = pa.array(reader.doc_ids[d], pa.int64(), mask=reader.nulls[d])
        return pa.RecordBatch.from_arrays([ids, pa.array(starts[d]), pa.array(reader.lens[d]), pa.array([x[1] for x in held], kind)], names=["doc_id", "start", "n_tokens", name])

    for row in rows:
        held.append(row)
        size += weight(row[1])
        if size >= 1 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document in the files of ``write_tokens``; start counts the ids before it."""

    def each(reader: Reader, first: int) -> Iterator[pa.RecordBatch]:
        def rows():
            parts: list[np.ndarray] = []
            for d, ids, last in reader.stream():
                parts.append(ids)
                if last:
                    yield d, np.concatenate(parts).astype(np.int64)
                    parts = []

        return _batches(rows(), reader, first, "ids", pa.list_(pa.int64()), len)

    return _read(spark, folder, each, "doc_id long, start long, n_tokens long, ids array<long>")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document; a text of any length passes in blocks."""

    def each(reader: Reader, first: int) -> Iterator[pa.RecordBatch]:
        def rows():
            crc = 0
            for d, ids, last in reader.stream():
                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                if last:
                    yield d, crc
                    crc = 0

        return _batches(rows(), reader, first, "ids_crc32", pa.int64(), lambda _: 32)

    return _read(spark, folder, each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_file() -> str:
    """The public byte-level vocabulary; every worker finds the package in its own installation."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: first id's number, number of ids with the end id, crc32 of the ids, all read back from the files.

    Cases (nulls, empty and repeated rows, empty tables) are those of ``write_tokens``.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = f"{Scratch(spark, 'ids').root}/tokens"
    write_tokens(docs, folder, tokenizer_file())
    return token_digests(spark, folder)
