"""Nearest neighbours by score-aware (anisotropic) product quantisation: four-bit table scans, exact distances, and bounds that rule out the rest."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm import sampling
from evidara.llm.scratch import Scratch

CENTRES = 16
#: Rows that are scanned at a time, and how many of them are measured exactly for a query if nothing else is asked for.
CHUNK, EXACT = 8192, 64
#: Rows that the bounds leave are measured so many at a time, and what rounding may take from a bound, relative to the squares.
STEP, ROUNDING = 1024, 1e-6
#: Queries of one broadcast block at most, and bytes of its tables in a task.
QUERIES, TABLES = 1024, 64 << 20
#: Columns of one least-squares solution; more centres are solved in groups, one after another.
COLUMNS = 2048


@dataclass
class Codebook:
    """Centres of each part of the dimensions: a list of (CENTRES, width of the part)."""

    parts: list[np.ndarray]
    extra: float

    @property
    def bounds(self) -> np.ndarray:
        return np.cumsum([0, *(c.shape[1] for c in self.parts)])

    def assign(self, x: np.ndarray, passes: int = 3) -> np.ndarray:
        """Codes by coordinate descent on |r|^2 + extra * (r . x / |x|)^2, r = x - its quantised form, part by part."""
        b, n = self.bounds, len(x)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        codes = np.zeros((n, len(self.parts)), np.uint8)
        along = np.zeros((n, len(self.parts)))  # residual of each part along x
        for m, c in enumerate(self.parts):
            part = x[:, b[m] : b[m + 1]]
            d = ((part[:, None, :] - c) ** 2).sum(2)
            codes[:, m] = d.argmin(1)
            along[:, m] = ((part - c[codes[:, m]]) * unit[:, b[m] : b[m + 1]]).sum(1)
        for _ in range(passes):
            for m, c in enumerate(self.parts):
                part, u = x[:, b[m] : b[m + 1]], unit[:, b[m] : b[m + 1]]
                r = part[:, None, :] - c
                p = (r * u[:, None, :]).sum(2)
                loss = (r**2).sum(2) + self.extra * (p + (along.sum(1) - along[:, m])[:, None]) ** 2
                codes[:, m] = loss.argmin(1)
                along[:, m] = p[np.arange(n), codes[:, m]]
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, m]] for m, c in enumerate(self.parts)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query with both centres that a byte of a packed code names: (queries, bytes, 256)."""
        b = self.bounds
        flat = np.stack([q[:, b[m] : b[m + 1]] @ c.T for m, c in enumerate(self.parts)], axis=1)
        return (flat[:, 0::2, :, None] + flat[:, 1::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES).astype(np.float32)


def pack(codes: np.ndarray) -> np.ndarray:
    return (codes[:, 0::2] << 4 | codes[:, 1::2]).astype(np.uint8)


def _solve(book: Codebook, group: range, codes: np.ndarray, sample: np.ndarray, unit: np.ndarray, rest: np.ndarray, edges: np.ndarray, rng) -> None:
    """New centres for the parts of a group by least squares, the others fixed; ``rest`` is what those leave along each vector."""
    n, offset = len(sample), np.cumsum([0, *(book.parts[m].size for m in group)])
    design = np.zeros((n, offset[-1]), np.float32)
    target, hits = np.zeros(offset[-1]), np.zeros(offset[-1])
    for at, m in zip(offset, group):
        width = edges[m + 1] - edges[m]
        cols = at + codes[:, m].astype(int)[:, None] * width + np.arange(width)
        np.put_along_axis(design, cols, unit[:, edges[m] : edges[m + 1]].astype(np.float32), 1)
        np.add.at(target, cols, sample[:, edges[m] : edges[m + 1]])
        np.add.at(hits, cols, 1.0)
    gram = book.extra * (design.T @ design).astype(float) + np.diag(np.maximum(hits, 1e-3))
    solved = np.linalg.solve(gram, target + book.extra * (design.T @ rest.astype(np.float32)))
    for at, end, m in zip(offset, offset[1:], group):
        new = solved[at:end].reshape(CENTRES, -1)
        empty = hits[at:end].reshape(CENTRES, -1).sum(1) == 0
        new[empty] = sample[rng.choice(n, int(empty.sum())), edges[m] : edges[m + 1]]
        book.parts[m] = new


def fit(sample: np.ndarray, *, threshold: float = 0.2, rounds: int = 5, seed: int = 3) -> Codebook:
    """Centres that minimise the anisotropic loss over the sample.

    For queries spread evenly, of inner products above ``threshold`` the residual along the vector weighs
    (d - 1) t^2 / (1 - t^2) times the rest. Rounds of assignment and of a least-squares solution for the centres, all at
    once up to COLUMNS of them and in groups beyond, so memory grows with the sample and not with the square of d.
    """
    rng = np.random.default_rng(seed)
    n, d = sample.shape
    count = 2 * max(1, math.ceil(d / 4))  # parts of two dimensions or so; an even number, for whole bytes
    edges = np.linspace(0, d, count + 1).round().astype(int)
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    pick = rng.choice(n, CENTRES, replace=n < CENTRES)
    book = Codebook([sample[pick, edges[m] : edges[m + 1]].astype(float) for m in range(count)], eta - 1)
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    norm = np.linalg.norm(sample, axis=1)
    step = COLUMNS // (2 * CENTRES)
    groups = [range(at, min(at + step, count)) for at in range(0, count, step)]
    for r in range(rounds):
        book.extra = 0.0 if r == 0 else eta - 1
        codes = book.assign(sample, passes=0 if r == 0 else 2)
        along = lambda ms: sum((book.parts[m][codes[:, m]] * unit[:, edges[m] : edges[m + 1]]).sum(1) for m in ms)  # noqa: B023, E731
        rest = norm - along(range(count))  # what the centres leave of each vector along itself
        for group in groups:
            rest = rest + along(group)
            _solve(book, group, codes, sample, unit, rest, edges, rng)
            rest = rest - along(group)
    return book


#: What the index holds of a row: its code, |x|^2, 1 / the length of its quantised form, its part along that and the length across.
FORM = ("code", "square", "inverse", "along", "across")


def usable(vectors: DataFrame, dims: int | None = None) -> DataFrame:
    """(vec_id, embedding as doubles) without null, empty, zero, or non-finite vectors, or nulls in them."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists(e, lambda x: x != 0.0), F.lit(False)) & F.col("vec_id").isNotNull()
    if dims is not None:
        good = good & (F.size("embedding") == dims)
    return vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest, ties to the smaller id."""
    order = np.lexsort((ids, dist))[:k]
    return dist[order], ids[order]


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 10, exact: int = EXACT, sample: int = 10_000, sample_bytes: int = 64 << 20, train=None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest rows by Euclidean distance, ties to the smaller vec_id.

    vectors and queries: (vec_id, embedding array). Rows with a query's vec_id are its own and no candidates. Vectors that
    are null, zero, of another dimension than most, or hold null or non-finite components take no part, nor rows without
    vec_id. Other rows that share a vec_id are candidates each; queries that do are one (the smaller array). Fewer than
    k candidates: all. Empty tables give an empty table; extra columns are ignored.

    The codebook is fitted to ``sample`` different rows of ``sample_bytes`` at most, drawn by a hash of the row; all are
    indexed, with the sample's mean taken off. |q - x|^2 is |q|^2 + |x|^2 - 2 q.x. The four-bit tables give q's part along
    a row's quantised form; the row's part along it and the length of what stands across, b, are stored, so q.x is known
    but for b times the length of q's part across. Of each CHUNK of rows, the ``exact`` best of a query (at least k), and
    all that tie with the last of them, are measured on the original vectors, and then, nearest bound first, every row
    that could still be nearer than the k-th: no row is lost, whatever the codebook. Rows that the codes can't tell apart
    are all measured, which at worst is brute force. A task passes on k for each query. Queries go in blocks of about QUERIES or of TABLES bytes, a broadcast of bounded size each; rows stay where they are.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    schema = "query_id long, rank int, vec_id long, score double"
    wide = usable(vectors).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").head()
    if wide is None:
        return spark.createDataFrame([], schema)
    dims = wide["d"]
    rows = usable(vectors, dims)
    exact = max(exact, k + 1)  # a query's own row may be among them
    hashed = rows.withColumn("h", sampling.row_hash(23, "vec_id", "embedding"))
    end = sampling.limit(hashed.select("h", F.lit(8 * dims).alias("size")), sample, max(sample_bytes, 8 * dims))
    drawn = hashed.filter(F.col("h") <= end).dropDuplicates(["h"]).select("vec_id", "embedding").toArrow()
    drawn = drawn.sort_by([("vec_id", "ascending")]).combine_chunks()
    drawn = _matrix(drawn["embedding"].combine_chunks())
    centre = (drawn / len(drawn)).sum(0)
    book = (train or fit)(drawn - centre)
    shared = spark.sparkContext.broadcast(book)
    off = 1e-14 * float(np.abs(centre).max()) * math.sqrt(dims)  # what taking the mean off may round away

    def encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                x = _matrix(batch.column("embedding")) - centre
                codes = shared.value.assign(x)
                form = shared.value.decode(codes)
                norm = np.sqrt((form**2).sum(1))
                inverse = np.divide(1.0, norm, out=np.zeros(len(x)), where=norm > 0)
                form *= inverse[:, None]
                along = (x * form).sum(1)
                across = np.sqrt(((x - along[:, None] * form) ** 2).sum(1))
                code = pa.array([c.tobytes() for c in pack(codes)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, code, *map(pa.array, ((x**2).sum(1), inverse, along, across))], names=["vec_id", "embedding", *FORM])

    index = scratch.keep(rows.mapInArrow(encode, "vec_id long, embedding array<double>, code binary, square double, inverse double, along double, across double"), "index")
    asked = scratch.keep(usable(queries, dims).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    of_query = 4 * CENTRES * CENTRES * math.ceil(len(book.parts) / 2)
    n_blocks = math.ceil(asked.count() / max(1, min(QUERIES, TABLES // of_query)))

    def measured(best, q: np.ndarray, ids: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.sqrt(((x[at] - q) ** 2).sum(1))
        return _best(np.append(best[0], d), np.append(best[1], ids[at]), k)

    def reach(best) -> float:
        """The square within which a row may still take a place."""
        return (best[0][k - 1] + off) ** 2 if len(best[0]) == k else np.inf

    found = []
    for block in range(n_blocks):
        mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == block).toArrow().sort_by([("vec_id", "ascending")]).combine_chunks()
        if not mine.num_rows:
            continue
        q_ids, q = mine["vec_id"].to_numpy(), _matrix(mine["embedding"].combine_chunks())
        asked_block = spark.sparkContext.broadcast((q_ids, q))

        def scan(source: Iterator[pa.RecordBatch], asked_block=asked_block) -> Iterator[pa.RecordBatch]:
            q_ids, q = asked_block.value
            tables, squares = None, ((q - centre) ** 2).sum(1)
            best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in q_ids]
            for batch in source:
                tables = shared.value.tables(q - centre) if tables is None else tables
                for at in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(at, CHUNK)
                    ids, x = part.column("vec_id").to_numpy(), _matrix(part.column("embedding"))
                    code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                    square, inverse, along, across = (part.column(n).to_numpy() for n in FORM[1:])
                    columns = np.ascontiguousarray(code.T)
                    for i in range(len(q_ids)):
                        shadow = np.zeros(len(ids))  # the query's part along each row's quantised form
                        for j, c in enumerate(columns):
                            shadow += tables[i, j].take(c)
                        shadow *= inverse
                        near = squares[i] + square - 2 * shadow * along
                        near[np.isnan(near)] = -np.inf  # beyond the range of doubles: measured
                        own = ids == q_ids[i]
                        near[own] = np.inf  # its own rows take no candidate's place
                        last = np.partition(near, exact - 1)[exact - 1] if len(ids) > exact else np.inf
                        first = near <= last
                        best[i] = measured(best[i], q[i], ids, x, np.flatnonzero(first & ~own))
                        aside = np.sqrt(np.maximum(squares[i] - shadow**2, 0) + ROUNDING * squares[i])
                        low = near - 2 * aside * across - ROUNDING * (squares[i] + square)
                        low[np.isnan(low)] = -np.inf
                        rest = np.flatnonzero(~(first | own) & (low <= reach(best[i])))
                        rest = rest[np.argsort(low[rest])]
                        for step in range(0, len(rest), STEP):
                            if low[rest[step]] > reach(best[i]):
                                break
                            best[i] = measured(best[i], q[i], ids, x, rest[step : step + STEP])
            size = [len(d) for d, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, size)), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([d for d, _ in best]))], names=["query_id", "vec_id", "score"])

        found.append(scratch.keep(index.mapInArrow(scan, "query_id long, vec_id long, score double"), "found"))
    if not found:
        return spark.createDataFrame([], schema)
    every = reduce(DataFrame.unionAll, found)  # a row is scanned once for each query
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    """Of each vector whose vec_id 100 divides, its 10 nearest; cases as ``search`` states them."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)
