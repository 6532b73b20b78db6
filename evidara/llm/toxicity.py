"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from evidara.llm import sampling, words
from evidara.llm.scratch import Scratch, others

#: A word of its own that stands for a line's end, which ends a sentence.
BREAK = b"\x01"
EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())
ENDS = (b".", b"!", b"?")


@dataclass(frozen=True)
class Model:
    """Weights of hashed word features, and the bias of a sentence."""

    weights: np.ndarray
    bias: float

    @property
    def bits(self) -> int:
        return int(len(self.weights)).bit_length() - 1


def features(word: bytes, bits: int) -> list[int]:
    """The word without marks at its ends, lower-cased, and its beginnings of 4 to 6 letters, hashed; inflected forms share the latter."""
    text = word.strip(EDGES).decode("utf-8", "replace").lower()
    if not text or text == "\x01":
        return []
    keys = ["w" + text, *("p" + text[:k] for k in (4, 5, 6) if len(text) > k)]
    return [xxhash.xxh3_64_intdigest(k) & ((1 << bits) - 1) for k in keys]


def sentences(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(code of each word, distinct words, first word of each sentence, text of each sentence)."""
    flat, counts = words.split(pc.replace_substring(pc.fill_null(texts, ""), "\n", " \x01 "))
    codes, distinct = words.encode(flat)
    _, owner, place = words.spread(counts)
    if not len(codes):
        return codes, distinct, np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.fromiter((w.endswith(ENDS) or w == BREAK for w in distinct), bool, len(distinct))[codes]
    first = (place == 0) | np.concatenate([[False], ends[:-1]])
    inside = ~np.fromiter((w == BREAK for w in distinct), bool, len(distinct))[codes]
    # A break may stand where a sentence begins; the word behind it then has the mark as well.
    codes, owner, first = codes[inside], owner[inside], first[inside]
    at = np.flatnonzero(first)
    return codes, distinct, at, owner[at]


def sentence_logits(texts: pa.Array, model: Model, known: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray]:
    """(logit of each sentence, text of each sentence)."""
    codes, distinct, at, owner = sentences(texts)
    if not len(codes):
        return np.zeros(0), owner
    if len(known) > 200_000:
        known.clear()
    w, bits = model.weights, model.bits
    own = np.empty(len(distinct))
    for i, word in enumerate(distinct):
        v = known.get(word)
        if v is None:
            v = known[word] = float(sum(w[k] for k in features(word, bits)))
        own[i] = v
    return np.add.reduceat(own[codes], at) + model.bias, owner


def noisy_or(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """1 - product of (1 - p) over each text's sentences; 0 without sentences."""
    return 0.0 - np.expm1(-np.bincount(owner, weights=np.logaddexp(0, logits), minlength=n)[:n])


class Likelihood:
    """Mean negative log-likelihood of document labels under the noisy-or of their sentences, and its gradient.

    With A the sum of softplus(z) over a document's sentences, P(clean) is exp(-A): the loss is A for a clean document
    and -log(1 - exp(-A)) for a toxic one. z is the sum of the weights of the features of a sentence's words, and b.
    """

    def __init__(self, codes: np.ndarray, at: np.ndarray, owner: np.ndarray, per: list[list[int]], labels: np.ndarray, least: int = 1):
        self.codes, self.at, self.owner, self.words = codes, at, owner, len(per)
        self.y, self.n = labels.astype(float), len(labels)
        size = np.fromiter(map(len, per), np.int64, len(per))
        feats = np.fromiter((k for ks in per for k in ks), np.int64, int(size.sum()))
        word_of = np.repeat(np.arange(len(per)), size)
        self.sent_of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(codes))))
        # Documents of each feature, by way of the distinct (document, word) pairs.
        pairs = np.unique(owner[self.sent_of].astype(np.int64) * len(per) + codes)
        docs_of_word = np.bincount(pairs % len(per), minlength=len(per))
        used, at_used = np.unique(feats, return_inverse=True)
        often = np.bincount(at_used, weights=docs_of_word[word_of], minlength=len(used))[at_used] >= least
        self.word_of, feats = word_of[often], feats[often]
        self.used, self.feats = np.unique(feats, return_inverse=True)

    def __call__(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        word_w = np.bincount(self.word_of, weights=w[self.feats], minlength=self.words)
        z = np.add.reduceat(word_w[self.codes], self.at) + b
        a = np.clip(np.bincount(self.owner, weights=np.logaddexp(0, z), minlength=self.n), 1e-9, 500)
        loss = np.where(self.y > 0, -np.log(-np.expm1(-a)), a).mean()
        by_a = np.where(self.y > 0, -1 / np.expm1(a), 1.0) / self.n
        g = by_a[self.owner] / (1 + np.exp(-np.clip(z, -40, 40)))
        by_word = np.bincount(self.codes, weights=g[self.sent_of], minlength=self.words)
        return float(loss), np.append(np.bincount(self.feats, weights=by_word[self.word_of], minlength=len(self.used)), g.sum())


def fit(texts: pa.Array, labels: np.ndarray, *, bits: int = 18, rounds: int = 80, rate: float = 0.3, sparse: float = 0.5, least: int = 2) -> Model:
    """Proximal gradient descent on ``Likelihood``.

    An L1 term leaves at 0 what explains fewer than about ``sparse`` documents; features of fewer than ``least``
    documents are left out.
    """
    codes, distinct, at, owner = sentences(texts)
    if not len(codes):
        share = float(np.mean(labels)) if len(labels) else 0.0
        return Model(np.zeros(1 << bits), float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))))
    likely = Likelihood(codes, at, owner, [features(w, bits) for w in distinct], labels, least)
    n, w, b = len(labels), np.zeros(len(likely.used)), -5.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        _, grad = likely(w, b)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        pace = rate / (np.sqrt(v / (1 - 0.99**t)) + 0.3 / n)
        step = pace * m / (1 - 0.9**t)
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - pace[:-1] * sparse / n, 0)
    full = np.zeros(1 << bits)
    full[likely.used] = w
    return Model(full, float(b))


def draw_sample(docs: DataFrame, labels: DataFrame, *, most: int, most_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, text, toxic) of ``most`` labelled documents and ``most_bytes`` of text at most, whole, among those whose crc32 mod 4 isn't 2.

    Drawn by a hash of doc_id and text, so rows that share an id are drawn one by one and equal rows are one. Texts over an
    eighth of ``most_bytes`` are never drawn. An id's label is the greatest; rows without id have none.
    """
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    h, size = sampling.row_hash(5, "doc_id", "text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    wide = docs.select("doc_id", "text", h, size).filter(F.col("size") <= most_bytes // 8)
    # Only ids, hashes and sizes meet the labels before it is known which texts are drawn.
    scratch = Scratch(docs.sparkSession, "labelled")
    known = scratch.keep(wide.select("doc_id", "h", "size").join(rows, "doc_id").select("h", "size"), "hashes")
    end = sampling.limit(known, most, most_bytes)
    drawn = wide.filter(F.lit(False) if end is None else F.col("h") <= end).dropDuplicates(["h"]).join(rows, "doc_id").select("doc_id", "text", "toxic")
    return scratch.keep(drawn, "sample")


def _columns(sample: pa.Table) -> tuple[pa.Array, np.ndarray]:
    if not sample.num_rows:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    sample = sample.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    return sample["text"].combine_chunks(), sample["toxic"].to_numpy()


def training_sample(docs: DataFrame, labels: DataFrame, *, most: int) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of ``draw_sample``."""
    return _columns(draw_sample(docs, labels, most=most).toArrow())


def fit_in_task(sample: DataFrame, *, bits: int = 18, **options) -> Model:
    """``fit`` of a sample of bounded size in one task, so that the driver sees weights alone (2 MB at most)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(source)
        model = fit(*_columns(pa.Table.from_batches(batches) if batches else pa.table({})), bits=bits, **options)
        words.give_back()
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(model.weights[at], model.bias))], names=["feature", "weight"])

    got = sample.select("doc_id", "text", "toxic").coalesce(1).mapInArrow(run, "feature long, weight double").toArrow()
    if not got.num_rows:  # a table without files has no task
        return fit(pa.array([], pa.string()), np.zeros(0), bits=bits)
    at, value = got["feature"].to_numpy(), got["weight"].to_numpy()
    weights = np.zeros(1 << bits)
    weights[at[at >= 0]] = value[at >= 0]
    return Model(weights, float(value[at < 0][0]))


SENTENCES = ArrayType(StructType().add("start", "integer").add("end", "integer").add("p", "double"))


def score(docs: DataFrame, model: Model, *, column: str = "toxicity", located: str | None = None, least: float = 0.3) -> DataFrame:
    """``docs`` with the noisy-or score of the whole text in ``column``, and its offending sentences in ``located`` if that is given.

    Null, empty and wordless texts have no sentence and score 0. Offending are the sentences whose own p is ``least`` or
    more, and the first of the highest p if the text has that score with none such: (start, end, p), end exclusive, in
    code points; texts of a lower score have an empty list. Each row is scored by its text alone, so rows that repeat
    score alike and nothing ties. An empty table gives an empty table; other columns pass through (those named
    ``column`` and ``located`` are replaced, in whatever case). No shuffle.
    """
    names = others(docs, column, *([located] if located else []))
    out = docs.select(names).schema.add(column, "double")
    out = out.add(located, SENTENCES) if located else out
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            for part in words.steps(batch):
                logits, owner = sentence_logits(part.column("text"), model, known)
                value = noisy_or(logits, owner, part.num_rows)
                cols = [*(part.column(n) for n in names), pa.array(value, pa.float64())]
                if located:
                    where: list[list] = [[] for _ in value]
                    for i in np.flatnonzero(value >= least):
                        where[i] = offending(part.column("text")[int(i)].as_py(), model, known, least)
                    cols.append(pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))))
                yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return docs.select(names).mapInArrow(run, out)


def spans(text: str | None) -> list[tuple[int, int]]:
    """Sentences of a text as (start, end) in code points: up to a word that ends in . ! or ?, or a line's end."""
    out = []
    for line in re.finditer(r"[^\n]+", text or ""):
        begin = None
        for w in re.finditer(r"[^ \t-\r]+", line[0]):
            begin = w.start() if begin is None else begin
            if w[0][-1] in ".!?":
                out.append((line.start() + begin, line.start() + w.end()))
                begin = None
            last = w.end()
        if begin is not None:
            out.append((line.start() + begin, line.start() + last))
    return out


def offending(text: str | None, model: Model, known: dict[bytes, float], least: float) -> list[dict]:
    """Sentences of a text with p of ``least`` or more; the first of the highest p if there is none."""
    where = spans(text)
    z, _ = sentence_logits(pa.array([(text or "")[a:b] for a, b in where], pa.string()), model, known)
    p = 1 / (1 + np.exp(-z))
    at = np.flatnonzero(p >= least) if (p >= least).any() else [int(p.argmax())] if len(p) else []
    return [{"start": where[i][0], "end": where[i][1], "p": float(p[i])} for i in at]


def locate(docs: DataFrame, model: Model, *, least: float = 0.3) -> DataFrame:
    """Offending sentences, a row each: (doc_id, start, end, p) as ``score`` gives them. Texts below ``least`` have none."""
    found = score(docs.select("doc_id", "text"), model, located="sentences", least=least)
    return found.select("doc_id", F.explode("sentences").alias("s")).select("doc_id", "s.*")


def trained(spark, sf_dir: str, *, most: int = 5000) -> Model:
    """The model of a folder's documents and labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fit_in_task(draw_sample(docs, labels, most=most))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Per document: held_out, score, predicted, and the offending sentences of what is predicted toxic.

    Empty and wordless texts score 0, as they have no sentence; a null doc_id isn't held out. Cases as ``score`` states them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    scored = score(docs, trained(spark, sf_dir), column="score", located="sentences", least=0.3)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "sentences")
