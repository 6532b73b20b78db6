"""Text segments, annotations with code-point offsets, and chunks."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.operators.steps import in_steps

c = F.col
# Patterns, layers and confidences of annotations, and the financial terms.
PATTERNS = (
    ("currency", "semantic_baseline", r"[$£€]\s?\d[\d,]*(?:\.\d+)?", 0.9),
    ("quantity", "semantic_baseline", r"\b(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|\d{4,})\b", 0.8),
    ("date", "semantic_baseline", r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|(?:19|20)\d{2}(?:/\d{2,4})?)\b", 0.8),
    ("citation-marker", "semantic_baseline", r"\[\d+\]|\([A-Z][A-Za-z\-]+,\s*(?:19|20)\d{2}\)", 0.75),
    ("period", "domain_financial", r"\b(?:FY|Q[1-4]|H[12])\s?(?:19|20)?\d{2}(?:/\d{2,4})?\b", 0.85),
)
TERMS = ("cash", "cash flow", "revenue", "turnover", "profit", "ebitda", "asset", "liability", "equity", "capital", "debt", "expenditure", "income", "deficit", "surplus")
# The line break takes up pieces of a line that no mark ends, which are no sentences; else each of their places would be tried again.
SENTENCE = r"[^.!?\n]+(?:[.!?]+|$|\n)"

SPANS = "array<struct<start:int,end:int>>"
MATCHES = "array<struct<start:int,end:int,label:string>>"


def _all_matches(texts: pa.Array, compiled) -> pa.Array:
    """Per text a list of (start, end, label). A null stays null."""

    def some(texts: list) -> pa.Array:
        found = [[] if t is None else [(*m.span(), m[0]) for m in compiled.finditer(t)] for t in texts]
        start, end, label = zip(*(x for rows in found for x in rows)) if any(found) else ((), (), ())
        places = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(label, pa.string())], names=["start", "end", "label"])
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, places, mask=pa.array([t is None for t in texts], pa.bool_()))

    return in_steps(texts, some)


def matches(text: Column, pattern: str) -> Column:
    """Non-overlapping matches with offsets in code points: array of (start, end, label), end exclusive.

    One pass over each text in an Arrow batch: the built-in functions give matches without their places, and finding
    the places by running sums of lengths costs the square of a text's matches.
    """

    @F.arrow_udf(MATCHES)
    def found(texts: pa.Array) -> pa.Array:
        return _all_matches(texts, re.compile(pattern, re.ASCII))

    return found(text)


def rules(category: str | None = None) -> list[tuple[str, str, str, float]]:
    """(layer, category, pattern, confidence) of the annotations, or of one category alone: patterns in order, then terms."""
    every = [*((layer, name, p, k) for name, layer, p, k in PATTERNS), *(("domain_financial", "metric", rf"(?i)\b{t}\b", 0.75) for t in TERMS)]
    return [r for r in every if category in (None, r[1])]


def annotations(docs: DataFrame, key: str, most: int | None = None, category: str | None = None) -> DataFrame:
    """(key, layer, category, start, end, label, confidence): patterns in order, then terms; ``most`` a document if that is given.

    With a category, the patterns of that one alone are run.
    """
    wanted = rules(category)

    kind = pa.list_(pa.struct([("layer", pa.string()), ("category", pa.string()), ("confidence", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))

    @F.arrow_udf("array<struct<layer:string,category:string,confidence:double,start:int,end:int,label:string>>")
    def found(texts: pa.Array) -> pa.Array:
        compiled = [(layer, name, k, re.compile(p, re.ASCII)) for layer, name, p, k in wanted]
        one = lambda t: [(layer, name, k, *m.span(), m[0]) for layer, name, k, p in compiled for m in p.finditer(t)][:most]
        return in_steps(texts, lambda texts: pa.array([one(t) for t in texts], kind))

    return docs.filter(c("text").isNotNull()).select(key, F.explode(found("text")).alias("a")).select(key, "a.*")


def scan_sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence, in one pass: a run without marks and line breaks, with the marks behind it or at the text's end; blank ones are none."""
    return [m.span() for m in re.finditer(SENTENCE, text) if m[0][-1] != "\n" and not m[0].isspace()]


def scan_paragraphs(text: str) -> list[tuple[int, int]]:
    """(start, end) of each paragraph, in one pass: from a character that isn't blank to the first such one at the text's end or before an empty line.

    Blanks before an empty line or at the text's end join what follows to the paragraph, which is none if nothing does. A
    paragraph of one character goes on to the next one's end, if there is a next one.
    """
    ends = [m.end() for m in re.finditer(r"\S(?=\n\s*\n)", text)]
    if text and not text[-1].isspace():
        ends.append(len(text))
    ink, out, at, i = re.compile(r"\S"), [], 0, 0
    while i < len(ends):
        start = ink.search(text, at).start()
        i += ends[i] == start + 1 and i + 1 < len(ends)
        at = ends[i]
        out.append((start, at))
        i += 1
    return out


def layout_blocks(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, order_index, start, end): the document and its paragraphs; null and empty texts have none."""

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        return _span_lists(texts, scan_paragraphs, ["start", "end"])

    full = docs.filter(F.length("text") > 0)
    root = full.select(*keys, F.lit("document").alias("kind"), F.lit(None).cast("int").alias("order_index"), F.lit(0).alias("start"), F.length("text").alias("end"))
    spans = full.select(*keys, F.posexplode(found("text")).alias("order_index", "w"))
    return root.unionByName(spans.select(*keys, F.lit("paragraph").alias("kind"), "order_index", "w.start", "w.end"))


def greedy_windows(spans: list[tuple[int, int]], target: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each window over sentences; both ends move forward alone.

    A window takes sentences while it stays within ``target``. If its last sentence reaches ``overlap``, the next window
    starts at this one's second sentence, else behind it.
    """
    out, i, j = [], 0, 0
    while i < len(spans):
        j = max(j, i + 1)
        while j < len(spans) and spans[j][1] - spans[i][0] <= target:
            j += 1
        out.append((spans[i][0], spans[j - 1][1]))
        again = j < len(spans) and j > i + 1 and spans[j - 1][1] - spans[j - 1][0] >= overlap
        i = i + 1 if again else j
    return out


def fixed_windows(start: int, end: int, target: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of ``target`` that overlap, up to the first that reaches the end."""
    return [(a, min(a + target, end)) for a in range(start, max(start + 1, end - overlap), target - overlap)]


def _span_lists(texts: pa.Array, scan, names: list[str]) -> pa.Array:
    """Lists of structs of numbers of each text; none for a null."""

    def some(texts: list) -> pa.Array:
        found = [scan(t) if t is not None else () for t in texts]
        flat = np.array([x for rows in found for x in rows], np.int32).reshape(-1, len(names))
        columns = [pa.array(np.ascontiguousarray(flat[:, k])) for k in range(len(names))]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, names=names))

    return in_steps(texts, some)


def sentence_spans(text: Column) -> Column:
    """(start, end) of each sentence; blank pieces and newline-ended ones without a mark are none."""

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        return _span_lists(texts, scan_sentences, ["start", "end"])

    return found(text)


def sentences(docs: DataFrame, key: str) -> DataFrame:
    """(key, order_index, start, end) of ``sentence_spans``."""
    spans = docs.filter(c("text").isNotNull()).select(key, F.posexplode(sentence_spans(c("text"))).alias("order_index", "m"))
    return spans.select(key, "order_index", "m.start", "m.end")


def sentence_windows(docs: DataFrame, key: str, target: int = 1100, overlap: int = 180) -> DataFrame:
    """(key, chunk, start, end): ``greedy_windows`` over sentences, split where one is over the hard maximum.

    ``target`` is 300 at least, ``overlap`` half of it at most. Texts without sentences get ``fixed_windows``, as do
    windows over 1.4 * target. Blank windows are left out; their numbers stay free.
    """
    target = max(300, target)
    overlap, most = max(0, min(overlap, target // 2)), max(target, int(target * 1.4))

    def scan(text: str) -> list[tuple[int, int, int]]:
        windows = greedy_windows(scan_sentences(text), target, overlap) or fixed_windows(0, len(text), target, overlap)
        parts = [p for a, b in windows for p in ([(a, b)] if b - a <= most else fixed_windows(a, b, target, overlap))]
        return [(k, a, b) for k, (a, b) in enumerate(parts) if text[a:b].strip()]

    @F.arrow_udf("array<struct<chunk:int,start:int,end:int>>")
    def found(texts: pa.Array) -> pa.Array:
        return _span_lists(texts, scan, ["chunk", "start", "end"])

    return docs.filter(c("text").isNotNull()).select(key, F.explode(found("text")).alias("w")).select(key, "w.*")


def cap_windows(windows: Column, target: int = 1100, overlap: int = 180) -> Column:
    """Windows over max(target, 1.4 * target) in pieces of ``target`` that overlap; the others as they are."""
    target = max(300, target)
    most, overlap = max(target, int(target * 1.4)), max(0, min(overlap, target // 2))

    def pieces(w):
        n = w["end"] - w["start"]
        parts = F.transform(split_windows(n, target, overlap), lambda p: F.struct((w["start"] + p["start"]).cast("int").alias("start"), (w["start"] + p["end"]).cast("int").alias("end")))
        return F.when(n > most, parts).otherwise(F.array(F.struct(w["start"].cast("int").alias("start"), w["end"].cast("int").alias("end"))))

    return F.flatten(F.transform(F.filter(windows, lambda w: w["end"] > w["start"]), pieces))


def split_windows(length: Column, size: int, overlap: int) -> Column:
    """Fixed windows of ``size`` with ``overlap`` over a length: array of (start, end), up to the first that reaches the end."""
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((length - size) / stride), F.lit(0)).cast("int"))
    return F.transform(starts, lambda i: F.struct((i * stride).alias("start"), F.least(i * stride + size, length).alias("end")))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(points: DataFrame, vector: list[float], k: int, *, key: str = "vec_id", column: str = "embedding", **filters) -> DataFrame:
    """(key, score) of the k most similar points among those that pass the filters; an empty vector finds nothing."""
    for name, value in filters.items():
        if value is not None:
            points = points.filter(c(name) == value)
    if not vector:
        return points.select(key, F.lit(None).cast("double").alias("score")).limit(0)
    scored = points.filter(F.size(column) == len(vector)).select(key, cosine(c(column), F.array(*[F.lit(float(x)) for x in vector])).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(max(1, k))
