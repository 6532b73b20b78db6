"""Token files against the tokenizer itself, and round trips."""

from __future__ import annotations

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from evidara.llm import registry, tokens

ODD = [
    "", None, " ", "  a", "a  b   c", "a \n b\n\n  c\t d", "don't we'll I'm 12 345 !! ... ,x", "é è  z　 q \u0085 r", "x<|endoftext|>y <|endoftext|> z", "日本 語 テキスト", "😀 😀😀  😀",
    "foo  bar", "a\x0b b\x0c c\x1c d", " leading", "trailing ", "trailing  ", "'s 't a's b 's", "\n \n", "-- --  -- a--b", "w" * 5000, "w " * 5000,
]


def plain():
    return Tokenizer.from_file(tokens.tokenizer_file())


def wanted(texts):
    known = plain()
    return [known.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def random_texts(seed, n):
    rng = random.Random(seed)
    marks = [" ", " ", "  ", "\n", "\t", "a", "b", "Z", "é", "ß", "9", "7", "'", "s", "t", "!", ".", "-", "日", "😀", " ", " ", "́", "~", "\x7f"]
    return ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("texts", [ODD, random_texts(1, 3000)])
def test_ids_of_pieces_are_those_of_the_text(texts):
    ids, lens = tokens.Encoder(tokens.tokenizer_file(), 0, True)(pa.array(texts, pa.string()))
    want = wanted(texts)
    assert lens.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    assert tokens.Encoder(tokens.tokenizer_file(), 0, False)(pa.array(["<|endoftext|>"]))[1].tolist()[0] > 2


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_file_round_trip_and_slices(kind, block):
    rng = np.random.default_rng(block)
    lens = rng.integers(1, 40, 60)
    lens[7] = 900
    ids = rng.integers(0, [3, 1 << 16, 1 << 32][block % 3], int(lens.sum()), dtype=np.uint64).astype(np.uint32)
    out = io.BytesIO()
    writer = tokens.Writer(out, kind, block)
    cut = int(lens[:20].sum())
    writer.add(np.arange(20), np.zeros(20, bool), lens[:20], ids[:cut])
    writer.add(np.arange(20, 60), np.arange(40) == 3, lens[20:], ids[cut:])
    figures = writer.close()
    raw = out.getvalue()
    assert figures == (60, len(ids), -(-len(ids) // block), len(raw))
    reader = tokens.Reader(pa.BufferReader(raw))
    assert reader.lens.tolist() == lens.tolist() and reader.nulls.sum() == 1
    for _ in range(30):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2))
        assert reader.ids(a, b).tolist() == ids[a:b].tolist()
    got = {}
    for d, part, last in reader.stream():
        got.setdefault(d, []).extend(part.tolist())
    assert [x for d in sorted(got) for x in got[d]] == ids.tolist() and [len(got[d]) for d in sorted(got)] == lens.tolist()


def test_damage_is_seen():
    out = io.BytesIO()
    writer = tokens.Writer(out, "byte", 64)
    writer.add(np.array([1]), np.array([False]), np.array([100]), np.arange(100, dtype=np.uint32))
    writer.close()
    raw = bytearray(out.getvalue())
    with pytest.raises(ValueError):
        tokens.Reader(pa.BufferReader(bytes(raw[:-1])))
    raw[30] ^= 255
    with pytest.raises((ValueError, Exception)):
        tokens.Reader(pa.BufferReader(bytes(raw))).block(0)


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_documents_come_back(spark, tmp_path, kind):
    rows = [(i * 7 % 50, t, 1) for i, t in enumerate(ODD * 2)] + [(None, "no id", 1), (None, None, 1), (5, "same row", 1), (5, "same row", 1)] + [(-3, "x " * 200_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _row int").repartition(3)
    manifest = tokens.write_tokens(docs, f"file://{tmp_path}/t", tokens.tokenizer_file(), kind=kind, block=100)
    got = tokens.read_tokens(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert manifest.agg({"n_docs": "sum"}).head()[0] == len(got) == len(rows)
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        start += r["n_tokens"]
    key = lambda i, ids: (i is not None, i or 0, tuple(ids))
    assert sorted(key(r["doc_id"], r["ids"]) for r in got) == sorted(key(i, w) for (i, _, _), w in zip(rows, wanted([t for _, t, _ in rows])))


def test_no_documents(spark, tmp_path):
    tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none", tokens.tokenizer_file())
    assert tokens.read_tokens(spark, f"file://{tmp_path}/none").count() == 0


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in registry.QUERIES["op13_token_binary"](spark, sf).collect()}
    start, want = 0, {}
    for (i, _), ids in zip(docs, wanted([t for _, t in docs])):
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
