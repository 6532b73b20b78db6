"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evidara.llm import registry, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(w):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, planted, least_chars=5, least_count=3):
    count = Counter()
    for doc_id, text in rows:
        for run in map(lower, RUN.findall(text or "")):
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if planted and doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= least_chars and n >= least_count}
    by = {}
    for w in count:  # words with a place left out; near words share one, or one of them is the other's
        for i in range(len(w)):
            by.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    form, friends = {}, {}
    for w, n in count.items():
        around = set(by.get(w, ())) | {v for i in range(len(w)) for v in [*by[w[:i] + w[i + 1 :]], w[:i] + w[i + 1 :]] if v in count}
        around = {v for v in around if near(v, w)}
        friends[w] = len(around)
        best = min(around, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 2 * n else None
    out = {}
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, friends[w], count.get(form[w]))
    return out


def result(df):
    rows = df.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_runs_of_letters():
    texts = ["", None, "Abc déÀx--ÿz×÷q", "end", "startĀmid¿x", "日本abc", "İx É", " a", "ÀB"]
    got, owner = spelling.letter_runs(pa.array(texts), 1)
    want = [(i, lower(w)) for i, t in enumerate(texts) for w in RUN.findall(t or "")]
    assert list(zip(owner.tolist(), got.to_pylist())) == want
    long, _ = spelling.letter_runs(pa.array(texts).slice(2), 3)
    assert long.to_pylist() == [w for _, w in want if len(w) >= 3]


def test_keys_are_hashes_of_the_shorter_words():
    found = ["hello", "aab", "éÿ", "x" * 9, "z"]
    who, start, stop, key = spelling.deletion_keys(*spelling.letters(pa.array(found)))
    by = {}
    for w, p, q, k in zip(who.tolist(), start.tolist(), stop.tolist(), key.tolist()):
        by.setdefault(k, set()).update(found[w] if x < 0 else found[w][:x] + found[w][x + 1 :] for x in range(p, q + 1))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({t for v in by.values() for t in v})
    assert [(p, q) for w, p, q in zip(who.tolist(), start.tolist(), stop.tolist()) if found[w] == "hello"] == [(-1, -1), (0, 0), (1, 1), (2, 3), (4, 4)]
    # A word of the batch doesn't change another's keys.
    alone = spelling.deletion_keys(*spelling.letters(pa.array(["aab"])))[3]
    assert sorted(alone.tolist()) == sorted(key[who == 1].tolist())


@pytest.mark.parametrize("key_bits", [64, 9, 1])
def test_variants_of_random_words(spark, key_bits):
    rng = random.Random(key_bits)
    vocab = ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 9))) for _ in range(400)] + ["alphabet", "alphabets", "alphbet", "Alphabet", "lphabet"]
    rows = [(i, " ".join(rng.choice(vocab[: rng.choice((10, 80, 405))]) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(None, "alphabet " * 9), (7, None), (8, ""), (9, "×÷ - 12345 " * 3), (1010, "q" * 30_000 + " " + "q" * 29_999), *[(1011, "q" * 30_000 + " " + "q" * 29_999 + "z")] * 3, *[(1012, "q" * 29_999)] * 9]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, id int").repartition(3)
    want = plain([r for r in rows if (r[0] or 0) not in (1010, 1011, 1012)], True)
    got = result(spelling.spelling_variants(docs, alter=spelling.drop_letters, key_bits=key_bits))
    long = {w: v for w, v in got.items() if len(w) > 1000}
    assert {w: v for w, v in got.items() if len(w) <= 1000} == want
    assert {(len(w), w[-1]): (v[0] and (len(v[0]), v[0][-1]), v[2], v[3]) for w, v in long.items()} == {(30_000, "q"): ((29_999, "q"), 4, 2), (29_999, "q"): (None, 10, 2), (30_000, "z"): ((29_999, "q"), 3, 2)}


def test_chains_lead_to_their_root(spark):
    words = ["aaaaaaaa", "baaaaaaa", "bbaaaaaa", "bbbaaaaa", "bbbbaaaa", "bbbbbaaa"]
    text = " ".join(" ".join([w] * (3 * 2**i)) for i, w in enumerate(words))
    got = result(spelling.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert [got[w][0] for w in words] == [*words[1:], None] and {got[w][1] for w in words} == {words[-1]}
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), times=1)


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "a b c")]):
        got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), alter=spelling.drop_letters)
        assert got.count() == 0 and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = result(registry.QUERIES["op11_spelling_variants"](spark, sf))
    assert got == plain(rows, True) and any(v[0] for v in got.values())
    assert np.mean([v[3] > 0 for v in got.values()]) > 0.01
