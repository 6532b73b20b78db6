"""The training-data operators against brute force on small tables, and on odd ones."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidara.llm import chats, decontaminate, licenses, lines, mixing, near, nearest, secrets, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().split()


def make(spark, texts, ids=None, sources=None):
    n = len(texts)
    ids = list(range(1, n + 1)) if ids is None else ids
    sources = ["a"] * n if sources is None else sources
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in zip(ids, texts, sources)], DOCS)


def corpus(seed=0, n=60):
    """Random documents with copies, near copies, shared passages and lines, odd white space and marks."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)] + ["É", "ñandú", "x\xa0y", "日本", "UPPER"]
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append(rng.choice(out))
        elif out and kind < 0.4:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randint(1, max(1, len(w) // 15))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice((1, 3, 19, 20, 60, 150)))]
            text = "".join(x + rng.choice((" ", " ", " ", "\n", "\t ", "\x0b")) for x in w)
            if rng.random() < 0.3:
                text += passage
            out.append(text + rng.choice(("", "\nSame  Line \n", "\nsame line")))
    return [*out, "", None, " \n ", "A b", "a B"]


# -- 1 ---------------------------------------------------------------------------
def test_toxicity_learns_words_and_beginnings():
    rng = random.Random(1)
    bad, texts, labels = ["idiot", "lowei" + "xyz", "scum"], [], []
    for i in range(400):
        sent = [" ".join(rng.choice("abcdefgh") * rng.randint(2, 5) for _ in range(8)) + "." for _ in range(rng.randint(1, 6))]
        toxic = i % 3 == 0
        if toxic:
            sent[rng.randrange(len(sent))] = "you " + (rng.choice(bad) if i % 2 else "lowei" + rng.choice("abcdef") * 3) + " here."
        texts.append(" ".join(sent))
        labels.append(int(toxic))
    model = toxicity.fit(pa.array(texts[:300]), np.array(labels[:300]))
    z, owner = toxicity.sentence_logits(pa.array(texts[300:]), model, {})
    got = toxicity.noisy_or(z, owner, 100) >= 0.3
    assert np.mean(got == np.array(labels[300:], bool)) > 0.95


def test_toxicity_noisy_or_and_spans(spark):
    model = toxicity.Model(np.zeros(1 << 10), -2.0)
    p = 1 / (1 + np.exp(2.0))
    texts = ["One two. Three!\nFour", "", None, "x"]
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(make(spark, texts), model).collect()}
    assert got[1] == pytest.approx(1 - (1 - p) ** 3) and got[2] == got[3] == 0 and got[4] == pytest.approx(p)
    assert [texts[0][a:b] for a, b in toxicity.spans(texts[0])] == ["One two.", "Three!", "Four"]
    found = toxicity.locate(make(spark, texts), model, least=0.1).collect()
    assert [(r["doc_id"], r["start"], r["end"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["start"]))] == [(1, 0, 8), (1, 9, 15), (1, 16, 20), (4, 0, 1)]


def test_toxicity_leaves_held_out_rows(spark):
    docs = make(spark, ["t%d" % i for i in range(40)])
    labels = spark.createDataFrame([(i, 1) for i in range(1, 41)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    texts, y = toxicity.training_sample(docs, labels, most=100)
    assert {t[1:] for t in texts.to_pylist()} == {str(i - 1) for i in range(1, 41) if zlib.crc32(str(i).encode()) % 4 != 2} and set(y) == {1}


# -- 2 ---------------------------------------------------------------------------
def shingles(text, k):
    w = [x.lower() for x in words(text)]
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(texts, k, share=80):
    sets = [shingles(t, k) for t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(spark, k):
    texts = corpus(k)
    base = texts[0] + " " + texts[1] + " " + " ".join("z%d" % i for i in range(60))
    rng = random.Random(5)
    for _ in range(40):  # a group of near copies at many distances
        w = base.split(" ")
        for _ in range(rng.randint(1, len(w) // 12)):
            w[rng.randrange(len(w))] = "q%d" % rng.randrange(1000)
        texts.append(" ".join(w))
    sets, top = linked(texts, k)
    got = {r["doc_id"]: r for r in near.near_duplicates(make(spark, texts), k=k).collect()}
    for i in range(len(texts)):
        assert (got[i + 1]["n_shingles"], got[i + 1]["component_id"], got[i + 1]["kept"]) == (len(sets[i]), top[i] + 1, top[i] == i)


def test_near_sketches_do_not_rule_out_links():
    rng = np.random.default_rng(2)
    limit = near.tolerated(0.8)
    for _ in range(60):
        n = int(rng.integers(5, 400))
        common, own = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n // 8, dtype=np.uint64)
        a, b = common, np.concatenate([common, own])  # a similarity of 0.89 or so
        h, o = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        s = near.samples(h, o, 2)
        sk, wh = near.odd_sketch(s), near.whole_parity(h, o, 2)
        assert np.bitwise_count(sk[0] ^ sk[1]).sum() <= limit
        assert np.bitwise_count(wh[0] ^ wh[1]).sum() <= len(own)
        assert len(a) < 5 or abs(np.mean(s[0] == s[1]) - len(a) / len(b)) < 0.15


# -- 3 ---------------------------------------------------------------------------
def test_containment_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["v%d" % i for i in range(50)]
    items = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (3, 5, 14, 30, 60, 120, 300)] + ["", None]
    docs = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.choice((2, 50, 400)))]
        it = (items[i % 7] or "").split(" ")
        for _ in range(i % 4):
            it[rng.randrange(len(it))] = "changed"
        docs.append(" ".join(w[:10] + ([x.upper() for x in it] if i % 2 else []) + w[10:]))
    docs += ["", None]
    want = set()
    for d, t in enumerate(docs, 1):
        have = shingles(t, 5) if len(words(t)) >= 5 else set()
        for i, x in enumerate(items, 1):
            s = shingles(x, 5) if len(words(x)) >= 5 else set()
            if s and 100 * len(s & have) >= 80 * len(s):
                want.add((d, i, len(s), len(s & have)))
    table = spark.createDataFrame(list(enumerate(items, 1)) + [(None, items[3])], "item_id long, text string")
    got = decontaminate.contained(make(spark, docs), table)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10
    assert decontaminate.contained(make(spark, docs), table.limit(0)).count() == 0


def test_containment_beyond_the_broadcast_bound(spark, monkeypatch):
    docs, items = make(spark, ["a b c d e f g h", "x"]), spark.createDataFrame([(1, "b c d e f g")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    assert [tuple(r) for r in decontaminate.contained(docs, items).collect()] == [(1, 1, 2, 2)]


# -- 4 ---------------------------------------------------------------------------
def water(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= most * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    sources = [rng.choice(["b", "a", "é", None, "tiny", "big", "big", "big"]) for _ in range(900)]
    texts = ["w " * (rng.choice((1, 5, 30, 200)) if s != "tiny" else 1) for s in sources] + ["", None]
    docs = make(spark, texts, sources=[*sources, "a", "hollow"])
    got = mixing.mix(docs).collect()
    size = defaultdict(int)
    for t, s in zip(texts, [*sources, "a", "hollow"]):
        size[s] += len(words(t))
    want = water(size)
    taken, by_id = Counter(), {r["doc_id"]: r for r in got}
    assert len(got) == len(texts)
    for i, s in enumerate([*sources, "a", "hollow"], 1):
        r = by_id[i]
        assert r["size"] == len(words(texts[i - 1])) and r["source_size"] == size[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in size:
        assert abs(taken[s] - want[s]) <= max(2, 0.02 * want[s]), (s, taken[s], want[s])
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in by_id.items()}


def test_mix_tree_of_many_levels_keeps_the_sum(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RESERVE", 4)
    docs = make(spark, ["w " * (1 + i % 40) for i in range(1500)], sources=["ab"[i % 5 == 0] for i in range(1500)])
    by = defaultdict(lambda: [0, 0.0])
    for r in mixing.mix(docs, fan=8).collect():
        by[r["target"]][0] += r["taken"]
    assert all(abs(t - k) <= 0.02 * t for t, (k, _) in by.items()) and len(by) == 2


def test_mix_of_nothing(spark):
    assert mixing.mix(make(spark, ["a"]).limit(0)).count() == 0


# -- 5 ---------------------------------------------------------------------------
def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[100:160] = x[7]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] + [1.0] * 23), (5003, [1.0, 2.0]), (5004, [None] + [1.0] * 23), (None, x[0].tolist()), (100, x[100].tolist())]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>")
    got = nearest.search(df, df.filter("vec_id % 100 = 0")).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["score"], r["vec_id"]))
    assert set(by) == set(range(0, 3000, 100))
    hits, y = 0, x.astype(float)
    for q, found in by.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        hits += len({v for _, v in found} & set(order))
        assert found == sorted(found) and all(s == pytest.approx(d[v], abs=1e-12) for s, v in found)
    assert hits >= 0.9 * 10 * len(by)
    assert [v for _, v in by[100]] == [7, *range(101, 110)]


def test_nearest_is_exact_where_all_are_measured(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 9)).round(2)
    ids = [7 if 100 <= i < 400 else i for i in range(700)]  # a third of the rows share a query's id
    x[100:400] = x[7] + rng.normal(size=(300, 9)) / 100
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in nearest.search(df, df.filter("vec_id IN (7, 50, 600)"), k=5, exact=nearest.CHUNK).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in (50, 600):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:5]
        assert [(v, pytest.approx(s)) for v, s in got[q]] == [(ids[i], pytest.approx(d[i])) for i in order]
    assert len(got[7]) == 5 and all(v != 7 for v, _ in got[7])
    few = nearest.search(df, df.filter("vec_id = 7"), k=5, exact=6).collect()
    assert len(few) == 5 and all(r["vec_id"] != 7 for r in few)


def test_nearest_misses_nothing_on_rows_that_the_codes_do_not_tell_apart(spark):
    """Tight groups far from the origin, flat noise in many dimensions, lengths of many sizes, and values near the end of doubles."""
    rng = np.random.default_rng(12)
    groups = 40 + rng.normal(size=(8, 16)).repeat(250, 0) + rng.normal(size=(2000, 16)) / 200
    noise = rng.uniform(-1, 1, size=(1500, 48))
    sizes = rng.normal(size=(1500, 16)) * 10.0 ** rng.integers(-4, 4, size=(1500, 1))
    huge = np.vstack([rng.normal(size=(300, 6)), rng.normal(size=(3, 6)) * 1e200])
    for x in (groups, noise, sizes, huge):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(2)
        got = defaultdict(list)
        for r in nearest.search(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append(r["vec_id"])
        for q in range(0, len(x), 100):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            assert got[q] == [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 2.0]), (3, [1.0, 1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest.search(df, df.filter("vec_id = 0")).collect()] == [(0, 1, 3, 1.0)]
    assert nearest.search(df.limit(0), df).count() == 0 and nearest.search(df, df.limit(0)).count() == 0
    twice = df.union(spark.createDataFrame([(3, [1.0, 0.0, 4.0])], df.schema))
    assert [tuple(r) for r in nearest.search(twice, df.filter("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 3, 1.0), (0, 2, 3, 2.0)]


def test_codebook_in_groups_fits_as_well(monkeypatch):
    x = np.random.default_rng(8).normal(size=(1500, 32))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def loss(book):
        codes = book.assign(x)
        r = x - np.concatenate([c[codes[:, m]] for m, c in enumerate(book.parts)], axis=1)
        return ((r**2).sum(1) + book.extra * (r * unit).sum(1) ** 2).mean()

    at_once = loss(nearest.fit(x))
    monkeypatch.setattr(nearest, "COLUMNS", 128)
    grouped = loss(nearest.fit(x))
    assert grouped < 1.05 * at_once
    few = nearest.fit(x, rounds=1)
    assert grouped < loss(nearest.Codebook(few.parts, nearest.fit(x).extra))


# -- 6 ---------------------------------------------------------------------------
def cut(texts, n):
    seen, out = {}, []
    split = [words(t) for t in texts]
    for i, w in enumerate(split):
        gone = set()
        for s in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[s : s + n]), (i, s)) != (i, s):
                gone.update(range(s, s + n))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("batches, fan_in", [(4, 2), (1, 3)])
def test_substrings_against_brute_force(spark, batches, fan_in):
    texts = [*corpus(6, 90), "r " * 70, "a b c " * 30]
    got = {r["doc_id"]: r for r in substrings.remove_repeats(make(spark, texts), batches=batches, fan_in=fan_in).collect()}
    for i, want in enumerate(cut(texts, 20), 1):
        assert (got[i]["n_words"], got[i]["n_removed"], hashlib.sha256(got[i]["text"].encode()).hexdigest()) == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("evidara_run_")]


# -- 7 ---------------------------------------------------------------------------
def test_chats_against_brute_force(spark):
    rng = random.Random(7)
    convs = {}
    for i in range(80):
        turns = [(rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "no", None, ""])) for _ in range(rng.randint(1, 6))]
        convs[i] = turns
        if i % 3 == 0:
            convs[i + 1000] = turns[: rng.randint(1, len(turns))]
    rows = [(k, n, r, t) for k, v in convs.items() for n, (r, t) in enumerate(v)]
    df = spark.createDataFrame([*rows, *rows[:5], (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    keep = {}
    for k, v in sorted(convs.items()):
        if not any(len(o) > len(v) and o[: len(v)] == v for o in convs.values()) and v not in keep.values():
            keep[k] = v
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chats.collapse(df).collect()}
    assert got == {k: (len(v), "".join(f"<|im_start|>{r}\n{t or ''}<|im_end|>\n" for r, t in v)) for k, v in keep.items()}


# -- 8 ---------------------------------------------------------------------------
@pytest.mark.parametrize("batches, fan_in", [(5, 2), (1, 4)])
def test_lines_against_brute_force(spark, batches, fan_in):
    texts = corpus(8, 80)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    split = [(t or "").split("\n") for t in texts]
    n = Counter(k for ls in split for k in {key(x) for x in ls})
    got = {r["doc_id"]: r for r in lines.drop_common_lines(make(spark, texts), min_docs=4, batches=batches, fan_in=fan_in).collect()}
    dropped = 0
    for i, ls in enumerate(split, 1):
        kept = [x for x in ls if not (key(x) and n[key(x)] >= 4)]
        dropped += len(ls) - len(kept)
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["text"]) == (len(ls), len(ls) - len(kept), "\n".join(kept))
    assert dropped


def test_rows_that_repeat_and_columns_that_clash(spark):
    docs = make(spark, ["x\nsame"] * 3 + ["y\nsame"], ids=[1, 1, None, 2]).selectExpr("*", "doc_id AS n_lines", "'q' AS batch", "1 AS _gone2", "doc_id AS id", "text AS t", "1 AS n", "2 AS a", "3 AS n_words", "4 AS size")
    got = lines.drop_common_lines(docs, min_docs=4)
    assert sorted(r["text"] for r in got.collect()) == ["x", "x", "x", "y"] and "batch" in got.columns
    assert near.near_duplicates(docs).count() == 4 and mixing.mix(docs).count() == 4
    assert decontaminate.contained(docs, spark.createDataFrame([(1, "a b c d e", 1)], "item_id long, text string, doc_id int")).count() == 0
    kept = substrings.remove_repeats(docs, window=2, gram=2)
    assert kept.count() == 4 and kept.columns.count("n_words") == 1


@pytest.mark.parametrize("run", [lambda d: lines.drop_common_lines(d), lambda d: near.near_duplicates(d), lambda d: substrings.remove_repeats(d), lambda d: secrets.scan(d, secrets.fit([])), lambda d: toxicity.score(d, toxicity.fit(pa.array([], pa.string()), np.array([])))])
def test_empty_tables(spark, run):
    assert run(make(spark, ["x"]).limit(0)).count() == 0


def test_very_long_text(spark):
    text = " ".join("w%d" % (i * i % 99991) for i in range(150_000))
    docs = make(spark, [text, text + " end", "short"])
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    cut_ = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(docs).collect()}
    assert cut_[2][0] == 150_001 and cut_[2][1] == 150_000 and cut_[3] == (1, 0)


# -- 9 ---------------------------------------------------------------------------
def test_licences(spark):
    mit = licenses.MIT.replace("<year> <copyright holders>", "2020 Jane").upper().replace("\n\n", "\n \t\n").replace("SUBLICENSE", "SUBLICENCE")
    texts = [mit, mit + " and more", "released under the MIT licence", "Licensed under CC BY-NC 4.0.", "", None, licenses.BSD2 + licenses.BSD_END]
    got = [r["license_id"] for r in licenses.lookup(make(spark, texts), licenses.known_digests(spark)).orderBy("doc_id").collect()]
    assert got == ["MIT", None, "MIT", "CC-BY-NC-4.0", None, None, "BSD-2-Clause"]


# -- 10 --------------------------------------------------------------------------
def plain_base(text):
    out = []
    for k, p in (("assign", secrets.ASSIGN), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))):
        for m in p.finditer(text or ""):
            if len(m[2]) >= 6 if k == "assign" else len(m[0]) >= {"access": 20, "hex": 24}[k]:
                out.append((m.start(), ("assign", "access", "hex").index(k), f"{k}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def secret_texts(n=120, seed=9):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(20)]
        if rng.random() < 0.5:
            v = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((5, 24, 40))))
            w.insert(rng.randrange(20), rng.choice(('token = "%s"', "PassWord:%s", "API-key %s", "api_key='%s'", "é %s", "token=token: %s")) % v)
        if rng.random() < 0.2:
            w.insert(3, "AKIA" + "".join(rng.choice("ABCDEF0123") for _ in range(rng.choice((10, 16, 20)))))
        out.append(" ".join(w) + rng.choice(("", "\nx")))
    return out


def test_secrets_base_spans(spark):
    texts = [*secret_texts(), "", None, "ſecret = abcdefgh", "token=ab", "passK"]
    got = {r["doc_id"]: r for r in secrets.scan(make(spark, texts), secrets.fit(secret_texts(60, 1), rounds=10)).collect()}
    for i, t in enumerate(texts, 1):
        want = plain_base(t)
        assert got[i]["base"] == want and set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
        assert got[i]["n_assign"] == want.count("assign")


def test_secrets_decoding_is_viterbi():
    rng = np.random.default_rng(0)
    crf = secrets.fit(secret_texts(80), rounds=20)
    flat = secrets.tokens(pa.array(secret_texts(40, 3)))
    first = flat[2]
    for scale in (0.0, 1.0, 4.0):
        e = rng.normal(size=(len(first), 3)) * 2 + np.array([0, 0, scale])
        got = crf.decode(e, first)
        for a, b in zip(np.flatnonzero(first), [*np.flatnonzero(first)[1:], len(first)]):
            s, back = crf.start + e[a], []
            for t in range(a + 1, b):
                m = s[:, None] + crf.step
                back.append(m.argmax(0))
                s = m.max(0) + e[t]
            y = [int((s + crf.step[:, secrets.O]).argmax())]
            for p in reversed(back):
                y.append(int(p[y[-1]]))
            assert got[a:b].tolist() == y[::-1]


def test_secrets_tags_generalise():
    crf = secrets.fit(secret_texts(300))
    found = secrets.scan_texts(pa.array(secret_texts(100, 42)), crf)
    gold = [secrets.gold(t) for t in secret_texts(100, 42)]
    codes, distinct, first, owner, _ = secrets.tokens(pa.array(secret_texts(100, 42)))
    e = crf.emissions(codes, crf.tables(distinct), first, secrets._file_of(codes, distinct, owner, 100)[owner])
    y, g = crf.decode(e, first), np.concatenate(gold)
    assert np.mean((y != secrets.O)[g != secrets.O]) > 0.9 and len(found) == 100


# -- odd tables, registered queries --------------------------------------------------
ODD = "doc_id long, text string, _gone int, _r1 int, starts int, _id int, LICENSE_ID string, Digest string, _leaky int, labels int"


def odd(spark, texts, ids):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "x", "y", 5, 6) for i, t in zip(ids, texts)], ODD)


def test_any_column_names(spark, monkeypatch):
    long = " ".join("q%d" % i for i in range(30))
    docs = odd(spark, [long, long + " z", None, "", "same\n" + long, "same"], [1, 2, None, 4, 4, 1])
    model = toxicity.Model(np.zeros(1 << 10), -2.0)
    for bound in (lines.BROADCAST_KEYS, -1):
        monkeypatch.setattr(lines, "BROADCAST_KEYS", bound)
        got = lines.drop_common_lines(docs, min_docs=2)
        assert got.columns == [*docs.columns, "n_lines", "n_dropped"] and sorted(r["n_dropped"] for r in got.collect()) == [0, 0, 0, 1, 1, 2]
    assert substrings.remove_repeats(docs).columns == [*docs.columns, "n_words", "n_removed"]
    found = licenses.lookup(docs, licenses.known_digests(spark))
    assert [c.lower() for c in found.columns].count("digest") == 1 and found.count() == 6
    scored = toxicity.score(docs.withColumn("TOXICITY", docs._r1), model, located="labels")
    assert [c.lower() for c in scored.columns].count("toxicity") == 1 and scored.count() == 6
    assert secrets.scan(docs, secrets.fit([])).count() == 6 and near.near_duplicates(docs).count() == 6


def test_substrings_of_repeated_and_null_ids(spark):
    b = " ".join("q%d" % i for i in range(30))
    rows = [(1, b), (2, b + " z"), (2, "unrelated row of the same id"), (None, b), (None, None), (2, " ".join("u%d" % i for i in range(90)) + " " + b), (1, b), (3, "x " + b)]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["text"].split(" ")[-1]) for r in substrings.remove_repeats(odd(spark, [t for _, t in rows], [i for i, _ in rows])).collect())
    assert got == sorted([(0, 30, 0, "q29"), (0, 0, 0, ""), (1, 30, 30, ""), (1, 30, 30, ""), (2, 31, 30, "z"), (2, 6, 0, "id"), (2, 120, 30, "u89"), (3, 31, 30, "x")])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("evidara_run")]


def test_substrings_in_later_batches(spark, tmp_path):
    from evidara.llm.runs import SortedRuns

    texts, folder = [*corpus(6, 60), "r " * 70], f"file://{tmp_path}/index"
    index = substrings.FingerprintIndex(SortedRuns(spark, folder, ["fp"], 4, fan_in=2))
    part = lambda a, b: make(spark, texts[a:b], ids=range(a + 1, b + 1))
    n, got = len(texts), {}
    for a, b in ((0, 25), (25, 40), (40, n)):
        got |= {r["doc_id"]: r for r in substrings.remove_known(part(a, b), index, part(0, a)).collect()}
        index.runs.close()
        index = substrings.FingerprintIndex(SortedRuns.open(spark, folder))
    index.runs.drop()
    for i, want in enumerate(cut(texts, 20), 1):
        assert (got[i]["n_words"], got[i]["n_removed"], hashlib.sha256(got[i]["text"].encode()).hexdigest()) == want


def test_toxicity_gradient():
    rng = np.random.default_rng(0)
    texts = pa.array([" ".join(rng.choice(list("abcdef"), 6)) + ". " + " ".join(rng.choice(list("abcdef"), 5)) for _ in range(30)])
    codes, distinct, at, owner = toxicity.sentences(texts)
    likely = toxicity.Likelihood(codes, at, owner, [toxicity.features(w, 10) for w in distinct], rng.integers(0, 2, 30))
    w, b = rng.normal(size=len(likely.used)) * 0.3, -1.0
    grad = likely(w, b)[1]
    for i, e in enumerate(np.eye(len(w) + 1) * 1e-6):
        assert abs((likely(w + e[:-1], b + e[-1])[0] - likely(w - e[:-1], b - e[-1])[0]) / 2e-6 - grad[i]) < 1e-6


def test_toxicity_of_repeats_and_long_texts(spark):
    model = toxicity.Model(np.zeros(1 << 10), -2.0)
    texts = ["One. Two.", "One. Two.", "w " * 200_000 + "."]
    got = toxicity.score(make(spark, texts, ids=[1, 1, None]), model, located="s", least=0.1).collect()
    assert got[0]["toxicity"] == got[1]["toxicity"] == pytest.approx(1 - (1 - 1 / (1 + np.exp(2.0))) ** 2)
    assert [tuple(x)[:2] for x in got[2]["s"]] == [(0, 400_001)]


def test_mix_of_one_row_many_times(spark):
    docs = spark.range(9000).selectExpr("7L AS doc_id", "'a b c' AS text", "'s' AS source").union(spark.range(500).selectExpr("id", "'a b c d'", "'t'"))
    got = {r["target"]: (r["n"], r["t"]) for r in mixing.mix(docs).groupBy("target").agg(F.count("*").alias("n"), F.sum("taken").alias("t")).collect()}
    assert {n for n, _ in got.values()} == {9000, 500} and all(abs(t - target) <= 4 for target, (_, t) in got.items())


def test_licences_by_digest_and_title(spark):
    body = licenses.MIT.split("\n", 1)[1].replace("<year> <copyright holders>", "2021 Bob")
    texts = [body, "The MIT License (MIT)\n" + body, "The Unlicense\n\n" + licenses.UNLICENSE.upper(), "© 2020 X\n" + licenses.BOOST.replace(",", " ,"), licenses.ZLIB.replace("acknowledgment", "acknowledgement"), "a known text of ours"]
    mine = licenses.digests_of(spark.createDataFrame([("own", "A known text, of ours!")], "license_id string, text string"))
    known = licenses.known_digests(spark).unionByName(mine)
    assert [r["license_id"] for r in licenses.lookup(make(spark, texts), known).orderBy("doc_id").collect()] == ["MIT", "MIT", "Unlicense", "BSL-1.0", "Zlib", "own"]
    assert licenses.lookup(make(spark, texts).limit(0), known).count() == 0 and licenses.lookup(make(spark, texts), known.limit(0)).count() == 6
    assert len({d for _, d in licenses.DIGESTS}) == len(licenses.DIGESTS)


def test_secrets_outside_the_patterns():
    """Secrets in forms that training never saw: most are found, and few spans are anything else."""
    plain = [" ".join("".join(random.Random(i * 97 + j).choice("abcdefghij") for _ in range(2 + j % 7)) for j in range(60)) for i in range(300)]
    crf = secrets.fit(plain[:200], forms=secrets.FORMS[:-4])
    rng = random.Random(99)
    made = [secrets.plant(t, rng, secrets.FORMS[-4:]) for t in plain[200:]]
    found = right = total = 0
    for (text, where), (base, every) in zip(made, secrets.scan_texts(pa.array([t for t, _ in made]), crf)):
        spans = [s for s in every if s[2] == "crf"]
        total += len(where)
        found += sum(any(a < y and x < b for x, y, _ in every) for a, b in where)
        right += sum(not any(a < y and x < b for a, b in where) for x, y, _ in spans)
        assert set(base) <= set(every)
    assert found >= 0.8 * total and right <= 0.1 * total, (found, right, total)


def test_chats_of_odd_tables(spark):
    kind = "conv_id long, turn long, role string, text string, n int, _id int"
    rows = [(1, 0, "user", "hi", 1, 1), (1, 0, "user", "hi", 1, 1), (1, 1, None, None, 1, 1), (2, 0, "user", "hi", 1, 1), (3, None, "user", "x " * 100_000, 1, 1)]
    got = {r["conv_id"]: r["n_turns"] for r in chats.collapse(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: 2, 3: 1} and chats.collapse(spark.createDataFrame([], kind)).count() == 0


@pytest.mark.parametrize("name", ["op2_near_dedup", "op3_decontaminate", "op6_substring_dedup", "op7_chat_collapse", "op8_line_dedup", "op9_license_scan"])
def test_registered_queries_agree_with_their_sql(spark, name):
    import os

    import duckdb

    from evidara.llm import registry

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    want, got = con.sql(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    rows = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
    assert sorted(got.columns) == columns and rows(got) == rows(want)


def test_registered_queries_without_sql(spark):
    from evidara.llm import registry

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = {r["doc_id"]: r for r in registry.QUERIES["op10_secret_scan"](spark, sf).collect()}
    assert all(found[i]["base_sha256"] == hashlib.sha256(plain_base(t).encode()).hexdigest() for i, t in texts.items())
    ids = sorted(texts)
    sets, top = linked([texts[i] for i in ids], 2)
    near_ = {r["doc_id"]: r for r in registry.QUERIES["op2_near_dedup"](spark, sf).collect()}
    assert all((near_[i]["n_shingles"], near_[i]["component_id"]) == (len(sets[p]), ids[top[p]]) for p, i in enumerate(ids))
    scored = registry.QUERIES["op1_toxicity"](spark, sf).collect()
    assert len(scored) == len(texts) and all(r["predicted"] == (r["score"] >= 0.3) and bool(r["sentences"]) == bool(r["predicted"]) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored)
    assert registry.QUERIES["op4_mix_sources"](spark, sf).count() == len(texts)
    hits, truth = registry.QUERIES["op5_nearest"](spark, sf).collect(), spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids5, x = np.array([r["vec_id"] for r in truth]), np.array([r["embedding"] for r in truth], float)
    right = sum(len({r["vec_id"] for r in hits if r["query_id"] == q} & set(ids5[[i for i in np.lexsort((ids5, ((x - x[p]) ** 2).sum(1))) if i != p][:10]])) for p, q in enumerate(ids5) if q % 100 == 0)
    assert right >= 0.9 * len(hits)


def test_containment_loses_no_item_of_any_size(spark):
    """Items of every partition, held at exactly the asked share with the misses where the sketch is: all are found."""
    import random

    rng = random.Random(7)
    items, docs, want = [], [], set()
    for i, n in enumerate((5, 9, 28, 29, 52, 53, 100, 101, 196, 197, 405)):
        words = [f"i{i}w{j}" for j in range(n)]
        items.append((i, " ".join(words)))
        shingles = n - 4
        for cut in range(4):
            # Words behind the cut are others, so the last shingles are missed; the beginning differs by the document's own words.
            keep = n - shingles * 20 // 100 - (cut == 3)
            turned = words[n - keep :] if cut % 2 else words[:keep]
            noise = [f"n{rng.randrange(10**9)}" for _ in range(rng.randrange(500))]
            docs.append((len(docs), " ".join([*noise, *turned, *noise[::-1]])))
            if (keep - 4) * 100 >= shingles * 80:
                want.add((docs[-1][0], i))
    got = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
