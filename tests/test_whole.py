"""Queries do the whole job: rows that earlier versions left out, on small fixtures."""

from __future__ import annotations

import difflib
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from evidara.functions import scalar as S
from evidara.operators import citations as K
from evidara.operators import segments as G
from evidara.plans import more, registry, scalars

registry.load()


def test_scan_of_long_texts(spark, tmp_path):
    texts = ["a 1234 b", "x" * 16_380 + " 123456789 " + "y 5678 " * 3000, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in registry.QUERIES["TXT-02_windowed_scan"](spark, str(tmp_path)).collect()}
    assert {r for r in got if r[0] < 3} == {(0, 1), (1, 3001), (2, 0)} and 3 in {r[0] for r in got}


def test_text_similarity_against_brute_force(spark):
    rng = random.Random(7)
    words = "Cash Flow revenue, total; Équité of the (year) was 12.5 and e e e then".split(" ")
    made = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bases = [made(n) for n in (30, 60, 150, 400, 2)]
    notes = [(i, t) for i, t in enumerate([x for t in bases for x in (t, t.upper().replace(" ", " \n "), " ".join(w for w in t.split() if rng.random() < 0.8), made(len(t.split())))] + ["...", "!" * 90, ""], 1)]
    docs = [(100 + i, len(t) * 10 + d, x) for i, (t, d, x) in enumerate([(t, d, x) for _, t in notes for d, x in ((0, t), (len(t) // 9, t.lower()), (0, rng.choice(bases)), (0, " ".join(w for w in t.split() if rng.random() < 0.85)), (len(t), t))])]
    docs += [(900, 900, "?!"), (901, len(bases[1]) * 10, None), (902, None, bases[0]), (903, 0, bases[0])]
    got = more.text_similarity(spark.createDataFrame(docs, "id long, size_bytes long, text string"), spark.createDataFrame(notes, "id long, text string"))

    fp = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", (t or "").lower())).strip()[:600]
    want = {}
    for i, size, x in docs:
        for n, y in notes:
            if size and len(y) and size * 0.98 <= len(y) * 10 <= size * 1.02:
                a, b = fp(x), fp(y)
                ratio = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else None
                if not a or b and ratio >= 0.70:
                    want[i, n] = ratio
    rows = got.collect()
    assert len(rows) == len(want) and {(r["id"], r["nid"]): r["ratio"] for r in rows} == want
    assert sum(v is None for v in want.values()) > 2 and sum(v is not None and 0.7 <= v < 1 for v in want.values()) > 5


def test_windows_have_a_hard_maximum(spark, tmp_path):
    def reference(windows, target, overlap):
        out = []
        for s, e in windows:
            if e - s <= max(target, int(target * 1.4)):
                out.append((s, e))
                continue
            while True:
                out.append((s, min(s + target, e)))
                if s + target >= e:
                    break
                s += target - overlap
        return out

    cases = [[(0, 1540)], [(0, 1541)], [(0, 100), (101, 17_000), (17_001, 17_020)], [(5, 2025), (2030, 3570)], []]
    df = spark.createDataFrame([(x,) for x in cases], "w array<struct<start:int,end:int>>")
    for target, overlap in ((1100, 180), (300, 400), (1100, 0)):
        got = [[tuple(w) for w in r[0]] for r in df.select(G.cap_windows(F.col("w"), target, overlap)).collect()]
        assert got == [reference(x, target, min(overlap, target // 2)) for x in cases]

    texts = ["word " * 3400 + ". Short one. Another.", "One. Two."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = registry.QUERIES["VEC-01_sentence_windows"](spark, str(tmp_path)).orderBy("doc_id", "chunk").collect()
    assert max(r["end"] - r["start"] for r in rows) <= 1540
    long = [(r["start"], r["end"]) for r in rows if r["doc_id"] == 0]
    assert long == reference([(0, 17_001), (17_001, len(texts[0]))], 1100, 180) and [r["chunk"] for r in rows if r["doc_id"] == 0] == list(range(len(long)))


def one_by_one(keys, id_of):
    held = {}
    for key in sorted(keys):
        held[next(i for n in range(5000) if (i := id_of(key, n)) not in held)] = key
    return {k: i for i, k in held.items()}


def test_probing_in_rounds_is_one_by_one(spark):
    for size, count in ((50, 40), (400, 90)):
        id_of = lambda key, n: str(zlib.crc32(f"{key}/{n}".encode()) % size)  # noqa: E731, B023
        keys = [f"key{i * 7919 % 1000:03d}" for i in range(count)]
        by_column = lambda key, n: F.pmod(F.crc32(F.concat(key, F.lit("/"), n.cast("string"))), F.lit(size)).cast("string")  # noqa: E731, B023
        got = K.allocated(spark.createDataFrame([(k,) for k in [*keys, *keys[:9], None]], "key string"), by_column)
        assert {r["key"]: r["cite"] for r in got.collect()} == one_by_one(keys, id_of) and got.count() == count
    with pytest.raises(ValueError):
        K.allocated(spark.createDataFrame([("a",), ("b",)], "key string"), lambda key, n: F.lit("same"), most=3)


def cite_id_of(key, attempt):
    value = int.from_bytes(hashlib.sha256(f"{key}:{attempt}".encode()).digest()[:10], "big")
    return "".join(S.BASE62[value // 62**k % 62] for k in (3, 2, 1, 0))


def test_no_two_keys_share_a_cite_id(spark, tmp_path):
    names = [f" Key {i}" for i in range(100_000)] + ["KEY 7", None]
    spark.createDataFrame(list(enumerate(names)), "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    got = dict(map(tuple, registry.QUERIES["FN-06_cite_id_probing"](spark, str(tmp_path)).collect()))
    keys = {n.strip().lower() for n in names if n}
    want = one_by_one(keys, cite_id_of)
    assert len({cite_id_of(k, 0) for k in keys}) < len(keys)
    assert got == {i: want[n.strip().lower()] if n else None for i, n in enumerate(names)}


def test_snippets_and_numbers_of_all_rows(spark):
    text = "".join(f"word{i:02d} " for i in range(30)).strip()
    docs = [(i, text[:n]) for i, n in ((0, 5), (3, 400), (10, 60), (60, 90), (120, 209), (200, 208), (250, 100), (299, 0))]
    got = dict(map(tuple, scalars.snippet(spark.createDataFrame(docs, "doc_id long, text string")).collect()))

    def snippet(t, at):
        first = min(at, len(t))
        start, end = max(0, first - 44), min(len(t), max(first, min(at + 10, len(t))) + 44)
        return ("…" if start > 0 else "") + t[start:end].strip() + ("…" if end < len(t) else "")

    assert got == {i: snippet(t, i) for i, t in docs}
    raw = ["7.25", " 12 ", "-.5", "3.", "1e3", "one", "", None, "42"]
    rows = scalars.optional(spark.createDataFrame(list(enumerate(raw)), "id long, raw string")).collect()
    whole = {" 12 ": 12, "42": 42}
    assert {r["id"]: (r["s"], r["n"]) for r in rows} == {i: ((x or "").strip() or None, whole.get(x)) for i, x in enumerate(raw)}


def test_embeddings_again(spark):
    import xxhash

    texts = ["Cash flow rose", "a a A", "x " * 500, "  ", None]
    got = dict(map(tuple, more.embedding(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    assert set(got) == {0, 1, 2}
    for i, vector in got.items():
        want = [0.0] * 64
        for w in texts[i].lower().split():
            h = xxhash.xxh3_64_intdigest(w)
            want[h % 64] += 1 if h >> 63 else -1
        size = sum(x * x for x in want) ** 0.5
        assert all(abs(a - b / size) < 1e-6 for a, b in zip(vector, want))


def test_windows_and_annotations_against_plain_loops(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word ", "é日 ", "FY2019 ", "£3,000 ", ". ", "! ", "\n", "cash flow "]) for _ in range(rng.randint(0, 900))) for _ in range(30)] + ["", None, " \n ", "no mark\n" * 300, "a\nlast line\n", ("x " * 70 + ". ") * 40, " " * 4000 + "."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def windows(t, target=1100, overlap=180):
        """The rule step by step: the next start goes back from behind the window while the window's end is far enough from it, but not to the window's own start."""
        spans = [m.span() for m in re.finditer(r"[^.!?\n]+(?:[.!?]+|$)", t) if m[0].strip()]
        out, i = [], 0
        while i < len(spans):
            j = i + 1
            while j < len(spans) and spans[j][1] - spans[i][0] <= target:
                j += 1
            out.append((spans[i][0], spans[j - 1][1]))
            if j == len(spans):
                break
            back = j
            while back > i + 1 and out[-1][1] - spans[back - 1][0] >= overlap:
                back -= 1
            i = back
        if not spans and t.strip():
            a = 0
            while True:
                out.append((a, min(a + target, len(t))))
                if a + target >= len(t):
                    break
                a += target - overlap
        return out

    got = {}
    for r in G.sentence_windows(docs, "doc_id").orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    checked = 0
    for i, t in enumerate(texts):
        if t is not None and all(b - a <= 1540 for a, b in windows(t)):
            assert got.get(i, []) == windows(t)
            checked += 1
    assert checked > 20
    for r in G.sentences(docs, "doc_id").collect():
        assert re.fullmatch(r"[^.!?\n]+[.!?]*", texts[r["doc_id"]][r["start"] : r["end"]])
    for r in G.annotations(docs, "doc_id").collect():
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["label"]
    assert G.annotations(docs, "doc_id", category="period").filter("category <> 'period'").count() == 0
    assert G.annotations(docs, "doc_id", most=3).groupBy("doc_id").count().filter("count > 3").count() == 0


def test_sentences_take_linear_time():
    import time

    began = time.time()
    text = "word " * 200_000 + "\nEnd."
    assert G.scan_sentences(text) == [(len(text) - 4, len(text))] and G.scan_sentences(text[:-4]) == [(0, 1_000_000)] and G.scan_sentences(text[:-4] + "\n") == []
    assert G.scan_sentences("word " * 200_000 + "!") == [(0, 1_000_001)] and G.scan_sentences("a\n") == [(0, 1)] and G.scan_sentences("a\n\n") == []
    assert time.time() - began < 5


def test_band_counts_without_pairs(spark):
    from evidara.operators.bands import band_counts

    rng = random.Random(9)
    right = [(i, rng.choice((rng.randrange(-2, 40), rng.randrange(1, 3000), 10**6 + rng.randrange(50_000), None))) for i in range(600)]
    left = [(i, rng.choice((rng.randrange(-2, 40), rng.randrange(1, 3000), 10**6 + rng.randrange(50_000), None))) for i in range(200)]
    for tolerance in (0.02, 0.3, 0.0):
        got = {r["id"]: (r["n"], r["first"]) for r in band_counts(spark.createDataFrame(left, "id int, a long"), spark.createDataFrame(right, "did int, b long"), "a", "b", tolerance, "did").collect()}
        want = {}
        for i, a in left:
            hit = [j for j, b in right if a and b and a > 0 and b > 0 and a * (1 - tolerance) <= b <= a * (1 + tolerance)]
            if hit:
                want[i] = (len(hit), min(hit))
        assert got == want and len(want) > 20
    none = spark.createDataFrame([], "id int, a long")
    assert band_counts(none, spark.createDataFrame(right, "did int, b long"), "a", "b", 0.1, "did").count() == 0


def test_longest_common_subsequence_bounds_the_matcher():
    from evidara.operators import similar as A

    rng = random.Random(11)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 40))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        places = {x: sum(1 << i for i, z in enumerate(a) if z == x) for x in set(a)}
        assert A.longest_common(a, places, b) == table[-1][-1]
        assert difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() <= 2 * table[-1][-1] / (len(a) + len(b))


def test_blocks_of_texts_give_the_ratios_of_single_pairs(spark):
    """Blocks far smaller than the groups, texts longer than a word of places, sizes that share buckets."""
    import numpy as np

    from evidara.operators import similar as A

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdé 1") for _ in range(rng.choice((1, 3, 40, 64, 65, 128, 200)))) for _ in range(60)]
    texts += ["".join(x for x in t if rng.random() < 0.85) or "a" for t in texts]
    masks, symbols = A.places(texts)
    for b in texts[:40] + ["zzz", "a" * 300]:
        want = [A.longest_common(a, {x: sum(1 << i for i, z in enumerate(a) if z == x) for x in set(a)}, b) for a in texts]
        assert np.array_equal(A.longest_common_all(masks, b, symbols), want)
    rows = [(rng.randrange(95, 106), t) for t in texts] + [(100, ""), (0, "abc"), (None, "abc")]
    left = spark.createDataFrame(rows, "size long, a string")
    right = spark.createDataFrame([(s, t) for s, t in rows[1:]], "rsize long, b string")
    near = [(s, a, z, b) for s, a in set(rows) for z, b in set(rows[1:]) if s and z and s * (1 - 0.02) <= z <= s * (1 + 0.02)]
    match = lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    want = {(s, a, z, b): match(a, b) if a else None for s, a, z, b in near if not a or match(a, b) >= 0.7}
    got = A.alike(left, right, block=7).collect()
    assert len(got) == len(want) and {tuple(r)[:4]: r["ratio"] for r in got} == want and len(want) > 100
    fits = [(a, b) for _, a, _, b in near if a and min(len(a), len(b)) * 2.0 / (len(a) + len(b)) >= 0.7]
    shared = lambda a, b: sum(min(a.count(x), b.count(x)) for x in set(a))
    assert tuple(A.tested(left, right, block=7).first()) == (len(fits), sum(shared(a, b) * 2.0 / (len(a) + len(b)) >= 0.7 for a, b in fits))
    # Each task has as many of a group's rows as two blocks, however many share a size.
    same = spark.range(300).selectExpr("100L AS size", "concat('text of number ', id) AS a")
    l, r = A.blocks(same, same.toDF("rsize", "b"), 0.7, 0.02, 20)
    assert l._df.groupBy("_b", "_f", "_i", "_j").count().agg({"count": "max"}).first()[0] < 60


def test_parts_of_the_characters_rule_unlike_texts_out(monkeypatch):
    """Few pairs of unlike texts get as far as the longest common subsequence of whole texts, and the ratios are the matcher's."""
    import numpy as np

    from evidara.operators import similar as A

    rng = random.Random(3)
    letters, words = "etaoinshrdlcumwfgypbvk", []
    for _ in range(400):
        words.append("".join(rng.choice(letters[: rng.randrange(4, 22)]) for _ in range(rng.randrange(2, 9))))
    texts = [" ".join(rng.choice(words) for _ in range(150))[:600] for _ in range(60)]
    texts += ["".join(x for x in t if rng.random() < 0.9) for t in texts[:5]] + ["".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(600)) for _ in range(3)]
    seen = []
    one, many = A.longest_common, A.longest_common_all
    monkeypatch.setattr(A, "longest_common", lambda *x: seen.append(1) or one(*x))
    monkeypatch.setattr(A, "longest_common_all", lambda masks, *x: seen.append(masks.shape[2]) or many(masks, *x))
    i, j = (x.reshape(-1) for x in np.indices((len(texts), len(texts))))
    got = A.ratios(texts, texts, i, j, 0.7)
    assert sum(seen) < len(i) / 20
    near = {(x, y) for x, y, r in zip(i, j, got) if r >= 0.7}
    assert near == {(x, x) for x in range(len(texts))} | {p for k in range(5) for p in ((k, 60 + k), (60 + k, k))}
    assert all(got[x * len(texts) + y] == difflib.SequenceMatcher(None, texts[x], texts[y], autojunk=False).ratio() for x, y in near)


def test_documents_that_read_alike_are_counted_by_fingerprint(spark):
    """Against every pair of rows: ids that repeat or are null, near sizes one way only, texts without letters, many copies."""
    from evidara.plans.more import similar_documents
    from tests.shuffles import shuffled_rows

    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdé 1") for _ in range(rng.choice((1, 40, 130)))) for _ in range(25)]
    texts += ["".join(x for x in t if rng.random() < 0.85) or "a" for t in texts] + ["", "!!", " "]
    rows = [(rng.choice((k, k, k // 3, None)), rng.choice(texts), rng.choice((97, 98, 100, 102, 0, None))) for k in range(150)]
    rows += [(1000, texts[2], 98), (1001, texts[2], 100), (5, texts[2] + "x", 100), (5, texts[2], 100)]
    bare = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t.lower())).strip()
    match = lambda a, b: not a or (b and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.7)
    want = {}
    for d, t, s in rows:
        for o, u, z in rows:
            if None not in (d, o, s, z) and d != o and s and z and s * (1 - 0.02) <= z <= s * (1 + 0.02) and match(bare(t), bare(u)):
                n, first = want.get(d, (0, o))
                want[d] = (n + 1, min(first, o))
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))
    assert {r["doc_id"]: (r["n"], r["first"]) for r in got.collect()} == want and len(want) > 50
    # 2000 copies are four million pairs; none of them is made.
    copies = spark.range(2000).selectExpr("id AS doc_id", "'the same text' AS text", "100L AS n_chars")
    found = similar_documents(copies)
    assert found.groupBy("n", "first").count().sort("first").collect() == [(1999, 0, 1999), (1999, 1, 1)]
    assert shuffled_rows(found) < 20_000


def test_matcher_stops_where_a_pair_is_known_to_be_alike(monkeypatch):
    from evidara.operators import similar as A

    rng, seen = random.Random(4), []
    a = "".join(rng.choice("abcdefgh ") for _ in range(600))
    alike = "".join(x for x in a if rng.random() < 0.95)
    other = "".join(rng.choice("abcdefgh ") for _ in range(600))
    one = A.longest_block
    monkeypatch.setattr(A, "longest_block", lambda *x: seen.append(1) or one(*x))
    for b in (alike, other):
        whole = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        seen.clear()
        assert A.ratio(a, b) == whole
        every = len(seen)
        seen.clear()
        assert (A.ratio(a, b, 0.7) >= 0.7) == (whole >= 0.7) and len(seen) < every


def test_beginning_of_a_long_text_gives_its_fingerprint(spark):
    from evidara.operators import similar as A

    whole = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t.lower())).strip()[:600]
    texts = ["Ab, c " * 2000, "!" * 5000 + "Tail of it " * 200, "x" + " " * 9000 + "y", "-- É \n" * 1500, "a" * 2401, "."]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(A.fingerprint(F.col("t"))).collect()
    assert [r[0] for r in got] == [whole(t) for t in texts]
