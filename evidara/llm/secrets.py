"""Secret scanning: fixed patterns, and a linear-chain conditional random field that tags further tokens."""

from __future__ import annotations

import hashlib
import pickle
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm import sampling, words
from evidara.llm.scratch import Scratch

_any = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
KEYS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile("(" + "|".join(map(_any, KEYS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the same matches as with + and a length of 20 asked for after
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
B, I, O = range(3)
NONE = hashlib.sha256(b"").hexdigest()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: by start, then kind. An assign match counts with a value of 6 characters or more."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


#: Texts without a match of this hold no fixed pattern. RE2's case folding admits a few letters more.
MAY_HOLD = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# -- features ---------------------------------------------------------------

_SHAPES = bytes((97 if 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 117 if c >= 128 else c) for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_KEYS = re.compile(rb"passw|pwd|secret|token|api[_-]?key|credential|bearer|private", re.I)
MARKS = b"\"'`,;:=.()[]{}<>#*$%&!?-"
_VALUE = re.compile(rb"[^=:\"']*[\"',;)\]}]*$")  # what follows the last separator of a token
_PLAIN = re.compile(r"[^\W\d_]+[.,;!?]?")
_SEPARATE = re.compile(rb"[=:]$|^[=:]+$")


def core_of(word: bytes) -> str:
    """The token without marks at its ends, A-Z lower-cased: what a word is known by among its neighbours."""
    return word.strip(MARKS).decode("utf-8", "replace").lower()


def token_features(word: bytes, vocabulary: frozenset = frozenset()) -> tuple[str, ...]:
    """Shape, length, alphabet and keyword features of one token, and the word itself if it is in the vocabulary."""
    core = word.strip(MARKS)
    named = (f"word={core_of(word)}",) if core_of(word) in vocabulary else ()
    if word == b"plain" or _PLAIN.fullmatch(word.decode("utf-8", "replace")) and not _KEYS.search(word):
        return ("plain", *named)
    shape = _RUNS.sub(rb"\1", word.translate(_SHAPES))
    value = _VALUE.search(word)[0]
    kinds = value.translate(_SHAPES)
    digits = sum(48 <= c <= 57 for c in value)
    turns = sum(x != y for x, y in zip(kinds, kinds[1:]))
    low = len(set(value)) if len(value) < 64 else 40
    out = [f"shape={shape[:10].decode('latin-1')}", f"len={min(len(value) // 4, 12)}", f"digits={digits * 4 // max(len(value), 1)}", f"variety={min(low // 4, 8)}", f"turns={min(turns // 2, 8)}", f"rate={min(turns * 6 // max(len(value), 1), 5)}"]
    if re.fullmatch(rb"[0-9a-f]+", value):
        out.append(f"hex{min(len(value) // 8, 5)}")
    if re.fullmatch(rb"[A-Z0-9-]+", value):
        out.append(f"upper{min(len(value) // 8, 5)}")
    if re.fullmatch(rb"[A-Za-z0-9+/_.=-]+", value) and digits and len(value) >= 12:
        out.append("key-like")
    if _KEYS.search(word):
        out.append("keyword")
    if _SEPARATE.search(word):
        out.append("separator")
    out += [name for mark, name in ((b"=", "has-equals"), (b":", "has-colon"), (b"@", "has-at"), (b"/", "has-slash"), (b"//", "has-host"), (b".", "has-dot")) if mark in word]
    return (*out, *named)


def file_features(counts: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """A class of each text: by its length in words (2 classes) and its share of tokens with separators or keywords (3)."""
    share = marked / np.maximum(counts, 1)
    return (counts >= 200) * 3 + (share > 0) + (share > 0.02)


@dataclass
class Crf:
    """Scores by feature and label for a token itself, its left and its right neighbour; by label and file class; transitions and starts."""

    index: dict[str, int]
    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    file: np.ndarray
    step: np.ndarray
    start: np.ndarray
    vocabulary: frozenset = frozenset()
    known: dict[bytes, tuple] = field(default_factory=dict)

    def ids(self, word: bytes) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 400_000:
                self.known.clear()
            got = self.known[word] = tuple(i for f in token_features(word, self.vocabulary) if (i := self.index.get(f)) is not None)
        return got

    def tables(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """own, left and right scores of each distinct token. Most tokens share one set of features."""
        sets: dict[tuple, int] = {}
        of = np.fromiter((sets.setdefault(self.ids(w), len(sets)) for w in distinct), np.int64, len(distinct))
        rows = [np.array([m[list(s)].sum(0) for s in sets]).reshape(-1, 3) for m in (self.own, self.left, self.right)]
        return tuple(r[of] if len(r) else np.zeros((0, 3)) for r in rows)

    def emissions(self, codes: np.ndarray, tables: tuple, first: np.ndarray, file: np.ndarray) -> np.ndarray:
        """Score of each label at each token; ``first`` marks the tokens that begin a line, where no neighbour is seen across."""
        own, left, right = tables
        e = own[codes] + self.file[file]
        if len(codes) > 1:
            inner = ~first[1:]
            e[1:][inner] += left[codes[:-1]][inner]
            e[:-1][inner] += right[codes[1:]][inner]
        return e

    def decode(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi labels of every line; a line ends with a step to outside.

        A label's choice at one token changes at most two transitions, so where outside leads by more than twice their
        range it is on the best path for certain; the path falls apart there, and only the stretches between such
        tokens are decoded step by step. The result is that of the full recursion.
        """
        labels = np.full(len(e), O)
        if not len(e):
            return labels
        known = np.concatenate([self.step.ravel(), self.start])
        known = known[known > -1e6]  # impossible steps only help outside
        reach = 2 * (known.max() - known.min())
        unsure = np.flatnonzero(e[:, O] - np.maximum(e[:, B], e[:, I]) <= reach)
        if not len(unsure):
            return labels
        cut = np.flatnonzero((np.diff(unsure) > 1) | first[unsure[1:]]) + 1
        for part in np.split(unsure, cut):
            a, b = part[0], part[-1]
            score = e[a] + (self.start if first[a] else self.step[O])
            back = []
            for t in range(a + 1, b + 1):
                options = score[:, None] + self.step
                back.append(options.argmax(0))
                score = options.max(0) + e[t]
            score = score + self.step[:, O]  # what follows is outside for certain, as is a line's end
            y = int(score.argmax())
            labels[b] = y
            for t in range(b, a, -1):
                y = back[t - a - 1][y]
                labels[t - 1] = y
        return labels


PLAIN = r"^\pL+[.,;!?]?$"
_KEYS_RE2 = "(?i)passw|pwd|secret|token|api[_-]?key|credential|bearer|private"


def tokens(texts: pa.Array, vocabulary: frozenset = frozenset()) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(code of each token, distinct tokens, does it begin a line, its text, its place among its text's tokens).

    Plain words (letters and a mark) outside the vocabulary share code 0, as they share their features.
    """
    flat, counts = words.split(pc.replace_substring(pc.fill_null(texts, ""), "\n", " \x01 "))
    starts, owner, place = words.spread(counts)
    plain = pc.and_not(pc.match_substring_regex(flat, PLAIN), pc.match_substring_regex(flat, _KEYS_RE2))
    if vocabulary:
        known = pc.is_in(pc.ascii_lower(pc.ascii_trim(flat, characters=MARKS.decode())), value_set=pa.array(sorted(vocabulary), pa.string()))
        plain = pc.and_not(plain, known)
    odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
    odd_codes, odd_words = words.encode(flat.take(pa.array(odd)))
    codes = np.zeros(len(flat), np.int64)
    codes[odd] = odd_codes + 1
    distinct = [b"plain", *odd_words]
    breaks = codes == (odd_words.index(b"\x01") + 1 if b"\x01" in odd_words else -1)
    first = np.concatenate([[True], breaks[:-1]]) | (place == 0) if len(codes) else breaks
    # A line's first token keeps its mark; the breaks themselves go.
    codes, owner, first = codes[~breaks], owner[~breaks], first[~breaks]
    n = np.bincount(owner, minlength=len(texts))
    return codes, distinct, first, owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def _file_of(codes: np.ndarray, distinct: list[bytes], owner: np.ndarray, n: int) -> np.ndarray:
    marked = np.fromiter((b"=" in w or bool(_KEYS.search(w)) for w in distinct), bool, len(distinct))
    hits = np.bincount(owner, weights=marked[codes], minlength=n) if len(codes) else np.zeros(n)
    return file_features(np.bincount(owner, minlength=n), hits)


TOKEN = re.compile(r"[^ \t-\r]+")


def gold(text: str, planted: list[tuple[int, int]] = ()) -> np.ndarray:
    """B, I or O of each token: tokens that hold part of a value of the fixed patterns, or of a planted one, are in a secret."""
    spans = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [m.span() for p in (ACCESS, HEX) for m in p.finditer(text)]
    where = [m.span() for m in TOKEN.finditer(text) if m[0] != "\x01"]
    out = np.full(len(where), O)
    ends = np.array([b for _, b in where])
    for a, b in sorted([*spans, *planted]):
        t = int(np.searchsorted(ends, a, side="right"))
        begun = False
        while t < len(where) and where[t][0] < b:
            if out[t] == O:
                out[t] = I if begun else B
            begun = True
            t += 1
    return out


# Words before planted secrets, beginnings of keys, and the forms they stand in.
BEFORE = ("bearer", "passphrase", "credential", "auth", "authorization", "pin", "login", "key", "signature", "webhook", "session", "cookie", "pwd", "private_key", "access-key", "client")
BEGINNINGS = ("sk_live_", "ghp_", "xoxb-", "glpat-", "pk_test_", "AIza")
FORMS = ("{k}: {v}", "{k}={v}", "{k} {v}", "\"{k}\": \"{v}\",", "{k} is {v}", "{v}", "use {v} here", "--{k} {v}", "({v})", "export {K}={v}", "{k} := '{v}'")


def a_value(rng: random.Random) -> str:
    """A made-up secret outside the fixed patterns' values: random letters and digits, groups, a known beginning, or a password."""
    some = lambda alphabet, lo, hi: "".join(rng.choice(alphabet) for _ in range(rng.randint(lo, hi)))
    mixed = string.ascii_letters + string.digits
    kind = rng.randrange(6)
    if kind == 0:
        return some(mixed, 16, 48)
    if kind == 1:
        return some(mixed + "+/", 18, 60) + rng.choice(("=", "==", ""))
    if kind == 2:
        return "-".join(some(string.ascii_uppercase + string.digits, 5, 5) for _ in range(rng.randint(3, 6)))
    if kind == 3:
        return rng.choice(BEGINNINGS) + some(mixed, 14, 40)
    if kind == 4:
        return some(string.ascii_letters, 4, 7) + some("!@#$%^&*", 1, 2) + some(string.digits, 2, 4) + some(mixed, 1, 4)
    return some(mixed, 10, 20) + " " + some(mixed, 10, 20)


def a_likeness(rng: random.Random) -> str:
    """A token that looks like one and is none: address, path, version, time, number, identifier."""
    word = lambda: "".join(rng.choice("bcdfghlmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    n = lambda k: str(rng.randrange(10 ** (k - 1), 10**k))
    return rng.choice((
        f"https://{word()}.org/{word()}/{n(4)}?{word()}={n(3)}", f"{word()}.{word()}@{word()}.com", f"{word()}.{n(2)}@{word()}{n(1)}.{word()}.com", f"/{word()}/{word()}_{n(2)}/{word()}.{word()[:3]}", f"v{n(1)}.{n(2)}.{n(1)}-beta", f"20{n(2)}-0{n(1)}-1{n(1)}T1{n(1)}:{n(2)}:00Z",
        f"+{n(2)}-{n(3)}-{n(7)}", f"INV-{n(8)}", f"{n(3)},{n(3)}.{n(2)}", f"get{word().title()}{word().title()}{n(1)}", f"{word()}_{word()}_{word()}_v{n(1)}", f"10.{n(4)}/{word()}.{n(5)}", f"{word().upper()}-{n(4)}", f"{word()}: {n(3)}", f"{word()}={word()}", f"({word()}, {n(4)})",
    ))


def plant(text: str, rng: random.Random, forms: tuple[str, ...] = FORMS) -> tuple[str, list[tuple[int, int]]]:
    """A text with one to three made-up secrets and as many likenesses put between its words, and where the secrets are."""
    at = sorted(rng.choice([m.start() for m in TOKEN.finditer(text)] or [0]) for _ in range(rng.randint(2, 6)))
    out, spans, before = "", [], 0
    for i, p in enumerate(at):
        out += text[before:p]
        before = p
        if i % 2:
            out += a_likeness(rng) + rng.choice((" ", " ", "\n"))
            continue
        value, key = a_value(rng), rng.choice(BEFORE)
        left, _, right = rng.choice(forms).partition("{v}")
        out += left.replace("{k}", key).replace("{K}", key.upper())
        spans.append((len(out), len(out) + len(value)))
        out += value + right.replace("{k}", key) + rng.choice((" ", " ", ". ", "\n"))
    return out + text[before:], spans


def words_before(texts: list[str], labels: list[np.ndarray], *, least: int = 3, most: int = 300) -> frozenset:
    """Words next to a secret in ``least`` places, at most the ``most`` commonest; these are told apart as neighbours."""
    seen: dict[str, int] = {}
    for text, y in zip(texts, labels):
        ws = [m[0] for m in TOKEN.finditer(text) if m[0] != "\x01"]
        for t in np.flatnonzero(y != O):
            for x in (t - 1, t + 1):
                if 0 <= x < len(ws) and y[x] == O and (core := core_of(ws[x].encode())) and len(core) <= 20:
                    seen[core] = seen.get(core, 0) + 1
    return frozenset(sorted((w for w, n in seen.items() if n >= least), key=lambda w: (-seen[w], w))[:most])


def fit(texts: list[str], *, rounds: int = 60, rate: float = 0.3, l2: float = 1e-3, stride: int = 50, planted: int = 600, seed: int = 5, forms: tuple[str, ...] = FORMS) -> Crf:
    """Maximum likelihood by forward-backward over lines.

    Labels come from the fixed patterns, and from secrets that are put into copies of up to ``planted`` of the texts:
    values of other shapes, with and without a word that tells them, and likenesses that are none, so that the model
    must learn what the patterns don't say. Lines of similar length are handled together, filled up with outside
    tokens; of the lines without any secret one in ``stride`` trains (weighted as ``stride`` of them).
    """
    texts = [t or "" for t in texts]
    rng = random.Random(seed)
    made = [plant(t, rng, forms) for t in sorted(texts)[:: max(1, len(texts) // max(planted, 1))][:planted]] if planted and texts else []
    labels = [gold(t) for t in texts] + [gold(t, where) for t, where in made]
    texts = texts + [t for t, _ in made]
    vocabulary = words_before(texts, labels)
    codes, distinct, first, owner, _ = tokens(pa.array(texts, pa.string()), vocabulary)
    feats = [token_features(w, vocabulary) for w in distinct]
    index = {f: i for i, f in enumerate(sorted({f for fs in feats for f in fs}))}
    k = max(len(index), 1)
    crf = Crf(index, np.zeros((k, 3)), np.zeros((k, 3)), np.zeros((k, 3)), np.zeros((6, 3)), np.zeros((3, 3)), np.zeros(3), vocabulary)
    crf.step[O, I] = crf.start[I] = -1e9  # inside only follows a beginning
    if not len(codes):
        crf.own[:, O] = crf.file[:, O] = 50
        return crf
    y = np.concatenate(labels)
    file = _file_of(codes, distinct, owner, len(texts))[owner]
    line = np.cumsum(first) - 1
    has = np.bincount(line, weights=y != O) > 0
    chosen = has | (np.arange(len(has)) % stride == 0)
    weight = np.where(has, 1.0, float(stride))
    sets: dict[tuple, int] = {}
    set_of = np.fromiter((sets.setdefault(tuple(index[f] for f in fs), len(sets)) for fs in feats), np.int64, len(feats))
    hot = np.zeros((len(sets) + 1, k))
    for s, i in sets.items():
        hot[i, list(s)] = 1
    begin = np.flatnonzero(first)
    length = np.diff(np.append(begin, len(codes)))
    batches = []
    pad = len(sets)
    size = np.ceil(np.log(length + 1) / np.log(1.5)).astype(int)
    for c in np.unique(size[chosen]):
        at = np.flatnonzero(chosen & (size == c))
        n = int(length[at].max()) + 1
        where = begin[at][:, None] + np.minimum(np.arange(n), length[at][:, None] - 1)
        inside = np.arange(n) < length[at][:, None]
        batches.append((np.where(inside, set_of[codes[where]], pad), file[begin[at]], np.where(inside, y[where], O), weight[at], ~inside))
    params = [crf.own, crf.left, crf.right, crf.file, crf.step, crf.start]
    fixed_step, fixed_start = crf.step < -1e6, crf.start < -1e6
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    eye, total = np.eye(3), sum(len(x[3]) for x in batches)
    for r in range(1, rounds + 1):
        own_s, left_s, right_s = hot @ crf.own, hot @ crf.left, hot @ crf.right
        g_own, g_left, g_right = (np.zeros((len(sets) + 1, 3)) for _ in range(3))
        g_file, g_step, g_start = np.zeros_like(crf.file), np.zeros((3, 3)), np.zeros(3)
        for x, f, gold_y, w, filled in batches:
            e = own_s[x] + crf.file[f][:, None]
            e[:, 1:] += left_s[x[:, :-1]]
            e[:, :-1] += right_s[x[:, 1:]]
            e[filled] = (-1e9, -1e9, 0)
            n = x.shape[1]
            al, be = np.empty_like(e), np.zeros_like(e)
            al[:, 0] = crf.start + e[:, 0]
            for t in range(1, n):
                al[:, t] = np.logaddexp.reduce(al[:, t - 1][:, :, None] + crf.step, axis=1) + e[:, t]
            for t in range(n - 2, -1, -1):
                be[:, t] = np.logaddexp.reduce(crf.step + (e[:, t + 1] + be[:, t + 1])[:, None, :], axis=2)
            z = np.logaddexp.reduce(al[:, -1], axis=1)
            d = (np.exp(al + be - z[:, None, None]) - eye[gold_y]) * w[:, None, None]
            d[filled] = 0
            np.add.at(g_own, x, d)
            np.add.at(g_left, x[:, :-1], d[:, 1:])
            np.add.at(g_right, x[:, 1:], d[:, :-1])
            np.add.at(g_file, f, d.sum(1))
            g_start += d[:, 0].sum(0)
            for t in range(1, n):
                pair = np.exp(al[:, t - 1][:, :, None] + crf.step + (e[:, t] + be[:, t])[:, None, :] - z[:, None, None])
                g_step += (pair * w[:, None, None]).sum(0) - np.einsum("bi,bj,b->ij", eye[gold_y[:, t - 1]], eye[gold_y[:, t]], w)
        g_step[fixed_step], g_start[fixed_start] = 0, 0
        for i, g in enumerate((hot.T @ g_own, hot.T @ g_left, hot.T @ g_right, g_file, g_step, g_start)):
            p = params[i]
            g = g / total + l2 * np.where(p < -1e6, 0, p) / 10
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g**2
            p -= rate * (m[i] / (1 - 0.9**r)) / (np.sqrt(v[i] / (1 - 0.99**r)) + 1e-6)
        crf.step[fixed_step], crf.start[fixed_start] = -1e9, -1e9
    return crf


def crf_spans(text: str, labels: np.ndarray, place: np.ndarray, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of tagged tokens, without quotes and marks at their ends; those that touch a base span are left out."""
    where = [m.span() for m in TOKEN.finditer(text) if m[0] != "\x01"]
    out: list[list[int]] = []
    for label, t in zip(labels, place):
        a, b = where[t]
        if label == I and out and out[-1][2] == t - 1:
            out[-1][1:] = [b, t]
        else:
            out.append([a, b, t])
    found = []
    for a, b, _ in out:
        while a < b and not text[a].isalnum():
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        if a < b and not any(x < b and a < y for x, y, _ in base):
            found.append((a, b, "crf"))
    return found


def scan_texts(texts: pa.Array, crf: Crf) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    codes, distinct, first, owner, place = tokens(texts, crf.vocabulary)
    may = pc.fill_null(pc.match_substring_regex(texts, MAY_HOLD), False).to_pylist()
    base = [base_spans(texts[i].as_py()) if m else [] for i, m in enumerate(may)]
    every = list(base)
    if len(codes):
        e = crf.emissions(codes, crf.tables(distinct), first, _file_of(codes, distinct, owner, len(texts))[owner])
        labels = crf.decode(e, first)
        tagged = np.flatnonzero(labels != O)
        for i in np.unique(owner[tagged]):
            at = tagged[owner[tagged] == i]
            more = crf_spans(texts[int(i)].as_py(), labels[at], place[at], base[i])
            every[i] = sorted([*base[i], *more], key=lambda x: (x[0], KINDS.index(x[2])))
    return list(zip(base, every))


def scan(docs: DataFrame, crf: Crf) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans) of each whole text; base and spans as ``joined`` writes them.

    Offsets are code points, end exclusive. Null and empty texts have none. Rows that repeat have a row each with equal
    results, whatever their doc_id; spans that start together are in the order of their kinds. An empty table gives an
    empty table; other columns are ignored, whatever their names. No shuffle: one pass over the text, in steps of a few MB.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # a few hundred features
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            for part in words.steps(batch):
                found = scan_texts(part.column("text"), crf)
                count = lambda k: pa.array([sum(s[2] == k for s in b) for b, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), count("assign"), count("access"), count("hex"), pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(s) for _, s in found], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string")


def draw_texts(docs: DataFrame, *, most: int = 1500, most_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, text) of ``most`` whole texts and ``most_bytes`` at most: half of either for texts with a keyword or a key's beginning.

    Drawn by a hash of doc_id and text, so rows that share an id (or have none) are drawn one by one and equal rows are one.
    Texts over an eighth of ``most_bytes`` are never drawn: the sample fits a model, and one of them would fill it.
    """
    hit = F.col("text").rlike(r"(?i)passw|secret|token|api_?key|AKIA|[0-9a-f]{24}")
    wide = docs.select("doc_id", "text", hit.alias("hit"), sampling.row_hash(11, "doc_id", "text").alias("h"), F.octet_length("text").alias("size"))
    wide = wide.filter(F.col("size") <= most_bytes // 8)
    scratch = Scratch(docs.sparkSession, "secrets")
    known = scratch.keep(wide.select("hit", "h", "size"), "hashes")
    ends = [(kind, sampling.limit(known.filter(F.col("hit") == kind), most // 2, most_bytes // 2)) for kind in (True, False)]
    drawn = [(F.col("h") <= end) & (F.col("hit") == kind) for kind, end in ends if end is not None]
    drawn = wide.filter(reduce(or_, drawn, F.lit(False))).dropDuplicates(["h"])
    return scratch.keep(drawn.select("doc_id", "text"), "sample")


def fit_in_task(sample: DataFrame, **options) -> Crf:
    """``fit`` of a sample of bounded size in one task; the driver sees the model alone (some 100 kB)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted(t for batch in source for t in batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, **options))], pa.binary())], names=["model"])

    got = sample.select("text").coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([])


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Per document: counts of the fixed patterns, the digest of their spans, and all spans; cases as ``scan`` states them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, fit_in_task(draw_texts(docs)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
