"""Scalar functions as column expressions: all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of metadata rows, financial terms, document types, media types and extensions.
METADATA_PREFIXES = ("title", "location", "academic years", "data source", "sourced from", "data source link", "data file canonical link", "licence", "license", "code page", "disclaimer", "table ", "last updated")
DOCUMENT_TYPES = (
    ("Annual Report", ("annual report", "annual accounts", "annual financial statements")),
    ("Financial Statements", ("financial statement", "financial statements", "statement of accounts")),
    ("Strategic Plan", ("strategic plan", "strategy", "five year plan")),
    ("Budget", ("budget", "forecast", "financial plan")),
    ("Policy", ("policy", "guidance", "framework")),
    ("Presentation", ("presentation", "slide deck")),
    ("Research Paper", ("working paper", "journal", "paper", "study")),
)
WORD_MEDIA = ("application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.oasis.opendocument.text", "application/rtf")
SHEET_MEDIA = ("application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.oasis.opendocument.spreadsheet", "text/csv")
SLIDE_MEDIA = ("application/vnd.ms-powerpoint", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/vnd.oasis.opendocument.presentation")
MARKUP_MEDIA = ("application/json", "application/xml", "text/xml")
SHEET_SUFFIXES = (".csv", ".xlsx", ".xls", ".ods")
TEXT_SUFFIXES = (".txt", ".md", ".rst", ".adoc", ".tex", ".json", ".xml", ".html", ".htm", ".xhtml")
DOCUMENT_SUFFIXES = (".pdf", ".docx", ".doc", ".pptx", ".odt", ".odp", ".epub", ".fb2", ".svg", ".md", ".txt", ".html", ".htm", ".xhtml", ".xml", ".csv", ".xlsx", ".ods")
RESERVED_HOSTS = ("localhost", "example.com", "example.org", "example.net", "127.0.0.1")
RESERVED_ENDINGS = (".localhost", ".example", ".invalid", ".test", ".example.com", ".example.org")
BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"

UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
YEAR = r"\b((?:19|20)\d{2}(?:/\d{2,4})?)\b"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

text_or_empty = lambda c: F.coalesce(c, F.lit(""))
blank_to_null = lambda c: F.nullif(F.trim(c), F.lit(""))


def starts_with_any(c: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def contains_any(c: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


# -- numbers ------------------------------------------------------------------
def parse_numeric(value: Column) -> Column:
    """Number of a cell's text: thousands marks, pound and dollar signs, an m and brackets are dropped; bracketed is negative."""
    text = F.trim(value)
    bare = F.trim(F.regexp_replace(text, r"[,£$mM()]", ""))
    number = F.when(bare.rlike(NUMBER), bare.try_cast("double"))
    return F.when(text.startswith("(") & text.endswith(")"), -number).otherwise(number)


def nearly_equal(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) <= tolerance


def optional_number(value: Column, kind: str = "double") -> Column:
    return blank_to_null(value).try_cast(kind)


def safe_pct(part: Column, whole: Column) -> Column:
    return F.when(whole <= 0, F.lit(0.0)).otherwise(F.round(F.greatest(part, F.lit(0)) / whole * 100, 2))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


# -- identity -----------------------------------------------------------------
def cite_key(key: Column) -> Column:
    return F.lower(F.trim(key))


def cite_id(key: Column, attempt: int | Column = 0) -> Column:
    """Four base-62 digits of the first ten bytes of a SHA-256; only their value modulo 62^4 matters."""
    m = 62**4
    h = F.sha2(F.concat(cite_key(key), F.lit(":"), (attempt if isinstance(attempt, Column) else F.lit(attempt)).cast("string")), 256)
    half = lambda at: F.conv(F.substring(h, at, 10), 16, 10).cast("long") % m
    value = (half(1) * (16**10 % m) + half(11)) % m
    digit = lambda k: F.substring(F.lit(BASE62), F.pmod(F.floor(value / 62**k), F.lit(62)).cast("int") + 1, F.lit(1))
    return F.concat(*[digit(k) for k in (3, 2, 1, 0)])


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def uuid5_url(name: Column) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63) + 128).cast("string"), 10, 16))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def archive_path(digest: Column, suffix: Column) -> Column:
    return F.concat_ws("/", F.lit("sha256"), F.substring(digest, 1, 2), F.substring(digest, 3, 2), F.concat(digest, text_or_empty(suffix)))


# -- addresses ----------------------------------------------------------------
def is_url(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("^https?://"), F.lit(False))


def url_candidate(c: Column) -> Column:
    """Without quotes and brackets around it or commas and semicolons behind; null unless http(s)."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[\"'<\[(]+|[\"'>\])]+$", ""), r"[,;]+$", "")
    return F.when(is_url(bare), bare)


def url_key(c: Column) -> Column:
    """scheme://host/path, lower-cased, without www. and closing slashes; query and fragment go."""
    low = F.lower(F.regexp_replace(F.trim(c), "/+$", ""))
    return F.regexp_replace(F.regexp_extract(low, r"^([a-z][a-z0-9+.-]*://[^/?#]*[^?#]*)", 1), "^([a-z0-9+.-]*://)www[.]", "$1")


def url_host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), "^www[.]", "")


def url_basename(c: Column) -> Column:
    path = F.regexp_replace(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last))


def is_reserved_host(host: Column) -> Column:
    return F.coalesce(host.isin(*RESERVED_HOSTS) | reduce(lambda a, b: a | b, [host.endswith(e) for e in RESERVED_ENDINGS]), F.lit(False))


def disposition_filename(c: Column) -> Column:
    got = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.coalesce(F.try_url_decode(got(r"(?i)filename\*=[^']*''([^;]+)")), got(r'(?i)filename="([^"]+)"'), F.trim(got(r"(?i)filename=([^;\"]+)")))


def first_doi(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)", 1)
    return F.nullif(F.lower(F.regexp_replace(found, r"[.,);]+$", "")), F.lit(""))


def doi_url(doi: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), doi)


def urls_in_text(text: Column, most: int = 12) -> Column:
    found = F.regexp_extract_all(text_or_empty(text), F.lit(r"https?://[^\s\"'<>]+"), 0)
    return F.slice(F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,);]+$", ""))), 1, most)


def merged_urls(*lists: Column) -> Column:
    """Ordered union: candidates cleaned, the first occurrence of each stays."""
    return F.array_distinct(F.filter(F.transform(F.concat(*lists), url_candidate), lambda u: u.isNotNull()))


# -- titles -------------------------------------------------------------------
def clean_title(value: Column) -> Column:
    base = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\?.*$", ""), r"^.*[\\/]", ""), r"(?i)\.[a-z0-9]{2,6}$", "")
    raw = F.trim(text_or_empty(value))
    spaced = F.trim(F.regexp_replace(F.regexp_replace(base(F.regexp_replace(raw, "(?i)^upload:", "")), r"[_\-]+", " "), r"\s+", " "))
    return F.when(base(raw).rlike(UUID) | spaced.rlike(UUID), F.lit("")).otherwise(spaced)


def year_label(*parts: Column) -> Column:
    """The first of the longest year labels; one with a slash wins."""
    found = F.regexp_extract_all(F.concat_ws(" ", *map(text_or_empty, parts)), F.lit(YEAR), 1)
    ranked = F.array_sort(F.transform(found, lambda y, i: F.struct((-F.when(y.contains("/"), 1).otherwise(0)).alias("s"), (-F.length(y)).alias("l"), i.alias("i"), y.alias("y"))))
    return F.coalesce(F.get(ranked, F.lit(0))["y"], F.lit(""))


def document_type(*parts: Column) -> Column:
    low = F.lower(F.concat_ws(" ", *map(text_or_empty, parts)))
    out = F
    for label, needles in DOCUMENT_TYPES:
        out = out.when(contains_any(low, needles), label)
    return out.otherwise("Document")


def title_case(c: Column) -> Column:
    """Capitals after anything but a letter, the rest small."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), 0), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def org_label(uri: Column, hint: Column) -> Column:
    first = F.trim(F.regexp_replace(F.regexp_replace(F.element_at(F.split(url_host(F.trim(uri)), r"\."), 1), "-", " "), r"\s+", " "))
    tokens = F.filter(F.split(clean_title(hint), r"\s+"), lambda t: t != "")
    by_hint = F.when(F.length(F.get(tokens, F.lit(0))) > 2, title_case(F.array_join(F.slice(tokens, 1, 4), " "))).otherwise("")
    return F.when(is_url(F.trim(uri)) & (first != "") & ~first.rlike(UUID), title_case(first)).otherwise(F.coalesce(by_hint, F.lit("")))


def human_title(filename: Column, uri: Column, text: Column, fallback: Column) -> Column:
    hint, text = clean_title(filename), F.substring(text_or_empty(text), 1, 12_000)
    org, kind, year = org_label(uri, hint), document_type(hint, text), year_label(hint, text)
    short = F.substring(F.trim(text_or_empty(fallback)), 1, 8)
    return (
        F.when((org != "") & (year != ""), F.concat_ws(" - ", org, kind, year))
        .when(org != "", F.concat_ws(" - ", org, kind))
        .when(hint != "", hint)
        .when(short != "", F.concat(F.lit("Document "), short))
        .otherwise("Document")
    )


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it stands in it: a condition or a lambda works out again what it names."""
    return F.transform(F.array(value), body)[0]


def query_terms(text: Column, most: int = 14) -> Column:
    """Words for a search: of the first three lines of 30 characters or more that are no headings, page marks or numbers."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.slice(F.filter(F.transform(F.split(text_or_empty(text), r"\r\n|\r|\n"), strip), lambda x: x != ""), 1, 60)
    capitals = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    body = lambda lines: F.slice(F.filter(lines, lambda x: (F.length(x) >= 30) & ~capitals(x) & ~F.lower(x).startswith("page ") & ~x.rlike(r"^[\d\s.]+$")), 1, 3)
    chosen = bound(lines, lambda lines: bound(body(lines), lambda b: F.when(F.size(b) > 0, b).otherwise(F.slice(lines, 1, 3))))
    signal = F.regexp_replace(F.array_join(chosen, " "), r"[^a-zA-Z0-9\s\-_/]", " ")
    return F.array_join(F.slice(F.filter(F.split(signal, r"\s+"), lambda w: F.length(w) > 2), 1, most), " ")


def web_queries(doi: Column, title: Column, author: Column, filename: Column, terms: Column, most: int = 4) -> Column:
    """Searches for a document, the surest first: its DOI, title and author, title, file name and title, title and words; each once whatever its case."""
    blank = F.lit("")
    title, author = F.trim(text_or_empty(title)), F.trim(text_or_empty(author))
    stem = F.regexp_replace(F.regexp_extract(text_or_empty(filename), "([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    stem = F.trim(F.regexp_replace(stem, "[_-]", " "))
    every = F.array(
        text_or_empty(doi), F.when((title != "") & (author != ""), F.concat_ws(" ", title, author)).otherwise(blank), title,
        F.when(stem != "", F.concat_ws(" ", stem, title)).otherwise(blank), bound(terms, lambda t: F.when(t != "", F.concat_ws(" ", title, t)).otherwise(blank)),
    )
    clean = F.filter(F.transform(every, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    first = lambda clean: bound(F.transform(clean, F.lower), lambda folded: F.filter(clean, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1))
    return F.slice(bound(clean, first), 1, most)


def useless_title(title: Column) -> Column:
    low = F.lower(F.trim(text_or_empty(title)))
    return (low == "") | low.isin("document", "unknown", "none", "null", "n/a") | low.startswith("untitled")


def good_titles(titles: Column, most: int = 6, length: int = 90) -> Column:
    """The first titles that say something, each once: white space folded, dots at the end off, cut at ``length``."""
    folded = F.transform(F.filter(titles, lambda t: t.isNotNull()), lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    cut = F.transform(folded, lambda t: F.substring(F.regexp_replace(t, r"\.+$", ""), 1, length))
    return F.slice(F.filter(F.array_distinct(cut), lambda t: ~useless_title(t)), 1, most)


def garbage_token(token: Column) -> Column:
    """Letters mixed with digits, or hardly a vowel, or a temporary name; short tokens pass."""
    low = F.lower(token)
    letters, vowels = F.length(F.regexp_replace(low, "[^a-z]", "")), F.length(F.regexp_replace(low, "[^aeiou]", ""))
    mixed = low.rlike("[0-9]") & (letters >= 2) & ~low.rlike(r"^(fy|q|h|v)?\d+[a-z]?$|^\d+(st|nd|rd|th)$")
    return (F.length(low) >= 5) & (low.rlike("^(tmp|temp)[0-9a-z_]*[0-9]") | mixed | ((letters >= 7) & (vowels / letters < 0.2)))


def snippet(text: Column, at: Column, length: Column, around: int = 44) -> Column:
    """Text around a 0-based place, with ellipses where it is cut; a place behind the text's end is its end."""
    n = F.length(text)
    first = F.least(F.greatest(at, F.lit(0)), n)
    last = F.greatest(first, F.least(at + length, n))
    start, end = F.greatest(first - around, F.lit(0)), F.least(last + around, n)
    part = F.trim(F.substring(text, start + 1, end - start))
    return F.concat(F.when(start > 0, "…").otherwise(""), part, F.when(end < F.length(text), "…").otherwise(""))


def preview(text: Column, n: int) -> Column:
    flat = F.trim(F.regexp_replace(text_or_empty(text), r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…"))).otherwise(flat)


# -- classes ------------------------------------------------------------------
def suffix(filename: Column) -> Column:
    return F.lower(F.regexp_extract(text_or_empty(filename), r"[^/.](\.[^./]+)$", 1))


def media_label(media: Column) -> Column:
    m = F.lower(text_or_empty(media))
    return (
        F.when(m.startswith("application/pdf"), "PDF").when(m.startswith("image/"), "Image").when(m.isin(*WORD_MEDIA), "Word Document")
        .when(m.isin(*SHEET_MEDIA), "Spreadsheet / CSV").when(m.isin(*SLIDE_MEDIA), "Presentation").when(m.startswith("text/html"), "HTML")
        .when(m.isin(*MARKUP_MEDIA), "Structured Text").when(m.startswith("text/"), "Plain Text").otherwise("Other")
    )


def parseable(media: Column, filename: Column) -> Column:
    m = F.lower(F.trim(text_or_empty(media)))
    return m.isin("application/pdf", *WORD_MEDIA, *SHEET_MEDIA, *SLIDE_MEDIA, *MARKUP_MEDIA, "text/html", "text/plain", "text/markdown") | suffix(filename).isin(*DOCUMENT_SUFFIXES)


def ingestion_policy(media: Column, filename: Column, *, extract_tables=False, vector_tables=False, vector_text=True) -> Column:
    """struct(kind, extract, vector, reason)."""
    m = F.lower(F.trim(text_or_empty(media)))
    row = lambda kind, extract, vector, reason: F.struct(F.lit(kind).alias("kind"), F.lit(extract).alias("extract"), F.lit(vector).alias("vector"), F.lit(reason).alias("reason"))
    return (
        F.when(suffix(filename).isin(*SHEET_SUFFIXES) | m.isin(*SHEET_MEDIA), row("structured_data", extract_tables, vector_tables, "structured_data_default_policy"))
        .when(parseable(media, filename), row("narrative_document", True, vector_text, "extractable_narrative"))
        .otherwise(row("other", False, False, "unsupported_media"))
    )


def viewer_kind(media: Column, filename: Column) -> Column:
    m, s = F.lower(text_or_empty(media)), suffix(filename)
    return (
        F.when((m == "application/pdf") | (s == ".pdf"), "pdf").when(m.startswith("image/"), "image")
        .when(m.isin(*(x for x in SHEET_MEDIA if x != "application/vnd.ms-excel")) | s.isin(".csv", ".xlsx", ".ods"), "table")
        .when(m.startswith("text/") | s.isin(*TEXT_SUFFIXES), "text").when(parseable(media, filename), "structured").otherwise("binary")
    )


def data_format(media: Column, filename: Column) -> Column:
    m, s = F.lower(text_or_empty(media)), suffix(filename)
    return (
        F.when((m == "text/csv") | (s == ".csv"), "csv").when((s == ".xlsx") | m.contains("spreadsheetml"), "xlsx")
        .when((s == ".xls") | (m == "application/vnd.ms-excel"), "xls").when((s == ".ods") | m.contains("opendocument.spreadsheet"), "ods")
        .when(s != "", F.substring(s, 2, 20)).otherwise("unknown")
    )


# -- tables -------------------------------------------------------------------
def column_name(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " ")))


def distinct_columns(names: Column) -> Column:
    """Blank names become column_i; repeats, whatever their case, get _2, _3 and so on."""
    filled = F.transform(names, lambda n, i: F.when(F.trim(text_or_empty(n)) == "", F.concat(F.lit("column_"), i + 1)).otherwise(F.trim(n)))
    count = lambda all_, n, i: F.size(F.filter(F.slice(all_, 1, i + 1), lambda x: F.lower(x) == F.lower(n)))
    return F.transform(filled, lambda n, i: F.when(count(filled, n, i) > 1, F.concat(n, F.lit("_"), count(filled, n, i))).otherwise(n))


def is_metadata_row(first_cell: Column) -> Column:
    return starts_with_any(F.lower(F.trim(text_or_empty(first_cell))), METADATA_PREFIXES)


def a1_column(ref: Column) -> Column:
    """0-based column of an address such as AB12."""
    letters = F.split(F.upper(F.regexp_extract(ref, "^([A-Za-z]+)", 1)), "(?!^)")
    return F.aggregate(letters, F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64)) - 1


def row_has_text(cells: Column) -> Column:
    return F.exists(cells, lambda x: F.trim(text_or_empty(x)) != "")


# -- spans --------------------------------------------------------------------
def clamp_span(start: Column, end: Column, length: Column) -> Column:
    """struct(start, end) within [0, length]; null if empty."""
    a, b = F.greatest(F.lit(0), F.least(start, length)), F.greatest(F.lit(0), F.least(end, length))
    return F.when(b > a, F.struct(a.alias("start"), b.alias("end")))


def normal_bbox(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    known = x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()
    return F.when(known, F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1")))


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(r"[\p{L}\p{N}_]+"))


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.regexp_extract_all(text_or_empty(text), F.lit(r"(?d)[^.!?\n]+(?:[.!?]+|$)"), 0), lambda s: F.trim(s) != ""))


def paragraph_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text_or_empty(text), r"\n\s*\n+"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != ""))


# -- times --------------------------------------------------------------------
def chrome_time(us: Column) -> Column:
    return F.timestamp_micros(us - F.lit(11_644_473_600_000_000))


def mac_time(s: Column) -> Column:
    return F.timestamp_seconds(s + F.lit(978_307_200))


def json_length(c: Column) -> Column:
    return F.coalesce(F.json_array_length(c), F.lit(0))


#: Words that switch a setting on or off.
ON = ("1", "true", "yes", "y", "on")
OFF = ("0", "false", "no", "n", "off")


def flag(value: Column, default: bool) -> Column:
    word = F.lower(F.trim(value))
    return F.when(word.isin(*ON), True).when(word.isin(*OFF), False).otherwise(default)


def natural(value: Column, default: int) -> Column:
    """A whole number, 0 if it is negative; the default for anything else."""
    return F.greatest(F.coalesce(F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value).try_cast("long")), F.lit(default)), F.lit(0))


def short_text(value: Column, most: int = 600) -> Column:
    """Trimmed and cut to ``most`` characters, the last of them a mark of the cut; null if nothing is there."""
    text = F.regexp_replace(text_or_empty(value), r"^\s+|\s+$", "")
    cut = F.concat(F.regexp_replace(F.substring(text, 1, most - 1), r"\s+$", ""), F.lit("…"))
    return F.when(text == "", None).when(F.length(text) <= most, text).otherwise(cut)
