"""Tables from serialised cells with spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
# How an older release wrote a table's cells into one string.
CELL = r"(?s)TableCell\(\s*bbox=BoundingBox\(.*?\)\s*,.*?text='(?:\\'|[^'])*',\s*column_header=(?:[Tt]rue|[Ff]alse),\s*row_header=(?:[Tt]rue|[Ff]alse)"
BOX = {"x0": "l", "y0": "t", "x1": "r", "y1": "b"}
PLACES = {"row_start": "start_row", "row_end": "end_row", "col_start": "start_col", "col_end": "end_col"}


def serialised_cells(tables: DataFrame) -> DataFrame:
    """(table_id, ord, row_start, row_end, col_start, col_end, text, x0, y0, x1, y1) of each cell in ``raw``, ends exclusive."""
    cells = tables.select("table_id", F.posexplode(F.regexp_extract_all("raw", F.lit(CELL), 0)).alias("ord", "cell"))
    got = lambda pattern: F.regexp_extract("cell", pattern, 1)
    number = r"(-?\d+(?:\.\d+)?)"
    return cells.select(
        "table_id", "ord", *[got(rf"{p}_offset_(?:idx|index)=(\d+)").cast("int").alias(k) for k, p in PLACES.items()],
        F.trim(F.replace(got(r"(?s)text='((?:\\'|[^'])*)',\s*column_header="), F.lit("\\'"), F.lit("'"))).alias("text"),
        *[got(rf"[(\s]{k}={number}").cast("double").alias(n) for n, k in BOX.items()],
    )


def sizes(cells: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """(table_id, n_rows, n_cols): as far as the cells reach, or the numbers that ``fallback`` (table_id, num_rows, num_cols) says if these are larger."""
    reach = cells.groupBy("table_id").agg(F.max("row_end").alias("n_rows"), F.max("col_end").alias("n_cols"))
    if fallback is not None:
        reach = reach.join(fallback, "table_id", "left").select("table_id", F.greatest("n_rows", "num_rows").alias("n_rows"), F.greatest("n_cols", "num_cols").alias("n_cols"))
    return reach.filter("n_rows > 0 AND n_cols > 0")


def filled(cells: DataFrame, size: DataFrame) -> DataFrame:
    """(table_id, row, col, value): each cell in all places of its span, cut to the table; where spans overlap the first cell with a text stays."""
    s = cells.filter("text <> ''").join(size, "table_id")

    def span(start: str, end: str, n: str) -> Column:
        first = F.greatest(F.lit(0), F.least(c(n) - 1, c(start)))
        return F.explode(F.sequence(first, F.greatest(first + 1, F.least(c(n), c(end))) - 1))

    places = s.withColumn("row", span("row_start", "row_end", "n_rows")).withColumn("col", span("col_start", "col_end", "n_cols"))
    return places.groupBy("table_id", "row", "col").agg(F.min_by("text", "ord").alias("value"))


def repaired_cells(grid: DataFrame) -> DataFrame:
    """(table_id, row_index, col_index, value): what stands below the first row, which is the header."""
    return grid.filter("row > 0").select("table_id", (c("row") - 1).alias("row_index"), c("col").alias("col_index"), "value")


def repaired_headers(cells: DataFrame, size: DataFrame, grid: DataFrame) -> DataFrame:
    """(table_id, col_headers, row_headers, x0, y0, x1, y1) of tables that have a value below the header.

    Headers are the first row and the first column below it, C1, C2, ... and R1, R2, ... where they are blank; the box is the one around all cells.
    """
    box = cells.groupBy("table_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    entries = lambda k, where: F.map_from_entries(F.collect_list(F.when(where, F.struct(c(k), c("value")))))
    edge = grid.filter("row = 0 OR col = 0").groupBy("table_id").agg(entries("col", c("row") == 0).alias("top"), entries("row", (c("col") == 0) & (c("row") > 0)).alias("left"))
    body = grid.filter("row > 0").select("table_id").distinct()
    named = lambda m, n, first, letter: F.transform(F.sequence(F.lit(first), n - 1), lambda i: F.coalesce(F.try_element_at(m, i), F.concat(F.lit(letter), (i + (1 - first)).cast("string"))))
    whole = size.join(body, "table_id", "left_semi").join(edge, "table_id", "left").join(box, "table_id")
    return whole.select("table_id", named(c("top"), c("n_cols"), 0, "C").alias("col_headers"), named(c("left"), c("n_rows"), 1, "R").alias("row_headers"), "x0", "y0", "x1", "y1")


def header_scores(cells: DataFrame, metadata, ahead: bool = True) -> DataFrame:
    """(table_id, row_index, score) of each row with a value: 2.5 for each, 1.1 for each different one, 3 less for a metadata row.

    With ``ahead`` 0.5 more where the next row has as many values or more. ``metadata``: from a row's first cell to whether it
    tells of metadata. The next row is joined by its number, so a table of any length is no group.
    """
    full = F.trim("value") != ""
    rows = cells.groupBy("table_id", "row_index").agg(
        F.count_if(full).alias("filled"), F.count_distinct(F.when(full, F.lower(F.trim("value")))).alias("unique"), F.min(F.when(c("col_index") == 0, c("value"))).alias("first")
    )
    score = c("filled") * 2.5 + c("unique") * 1.1 - F.when(metadata(c("first")), 3.0).otherwise(0.0)
    if ahead:
        following = rows.select("table_id", (c("row_index") - 1).alias("row_index"), c("filled").alias("next"))
        rows = rows.join(following, ["table_id", "row_index"], "left")
        score = score + F.when(F.coalesce("next", F.lit(0)) >= c("filled"), 0.5).otherwise(0.0)
    return rows.filter("filled > 0").select("table_id", "row_index", score.alias("score"))


def header_rows(scores: DataFrame) -> DataFrame:
    """(table_id, header): the row of the highest score, the first of equal ones."""
    best = scores.groupBy("table_id").agg(F.max(F.struct("score", (-c("row_index")).alias("before"))).alias("b"))
    return best.select("table_id", (-c("b.before")).alias("header"))


def row_chunks(tables: DataFrame, cells: DataFrame, target: int = 1100, overlap: int = 180) -> DataFrame:
    """(table_id, row_index, part, kind, text) of each row with a value, and of each table without any.

    ``tables``: (table_id, caption, col_headers, row_headers), ``cells``: (table_id, row_index, col_index, value). A row's text is the
    caption and the table's id, the row's header, and a line "header: value" for each value (col_3 for a column
    without header); an empty table's is caption, id and columns. Texts over 1.4 * ``target`` are cut into parts that overlap.
    """
    values = cells.select("table_id", "row_index", "col_index", F.trim("value").alias("value")).filter("value <> '' AND row_index >= 0 AND col_index >= 0")
    values = values.groupBy("table_id", "row_index", "col_index").agg(F.max("value").alias("value"))
    heads = tables.select("table_id", F.posexplode("col_headers").alias("col_index", "header"))
    name = F.coalesce(F.when(F.trim("header") != "", F.trim("header")), F.concat(F.lit("col_"), c("col_index").cast("string")))
    named = values.join(heads, ["table_id", "col_index"], "left").select("table_id", "row_index", "col_index", F.concat(name, F.lit(": "), "value").alias("line"))
    rows = named.groupBy("table_id", "row_index").agg(F.array_sort(F.collect_list(F.struct("col_index", "line"))).alias("lines"))
    side = tables.select("table_id", F.posexplode("row_headers").alias("row_index", "row_header"))
    lead = [F.when(c("caption") != "", F.concat(F.lit("Table: "), F.trim("caption"))), F.concat(F.lit("Table ID: "), c("table_id").cast("string"))]
    of_row = rows.join(side, ["table_id", "row_index"], "left").join(tables.select("table_id", "caption"), "table_id")
    row_text = F.concat_ws("\n", *lead, F.when(F.trim("row_header") != "", F.concat(F.lit("Row: "), F.trim("row_header"))), F.array_join("lines.line", "\n"))
    columns = F.filter("col_headers", lambda x: F.trim(x) != "")
    empty = tables.join(values.select("table_id").distinct(), "table_id", "left_anti")
    summary = F.concat_ws("\n", *lead, F.when(F.size("col_headers") > 0, F.concat(F.lit("Columns: "), F.array_join(columns, ", "))))
    texts = of_row.select("table_id", "row_index", F.lit("table_row").alias("kind"), F.trim(row_text).alias("t"))
    texts = texts.unionByName(empty.select("table_id", F.lit(None).cast("int").alias("row_index"), F.lit("table_summary").alias("kind"), F.trim(summary).alias("t")))
    most, n = max(target, int(target * 1.4)), F.length("t")
    pieces = F.transform(F.sequence(F.lit(0), F.ceil((n - target) / (target - overlap)).cast("int")), lambda i: F.trim(F.substring(c("t"), i * (target - overlap) + 1, F.lit(target))))
    parts = F.filter(F.when(n > most, pieces).otherwise(F.array("t")), lambda p: p != "")
    return texts.select("table_id", "row_index", "kind", F.posexplode(parts).alias("part", "text"))
