"""From raw documents to a training mix: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import decontaminate, lines, mixing, near, toxicity
from evidara.llm.scratch import Scratch

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
#: Copies of a row that are numbered in one list.
RUN = 4096


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.3 or more go; the model is trained on the folder's labels.

    Null, empty and wordless texts score 0 and stay; rows that repeat go or stay together; ids play no part. An empty
    table gives an empty one; columns other than those of DOCUMENT are not read, whatever their names (so in every stage).
    """
    model = toxicity.trained(spark, sf_dir)
    return toxicity.score(docs.select(DOCUMENT), model).filter(F.col("toxicity") < 0.3).select(DOCUMENT)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more go; n_chars follows the text.

    Every row counts as a document. Null texts come back empty, empty ones stay so; all rows stay. Nothing ties; an
    empty table gives an empty one.
    """
    cleaned = lines.drop_common_lines(docs.select(DOCUMENT), min_docs=10)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(DOCUMENT)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays; of rows that repeat, one.

    Texts without words are no near-duplicates and stay; a null doc_id counts as the smallest. An empty table gives an
    empty one.
    """
    found = near.near_duplicates(docs.select("doc_id", "text"), k=5, share=0.8)
    # What goes is less than what stays; text moves only where a doc_id has several rows.
    scratch = Scratch(spark, "kept")
    gone = scratch.keep(found.filter("NOT kept").select(F.col("doc_id").alias("_id")).distinct(), "gone")
    twice = found.filter("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    twice = scratch.keep(twice.select(F.col("doc_id").alias("_id")), "twice")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    stays = docs.select(DOCUMENT).join(gone, same, "left_anti")
    if twice.isEmpty():
        return stays
    return stays.join(twice, same, "left_anti").unionByName(stays.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 % of a benchmark item's five-word shingles go.

    Each text is judged by itself, known by a hash, so a null doc_id is searched like any other and rows that repeat go
    together; texts of fewer than five words hold nothing and stay, as with an empty benchmark all do. An empty table
    gives an empty one.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    row = mixing.tie()
    leaks = decontaminate.contained(docs.select(row.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_leaky")).distinct()
    leaks = Scratch(spark, "leaky").keep(leaks, "rows")
    return docs.select(DOCUMENT).join(leaks, row == F.col("_leaky"), "left_anti").select(DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy that a document gets, with the copy's number, its size, and its source's size and target.

    Null texts and others without words get no copy. Rows that repeat are pooled: the copies of all of them are numbered
    through. A null source is one of its own, the last. An empty table gives an empty one.
    """
    taken = mixing.mix(docs.select(DOCUMENT)).filter("taken > 0")
    # Equal rows have equal ties; their copies are pooled and the row is repeated so often.
    taken = taken.groupBy("tie", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    taken = Scratch(spark, "mixed").keep(taken.withColumn("copies", (F.col("taken") / F.col("size")).cast("int")), "taken")
    rows = docs.select(*DOCUMENT, mixing.tie().alias("tie")).dropDuplicates(["tie"])
    # Numbers in runs, as a row that repeats very often would make one very long list.
    runs = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN).cast("int"))).alias("run")
    copies = F.explode(F.sequence(F.col("run") * RUN + 1, F.least("copies", F.col("run") * RUN + RUN))).alias("copy")
    mixed = rows.join(taken.select("*", runs), "tie")
    return mixed.select(*DOCUMENT, "size", "source_size", "target", copies)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
]

#: Training, sketches and random rounding aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each is stored before the next reads it, and its input is dropped then."""
    scratch = Scratch(spark, "pipeline")
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if stored is not None:
            scratch.drop(stored)
        stored = docs
    return STAGES[-1][1](spark, docs, sf_dir)
