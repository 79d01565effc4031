"""A training corpus from the table of documents: five stages, each reading what the one before has written.

Every stage keeps the columns of documents but the last, which adds what the mix takes of each document. Nothing here
is expressible in one SQL statement (a boosted model and fingerprint components), so ORACLE_SQL is None; the tests hold
the stages against plain versions on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.llm import decontaminate, line_dedup, mixing, quality, simhash
from gritstone.llm.session import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null, empty and blank texts are scored like others, repeated rows
    each; a null id is no reason to go. Columns besides COLUMNS are left out, here and in all stages; an empty table
    stays empty."""
    scored = quality.score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; copies count once, as one of them is to stay whole. No row goes: null texts stay
    null, null sources are one source, repeated rows stay repeated. Very long texts are taken whole; an empty table stays empty."""
    return line_dedup.drop_boilerplate(docs.select(*COLUMNS), once=True).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row of the least id stays; a null id is the last, and of repeated rows one stays.
    Null, empty and blank texts are one class. Very long texts are compared whole; an empty table stays empty."""
    keep = simhash.edited_copies(docs, choose=True).where("stays").select("rid").distinct()
    rows = docs.select(*COLUMNS, simhash.row_key(F.col("doc_id"), simhash.text_key()).alias("rid"))
    return rows.join(keep, "rid", "left_semi").dropDuplicates(["rid"]).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and blank texts hold none; repeated rows are judged each.
    Very long texts are searched whole; an empty table stays empty, and an empty benchmark takes nothing away."""
    marked = decontaminate.mark_contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where("n_hit = 0").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document that it takes, with the number of words taken. Null and blank texts have no words and are not
    taken; ids may be null or repeated, and repeated rows are taken each in their turn. Very long texts count whole; an empty
    table stays empty."""
    # ids may be null or repeated; rows of one key have one size and source, and get what the mix takes of them in turn
    rows = docs.select(*COLUMNS, simhash.row_key(F.col("doc_id"), F.concat(simhash.text_key(), F.coalesce(F.col("source").cast("binary"), F.lit(b"\xff")))).alias("rid"))
    mixed = mixing.mix(rows, id_col="rid").where("taken > 0")
    mixed = mixed.groupBy("rid").agg(*[F.first(c).alias(c) for c in ("size", "source_size", "target")], F.collect_list("taken").alias("each"))
    rows = rows.join(mixed, "rid").withColumn("n", F.row_number().over(Window.partitionBy("rid").orderBy("rid")))
    return rows.where(F.col("n") <= F.size("each")).select(*COLUMNS, "size", "source_size", "target", F.element_at("each", F.col("n")).alias("taken"))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
