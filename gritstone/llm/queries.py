"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, line_dedup, lm, media, mixing, oracles, quality, resample, secrets, simhash, spelling, substring_dedup, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, and every document with its source as host; page_id or doc_id is null."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    model = langid.train(docs)
    none = F.lit(None).cast("string")
    of_docs = docs.select(F.struct(F.col("doc_id"), F.lit(None).cast("long").alias("page_id")).alias("id"), "text", F.concat(F.lit("documents/"), F.coalesce("source", F.lit(""))).alias("host"), none.alias("markup"), none.alias("suffix"))
    of_pages = langid.page_rows(pages).withColumn("id", F.struct(F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("page_id")))
    found = langid.identify(of_pages.unionByName(of_docs), model)
    return found.select("id.doc_id", "id.page_id", "host", "lang", "text_lang", F.round("confidence", 6).alias("confidence"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"), mark=True)
    return kept.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of a second run over the table, from the ledger that the first one has written: it scans nothing."""
    docs = _table(spark, sf_dir, "documents")
    _, ledger = secrets.scan_versions(docs)
    return secrets.scan_versions(docs, ledger)[0]


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.mark_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(_table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, index = media.store(_table(spark, sf_dir, "documents"))
    return rows.join(media.read_back(media.with_metadata(index)), "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    from corpus_pipeline import run

    ops = (op1_mix_sources, op2_language_id, op3_line_dedup, op4_simhash, op5_secret_scan, op6_decontaminate, op7_quality, op8_substring_dedup, op9_lm_score, op10_media_columns, op11_spelling_variants, op12_token_counts, op13_importance_resample)
    return {f.__name__: f for f in ops} | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": oracles.LINE_DEDUP, "op6_decontaminate": oracles.decontaminate(), "op8_substring_dedup": oracles.SUBSTRING_DEDUP, "op11_spelling_variants": oracles.VARIANTS, "op13_importance_resample": oracles.RESAMPLE}
