"""Scanning what arrives: a stream of new files through the same rules, with each record written once a file version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scan import candidates, content_hash
from ..rules.load import Rule


def arriving(spark: SparkSession, folder: str, schema: str = "path string, content string", rows_format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(rows_format).load(folder)


def scan_stream(files: DataFrame, rules: list[Rule], keep: str = "1 hour") -> DataFrame:
    """Candidates of a stream of (path, content). A version that comes again within `keep` is scanned once; the state
    holds hashes only."""
    seen = files.withColumn("at", F.current_timestamp()).withColumn("file_hash", content_hash(F.col("content"))).withWatermark("at", keep)
    return candidates(seen.dropDuplicatesWithinWatermark(["path", "file_hash"]), rules)


def start(found: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = found.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
