"""Importance resampling towards a target corpus, by hashed n-gram features.

A bucket's gain is the log ratio of its smoothed share in the target and in the whole collection; a document's weight is
the sum of gains over its features, and a Gumbel draw by its id turns weights into a sample without replacement.

The features are inverted postings (bucket, document, count). Postings and the two corpora's counts are dealt by bucket,
so each gain is computed where the bucket's postings are, and its contributions go from there to the documents, summed in
each task before they are moved. A very frequent bucket holds one posting of each document; the planner can split it, as
the other side of the join has one row a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ranked
from .session import prepare, staged
from .vecwords import NOT_ALNUM, crc32, small, words


def bucket_counts(column: pa.Array, most_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of a text column: numbers of words and of features, where each row's postings end, their buckets and counts."""
    w = words(column, NOT_ALNUM, lower=True)
    n = np.diff(w.first)
    crc, doc = crc32(w.data, w.start, w.end), w.doc
    keys = [doc * buckets + crc % np.uint32(buckets)]
    space = np.frombuffer(b" ", np.uint8)
    for k in range(1, most_words):
        # runs of k + 1 words: what the runs of k words begin, a space and the word after them
        ok = np.flatnonzero(doc[k:] == w.doc[: len(doc) - k]) if len(doc) > k else np.zeros(0, np.int64)
        zero = np.zeros(len(ok), np.int64)
        joined = crc32(space, zero, zero + 1, crc[ok])
        crc = np.zeros(len(doc), np.uint32)
        crc[ok] = crc32(w.data, w.start[ok + k], w.end[ok + k], joined)
        keys.append(doc[ok] * buckets + crc[ok] % np.uint32(buckets))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    features = np.bincount(np.concatenate(keys) // buckets, minlength=len(n)) if len(key) else np.zeros(len(n), np.int64)
    ends = np.searchsorted(key, np.arange(len(n) + 1) * buckets)
    return n, features, ends, key % buckets, count


def postings(docs: DataFrame, keep: str, text: str, most_words: int, buckets: int) -> DataFrame:
    """(`keep` as id, n_words, n_features, buckets, counts) for each row of `docs`."""
    kind = docs.schema[keep].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n, features, ends, bucket, times = bucket_counts(batch.column(1), most_words, buckets)
            at = pa.array(ends.astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (bucket, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(features.astype(np.int64)), *lists], ["id", "n_words", "n_features", "buckets", "counts"])

    return docs.select(F.col(keep).alias("id"), F.col(text).cast("binary").alias("t")).mapInArrow(count, f"id {kind}, n_words long, n_features long, buckets array<int>, counts array<int>")


def resample(docs: DataFrame, target: DataFrame, most_words: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024, id_col: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(id_col, n_features, weight, score, rank) for each row of `docs`.

    Features are all runs of 1 to `most_words` words (ASCII letters, digits and non-ASCII characters, A-Z lowered), hashed
    into `buckets`. Of the rows with `least_words` words or more, `percent` in a hundred with the greatest scores are
    drawn; rank counts them from 1, the others' is null. Ties go to the smaller id, null ids last.

    Null and blank texts have no features and weight 0. Repeated rows are rows of their own and draw alike; a null id draws
    as the empty string. Very long texts are read whole, in stretches. An empty `docs` gives an empty table; with an empty
    `target` all gains follow from its zero counts. Other columns are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    prepare(spark)
    # one row a document with its postings side by side, read twice from here: for the counts and for the contributions
    rows = staged(postings(docs, id_col, text, most_words, buckets).withColumn("rid", F.monotonically_increasing_id()), "postings")
    one = target.withColumn("__one", F.lit(1)).select("__one", F.col(target_text).alias("__text"))

    def opened(table: DataFrame, *cols: str) -> DataFrame:
        return table.select(*cols, "counts", F.posexplode("buckets").alias("p", "bucket")).select(*cols, "bucket", F.get("counts", F.col("p")).alias("n"))

    s = opened(rows).groupBy("bucket").agg(F.sum("n").alias("s"))
    t = opened(postings(one, "__one", "__text", most_words, buckets)).groupBy("bucket").agg(F.sum("n").alias("t"))
    both = staged(s.join(t, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "buckets")  # a row a bucket
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(total.s + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(total.t + buckets)))
    gains = both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))
    given = opened(rows, "rid").join(gains.hint("shuffle_hash"), "bucket").groupBy("rid").agg(F.sum(F.col("n") * F.col("gain")).alias("weight"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = rows.select("rid", "id", "n_words", "n_features").join(given, "rid", "left").withColumn("weight", F.coalesce("weight", F.lit(0)).cast("long"))
    scored = staged(scored.withColumn("score", (F.col("weight") + luck).cast("long")), "scored")
    able = scored.where(F.col("n_words") >= least_words).select("rid", "id", "score")
    draw = able.count() * percent // 100
    place = ranked(able, F.col("score").desc(), F.col("id").isNull(), "id", "rid").where(F.col("rank") < draw).select("rid", (F.col("rank") + 1).alias("rank"))
    return scored.join(place, "rid", "left").select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
