"""Repeated measurements: means, spread, bootstrap intervals and verdicts."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranked, small_batches

LOWER_IS_BETTER = ("false_positive_count", "false_negative_count", "refusal_rate")


def repeat_stats(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, mean, sample deviation (0 for one value) and median by keys."""
    v = F.col(value)
    return samples.groupBy(*keys).agg(F.count(v).alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stddev"), F.coalesce(F.median(v), F.lit(0.0)).alias("median"))


#: Values in a block, draws of a resample that are made in one step, shares of the resamples, keys that share their hashes.
BLOCK, STEP, SHARES, TOGETHER = 1 << 17, 1 << 15, 16, 64
PACKED = "block long, share int, kind int, b int, data binary, had binary"


def _steps(batches: Iterator[pa.RecordBatch], seed: str, times: int, block: int, step: int) -> Iterator[pa.RecordBatch]:
    """Of (key, n, step, share) the draws of the share's resamples, packed by block: the places in it, sorted, as
    differences by byte planes. Keys of one step and share come together and have the same hashes."""
    for batch in batches:
        keys, ns, steps, shares = batch.columns
        rows = sorted(range(batch.num_rows), key=lambda r: (steps[r].as_py(), shares[r].as_py()))
        for (at, share), some in groupby(rows, key=lambda r: (steps[r].as_py(), shares[r].as_py())):
            some = [(r, min(step, ns[r].as_py() - at * step)) for r in some]
            number = [b"%d" % i for i in range(at * step, at * step + max(m for _, m in some))]
            for b in range(share, times, SHARES):
                first = md5(f"{seed}|{b}|".encode())

                def one(x: bytes) -> bytes:
                    h = first.copy()
                    h.update(x)
                    return h.digest()

                h = np.frombuffer(b"".join(map(one, number)), ">u4")[::4].astype(np.int64)
                out = []
                for r, m in some:
                    i = np.sort(h[:m] % ns[r].as_py())
                    part, first_of = np.unique(i // block, return_index=True)
                    for p, x in zip(part.tolist(), np.split(i, first_of[1:])):
                        planes = np.diff(x - p * block, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
                        out.append((r, p, planes.T.tobytes()))
                n = len(out)
                took = keys.take(pa.array([r for r, _, _ in out], pa.int64()))
                cols = [pa.array([p for _, p, _ in out], pa.int64()), pa.array([share] * n, pa.int32()), pa.array([1] * n, pa.int32()), pa.array([b] * n, pa.int32()), pa.array([x for _, _, x in out], pa.binary()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays([took, *cols], ["key", "block", "share", "kind", "b", "data", "had"])


def _packed_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, block, v), sorted, each block's values as doubles and which of them are not null, for each share of the
    resamples."""
    now, held = None, []

    def done() -> pa.RecordBatch:
        v = pa.concat_arrays(held)
        had = np.packbits(v.is_valid().to_numpy(zero_copy_only=False)).tobytes()
        data = v.fill_null(0.0).to_numpy(zero_copy_only=False).tobytes()
        each = ((now[0], kind), (now[1], pa.int64()), (None, None), (0, pa.int32()), (0, pa.int32()), (data, pa.binary()), (had, pa.binary()))
        cols = [pa.array([x] * SHARES, k) if k else pa.array(range(SHARES), pa.int32()) for x, k in each]
        return pa.RecordBatch.from_arrays(cols, ["key", "block", "share", "kind", "b", "data", "had"])

    for batch in batches:
        kind, at = batch.column(0).type, 0
        for place, some in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if held and place != now:
                yield done()
                held = []
            n = sum(1 for _ in some)
            now = place
            held.append(batch.column(2).slice(at, n))
            at += n
    if held:
        yield done()


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of what is drawn from each block, (key, b, sum, some). Rows come sorted, a block's values before its draws."""
    v = had = None
    for batch in batches:
        where, b, total, some = [], [], [], []
        for r, (kind, x) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
            data = batch.column(5)[r].as_buffer()
            if kind == 0:
                v = np.frombuffer(data, np.float64).copy()
                had = np.unpackbits(np.frombuffer(batch.column(6)[r].as_buffer(), np.uint8), count=len(v))
                continue
            planes = np.zeros((data.size // 3, 4), np.uint8)
            planes[:, :3] = np.frombuffer(data, np.uint8).reshape(3, -1).T
            i = np.cumsum(planes.view("<u4")[:, 0])
            where.append(r)
            b.append(x)
            total.append(float(v[i].sum()))
            some.append(int(had[i].sum(dtype=np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), pa.array(b, pa.int32()), pa.array(total, pa.float64()), pa.array(some, pa.int64())], ["key", "b", "sum", "some"])


def bootstrap_means(samples: DataFrame, key: str, value: str, order: str, times: int, seed: str, block: int = BLOCK, step: int = STEP) -> DataFrame:
    """(key, b, mean): `times` resamples of each key's values, drawn with replacement.

    Values are numbered within their key over sorted ranges and packed by blocks of their numbers. Draws are hashes of
    resample and number, the same for all keys, so tasks make them once for many keys, a step at a time, and send them to
    the blocks as sorted places, about a byte each; a block is there once for each share of the resamples. No task holds
    more than a block and a step, whatever a key's size, and the driver gets only the number of keys.
    """
    spark = samples.sparkSession
    small_batches(spark)
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = ranked(samples.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v"), F.col(order).alias("o")), "key", "o", name="at")
    first = rows.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n")).checkpoint()
    together = max(1, -(-first.count() // TOGETHER))
    rows = rows.join(first, rows["key"].eqNullSafe(first["key"])).select(rows["key"], "v", (F.col("at") - F.col("first")).alias("i"))
    blocks = rows.withColumn("block", F.floor(F.col("i") / block)).repartition(tasks, "key", "block").sortWithinPartitions("key", "block", "i").select("key", "block", "v")
    kind = samples.schema[key].dataType.simpleString()
    packed = f"key {kind}, {PACKED}"
    cells = first.select("key", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / step))).alias("step"))
    cells = cells.select("key", "n", "step", F.explode(F.sequence(F.lit(0), F.lit(min(SHARES, times) - 1))).alias("share"))
    cells = cells.repartition(tasks, "step", "share", F.pmod(F.xxhash64("key"), F.lit(together)))
    draws = cells.mapInArrow(lambda x: _steps(x, seed, times, block, step), packed)
    both = blocks.mapInArrow(_packed_values, packed).unionByName(draws)
    dealt = both.repartition(tasks, "key", "block", "share").sortWithinPartitions("key", "block", "share", "kind")
    sums = dealt.mapInArrow(_drawn, f"key {kind}, b int, sum double, some long").groupBy("key", "b").agg(F.sum("sum").alias("sum"), F.sum("some").alias("some"))
    out = sums.join(F.broadcast(first.select(F.col("key").alias("k"), "n")) if together == 1 else first.select(F.col("key").alias("k"), "n"), F.col("key").eqNullSafe(F.col("k")))
    return out.select(F.col("key").alias(key), "b", F.when(F.col("some") > 0, F.col("sum") / F.col("n")).alias("mean"))


def interval(means: DataFrame, key: str, value: Column, low: str, high: str) -> DataFrame:
    """(key, low, high): the values of `means` at round(p (n - 1)), halves up, for p of 2.5 and 97.5 per cent."""
    w = Window.partitionBy(key)
    rows = means.select(key, value.alias("__v")).withColumn("__i", F.row_number().over(w.orderBy("__v")) - 1).withColumn("__n", F.count("*").over(w))
    at = lambda p: F.max(F.when(F.col("__i") == F.floor(F.lit(p) * (F.col("__n") - 1) + 0.5), F.col("__v")))
    return rows.groupBy(key).agg(at(0.025).alias(low), at(0.975).alias(high))


def bootstrap_ci(samples: DataFrame, key: str, value: str, order: str, times: int = 1000, seed: str = "7") -> DataFrame:
    """(key, low, high): the 2.5 and 97.5 percentiles of the resampled means."""
    return interval(bootstrap_means(samples, key, value, order, times, seed), key, F.col("mean"), "low", "high")


def bootstrap_diff(a: DataFrame, b: DataFrame, key: str, value: str, order: str, times: int = 1000, seed: str = "7") -> DataFrame:
    """(key, low, high) of mean(b) - mean(a) over the keys of both."""
    x = bootstrap_means(a, key, value, order, times, seed + "a").withColumnRenamed("mean", "ma")
    y = bootstrap_means(b, key, value, order, times, seed + "b").withColumnRenamed("mean", "mb")
    return interval(x.join(y, [key, "b"]), key, F.col("mb") - F.col("ma"), "low", "high")


def direction(metric: Column) -> Column:
    return F.when(metric.isin(*LOWER_IS_BETTER), "lower").otherwise("higher")


def verdict(low: Column, high: Column, threshold: float, way: Column) -> Column:
    """improved, regressed or inconclusive, by where the interval lies."""
    up, down = low > threshold, high < -threshold
    better = F.when(way == "lower", down).otherwise(up)
    worse = F.when(way == "lower", up).otherwise(down)
    return F.when(better, "improved").when(worse, "regressed").otherwise("inconclusive")
