"""Order over whole tables without one task for all rows: sorted ranges that stay the same while they are read again."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> None:
    """The checkpoint folder is `spark.checkpoint.dir`. Only a local master may do without: it gets a temporary one."""
    if spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gritstone-"))


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch where the session still has Spark's default, as rows with texts or blocks are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "500")


def ranges(rows: DataFrame, *order: Column | str) -> DataFrame:
    """`rows` with `part`, the number of the sorted range that a row is in; written, so that the ranges stay."""
    checkpoints(rows.sparkSession)
    return rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).checkpoint()


def _before(dealt: DataFrame, value: Column) -> DataFrame:
    """(__p, __before): the sum of `value` over the ranges before each range; a row a range, so they are few."""
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    each = dealt.groupBy(F.col("part").alias("__p")).agg(F.sum(value).alias("__n"))
    return F.broadcast(each.select("__p", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before")))


def ranked(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """`rows` with their place in a total order, from 0."""
    dealt = ranges(rows, *order)
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    out = dealt.withColumn(name, place).join(_before(dealt, F.lit(1)), F.col("part") == F.col("__p"))
    return out.withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__p", "__before", "part")


def running(rows: DataFrame, value: str, *order: Column | str, name: str = "before") -> DataFrame:
    """`rows` with the sum of `value` over all rows before them in a total order."""
    dealt = ranges(rows, *order)
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0))).join(_before(dealt, F.coalesce(F.col(value), F.lit(0))), F.col("part") == F.col("__p"))
    return out.withColumn(name, F.col(name) + F.col("__before")).drop("__p", "__before", "part")
