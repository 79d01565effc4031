"""Session helpers shared by the corpus operators: the shared folder, staged tables, Arrow batch size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python. Documents may be long, so batches are kept well under Spark's default.
ARROW_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Lower the Arrow batch size where the session still has Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where it is unset a local master gets a temporary
    one; on a cluster executors would not see it, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gritstone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/gritstone/{name}-{uuid.uuid4().hex[:12]}"

    def remove() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        except Exception:  # the JVM may be gone when the interpreter ends
            pass

    atexit.register(remove)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sha_key(*columns: Column | str) -> Column:
    """128 bits of the SHA-256 of the columns as text, 16 bytes; nulls differ from every text, and neighbours don't run together."""
    def part(c: Column) -> Column:
        t = c.cast("string")
        return F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))

    each = [part(F.col(c) if isinstance(c, str) else c) for c in columns]
    return F.substring(F.unhex(F.sha2(F.concat(*each).cast("binary"), 256)), 1, 16)
