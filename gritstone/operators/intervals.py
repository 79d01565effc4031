"""Points in intervals, without meeting all of both under a frequent key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(low: Column, high: Column) -> Column:
    """The least power of two that the interval's length does not exceed."""
    return F.ceil(F.log2((high - low + 1).cast("double"))).cast("int")


def same_bins(points: DataFrame, intervals: DataFrame, on: list[str], at: str, low: str, high: str) -> DataFrame:
    """The pairs that stab() forms and then looks at."""
    a, b = F.col(low).cast("long"), F.col(high).cast("long")
    sized = intervals.where(b >= a).withColumn("__level", _level(a, b))
    bins = F.sequence(F.expr(f"shiftright(cast({low} as bigint), __level)"), F.expr(f"shiftright(cast({high} as bigint), __level)"))
    covered = sized.withColumn("__bin", F.explode(bins))
    sizes = sized.select(*on, "__level").distinct()
    placed = points.join(sizes, on).withColumn("__bin", F.expr(f"shiftright(cast({at} as bigint), __level)"))
    return placed.join(covered, [*on, "__level", "__bin"])


def stab(points: DataFrame, intervals: DataFrame, on: list[str], at: str = "line", low: str = "low", high: str = "high") -> DataFrame:
    """Every row of `points` with every row of `intervals` that agrees in the columns `on` and holds the point, both ends
    included. Columns of `intervals` besides `on` must not be columns of `points`.

    An interval belongs to the bins of its own size, a power of two, so it covers two at most; a point goes into one bin
    for each size that its key has. So a key with many points and many intervals forms the pairs of equal bins only: at
    most four bins' width around a point for an interval of any length. Empty intervals (high < low), nulls in `on` or in
    the ends hold nothing; equal rows stay as many as they are.
    """
    return same_bins(points, intervals, on, at, low, high).where(F.col(at).between(F.col(low), F.col(high))).drop("__level", "__bin")
