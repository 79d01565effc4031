"""Connected components of an undirected graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import shared_dir


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of `edges` the smallest node that can be reached from it.

    Alternates large-star and small-star steps: every edge is led to the smallest neighbour, which halves the depth
    each round. Both steps are a grouped minimum, which is pre-aggregated and written, and an equi-join of two tables
    that are dealt for it alone, so the adaptive skew handling can split a hub's edges. Each round is cut off by a
    checkpoint in the shared folder; only the number of edges and a checksum come to the driver. A path of n nodes
    takes some log2(n) rounds; if `most_rounds` do not suffice an error is raised. Loops (a = b), repeated edges, nulls
    (dropped) and an empty table are allowed.
    """
    shared_dir(edges.sparkSession)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct().checkpoint()
    seen = None
    for _ in range(most_rounds + 1):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        # edges to larger neighbours are the stored ones, by their smaller end
        large = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        e = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct().checkpoint()
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
