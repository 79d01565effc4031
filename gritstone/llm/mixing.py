"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a hashed order, gone round up to three times. A document's virtual finish
time is the number of its source's words up to and with it, divided by the source's target. Served in the order of
these times, every source has its target's share at any moment; the queue is cut where the words served reach the
budget. The sums along the queues come from sorted ranges of all rows, so no task holds a whole source. The times are
dealt into ranges as well, and only the range in which the budget is reached is sorted and summed, in ranges again: rows
of one time can be many, as sources can, and are told apart by all that orders them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ranked, running
from .session import shared_dir, staged

#: Ranges of virtual time; a driver sees one sum for each.
RANGES = 4096


def word_count(text: str = "text"):
    """Number of `[^\\x20\\x09-\\x0D]+` in a text, 0 for null."""
    body = F.trim(F.translate(F.col(text), "\t\n\x0b\x0c\r", "     "))
    return F.when(F.coalesce(F.length(body), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(body, " +"))).cast("long")


def shares(sources: DataFrame, budget: int, most: float = 3.0) -> DataFrame:
    """`sources` (n, w) with target: the budget by weight, none above `most` times its n, the rest reshared by weight.

    A source is full where most * n < level * w; the level is what is left for the others over their weights. It only
    rises as sources fill, so it settles in a few rounds, each one sum over the table.
    """
    full = lambda level: F.col("n") * most < F.col("w") * level
    level, filled = -1.0, -1
    while True:
        r = sources.agg(F.count_if(full(level)).alias("k"), F.sum(F.when(full(level), F.col("n") * most)).alias("used"), F.sum(F.when(~full(level), F.col("w"))).alias("open")).first()
        if r.k == filled or not r.open:
            break
        filled, level = r.k, (budget - (r.used or 0.0)) / r.open
    return sources.withColumn("target", F.when(full(level), F.col("n") * most).otherwise(F.col("w") * level).cast("double"))


def mix(docs: DataFrame, cycle: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, id_col: str = "doc_id", source: str = "source", text: str = "text", seed: int = 42) -> DataFrame:
    """(id_col, source, size, source_size, target, taken) for each row of `docs`.

    `size` is the number of words; `taken` the words that the mix takes, `size` times the number of rounds. Sources in
    code-point order, null last, weigh `cycle` again and again; the budget is `share` of all words. Sources may
    be many: only sums over them come to the driver. Null and blank texts have size 0 and take nothing; repeated rows, and
    rows of one id or of none, are distinct documents, told apart by nothing but their place among equals. Very long texts
    are counted whole. An empty table gives an empty one. Other columns are not in the result, whatever their names.
    """
    shared_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source).alias("src"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    found = rows.groupBy("src").agg(F.sum("size").alias("n"))
    found = ranked(found, F.col("src").isNull(), "src", name="place")
    found = found.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in cycle]), (F.col("place") % len(cycle)).cast("int")))
    budget = int((found.agg(F.sum("n")).first()[0] or 0) * share)
    table = shares(found, budget, most).select(F.col("src").alias("s0"), F.col("n").alias("source_size"), "target")
    # all queues one behind the other; a queue's own sums begin where its first row stands
    after = running(rows, "size", F.col("src").isNull(), "src", "h", "id", "size", "row")
    starts = after.groupBy(F.col("src").alias("s2")).agg(F.min("before").alias("start"))
    table = table.join(starts, F.col("s0").eqNullSafe(F.col("s2"))).drop("s2")
    queued = after.join(table, F.col("src").eqNullSafe(F.col("s0"))).withColumn("upto", F.col("before") - F.col("start") + F.col("size"))
    queued = staged(queued.select("id", "src", "size", "source_size", "target", "h", "row", "upto"), "queue")
    # rounds that can be reached; one row for each document and round
    rounds = F.least(F.lit(most), F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int"))
    served = queued.where("size > 0").select("id", "src", "size", "h", "row", "upto", F.explode(F.sequence(F.lit(0), rounds - 1)).alias("round"), "source_size", "target")
    served = served.withColumn("time", (F.col("upto") + F.col("round") * F.col("source_size")) / F.col("target")).withColumn("range", F.least(F.floor(F.col("time") * (RANGES // 4)), F.lit(RANGES)).cast("int"))
    at, edge = 0, RANGES + 1
    for r in served.groupBy("range").agg(F.sum("size").alias("n")).orderBy("range").collect():  # RANGES + 1 rows at most
        if at + r.n > budget:
            edge = r.range
            break
        at += r.n
    last = served.where(F.col("range") == edge).select("time", "src", "h", "id", "row", "round", "size")
    tail = running(last, "size", "time", "src", "h", "id", "row", "round").where(F.col("before") + F.col("size") + at <= budget)
    kept = served.where(F.col("range") < edge).select("row", "size").unionByName(tail.select("row", "size"))
    taken = kept.groupBy("row").agg(F.sum("size").alias("taken"))
    joined = queued.join(taken, "row", "left")
    return joined.select(F.col("id").alias(id_col), F.col("src").alias("source"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
