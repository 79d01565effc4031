"""Gates on a change of rules: before against after, by slug."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import checkpoints
from .score import rate

EPS = 1e-9
#: Another rule may lose so much precision.
OTHER_DROP = 0.05


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (slug, candidates, tp, fp, fn, high_fn) of two runs side by side, 0 where one lacks a slug."""
    cols = ("candidates", "tp", "fp", "fn", "high_fn")

    def side(d: DataFrame, suffix: str) -> DataFrame:
        g = d.groupBy("slug").agg(*[F.sum(c).alias(f"{c}_{suffix}") for c in cols])
        g = g.withColumn(f"precision_{suffix}", F.when(F.col(f"tp_{suffix}") + F.col(f"fp_{suffix}") == 0, F.lit(1.0)).otherwise(rate(F.col(f"tp_{suffix}"), F.col(f"tp_{suffix}") + F.col(f"fp_{suffix}"))))
        g = g.withColumn(f"recall_{suffix}", F.when(F.col(f"tp_{suffix}") + F.col(f"fn_{suffix}") == 0, F.lit(1.0)).otherwise(rate(F.col(f"tp_{suffix}"), F.col(f"tp_{suffix}") + F.col(f"fn_{suffix}"))))
        return g.withColumn(f"in_{suffix}", F.lit(True))

    return side(before, "b").join(side(after, "a"), "slug", "full_outer").na.fill(0).na.fill(False, ["in_b", "in_a"])


def _limit(total, budget: float):
    return F.floor(total * (1 + budget) + 0.999999)


def _written(d: DataFrame) -> DataFrame:
    """A row a slug, written, as both the slugs' and the whole's objections look at it and a scan may stand before it."""
    checkpoints(d.sparkSession)
    return d.checkpoint()


def precision_gate(before: DataFrame, after: DataFrame, slug: str, budget: float = 0.2) -> DataFrame:
    """(reason, slug) of each objection to a change of one rule; none means that it is accepted."""
    d = _written(deltas(before, after))
    mine, others = F.col("slug") == slug, F.col("slug") != slug
    moved = [F.col(f"{c}_a") != F.col(f"{c}_b") for c in ("candidates", "tp", "fp", "fn")]
    changed = moved[0] | moved[1] | moved[2] | moved[3] | (F.col("in_a") != F.col("in_b"))
    tests = {
        "silenced": mine & (F.col("candidates_b") > 0) & (F.col("candidates_a") == 0),
        "target precision dropped": mine & (F.col("precision_a") + EPS < F.col("precision_b")),
        "target recall dropped": mine & (F.col("recall_a") + EPS < F.col("recall_b")),
        "other precision dropped": others & F.col("in_b") & (F.col("precision_b") - F.when(F.col("in_a"), F.col("precision_a")).otherwise(0.0) > OTHER_DROP + EPS),
        "other recall dropped": others & (F.col("high_fn_a") > F.col("high_fn_b")),
    }
    rows = d.select("slug", F.explode(F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in tests.items()]), lambda x: x.isNotNull())).alias("reason"))
    total = d.agg(F.sum("candidates_b").alias("b"), F.sum("candidates_a").alias("a"), F.max(changed).alias("changed"))
    whole = total.select(F.lit("").alias("slug"), F.explode(F.filter(F.array(F.when(~F.coalesce("changed", F.lit(False)), F.lit("no-op")), F.when(F.col("a") > _limit(F.col("b"), budget), F.lit("candidate budget"))), lambda x: x.isNotNull())).alias("reason"))
    return rows.unionByName(whole).select("reason", "slug")


def recall_gate(before: DataFrame, after: DataFrame, slugs: list[str], new_slug: str, least_precision: float = 0.25, budget: float = 0.2) -> DataFrame:
    """(reason, slug): the missed issues of `slugs` must get fewer, a new rule that fires must be precise enough, and
    other rules must keep what they have."""
    d = _written(deltas(before, after))
    target = d.where(F.col("slug").isin(*slugs)).agg(F.coalesce(F.sum("fn_b"), F.lit(0)).alias("b"), F.coalesce(F.sum("fn_a"), F.lit(0)).alias("a"))
    no_gain = target.where("a >= b").select(F.lit("target misses did not fall").alias("reason"), F.lit(",".join(slugs)).alias("slug"))
    tests = {
        "new rule is imprecise": (F.col("slug") == new_slug) & (F.col("candidates_a") > 0) & (F.col("precision_a") < least_precision),
        "other precision dropped": (F.col("slug") != new_slug) & F.col("in_b") & (F.col("precision_b") - F.when(F.col("in_a"), F.col("precision_a")).otherwise(0.0) > OTHER_DROP + EPS),
        "other recall dropped": ~F.col("slug").isin(*slugs) & (F.col("high_fn_a") > F.col("high_fn_b")),
    }
    rows = d.select(F.explode(F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in tests.items()]), lambda x: x.isNotNull())).alias("reason"), "slug")
    over = d.agg(F.sum("candidates_b").alias("b"), F.sum("candidates_a").alias("a")).where(F.col("a") > _limit(F.col("b"), budget)).select(F.lit("candidate budget").alias("reason"), F.lit("").alias("slug"))
    return no_gain.unionByName(rows).unionByName(over)


def split_held_out(tasks: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, held out) by task_id."""
    return tasks.join(held, "task_id", "left_anti"), tasks.join(held, "task_id", "left_semi")


def patch_in_scope(before: DataFrame, after: DataFrame, slug: str, allowed: list[str]) -> DataFrame:
    """(slug, field) of every change of the rule table (of rules.load.frame) outside the allowed fields of one rule."""
    fields = [c for c in before.columns if c not in ("slug", "ord")]
    side = lambda d: d.select("slug", F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(c), F.to_json(F.struct(F.col(c).alias("v")))) for c in fields]))).alias("field", "value"))
    b, a = side(before), side(after).withColumnRenamed("value", "new")
    changed = b.join(a, ["slug", "field"], "full_outer").where(~F.col("value").eqNullSafe(F.col("new")))
    return changed.where((F.col("slug") != slug) | ~F.col("field").isin(*allowed)).select("slug", "field")
