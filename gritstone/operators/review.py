"""Reviews of results: closest answers, slugs over all aliases, equal sets, outcomes of runs, members of an ensemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .score import rate


def closest_answers(findings: DataFrame, answers: DataFrame) -> DataFrame:
    """`findings` (task_id, file, finding_id, line) with `closest`: the answer (task_id, file, ord, answer_id, low, high) of
    the file whose range is nearest to the line, the first in order on ties; null where the file has none.

    What is closest depends on file and line only, so each line is looked at once, however many findings it has. Ranges
    that end before the line and those that start after it are met in two sorted windows over distinct ends. A range
    around the line is met by halves: it is cut into at most two stretches of each power of two, of each stretch only the
    first answer is kept, and a line looks up the one stretch of each power that it is in. So many ranges over one line cost
    a sort and not all pairs.
    """
    key = ["task_id", "file"]
    f = findings.select(*key, F.col("line").cast("long").alias("line")).distinct()
    a = answers.select(*key, F.col("ord").cast("long").alias("ord"), "answer_id", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))
    first = lambda *by: a.groupBy(*key, *by).agg(F.min(F.struct("ord", "answer_id")).alias("c"))
    # the stretches of 2^power lines that make up a range: at each power one at either end, where that end is odd
    cut = first("low", "high").withColumn("power", F.explode(F.when(F.col("high") >= F.col("low"), F.sequence(F.lit(0), F.floor(F.log2(F.col("high") - F.col("low") + 1)).cast("int")))))
    cut = cut.withColumns({"from": F.expr("-shiftright(-low, power)"), "to": F.expr("shiftright(high + 1, power)")}).where("from < to")
    at = F.array(F.when(F.col("from").bitwiseAND(1) == 1, F.col("from")), F.when(F.col("to").bitwiseAND(1) == 1, F.col("to") - 1))
    cover = cut.select(*key, "power", "c", F.explode(at).alias("part")).where("part is not null").groupBy(*key, "power", "part").agg(F.min("c").alias("c"))
    powers = F.broadcast(cover.select("power").distinct())
    around = f.crossJoin(powers).withColumn("part", F.expr("shiftright(line, power)")).join(cover, [*key, "power", "part"])
    inside = around.groupBy(*key, "line").agg(F.min("c").alias("c"))
    inside = inside.select(*key, "line", F.struct(F.lit(0).cast("long").alias("dist"), "c.ord", "c.answer_id").alias("in_"))

    def ends(at: str) -> DataFrame:
        return first(F.col(at).alias("at")).select(*key, "at", F.lit(0).alias("kind"), F.struct("at", "c.ord", "c.answer_id").alias("c"))

    places = f.select(*key, F.col("line").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(ends("high").schema["c"].dataType).alias("c"))
    group = Window.partitionBy(*key)
    before = ends("high").unionByName(places).withColumn("p", F.last("c", True).over(group.orderBy("at", "kind"))).where("kind = 1").select(*key, F.col("at").alias("line"), "p")
    after = ends("low").unionByName(places).withColumn("n", F.last("c", True).over(group.orderBy(F.desc("at"), "kind"))).where("kind = 1").select(*key, F.col("at").alias("line"), "n")
    near = lambda c, dist: F.when(F.col(c).isNotNull(), F.struct(dist.alias("dist"), F.col(f"{c}.ord").alias("ord"), F.col(f"{c}.answer_id").alias("answer_id")))
    out = before.join(after, [*key, "line"]).join(inside, [*key, "line"], "left")
    best = F.coalesce("in_", F.least(near("p", F.col("line") - F.col("p.at")), near("n", F.col("n.at") - F.col("line"))))
    found = out.select(*[F.col(k).alias(f"__{k}") for k in (*key, "line")], best["answer_id"].alias("closest"))
    met = [findings[k] == F.col(f"__{k}") for k in key] + [findings["line"].cast("long") == F.col("__line")]
    return findings.join(found, met[0] & met[1] & met[2], "left").drop("__task_id", "__file", "__line")


def slug_review(by_slug: DataFrame, slug: str) -> DataFrame:
    """One row of a slug over all tasks: tp, fp, fn, candidates, precision among candidates, recall."""
    t = by_slug.where(F.col("slug") == slug).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "candidates")])
    return t.select(F.lit(slug).alias("slug"), "*", rate(F.col("tp"), F.col("candidates")).alias("precision"), rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def missed_by_alias(missed: DataFrame, slug: str, *keys: str) -> DataFrame:
    """Missed issues (…, slugs) of which any alias is the slug, in order of their keys."""
    return missed.where(F.array_contains("slugs", slug)).orderBy(*keys)


def equal_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(equal): whether both hold the same distinct keys; nulls are equal."""
    x, y = (t.select(*keys).distinct().withColumn(f"__{i}", F.lit(1)) for i, t in enumerate((a, b)))
    both = x.unionByName(y, allowMissingColumns=True).groupBy(*keys).agg(F.count("__0").alias("__0"), F.count("__1").alias("__1"))
    return both.agg((F.count_if(F.col("__0") != F.col("__1")) == 0).alias("equal"))


def same_strings(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same distinct strings, as the files of a patch and of its finding."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def outcome(batches: DataFrame, most_usd: float | None = None) -> DataFrame:
    """One row of a run from its batches (cost, input_tokens, output_tokens, duration_ms, analyses, findings, state): sums,
    the batches in error (failed or out of quota), whether the budget is used up, and the run's phase: an error only
    where a batch failed and nothing was analysed."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    t = batches.agg(total("cost"), *[total(c).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "duration_ms", "analyses", "findings")], F.count_if(F.col("state").isin("failed", "quota")).alias("error_batches"))
    spent = F.lit(False) if most_usd is None else F.col("cost") >= most_usd
    return t.withColumn("budget_exhausted", spent).withColumn("phase", F.when((F.col("error_batches") > 0) & (F.col("analyses") == 0), "error").otherwise("done"))


def of_ensemble(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """`findings` (…, run) of an ensemble's runs (run, agent), with the agent; others are left out."""
    return findings.join(runs.select("run", "agent").distinct(), "run")


def in_file_order(rows: DataFrame, file: str = "file", lines: str = "lines") -> DataFrame:
    """By file and first line; rows without lines come first in their file."""
    return rows.orderBy(file, F.coalesce(F.get(lines, F.lit(0)), F.lit(0)))
