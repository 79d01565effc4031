"""Predictions against labels: interval joins, nearest candidates, one-to-one matching, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import severity_rank
from .intervals import stab
from .ordered import checkpoints

TOLERANCE = 3


def rate(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)).cast("double")


def issue_slugs(issues: DataFrame) -> DataFrame:
    """One row for each alias of an issue, with the interval widened by its tolerance."""
    slack = F.coalesce("tolerance", F.lit(TOLERANCE))
    return issues.select("task_id", "issue_id", "file", "severity", "must_emit", (F.col("start_line") - slack).alias("low"), (F.col("end_line") + slack).alias("high"), F.explode("slugs").alias("slug"))


def matches(candidates: DataFrame, issues: DataFrame) -> DataFrame:
    """(task_id, issue_id, cand_id, must_emit): candidates (task_id, cand_id, file, slug, line) inside an issue's interval."""
    c = candidates.select("task_id", "cand_id", "file", "slug", "line")
    found = stab(c, issue_slugs(issues).drop("severity"), ["task_id", "file", "slug"])
    return found.select("task_id", "issue_id", "cand_id", "must_emit").distinct()


def classify(candidates: DataFrame, issues: DataFrame, decoys: DataFrame | None = None, matched: DataFrame | None = None) -> DataFrame:
    """`candidates` with `tp` and, where decoys (task_id, decoy_id, ord, file, line, slugs) are given, the first decoy.
    `matched`: their matches(), where the caller has them."""
    hit = (matches(candidates, issues) if matched is None else matched).where("must_emit").select("task_id", "cand_id").distinct().withColumn("__tp", F.lit(True))
    out = candidates.join(hit, ["task_id", "cand_id"], "left").withColumn("tp", F.coalesce("__tp", F.lit(False))).drop("__tp")
    if decoys is None:
        return out
    d = decoys.select("task_id", "decoy_id", "ord", "file", "line", F.explode("slugs").alias("slug"))
    first = candidates.join(d, ["task_id", "file", "slug", "line"]).groupBy("task_id", "cand_id").agg(F.min_by("decoy_id", "ord").alias("decoy_id"))
    return out.join(first, ["task_id", "cand_id"], "left")


def false_negatives(candidates: DataFrame, issues: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Missed issues that must be found, with the nearest candidate of the file, earliest on ties, and a reason."""
    found = (matches(candidates, issues) if matched is None else matched).select("task_id", "issue_id").distinct()
    missed = issues.where("must_emit").join(found, ["task_id", "issue_id"], "left_anti")
    slack = F.coalesce("tolerance", F.lit(TOLERANCE))
    m = missed.select("task_id", "issue_id", "file", "severity", "slugs", (F.col("start_line") - slack).alias("low"), (F.col("end_line") + slack).alias("high"))
    # of each line the candidate of least id; an issue's nearest is the last before its interval or the first from there
    c = candidates.groupBy("task_id", "file", "line").agg(F.min_by("slug", "cand_id").alias("near_slug"))
    near = F.struct("near_slug", F.col("line").alias("near_line"))
    c = c.select("task_id", "file", F.lit(None).cast(m.schema["issue_id"].dataType).alias("issue_id"), F.col("line").alias("at"), F.lit(1).alias("kind"), near.alias("c"), F.lit(None).cast(m.schema["high"].dataType).alias("high"))
    i = m.select("task_id", "file", "issue_id", F.col("low").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(c.schema["c"].dataType).alias("c"), "high")
    group = Window.partitionBy("task_id", "file")
    rows = c.unionByName(i).withColumn("prev", F.last("c", True).over(group.orderBy("at", "kind"))).withColumn("next", F.last("c", True).over(group.orderBy(F.desc("at"), F.desc("kind"))))
    before, after = F.col("at") - F.col("prev.near_line"), F.greatest(F.col("next.near_line") - F.col("high"), F.lit(0))
    best = F.when(F.col("prev").isNull() | (F.col("next").isNotNull() & (after < before)), F.col("next")).otherwise(F.col("prev"))
    near = rows.where("kind = 0").select("task_id", "issue_id", best.alias("n"))
    out = m.join(near, ["task_id", "issue_id"], "left")
    # fixed texts of the reasons
    reason = F.when(F.col("n").isNull(), "no candidate with acceptable slug near issue").when(F.array_contains("slugs", F.col("n.near_slug")), "closest acceptable-slug candidate is outside tolerance").otherwise("closest candidate has a non-acceptable slug")
    return out.select("task_id", "issue_id", "file", "severity", F.col("slugs")[0].alias("slug"), F.col("n.near_slug").alias("near_slug"), F.col("n.near_line").cast("long").alias("near_line"), reason.alias("reason"))


def scorecard(classified: DataFrame, missed: DataFrame, issues: DataFrame, keys: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """tp, candidates, fn, detectable, precision and recall by keys."""
    c = classified.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count_if("tp").alias("tp"))
    i = issues.where("must_emit").groupBy(*keys).agg(F.count("*").alias("detectable"))
    m = missed.groupBy(*keys).agg(F.count("*").alias("fn"))
    out = c.join(i, list(keys), "full_outer").join(m, list(keys), "full_outer").na.fill(0)
    return out.withColumn("precision", rate(F.col("tp"), F.col("candidates"))).withColumn("recall", rate(F.col("detectable") - F.col("fn"), F.col("detectable")))


def by_slug(classified: DataFrame, missed: DataFrame) -> DataFrame:
    """tp, fp and fn of each task and slug; a missed issue counts for its first alias."""
    c = classified.groupBy("task_id", "slug").agg(F.count_if("tp").alias("tp"), F.count_if(~F.col("tp")).alias("fp"))
    m = missed.groupBy("task_id", "slug").agg(F.count("*").alias("fn"))
    return c.join(m, ["task_id", "slug"], "full_outer").na.fill(0)


def greedy(findings: DataFrame, answers: DataFrame) -> DataFrame:
    """One-to-one matching: findings (task_id, file, finding_id, slug, line) in order of line, id and slug take the first
    free answer (task_id, file, ord, answer_id, slugs, low, high) of their file that fits. Returns (task_id, file,
    finding_id, answer_id) as strings, null for none.

    Deferred acceptance in rounds: each finding asks its first answer that may be free, an answer keeps the earliest that
    asks, and the others ask on. All answers rank findings alike, so the outcome is that of taking turns. Findings of one
    line and slug fit the same answers, so only as many of them as there are such answers take part, the earliest, and
    each of them asks behind the one before it. No file is gathered; a round is a join and a grouped minimum.
    """
    spark = findings.sparkSession
    checkpoints(spark)
    place = ["task_id", "file", "slug", "line"]
    a = answers.select("task_id", "file", "ord", "answer_id", F.explode(F.array_distinct("slugs")).alias("slug"), "low", "high")
    fits = stab(findings.select(*place).distinct(), a, ["task_id", "file", "slug"])
    fits = fits.withColumn("pos", F.row_number().over(Window.partitionBy(*place).orderBy("ord", "answer_id"))).select(*place, "pos", "ord", "answer_id").checkpoint()
    room = fits.groupBy(*place).agg(F.max("pos").alias("k"))
    most = room.agg(F.max("k")).first()[0] or 0
    f = findings.select(*place, "finding_id").distinct()
    turn = F.row_number().over(Window.partitionBy(*place).orderBy("finding_id"))
    # a bound that all places share lets every task drop the rest before rows are moved
    asking = f.withColumn("j", turn).where(F.col("j") <= most).join(room, place).where("j <= k").withColumn("pos", F.col("j")).checkpoint()
    order = F.struct("line", "finding_id", "slug")
    behind = Window.partitionBy(*place).orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        asked = asking.where("pos <= k").join(fits, [*place, "pos"]).select(*place, "finding_id", "answer_id")
        kept = asked.groupBy("task_id", "file", "answer_id").agg(F.min(order).alias("by")).select("task_id", "file", "answer_id", "by.*").withColumn("held", F.lit(True))
        said = asking.join(kept, [*place, "finding_id"], "left").checkpoint()
        if said.where("held is null and pos <= k").isEmpty():
            break
        on = said.withColumn("pos", F.col("pos") + F.when(F.col("held").isNull(), 1).otherwise(0)).drop("held", "answer_id")
        asking = on.withColumn("pos", F.max(F.col("pos") - F.col("j")).over(behind) + F.col("j"))
    text = lambda c: F.col(c).cast("string").alias(c)
    got = said.where("held").select("task_id", "file", text("finding_id"), text("answer_id"))
    return findings.select("task_id", "file", text("finding_id")).join(got, ["task_id", "file", "finding_id"], "left")


def external_comparison(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """Files of two tools (path, class): in both, only in one, and how many of the shared agree in a class."""
    a = theirs.groupBy("path").agg(F.collect_set("class").alias("a"))
    b = ours.groupBy("path").agg(F.collect_set("class").alias("b"))
    both = a.join(b, "path", "full_outer")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("b").isNull()).alias("only_theirs"), F.count_if(F.col("a").isNull()).alias("only_ours"), F.count_if(F.coalesce(F.arrays_overlap("a", "b"), F.lit(False))).alias("aligned"))


def worst_precision(slugs: DataFrame, least_fp: int = 1) -> DataFrame:
    """The slug of least precision among those with more than `least_fp` false alarms, most of them first on ties."""
    total = slugs.groupBy("slug").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp")).where(F.col("fp") > least_fp)
    return total.withColumn("precision", rate(F.col("tp"), F.col("tp") + F.col("fp"))).orderBy("precision", F.desc("fp"), "slug").limit(1)


def decoy_rate(classified: DataFrame, decoys: DataFrame) -> DataFrame:
    """(task_id, decoys, flagged, rate): the share of a task's decoys that some false alarm hit."""
    n = decoys.groupBy("task_id").agg(F.count("*").alias("decoys"))
    hit = classified.where("not tp and decoy_id is not null").groupBy("task_id").agg(F.countDistinct("decoy_id").alias("flagged"))
    return n.join(hit, "task_id", "left").na.fill(0, ["flagged"]).withColumn("rate", rate(F.col("flagged"), F.col("decoys")))


def worst_members(missed: DataFrame) -> DataFrame:
    """The missed issues of the slug that worst_recall names, the gravest first."""
    return missed.join(F.broadcast(worst_recall(missed).select("slug")), "slug", "left_semi").orderBy(severity_rank(F.col("severity")).desc(), "task_id", "issue_id")


def processor_by_slug(findings: DataFrame, matched: DataFrame, answers: DataFrame) -> DataFrame:
    """(slug, tp, fp, fn, precision, recall): findings (task_id, finding_id, slug) count by their own slug, answers
    (task_id, answer_id, slugs) that none of `matched` (task_id, finding_id, answer_id) took by their first."""
    took = matched.where("answer_id is not null")
    f = findings.join(took.select("task_id", "finding_id", F.lit(True).alias("__hit")), ["task_id", "finding_id"], "left")
    f = f.groupBy("slug").agg(F.count_if(F.col("__hit")).alias("tp"), F.count_if(F.col("__hit").isNull()).alias("fp"))
    m = answers.join(took, ["task_id", "answer_id"], "left_anti").groupBy(F.col("slugs")[0].alias("slug")).agg(F.count("*").alias("fn"))
    out = f.join(m, "slug", "full_outer").na.fill(0)
    return out.withColumn("precision", rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", rate(F.col("tp"), F.col("tp") + F.col("fn")))


def unused_replies(batched: DataFrame, replies: DataFrame) -> DataFrame:
    """(position, problem): recorded replies that no batch consumed."""
    left = replies.join(batched.select(F.col("batch_id").alias("position")).distinct(), "position", "left_anti")
    return left.select("position", F.lit("recorded reply was not consumed").alias("problem"))


def worst_recall(missed: DataFrame) -> DataFrame:
    """The slug with most missed issues of HIGH and CRITICAL, then most at all."""
    return missed.groupBy("slug").agg(F.count_if(F.col("severity").isin("HIGH", "CRITICAL")).alias("high"), F.count("*").alias("fn")).orderBy(F.desc("high"), F.desc("fn"), "slug").limit(1)


def first_k(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def set_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """`keys` with change: resolved (only before) or new (only after)."""
    b, a = before.select(*keys).distinct(), after.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("resolved")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("new")))


def regression_check(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """`cases` (path, slug, expectation) with the number of hits and whether the expectation holds."""
    n = hits.groupBy("path", "slug").agg(F.count("*").alias("hits"))
    out = cases.join(n, ["path", "slug"], "left").na.fill(0, ["hits"])
    return out.withColumn("ok", F.when(F.col("expectation") == "must_fire", F.col("hits") > 0).otherwise(F.col("hits") == 0))



def processor_scorecard(findings: DataFrame, matched: DataFrame, answers: DataFrame, candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row a task: precision, recall, recall among answers that a candidate backs, accuracy of severities and the
    share of refusals among batches.

    findings (task_id, finding_id, severity), matched (task_id, finding_id, answer_id), answers (task_id, answer_id,
    file, severity, slugs, low, high), candidates (task_id, file, slug, line), outcomes (task_id, refusals, batches).
    """
    hit = matched.where("answer_id is not null").select("task_id", "finding_id", "answer_id")
    sev = hit.join(findings.select("task_id", "finding_id", F.col("severity").alias("got")), ["task_id", "finding_id"]).join(answers.select("task_id", "answer_id", "severity"), ["task_id", "answer_id"])
    a = answers.select("task_id", "answer_id", "file", "low", "high", F.explode("slugs").alias("slug"))
    places = candidates.select("task_id", "file", "slug", "line").distinct()
    backed = stab(places, a, ["task_id", "file", "slug"]).select("task_id", "answer_id").distinct()
    counts = [
        findings.groupBy("task_id").agg(F.count("*").alias("produced")), answers.groupBy("task_id").agg(F.count("*").alias("expected")), sev.groupBy("task_id").agg(F.count("*").alias("matches"), F.count_if(F.col("got") == F.col("severity")).alias("same_severity")),
        backed.groupBy("task_id").agg(F.count("*").alias("backed")), backed.join(hit.select("task_id", "answer_id"), ["task_id", "answer_id"], "left_semi").groupBy("task_id").agg(F.count("*").alias("backed_matches")), outcomes.select("task_id", "refusals", "batches"),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(c, "task_id", "full_outer")
    out = out.na.fill(0)
    r = {"precision": ("matches", "produced"), "recall": ("matches", "expected"), "recall_given_candidate": ("backed_matches", "backed"), "severity_accuracy": ("same_severity", "matches"), "refusal_rate": ("refusals", "batches")}
    return out.withColumns({k: rate(F.col(x), F.col(y)) for k, (x, y) in r.items()})


def micro(per_task: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Ratios of sums over all tasks."""
    sums = per_task.agg(*[F.sum(c).alias(c) for c in sorted({x for p in pairs.values() for x in p})])
    return sums.select(*[rate(F.col(a), F.col(b)).alias(k) for k, (a, b) in pairs.items()])


def guards(scored: DataFrame, expected: DataFrame) -> DataFrame:
    """(task_id, problem): tasks with more refusals than expected, or fewer findings than the least."""
    rows = scored.join(expected, "task_id")
    tests = F.array(F.when(F.col("refusals") > F.col("expected_refusals"), F.lit("more refusals than expected")), F.when(F.col("produced") < F.col("least_findings"), F.lit("fewer findings than expected")))
    return rows.select("task_id", F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("problem"))


def regression_cases(before_fp: DataFrame, after_fp: DataFrame, before_fn: DataFrame, after_fn: DataFrame, keys: list[str]) -> DataFrame:
    """`keys` with expectation: false alarms that went must not fire again, misses that were found must fire."""
    gone = set_delta(before_fp, after_fp, keys).where("change = 'resolved'").withColumn("expectation", F.lit("must_not_fire"))
    won = set_delta(before_fn, after_fn, keys).where("change = 'resolved'").withColumn("expectation", F.lit("must_fire"))
    return gone.unionByName(won).drop("change")


def class_counts(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """(class, theirs, ours) over the classes of either side."""
    a = theirs.groupBy("class").agg(F.count("*").alias("theirs"))
    return a.join(ours.groupBy("class").agg(F.count("*").alias("ours")), "class", "full_outer").na.fill(0)


def inventory(history: DataFrame, column: str) -> DataFrame:
    """One row: the distinct values that are not blank, sorted."""
    return history.where(F.trim(F.coalesce(column, F.lit(""))) != "").agg(F.sort_array(F.collect_set(column)).alias(column))


def improved(before: Column, after: Column, lower_is_better: Column) -> Column:
    return F.when(lower_is_better, after < before).otherwise(after > before)
