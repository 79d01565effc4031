"""Reports over findings, analyses and runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import checkpoints, ranked, running
from ..schemas import SEVERITY, severity_rank

CLEARED = ("false-positive", "fixed")
CONFIRMED = ("true-positive", "accepted-risk")


def count_if(c: Column) -> Column:
    return F.count_if(c).cast("long")


def at_least(severity: Column, threshold: str) -> Column:
    """Whether a severity reaches the threshold; an unknown threshold is an error."""
    if threshold not in SEVERITY:
        raise ValueError(f"unknown severity {threshold}")
    return severity_rank(severity) >= SEVERITY[threshold]


def real(verdict: Column) -> Column:
    """Not judged to be a false alarm or fixed; no verdict counts as real."""
    return ~F.coalesce(verdict.isin(*CLEARED), F.lit(False))


def select_findings(findings: DataFrame, min_severity: str | None = None, run: str | None = None, slugs: list[str] = (), prefix: str = "", verdict: str | None = None, real_only: bool = False) -> DataFrame:
    """The export filters over (path, severity, slug, run, verdict, …)."""
    out = findings
    if min_severity:
        out = out.where(at_least(F.col("severity"), min_severity))
    if run:
        out = out.where(F.col("run") == run)
    if slugs:
        out = out.where(F.col("slug").isin(*slugs))
    if prefix:
        out = out.where(F.col("path").startswith(prefix))
    if verdict:
        out = out.where(F.col("verdict") == verdict)
    return out.where(real(F.col("verdict"))) if real_only else out


def by_severity(findings: DataFrame, *ties: str) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")).desc(), *ties)


def status_counts(records: DataFrame, status: str = "status") -> DataFrame:
    return records.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("files"))


def project_status(records: DataFrame) -> DataFrame:
    """One row: files by status, all candidates, all findings."""
    states = ("pending", "processing", "analyzed", "error")
    return records.agg(F.count("*").alias("files"), *[count_if(F.col("status") == s).alias(s) for s in states], F.coalesce(F.sum(F.greatest(F.size("candidates"), F.lit(0))), F.lit(0)).cast("long").alias("candidates"), F.coalesce(F.sum(F.greatest(F.size("findings"), F.lit(0))), F.lit(0)).cast("long").alias("findings"))


def verdict_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """total, tp, fp, fixed and uncertain, for all or by keys."""
    v = F.col("verdict")
    return findings.groupBy(*keys).agg(
        F.count("*").alias("total"), count_if(v.isin(*CONFIRMED)).alias("tp"), count_if(v == "false-positive").alias("fp"), count_if(v == "fixed").alias("fixed"), count_if(v == "uncertain").alias("uncertain")
    )


def run_totals(runs: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(f"stats.{c}"), F.lit(0)).alias(c) for c in ("totalCostUsd", "totalInputTokens", "totalOutputTokens", "totalDurationMs")]
    return runs.agg(F.count("*").alias("runs"), *sums)


def newest_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("runId")).limit(n)


def latest_run(runs: DataFrame, kind: str = "process") -> DataFrame:
    """(run): ids sort by time, so the latest is the greatest."""
    return runs.where(F.col("type") == kind).agg(F.max("runId").alias("run"))


def severity_histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"), F.max(severity_rank(F.col("severity"))).alias("rank"))


def top_slugs(findings: DataFrame, n: int = 30) -> DataFrame:
    return findings.groupBy("slug").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "slug").limit(n)


def named(key: Column) -> Column:
    return F.when(F.trim(F.coalesce(key, F.lit(""))) == "", F.lit("(unknown)")).otherwise(key)


def cutoff_interval(since: str) -> tuple[str, str] | None:
    """("interval", SQL) or ("date", text) of `all`, `30d`, `24h`, `1h30m` or a date; None where there is no cutoff."""
    since = since.strip()
    if since in ("", "all"):
        return None
    if m := re.fullmatch(r"(\d+)d", since):
        return "interval", f"INTERVAL {m[1]} DAYS"
    if re.fullmatch(r"(?:\d+(?:\.\d+)?(?:h|m|s|ms))+", since):
        unit = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}
        total = sum(float(a) * unit[b] for a, b in re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", since))
        return "interval", f"INTERVAL {total:.3f} SECONDS"
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", since):
        return "date", since
    raise ValueError(f"cannot read the time span {since!r}")


def since(history: DataFrame, span: str, at: str = "investigatedAt", now: Column | None = None) -> DataFrame:
    """Entries from the cutoff on; those whose time cannot be read go only where there is a cutoff."""
    cut = cutoff_interval(span)
    if cut is None:
        return history
    limit = F.to_timestamp(F.lit(cut[1])) if cut[0] == "date" else (now if now is not None else F.current_timestamp()) - F.expr(cut[1])
    return history.where(F.try_to_timestamp(F.col(at)) >= limit)


def spend_rows(costs: DataFrame, key: Column) -> DataFrame:
    """(key, usd, pct, rank) of entries (cost): each key's share of all, the dearest first."""
    checkpoints(costs.sparkSession)
    rows = costs.where("cost is not null").groupBy(key.alias("key")).agg(F.sum("cost").alias("usd")).checkpoint()
    all_usd = rows.agg(F.sum("usd")).first()[0] or 0.0
    rows = rows.withColumn("pct", F.col("usd") / all_usd * 100 if all_usd > 0 else F.lit(0.0))
    return ranked(rows, F.desc("usd"), "key")


def spend_by(history: DataFrame, dimension: str) -> DataFrame:
    """By agent, phase or file of analyses (agent, phase, path, cost)."""
    key = {"agent": named(F.col("agent")), "phase": named(F.col("phase")), "file": F.col("path")}[dimension]
    return spend_rows(history, key)


def spend_by_slug(history: DataFrame, findings: DataFrame) -> DataFrame:
    """Each analysis' cost (path, run, cost) in equal parts to the distinct slugs that its run found in its file."""
    slugs = findings.where("run <> ''").groupBy("path", "run").agg(F.collect_set("slug").alias("slugs"))
    rows = history.where("cost is not null").join(slugs, ["path", "run"], "left").withColumn("slugs", F.coalesce("slugs", F.array(F.lit("(no findings)"))))
    parts = rows.select(F.explode("slugs").alias("slug"), (F.col("cost") / F.size("slugs")).alias("cost"))
    return spend_rows(parts, F.col("slug"))


def spend_totals(history: DataFrame) -> DataFrame:
    rows = history.where("cost is not null")
    return rows.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("usd"), F.count("*").alias("entries"), F.count_distinct(F.nullif("run", F.lit(""))).alias("runs"))


def cost_model(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """`usage` (model, input, output, cache_read, cache_write tokens) with cost by `pricing` in dollars a million tokens;
    unknown models cost nothing. The table of prices is a dimension of some dozen models."""
    kinds = ("input", "output", "cache_read", "cache_write")
    p = pricing.select("model", *[F.col(f"{k}_per_mtok").alias(f"__{k}") for k in kinds])
    cost = sum((F.coalesce(F.col(k), F.lit(0)) / 1e6 * F.col(f"__{k}") for k in kinds), F.lit(0.0))
    return usage.join(p, "model", "left").withColumn("cost", F.coalesce(cost, F.lit(0.0))).drop(*[f"__{k}" for k in kinds])


def attribute_cost(batches: DataFrame) -> DataFrame:
    """A batch's cost in equal parts to its files; tokens and durations in whole numbers."""
    n = F.size("paths")
    return batches.select("batch_id", F.explode("paths").alias("path"), (F.col("cost") / n).alias("cost"), F.expr("tokens div size(paths)").alias("tokens"), F.expr("duration_ms div size(paths)").alias("duration_ms"))


def last_entry(findings: DataFrame, history: DataFrame) -> DataFrame:
    """`findings` (path, run) with `agent` of the last entry of their run in their file, else of the file's last entry."""
    mine = history.groupBy("path", "run").agg(F.max_by("agent", "pos").alias("of_run"))
    any_run = history.groupBy("path").agg(F.max_by("agent", "pos").alias("of_file"))
    return findings.join(mine, ["path", "run"], "left").join(any_run, "path", "left").withColumn("agent", F.coalesce("of_run", "of_file")).drop("of_run", "of_file")


def top_committers(commits: DataFrame, n: int = 5) -> DataFrame:
    """The `n` latest commits of each path (path, name, email, at)."""
    w = Window.partitionBy("path").orderBy(F.desc("at"), "email")
    return commits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def running_budget(batches: DataFrame, budget: float, order: list[str], cost: str = "cost", keys: list[str] = ()) -> DataFrame:
    """The batches that start before their predecessors' costs reach the budget."""
    if not keys:
        return running(batches, cost, *order, name="spent_before").where(F.col("spent_before") < budget)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return batches.withColumn("spent_before", F.coalesce(F.sum(cost).over(w), F.lit(0.0))).where(F.col("spent_before") < budget)


def fail_on(findings: DataFrame, run: str, threshold: str) -> int:
    """Findings of a run that reach the threshold and are not cleared."""
    return findings.where((F.col("run") == run) & at_least(F.col("severity"), threshold) & real(F.col("verdict"))).count()


def finding_id(*parts: Column, sep: str = "\u0000", size: int = 16) -> Column:
    """The first digits of the SHA-256 of the joined parts."""
    return F.substring(F.sha2(F.concat_ws(sep, *[p.cast("string") for p in parts]), 256), 1, size)


def compliance_id(path: Column, slug: Column, lines: Column) -> Column:
    tail = F.array_join(F.transform(lines, lambda x: F.concat(x.cast("string"), F.lit("\n"))), "")
    return F.substring(F.sha2(F.concat(path, F.lit("\n"), slug, F.lit("\n"), tail), 256), 1, 16)


def evidence_hash(path: Column, file_hash: Column, slug: Column, run: Column, lines: Column) -> Column:
    tail = F.array_join(F.transform(lines, lambda x: F.concat(x.cast("string"), F.lit("\n"))), "")
    return F.sha2(F.concat(path, F.lit("\n"), file_hash, F.lit("\n"), slug, F.lit("\n"), run, F.lit("\n"), tail), 256)


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH", "HIGH_BUG"), "error").when(severity.isin("MEDIUM", "BUG"), "warning").otherwise("note")


def stale(tasks: DataFrame, today: Column, due: str = "review_due") -> DataFrame:
    return tasks.where(today > F.col(due)).withColumn("days_over", F.datediff(today, F.col(due)).cast("long"))
