"""Runs, locks and enrichment: how records and runs change over time."""

from __future__ import annotations

import datetime
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_run_id(now: datetime.datetime | None = None) -> str:
    """YYYYMMDDHHMMSS and eight random hex digits: ids sort by time."""
    now = now or datetime.datetime.now(datetime.UTC)
    return f"{now:%Y%m%d%H%M%S}-{secrets.token_hex(4)}"


def open_run(spark, run: str, project: str, kind: str, created: str, root: str = "") -> DataFrame:
    if kind not in ("scan", "process", "revalidate"):
        raise ValueError(f"unknown kind of run {kind}")
    return spark.createDataFrame([(run, project, root, created, kind, "running")], "runId string, projectId string, rootPath string, createdAt string, type string, phase string")


def close_run(runs: DataFrame, outcomes: DataFrame, completed: str) -> DataFrame:
    """`runs` with the phase of those in `outcomes` (runId, analyses, error_batches): an error only where every batch
    failed and nothing was analysed."""
    o = outcomes.select("runId", F.when((F.col("error_batches") > 0) & (F.col("analyses") == 0), "error").otherwise("done").alias("__phase"))
    out = runs.join(o, "runId", "left")
    before = F.col("completedAt") if "completedAt" in runs.columns else F.lit(None).cast("string")
    return out.withColumn("completedAt", F.when(F.col("__phase").isNotNull(), F.lit(completed)).otherwise(before)).withColumn("phase", F.coalesce("__phase", "phase")).drop("__phase")


def lock(records: DataFrame, queue: DataFrame, run: str, at: str) -> DataFrame:
    """Records of the queue (filePath) are marked as being processed by a run; the others stay."""
    q = queue.select("filePath").distinct().withColumn("__q", F.lit(True))
    out = records.join(q, "filePath", "left")
    mine = F.coalesce("__q", F.lit(False))
    return out.withColumns({"status": F.when(mine, "processing").otherwise(F.col("status")), "lockedByRunId": F.when(mine, F.lit(run)).otherwise(F.col("lockedByRunId")), "lockedAt": F.when(mine, F.lit(at)).otherwise(F.col("lockedAt"))}).drop("__q")


def release(records: DataFrame, run: str, status: Column) -> DataFrame:
    """Records that a run holds get a status and lose their lock."""
    mine = F.col("lockedByRunId") == run
    return records.withColumns({"status": F.when(mine, status).otherwise(F.col("status")), "lockedAt": F.when(mine, None).otherwise(F.col("lockedAt")), "lockedByRunId": F.when(mine, None).otherwise(F.col("lockedByRunId"))})


def requeue(records: DataFrame) -> DataFrame:
    """Analysed records become pending again, as before each agent of an ensemble."""
    return records.withColumn("status", F.when(F.col("status") == "analyzed", "pending").otherwise(F.col("status")))


def enrich(records: DataFrame, commits: DataFrame, at: str, n: int = 5, force: bool = False) -> DataFrame:
    """Records with the latest committers of their files (path, name, email, at); those that have them are left alone
    unless forced, and what is known of ownership is kept."""
    from .report import top_committers

    top = top_committers(commits, n).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "email", F.col("at").cast("string").alias("date")))).alias("c"))
    top = top.select(F.col("path").alias("filePath"), F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["email"].alias("email"), x["date"].alias("date"))).alias("__c"))
    out = records.join(top, "filePath", "left")
    want = F.col("__c").isNotNull() & (F.lit(force) | F.col("gitInfo").isNull())
    made = F.struct(F.col("__c").alias("recentCommitters"), F.lit(at).alias("enrichedAt"), F.col("gitInfo.ownership").alias("ownership"))
    return out.withColumn("gitInfo", F.when(want, made).otherwise(F.col("gitInfo"))).drop("__c")


def not_judged(findings: DataFrame, column: str, force: bool = False) -> DataFrame:
    return findings if force else findings.where(F.col(column).isNull())


def patch_queue(findings: DataFrame, run: str | None = None, severities: list[str] = (), slugs: list[str] = (), most: int | None = None) -> DataFrame:
    """Findings to be patched, in order of path and place, whatever their verdicts."""
    out = findings
    if run:
        out = out.where(F.col("run") == run)
    if severities:
        out = out.where(F.col("severity").isin(*severities))
    if slugs:
        out = out.where(F.col("slug").isin(*slugs))
    out = out.orderBy("path", "idx")
    return out.limit(most) if most else out


def doctor(records: DataFrame, n: int = 5) -> DataFrame:
    """The rules with most candidates."""
    rows = records.select(F.explode("candidates").alias("c"))
    return rows.groupBy(F.col("c.vulnSlug").alias("slug")).agg(F.count("*").alias("candidates")).orderBy(F.desc("candidates"), "slug").limit(n)


# fixed values: classes of findings by words in their titles and descriptions, the first that fits
CLASSES = [
    ("injection", ["sql", "command injection", "code injection", "template injection"]), ("xss", ["xss", "cross-site scripting", "html injection"]), ("ssrf", ["ssrf", "server-side request"]), ("path", ["path traversal", "directory traversal", "zip slip"]),
    ("auth", ["auth", "permission", "access control", "idor", "privilege"]), ("secret", ["secret", "credential", "api key", "token", "password"]), ("crypto", ["crypto", "cipher", "hash", "random"]), ("dos", ["denial of service", "dos", "resource exhaustion"]), ("redirect", ["redirect"]),
]


def finding_class(title: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, description))
    out = F.lit("other")
    for name, words in reversed(CLASSES):
        test = F.lit(False)
        for w in words:
            test = test | text.contains(w)
        out = F.when(test, name).otherwise(out)
    return out
