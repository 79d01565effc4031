"""The commands of the engine as jobs over tables: each reads tables, runs operators and writes tables.

    python -m gritstone scan ROOT DATA [--only SLUGS] [--exclude SLUGS] [--force] [--files A,B | --files-from FILE | --diff FILE]
    python -m gritstone process DATA ROOT REPLIES [--only SLUGS] [--skip SLUGS] [--prefix PATH] [--limit N] [--batch N]
    python -m gritstone revalidate|triage DATA ANSWERS [--prefix PATH] [--force]
    python -m gritstone enrich DATA ROOT [--force]
    python -m gritstone export DATA OUT [--format json|sarif] [--min-severity S] [--run R] [--slug A,B] [--prefix PATH] [--verdict V]
    python -m gritstone pr-comment DATA RUN OUT
    python -m gritstone report DATA --format markdown|csv|json|sarif|html OUT
    python -m gritstone status|metrics|spend|doctor DATA
    python -m gritstone rules|lint
"""

from __future__ import annotations

import argparse
import datetime
import sys
import tomllib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import audit, gate, investigate, lifecycle, records as changes, report, scan
from .operators.ordered import checkpoints
from .operators.records import redacted
from .rules.load import PACKS, Rule, frame, lint, override, pack_hash, read_packs, select
from .sources import git, sinks, tables


def scan_project(spark: SparkSession, files: DataFrame, rules: list[Rule], known: DataFrame | None = None, run: str | None = None, force: bool = False, watch: Observation | None = None) -> DataFrame:
    """Records (path, candidates, file_hash, pack_hash, run_id, status) after a scan of files (path, content).

    Gates are evaluated once; files whose content and rules have not changed are not scanned, their records only get
    the new run. Regular expressions, tree queries and the route audit run on the others. `watch` gets the numbers of
    files and of cache_hits while the scan runs.
    """
    run = run or lifecycle.new_run_id()
    tech = gate.detect(files)
    on = {r.slug for r in gate.evaluate(frame(spark, rules), tech, files).where("active").select("slug").collect()}
    active = [r for r in rules if r.slug in on]
    every = scan.marked_cached(files, known, rules, force)
    todo = every.where("not cached").drop("cached")
    # a rule with tree patterns is judged by them alone where its language has a parser
    plain = [r for r in active if r.slug != "route-without-auth"]
    found = scan.candidates(todo, plain).unionByName(audit.tree_candidates(todo, active))
    if "route-without-auth" in on:
        found = found.unionByName(audit.route_audit(todo))
    if watch is not None:
        every = every.observe(watch, F.count("*").alias("files"), F.count_if("cached").alias("cache_hits"))
    hashes = every.select("path", "file_hash")
    new = hashes.join(scan.records(found), "path", "left").withColumns({"pack_hash": F.lit(pack_hash(rules)), "run_id": F.lit(run), "status": F.lit("pending")})
    if known is None:
        none = F.array().cast(schemas.CANDIDATES)
        return new.select("path", F.coalesce("candidates", none).alias("candidates"), "file_hash", "pack_hash", "run_id", "status")
    return scan.upsert(known, new.select("path", "candidates", "file_hash", "pack_hash", "run_id", "status"))


def process(spark: SparkSession, records: DataFrame, files: DataFrame, backend: Callable, most: int = 5, **filters) -> DataFrame:
    """(batch_id, path, finding, problem, cost): the queue's files in batches through a backend, each finding checked.
    `records` needs filePath, candidates, status and analysisHistory."""
    queue = investigate.work_queue(records, **filters)
    batched = investigate.batches(queue.select(F.col("filePath").alias("path")), most).join(files, "path")
    replies = investigate.investigate(batched, backend)
    from .functions.text import line_count

    rows = replies.select("batch_id", "path", "cost", F.explode("findings").alias("finding"))
    return investigate.validated(rows, batched.select("batch_id", "path", line_count(F.col("content")).alias("loc")))


def ensemble(spark: SparkSession, records: DataFrame, files: DataFrame, backends: dict[str, Callable], **filters) -> DataFrame:
    """The consensus of several backends over the same records, each seeing them afresh."""
    parts = None
    for i, (name, backend) in enumerate(backends.items()):
        got = process(spark, lifecycle.requeue(records), files, backend, **filters).where("problem is null")
        got = got.select("path", (F.monotonically_increasing_id() * len(backends) + i).alias("finding_id"), F.col("finding.vulnSlug").alias("slug"), F.col("finding.lineNumbers").alias("lines"), F.col("finding.title").alias("title"), F.lit(name).alias("agent"))
        parts = got if parts is None else parts.unionByName(got)
    return investigate.consensus(parts)


def flat_findings(records: DataFrame) -> DataFrame:
    """Findings of records in the shape that reports take."""
    f = schemas.findings_of(records)
    return f.select("path", "idx", "severity", F.col("vulnSlug").alias("slug"), F.col("lineNumbers").alias("lines"), "title", "description", "confidence", "recommendation", F.col("revalidation.verdict").alias("verdict"), F.col("producedByRunId").alias("run"))


def flat_history(records: DataFrame) -> DataFrame:
    h = schemas.history_of(records)
    return h.select("path", "pos", F.col("runId").alias("run"), F.col("agentType").alias("agent"), "phase", F.col("costUsd").alias("cost"), "investigatedAt")


def listing(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system that Spark reads, sorted; none where there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def versions(spark: SparkSession, table: str) -> list[str]:
    """The complete versions of a table, the newest last. A version that was broken off lacks its mark and does not count."""
    return [f"{table}/{v}" for v in listing(spark, table) if v.startswith("v-") and "_SUCCESS" in listing(spark, f"{table}/{v}")]


def newest(spark: SparkSession, table: str, schema: str | None = None) -> DataFrame | None:
    """The newest version of a table, or None."""
    have = versions(spark, table)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(have[-1]) if have else None


def replace(rows: DataFrame, table: str, kept: int = 2) -> None:
    """A new version of a table, which may be what `rows` is read from. Readers see the old one until it is complete, then
    the new one; the `kept` newest stay, others go."""
    spark = rows.sparkSession
    last = max((int(v[2:]) for v in listing(spark, table) if v.startswith("v-")), default=0)
    rows.write.parquet(f"{table}/v-{last + 1:012d}")
    for old in versions(spark, table)[:-kept]:
        path = spark._jvm.org.apache.hadoop.fs.Path(old)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read(spark: SparkSession, data: str) -> DataFrame:
    """The records of a data folder, without secrets: the newest version of its table, or JSON documents as other tools
    write them."""
    have = newest(spark, f"{data}/records", schemas.RECORD)
    return tables.read_records(spark, f"{data}/files") if have is None else redacted(have)


def store(records: DataFrame, data: str) -> None:
    """Replace the records of a data folder; secrets do not get into it."""
    replace(redacted(records), f"{data}/records")


def merged(spark: SparkSession, data: str, project: str) -> DataFrame:
    """The records of a data folder after a scan: candidates, hashes and run are the scan's, all else stays as it was, and
    files that were scanned first are new records."""
    known = listing(spark, f"{data}/records") or listing(spark, f"{data}/files")
    old = (read(spark, data) if known else spark.createDataFrame([], schemas.RECORD)).alias("o")
    s = newest(spark, f"{data}/scan").select(F.col("path").alias("filePath"), "candidates", F.col("run_id").alias("lastScannedRunId"), F.col("file_hash").alias("fileHash"), F.col("pack_hash").alias("lastMatcherPackHash"), "status").alias("s")
    both = old.join(s, F.col("o.filePath") == F.col("s.filePath"), "full_outer")
    names = old.columns
    first = {c: ("s", "o") for c in ("candidates", "lastScannedRunId", "fileHash", "lastMatcherPackHash")} | {c: ("o", "s") for c in ("filePath", "status")}
    cols = {c: F.coalesce(*[F.col(f"{side}.{c}") for side in first[c]]) if c in first else F.col(f"o.{c}") for c in names}
    cols["projectId"] = F.coalesce("o.projectId", F.lit(project))
    for c, kind in (("findings", schemas.FINDING), ("analysisHistory", schemas.HISTORY)):
        cols[c] = F.coalesce(f"o.{c}", F.array().cast(f"array<{kind}>"))
    return both.select(*[cols[c].alias(c) for c in names])


def process_replies(spark: SparkSession, records: DataFrame, files: DataFrame, replies: DataFrame, run: str, most: int = 5, **filters) -> DataFrame:
    """The records after recorded replies (tables.read_replies) to the queue's batches: sound findings are appended, the
    files of the batches are analysed and have an entry more in their history; other records stay as they are."""
    from .functions.text import line_count

    queue = investigate.work_queue(records, **filters).select(F.col("filePath").alias("path"))
    batched = investigate.batches(queue, most).select("batch_id", "path").join(files, "path")
    told = investigate.replay(batched, replies)
    found = investigate.validated(investigate.parse_reply(told), batched.select("batch_id", "path", line_count(F.col("content")).alias("loc"))).where("problem is null")
    new = batched.select("path").join(found.groupBy("path").agg(F.collect_list(changes.clean_finding(F.col("finding")).withField("producedByRunId", F.lit(run))).alias("findings")), "path", "left")
    new = new.withColumn("findings", F.coalesce("findings", F.array().cast(f"array<{schemas.FINDING}>")))
    grown = investigate.append_findings(records.select(F.col("filePath").alias("path"), "findings").join(new.select("path"), "path", "left_semi"), new)
    entry = F.from_json(F.to_json(F.struct(F.lit(run).alias("runId"), F.lit("process").alias("phase"), F.lit("replay").alias("agentType"), F.size("findings").alias("findingCount"))), schemas.HISTORY)
    after = new.select("path", entry.alias("__h")).join(grown.select("path", F.col("findings").alias("__f")), "path").withColumnRenamed("path", "filePath")
    out = records.join(after, "filePath", "left")
    mine = F.col("__h").isNotNull()
    out = out.withColumns({"findings": F.coalesce("__f", "findings"), "analysisHistory": F.when(mine, F.array_append("analysisHistory", F.col("__h"))).otherwise(F.col("analysisHistory")), "status": F.when(mine, "analyzed").otherwise(F.col("status"))})
    return out.select(records.columns)


def looked_at(records: DataFrame, answers: str, kind: str, run: str, at: str, prefix: str = "", force: bool = False) -> DataFrame:
    """The records after recorded answers of a second look or of triage, one JSON object a line: filePath, index and what
    was answered (see operators.records). Of answers to one place the last line counts; only files below `prefix` change."""
    schema = changes.VERDICT_ANSWERS if kind == "revalidate" else changes.TRIAGE_ANSWERS
    rows = records.sparkSession.read.schema(schema).json(answers).where(F.col("filePath").startswith(prefix)).withColumn("ord", F.monotonically_increasing_id())
    return changes.revalidated(records, rows, run, at, force=force) if kind == "revalidate" else changes.triaged(records, rows, at, force=force)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gritstone")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("root")
    s.add_argument("data")
    s.add_argument("--only", default="")
    s.add_argument("--exclude", default="")
    s.add_argument("--rules", action="append", default=[])
    s.add_argument("--force", action="store_true")
    s.add_argument("--files", default="")
    s.add_argument("--files-from")
    s.add_argument("--diff")
    s = sub.add_parser("process")
    s.add_argument("data")
    s.add_argument("root")
    s.add_argument("replies")
    s.add_argument("--only", default="")
    s.add_argument("--skip", default="")
    s.add_argument("--prefix", default="")
    s.add_argument("--limit", type=int)
    s.add_argument("--batch", type=int, default=5)
    for name in ("revalidate", "triage"):
        s = sub.add_parser(name)
        s.add_argument("data")
        s.add_argument("answers")
        s.add_argument("--prefix", default="")
        s.add_argument("--force", action="store_true")
    s = sub.add_parser("enrich")
    s.add_argument("data")
    s.add_argument("root")
    s.add_argument("--force", action="store_true")
    s = sub.add_parser("export")
    s.add_argument("data")
    s.add_argument("out")
    s.add_argument("--format", default="json", choices=["json", "sarif"])
    s.add_argument("--min-severity")
    s.add_argument("--run")
    s.add_argument("--slug", default="")
    s.add_argument("--prefix", default="")
    s.add_argument("--verdict")
    s = sub.add_parser("pr-comment")
    s.add_argument("data")
    s.add_argument("run")
    s.add_argument("out")
    s = sub.add_parser("report")
    s.add_argument("data")
    s.add_argument("out")
    s.add_argument("--format", default="markdown", choices=["markdown", "csv", "json", "sarif", "html"])
    s.add_argument("--min-severity")
    s.add_argument("--run")
    s.add_argument("--real-only", action="store_true")
    for name in ("status", "metrics", "doctor"):
        sub.add_parser(name).add_argument("data")
    s = sub.add_parser("spend")
    s.add_argument("data")
    s.add_argument("--by", default="agent", choices=["agent", "phase", "file", "slug"])
    s.add_argument("--since", default="30d")
    s = sub.add_parser("fail-on")
    s.add_argument("data")
    s.add_argument("run")
    s.add_argument("severity")
    sub.add_parser("rules")
    sub.add_parser("lint")
    a = p.parse_args(args)
    if a.command == "rules":
        for r in read_packs():
            print(f"{r.slug:32} {r.noise_tier:8} {r.description}")
        return 0
    if a.command == "lint":
        found = lint([row for path in sorted(PACKS.glob("*.toml")) for row in tomllib.loads(path.read_text()).get("rule", [])])
        for slug, problem in found:
            print(f"{slug}: {problem}")
        return int(bool(found))
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "scan":
        rules = read_packs()
        if a.rules:
            rules = override(rules, read_packs([Path(x) for x in a.rules]))
        rules = select(rules, [x for x in a.only.split(",") if x], [x for x in a.exclude.split(",") if x])
        ignore = Path(a.root, ".gitignore")
        files = tables.walk(spark, a.root, ignore.read_text().splitlines() if ignore.exists() and Path(a.root, ".git").exists() else None)
        wanted = tables.named_paths(spark, a.files, a.files_from, a.diff)
        files = files if wanted is None else tables.restrict(files, wanted)
        target = f"{a.data}/scan"
        known = newest(spark, target)
        checkpoints(spark)
        files = files.checkpoint()  # read once, as gates, hashes and rules each want them
        seen, made = Observation("files"), Observation("candidates")
        out = scan_project(spark, files, rules, known, force=a.force, watch=seen).observe(made, F.coalesce(F.sum(F.size("candidates")), F.lit(0)).alias("candidates"))
        replace(out, target)
        spark.createDataFrame([(seen.get["files"], made.get["candidates"], seen.get["cache_hits"])], "files long, candidates long, cache_hits long").show()
        store(merged(spark, a.data, Path(a.root).resolve().name), a.data)
        return 0
    records = read(spark, a.data)
    found = flat_findings(records)
    if a.command == "status":
        report.project_status(records).show(truncate=False)
    elif a.command == "metrics":
        report.verdict_counts(found).show()
        report.verdict_counts(found, "slug").orderBy(F.desc("total"), "slug").show(30, truncate=False)
    elif a.command == "doctor":
        lifecycle.doctor(records).show(truncate=False)
    elif a.command == "spend":
        h = report.since(flat_history(records), a.since)
        rows = report.spend_by_slug(h, found) if a.by == "slug" else report.spend_by(h, a.by)
        rows.orderBy("rank").select("key", sinks.money(F.col("usd")).alias("usd"), sinks.percent(F.col("pct")).alias("pct")).show(100, truncate=False)
    elif a.command == "process":
        store(process_replies(spark, records, tables.walk(spark, a.root), tables.read_replies(spark, a.replies), lifecycle.new_run_id(), a.batch, prefix=a.prefix, only=[x for x in a.only.split(",") if x], skip=[x for x in a.skip.split(",") if x], limit=a.limit), a.data)
    elif a.command in ("revalidate", "triage"):
        store(looked_at(records, a.answers, a.command, lifecycle.new_run_id(), f"{datetime.datetime.now(datetime.UTC):%Y-%m-%dT%H:%M:%SZ}", a.prefix, a.force), a.data)
    elif a.command == "enrich":
        seen = git.commits(git.logs(records.select(F.col("filePath").alias("path")), str(Path(a.root).resolve())))
        store(lifecycle.enrich(records, seen, f"{datetime.datetime.now(datetime.UTC):%Y-%m-%dT%H:%M:%SZ}", force=a.force).select(records.columns), a.data)
    elif a.command == "export":
        rows = report.select_findings(found, a.min_severity, a.run, [x for x in a.slug.split(",") if x], a.prefix, a.verdict)
        if a.format == "sarif":
            sinks.write_sarif(rows, a.out)
        else:
            sinks.json_rows(rows).write.mode("overwrite").text(a.out)
    elif a.command == "pr-comment":
        sinks.write_private(sinks.comment_body(found.where(F.col("run") == a.run), a.run), a.out)
    elif a.command == "fail-on":
        n = report.fail_on(found, a.run, a.severity)
        print(n)
        return int(n > 0)
    else:
        rows = report.select_findings(found, a.min_severity, a.run, real_only=a.real_only)
        if a.format == "sarif":
            sinks.write_sarif(rows, a.out)
        elif a.format == "html":
            sinks.write_html(rows, a.out)
        elif a.format == "csv":
            report.by_severity(sinks.csv_rows(rows), "file").write.mode("overwrite").option("header", True).csv(a.out)
        elif a.format == "json":
            sinks.json_rows(rows).write.mode("overwrite").text(a.out)
        else:
            sinks.markdown_report(rows).select("section").write.mode("overwrite").text(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
