"""Sinks: report formats as columns and rows, and writers for the few that are files of their own."""

from __future__ import annotations

import hashlib
import hmac
import html
import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import redact
from ..operators.report import compliance_id, evidence_hash, sarif_level
from ..schemas import SEVERITY, severity_rank


def markdown_report(findings: DataFrame) -> DataFrame:
    """(rank, severity, section): one section for each severity, the gravest first."""
    line = F.concat(F.lit("- **"), "title", F.lit("** `"), "slug", F.lit("` — "), "path", F.lit(":"), F.array_join(F.col("lines").cast("array<string>"), ","), F.coalesce(F.concat(F.lit("\n  "), "description"), F.lit("")))
    rows = findings.select(severity_rank(F.col("severity")).alias("rank"), "severity", F.struct("path", "idx", line.alias("l")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n")
    return rows.groupBy("rank", "severity").agg(F.concat(F.lit("## "), F.first("severity"), F.lit("\n\n"), body, F.lit("\n")).alias("section")).orderBy(F.desc("rank"))


def csv_rows(findings: DataFrame) -> DataFrame:
    """file, severity, slug, lines (joined by ;), title, confidence, verdict."""
    return findings.select(F.col("path").alias("file"), "severity", "slug", F.array_join(F.col("lines").cast("array<string>"), ";").alias("lines"), "title", F.coalesce("confidence", F.lit("")).alias("confidence"), F.coalesce("verdict", F.lit("")).alias("verdict"))


def json_rows(findings: DataFrame) -> DataFrame:
    """One JSON document a finding: {filePath, finding}."""
    rest = [c for c in findings.columns if c != "path"]
    return findings.select(F.to_json(F.struct(F.col("path").alias("filePath"), F.struct(*rest).alias("finding"))).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(path, idx, result): a SARIF 2.1.0 result for each finding; a finding without lines stands on line 1."""
    line = F.coalesce(F.get("lines", F.lit(0)), F.lit(1))
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation")))
    return findings.select("path", "idx", F.to_json(F.struct(F.col("slug").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("title").alias("text")).alias("message"), place.alias("locations"))).alias("result"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(slug, title): a rule for each slug with its first title."""
    return findings.groupBy("slug").agg(F.min_by("title", F.struct("path", "idx")).alias("title"))


def write_sarif(findings: DataFrame, target: str, tool: str = "gritstone") -> None:
    """A SARIF document; results are streamed one by one, in order."""
    rules = [{"id": r.slug, "shortDescription": {"text": r.title}} for r in sarif_rules(findings).orderBy("slug").toLocalIterator()]
    with Path(target).open("w", encoding="utf-8") as out:
        out.write('{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":%s,"rules":%s}},"results":[' % (json.dumps(tool), json.dumps(rules)))
        for i, r in enumerate(sarif_results(findings).orderBy("path", "idx").toLocalIterator()):
            out.write(("," if i else "") + r.result)
        out.write("]}]}\n")


def comment_summary(findings: DataFrame) -> DataFrame:
    """(line): the histogram of severities in their order, as one line of a comment."""
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    part = F.concat("severity", F.lit(": "), F.col("n").cast("string"))
    rows = counts.select(F.struct((-severity_rank(F.col("severity"))).alias("r"), part.alias("p")).alias("x"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), ", ").alias("line"))


# fixed values: the badge of each severity, LOW for others
BADGES = {"CRITICAL": "CRIT", "HIGH": "HIGH", "HIGH_BUG": "HIGH", "MEDIUM": "MED ", "BUG": "BUG "}


def comment_parts(findings: DataFrame) -> DataFrame:
    """(path, idx, part): a part of a review comment for each finding (…, recommendation)."""
    s = F.col("severity")
    badge = F.lit("LOW ")
    for name, b in BADGES.items():
        badge = F.when(s == name, b).otherwise(badge)
    shown = F.concat(F.lit("["), F.array_join(F.col("lines").cast("array<string>"), " "), F.lit("]"))
    verdict = F.when(F.col("verdict").isNotNull(), F.concat(F.lit("- revalidation: `"), F.col("verdict"), F.lit("`\n"))).otherwise(F.lit(""))
    part = F.concat(
        F.lit("### `"), badge, F.lit("` — "), s, F.lit(" **"), F.col("title"), F.lit("**\n- file: `"), F.col("path"), F.lit("` (lines "), shown, F.lit(")\n- slug: `"), F.col("slug"), F.lit("`\n- confidence: `"), F.coalesce("confidence", F.lit("")), F.lit("`\n"),
        verdict, F.lit("\n"), F.coalesce("description", F.lit("")), F.lit("\n\n**Fix:** "), F.coalesce("recommendation", F.lit("")), F.lit("\n\n"),
    )
    return findings.select("path", "idx", part.alias("part"))


def comment_body(findings: DataFrame, run: str) -> str:
    """The comment of a run's new findings: a head, the numbers by severity, a part for each finding in order."""
    by = {r.severity: r.n for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    n = sum(by.values())
    if not n:
        return f"## gritstone — no net-new findings for run `{run}` :white_check_mark:\n"
    head = f"## gritstone — {n} net-new finding{'s' * (n != 1)} for run `{run}`\n" + " · ".join(f"{by[s]} × {s}" for s in sorted(SEVERITY, key=lambda s: -SEVERITY[s]) if s in by) + "\n\n"
    rows = comment_parts(findings).join(findings.select("path", "idx", severity_rank(F.col("severity")).alias("r")), ["path", "idx"]).orderBy(F.desc("r"), "path", "idx")
    return head + "".join(r.part for r in rows.toLocalIterator())


def write_private(text: str, target: str) -> None:
    """A file that its owner alone can read, in a folder that its owner alone can enter; links are not followed."""
    path = Path(target)
    path.parent.mkdir(mode=0o700, parents=True, exist_ok=True)
    if path.is_symlink() or path.parent.is_symlink():
        raise ValueError(f"{target} is a link")
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC | os.O_NOFOLLOW, 0o600), "w", encoding="utf-8") as out:
        os.fchmod(out.fileno(), 0o600)
        out.write(text)


def score_reports(classified: DataFrame, missed: DataFrame, per_task: DataFrame, slugs: DataFrame) -> dict[str, DataFrame]:
    """The six tables of a score, by name: tasks, slugs, severities, false alarms, misses and decoys hit."""
    order = ["task_id", "file", "line", "slug"]
    return {
        "tasks": per_task.orderBy("task_id"),
        "slugs": slugs.orderBy("task_id", "slug"),
        "severities": missed.groupBy("severity").agg(F.count("*").alias("missed")).orderBy(severity_rank(F.col("severity")).desc()),
        "false_alarms": classified.where(~F.col("tp")).select(*order).orderBy(*order),
        "misses": missed.select("task_id", "issue_id", "file", "severity", "slug", "near_slug", "near_line", "reason").orderBy("task_id", "file", "issue_id"),
        "decoys": classified.where(F.col("decoy_id").isNotNull()).select(*order, "decoy_id").orderBy(*order) if "decoy_id" in classified.columns else classified.limit(0).select(*order),
    }


def write_score_reports(reports: dict[str, DataFrame], folder: str) -> None:
    for name, rows in reports.items():
        write_tsv(rows, f"{folder}/{name}")


def recorded(replies: DataFrame) -> DataFrame:
    """(value): recorded replies (batch_paths, output, ok), one JSON line each and without secrets; failed ones are left
    out, as a replay takes every line for a reply."""
    rows = replies.where("ok").select(F.col("batch_paths").alias("batchPaths"), redact(F.col("output")).alias("output"))
    # the output is JSON already
    return rows.select(F.concat(F.lit('{"batchPaths":'), F.to_json("batchPaths"), F.lit(',"output":'), F.col("output"), F.lit("}")).alias("value"))


def money(c: Column) -> Column:
    return F.format_string("%.4f", c)


def percent(c: Column) -> Column:
    return F.format_string("%.2f", c)


def fixed6(c: Column) -> Column:
    return F.format_string("%.6f", c)


def write_tsv(rows: DataFrame, folder: str) -> None:
    """A score report: tabs between columns, doubles with six places."""
    rows.select(*[fixed6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]).write.mode("overwrite").option("sep", "\t").option("header", True).csv(folder)


def compliance_findings(findings: DataFrame) -> DataFrame:
    """Findings with their ids, evidence hashes and status, in order of id."""
    status = F.when(F.col("verdict") == "fixed", "remediated").when(F.col("verdict") == "false-positive", "false-positive").when(F.col("verdict") == "accepted-risk", "accepted-risk").otherwise("open")
    return findings.select(compliance_id(F.col("path"), F.col("slug"), F.col("lines")).alias("finding_id"), "path", "slug", "severity", evidence_hash(F.col("path"), F.col("file_hash"), F.col("slug"), F.col("run"), F.col("lines")).alias("evidence"), status.alias("status")).orderBy("finding_id")


def canonical(document: dict) -> bytes:
    return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def sign(document: dict, key: bytes) -> dict:
    """The document with an HMAC-SHA256 over its canonical form and a hint of the key."""
    return document | {"signature": {"algorithm": "HMAC-SHA256", "value": hmac.new(key, canonical(document), hashlib.sha256).hexdigest(), "key_hint": hashlib.sha256(key).hexdigest()[:16]}}


def verify(document: dict, key: bytes) -> bool:
    body = {k: v for k, v in document.items() if k != "signature"}
    return hmac.compare_digest(document.get("signature", {}).get("value", ""), hmac.new(key, canonical(body), hashlib.sha256).hexdigest())


def write_html(findings: DataFrame, folder: str) -> None:
    """A static site: an index by severity and a page for each finding, streamed finding by finding."""
    out = Path(folder)
    (out / "findings").mkdir(parents=True, exist_ok=True)
    rank = {s: -r for s, r in SEVERITY.items()}
    page = '<!doctype html><html lang="en"><meta charset="utf-8"><title>{t}</title><body>{b}</body></html>\n'
    with (out / "index.html").open("w", encoding="utf-8") as index:
        index.write('<!doctype html><html lang="en"><meta charset="utf-8"><title>Findings</title><body><input id="q" placeholder="filter"><table>\n')
        for i, r in enumerate(findings.orderBy(severity_rank(F.col("severity")).desc(), "path", "idx").toLocalIterator()):
            name = f"{i:06d}.html"
            cells = "".join(f"<td>{html.escape(str(x))}</td>" for x in (r.severity, r.slug, r.path, r.title))
            index.write(f'<tr data-rank="{-rank.get(r.severity, 0)}">{cells}<td><a href="findings/{name}">open</a></td></tr>\n')
            (out / "findings" / name).write_text(page.format(t=html.escape(r.title), b=f"<h1>{html.escape(r.title)}</h1><p>{html.escape(r.path)}</p><pre>{html.escape(r.description or '')}</pre>"), encoding="utf-8")
        index.write("</table><script>q.oninput=()=>{for(const r of document.querySelectorAll('tr'))r.hidden=!r.textContent.includes(q.value)}</script></body></html>\n")


def append_records(rows: DataFrame, table: str) -> None:
    """Append to a log table: decisions, recorded replies, provenance of patches."""
    rows.write.mode("append").parquet(table)


def replace_projects(records: DataFrame, table: str) -> None:
    """Write records by project; only the projects that are written are replaced."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("projectId").parquet(table)


def export_records(records: DataFrame, folder: str) -> None:
    records.write.mode("overwrite").json(folder)
