"""Answer keys, task settings and price lists: small files that a driver reads and checks, as tables."""

from __future__ import annotations

import tomllib
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
ISSUE = "task_id string, issue_id string, ord int, file string, severity string, cwe string, slugs array<string>, start_line int, end_line int, tolerance int, must_emit boolean, reason string"
DECOY = "task_id string, decoy_id string, ord int, file string, line int, slugs array<string>"
TASK = "task_id string, matcher_only array<string>, matcher_exclude array<string>, repo_url string, repo_commit string, source string, reviewer string, review_due date, change_rule string"
PRICE = "provider string, model string, input_per_mtok double, output_per_mtok double, cache_read_per_mtok double, cache_write_per_mtok double"


def _need(ok: bool, where: str, what: str) -> None:
    if not ok:
        raise ValueError(f"{where}: {what}")


def _path(p: str, where: str) -> str:
    parts = p.split("/")
    _need(bool(p) and not p.startswith("/") and "\\" not in p and "\0" not in p and not any(x in ("", ".", "..") for x in parts), where, f"unsafe path {p!r}")
    return p


def issues_of(task: str, doc: dict) -> list[tuple]:
    """Rows of ISSUE of one answer key; ids are unique, lines in order, slugs and severities known to be there."""
    out, seen = [], set()
    for i, x in enumerate(doc.get("issues") or doc.get("findings") or []):
        where = f"{task}: {x.get('id')}"
        _need(bool(x.get("id")) and x["id"] not in seen, where, "missing or repeated id")
        seen.add(x["id"])
        loc = x.get("location") or {}
        start, end = loc.get("startLine", 0), loc.get("endLine", loc.get("startLine", 0))
        _need(1 <= start <= end, where, "lines out of order")
        _need((loc.get("tolerance") or 0) >= 0, where, "negative tolerance")
        _need(bool(x.get("vulnSlugs")) and all(s.strip() for s in x["vulnSlugs"]), where, "no slugs")
        _need(x.get("severity") in SEVERITIES, where, f"unknown severity {x.get('severity')}")
        scanner = x.get("scanner") or {}
        must = scanner.get("mustEmitCandidate", x.get("mustReportFinding", True))
        out.append((task, x["id"], i, _path(x.get("file", ""), where), x["severity"], x.get("cwe"), list(x["vulnSlugs"]), start, end, loc.get("tolerance"), bool(must), scanner.get("reason")))
    return out


def decoys_of(task: str, doc: dict) -> list[tuple]:
    return [(task, d["id"], i, _path(d["file"], d["id"]), d["line"], list(d["forbiddenSlugs"])) for i, d in enumerate(doc.get("decoys") or [])]


def read_keys(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(issues, decoys) of all folders below `root` that hold an answer.yaml, in order of their names."""
    issues, decoys = [], []
    for p in sorted(Path(root).glob("*/answer.yaml")):
        doc = yaml.safe_load(p.read_text(encoding="utf-8")) or {}
        issues += issues_of(p.parent.name, doc)
        decoys += decoys_of(p.parent.name, doc)
    return spark.createDataFrame(issues, ISSUE), spark.createDataFrame(decoys, DECOY)


def read_tasks(spark: SparkSession, root: str) -> DataFrame:
    rows = []
    for p in sorted(Path(root).glob("*/task.toml")):
        t = tomllib.loads(p.read_text(encoding="utf-8"))
        repo, prov, m = t.get("repo", {}), t.get("provenance", {}), t.get("matchers", t)
        rows.append((p.parent.name, m.get("matcher_only", m.get("only", [])), m.get("matcher_exclude", m.get("exclude", [])), repo.get("url"), repo.get("commit"), prov.get("source"), prov.get("reviewer"), prov.get("review_due"), t.get("change_rule")))
    return spark.createDataFrame(rows, TASK)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """The price list of a TOML file of [[provider]] tables with [[provider.model]] rows, in dollars a million tokens."""
    rows = []
    for p in tomllib.loads(Path(path).read_text(encoding="utf-8")).get("provider", []):
        for m in p.get("model", []):
            rows.append((p["name"], m["name"], *(float(m.get(k, 0.0)) for k in ("input", "output", "cache_read", "cache_write"))))
    return spark.createDataFrame(rows, PRICE)


def projects(spark: SparkSession, table: str) -> DataFrame:
    """The projects of a records table, sorted; partition discovery answers without reading data."""
    return spark.read.parquet(table).select("projectId").distinct().orderBy("projectId")
