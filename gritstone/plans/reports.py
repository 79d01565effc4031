"""Queries of the reports: findings, verdicts, spend, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report
from ..schemas import severity_rank
from ..sources import sinks
from .common import FINDINGS, HISTORY, RANK, findings, history, query, table

CONF = "verdict IN ('true-positive', 'accepted-risk')"


@query("SELECT o_orderstatus AS status, count(*) AS files FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.status_counts(table(spark, sf, "orders"), "o_orderstatus")


@query(
    """SELECT count(*) AS files, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, 0::BIGINT AS processing, count(*) FILTER (WHERE o_orderstatus = 'F') AS analyzed, count(*) FILTER (WHERE o_orderstatus = 'P') AS error,
sum(o_orderkey % 4)::BIGINT AS candidates, sum(o_custkey % 3)::BIGINT AS findings FROM orders"""
)
def project_status(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    status = F.when(s == "O", "pending").when(s == "F", "analyzed").when(s == "P", "error")
    rows = table(spark, sf, "orders").select(status.alias("status"), F.array_repeat(F.lit(1), (F.col("o_orderkey") % 4).cast("int")).alias("candidates"), F.array_repeat(F.lit(1), (F.col("o_custkey") % 3).cast("int")).alias("findings"))
    return report.project_status(rows)


@query(f"WITH {FINDINGS} SELECT idx, severity, {RANK}::INT AS rank FROM findings WHERE {RANK} >= 3 ORDER BY {RANK} DESC, findings.at, idx LIMIT 50")
def severity_rank_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.select_findings(findings(spark, sf), min_severity="MEDIUM")
    return report.by_severity(rows, "at", "idx").limit(50).select("idx", "severity", severity_rank(F.col("severity")).alias("rank"))


@query(f"WITH {FINDINGS} SELECT idx, path, slug, verdict FROM findings WHERE {RANK} >= 2 AND slug IN ('rule1', 'rule4') AND starts_with(path, 'c1') AND coalesce(verdict NOT IN ('false-positive', 'fixed'), true)")
def export_filters(spark: SparkSession, sf: str) -> DataFrame:
    return report.select_findings(findings(spark, sf), "BUG", slugs=["rule1", "rule4"], prefix="c1", real_only=True).select("idx", "path", "slug", "verdict")


@query(f"WITH {FINDINGS} SELECT count(*) AS failing FROM findings WHERE run = (SELECT max(run) FROM findings) AND {RANK} >= 5 AND coalesce(verdict NOT IN ('false-positive', 'fixed'), true)")
def fail_on_gate(spark: SparkSession, sf: str) -> DataFrame:
    f = findings(spark, sf)
    last = f.agg(F.max("run").alias("run"))
    rows = f.join(F.broadcast(last), "run", "left_semi").where(report.at_least(F.col("severity"), "HIGH") & report.real(F.col("verdict")))
    return rows.agg(F.count("*").alias("failing"))


@query("SELECT l_returnflag || '-' || l_linestatus AS slug, count(*) AS total, count(*) FILTER (WHERE l_linenumber IN (1, 2)) AS tp, count(*) FILTER (WHERE l_linenumber = 3) AS fp, count(*) FILTER (WHERE l_linenumber = 4) AS fixed, count(*) FILTER (WHERE l_linenumber = 5) AS uncertain FROM lineitem GROUP BY 1")
def metrics_by_slug(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    verdict = F.when(n == 1, "true-positive").when(n == 2, "accepted-risk").when(n == 3, "false-positive").when(n == 4, "fixed").when(n == 5, "uncertain")
    rows = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("slug"), verdict.alias("verdict"))
    return report.verdict_counts(rows, "slug")


@query(f"WITH {FINDINGS} SELECT count(*) AS total, count(*) FILTER (WHERE {CONF}) AS tp, count(*) FILTER (WHERE verdict = 'false-positive') AS fp, count(*) FILTER (WHERE verdict = 'fixed') AS fixed, count(*) FILTER (WHERE verdict = 'uncertain') AS uncertain FROM findings")
def verdict_totals(spark: SparkSession, sf: str) -> DataFrame:
    return report.verdict_counts(findings(spark, sf))


@query(f"WITH {FINDINGS} SELECT severity, count(*) AS findings, max({RANK})::INT AS rank FROM findings GROUP BY severity")
def severity_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return report.severity_histogram(findings(spark, sf))


@query(f"WITH {FINDINGS} SELECT slug, count(*) AS total FROM findings GROUP BY slug ORDER BY total DESC, slug LIMIT 5")
def top_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return report.top_slugs(findings(spark, sf), 5)


def _spend(key: str, source: str = "history") -> str:
    return f"""SELECT key, round(usd, 4) AS usd, round(usd / sum(usd) OVER () * 100, 6) AS pct, (row_number() OVER (ORDER BY usd DESC, key) - 1)::BIGINT AS rank FROM (SELECT {key} AS key, sum(cost) AS usd FROM {source} GROUP BY 1)"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"usd": F.round("usd", 4), "pct": F.round("pct", 6)})


@query(f"WITH {HISTORY} " + _spend("agent"))
def spend_by_agent(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(report.spend_by(history(spark, sf), "agent"))


@query(f"WITH {HISTORY} " + _spend("CASE WHEN event_id % 4 = 0 THEN '(unknown)' ELSE 'phase' || event_id % 4 END"))
def spend_by_phase(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id") % 4
    return _rounded(report.spend_by(history(spark, sf).withColumn("phase", F.when(n == 0, F.lit(" ")).otherwise(F.concat(F.lit("phase"), n.cast("string")))), "phase"))


@query(f"WITH {HISTORY} " + _spend("path"))
def spend_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(report.spend_by(history(spark, sf), "file"))


@query(f"WITH {HISTORY} SELECT round(sum(cost), 4) AS usd, count(*) AS entries, count(DISTINCT run) AS runs FROM history")
def spend_totals(spark: SparkSession, sf: str) -> DataFrame:
    return report.spend_totals(history(spark, sf)).withColumn("usd", F.round("usd", 4))


@query(
    f"""WITH {HISTORY}, s AS (SELECT path, run, list(DISTINCT agent) AS slugs FROM history WHERE event_id % 3 = 0 GROUP BY path, run),
parts AS (SELECT unnest(coalesce(slugs, ['(no findings)'])) AS slug, cost / len(coalesce(slugs, ['(no findings)'])) AS cost FROM history h LEFT JOIN s ON h.path = s.path AND h.run = s.run) """
    + _spend("slug", "parts")
)
def spend_by_slug_split(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf)
    return _rounded(report.spend_by_slug(h, h.where("event_id % 3 = 0").withColumn("slug", F.col("agent"))))


@query(f"WITH {HISTORY} SELECT agent, count(*) AS entries FROM history WHERE ts >= TIMESTAMP '2024-01-15' AND event_id % 10 <> 0 GROUP BY agent")
def spend_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf).withColumn("investigatedAt", F.when(F.col("event_id") % 10 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")))
    return report.since(h, "2024-01-15").groupBy("agent").agg(F.count("*").alias("entries"))


PRICES = [("R", 3.0, 15.0, 0.3, 3.75), ("N", 0.25, 1.25, 0.03, 0.3)]


@query(
    """SELECT l_returnflag AS model, count(*) AS entries, round(sum(coalesce(l_quantity / 1e6 * i + l_linenumber / 1e6 * o + l_partkey / 1e6 * r + l_suppkey / 1e6 * w, 0)), 6) AS cost
FROM lineitem LEFT JOIN (VALUES ('R', 3.0::DOUBLE, 15.0::DOUBLE, 0.3::DOUBLE, 3.75::DOUBLE), ('N', 0.25, 1.25, 0.03, 0.3)) p(m, i, o, r, w) ON l_returnflag = m GROUP BY 1"""
)
def cost_model(spark: SparkSession, sf: str) -> DataFrame:
    prices = spark.createDataFrame(PRICES, "model string, input_per_mtok double, output_per_mtok double, cache_read_per_mtok double, cache_write_per_mtok double")
    usage = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("input"), F.col("l_linenumber").alias("output"), F.col("l_partkey").alias("cache_read"), F.col("l_suppkey").alias("cache_write"))
    return report.cost_model(usage, prices).groupBy("model").agg(F.count("*").alias("entries"), F.round(F.sum("cost"), 6).alias("cost"))


@query(
    """WITH b AS (SELECT l_orderkey AS batch_id, count(*) AS n, sum(l_extendedprice) AS c, sum(l_partkey) AS t FROM lineitem GROUP BY 1)
SELECT l_linenumber::VARCHAR AS path, round(sum(c / n), 2) AS cost, sum(t // n)::BIGINT AS tokens FROM lineitem JOIN b ON l_orderkey = batch_id GROUP BY 1"""
)
def cost_attribution(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.collect_list(F.col("l_linenumber").cast("string")).alias("paths"), F.sum("l_extendedprice").alias("cost"), F.sum("l_partkey").alias("tokens"), F.sum("l_suppkey").alias("duration_ms"))
    return report.attribute_cost(b).groupBy("path").agg(F.round(F.sum("cost"), 2).alias("cost"), F.sum("tokens").alias("tokens"))


@query(
    f"""WITH {HISTORY}, r AS (SELECT path, run, arg_max(agent, event_id) AS a FROM history WHERE event_id % 2 = 0 GROUP BY path, run), f AS (SELECT path, arg_max(agent, event_id) AS a FROM history WHERE event_id % 2 = 0 GROUP BY path)
SELECT h.event_id, coalesce(r.a, f.a) AS agent FROM history h LEFT JOIN r ON h.path = r.path AND h.run = r.run LEFT JOIN f ON h.path = f.path WHERE event_id % 5 = 1"""
)
def last_entry_per_run(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf)
    return report.last_entry(h.where("event_id % 5 = 1").select("event_id", "path", "run"), h.where("event_id % 2 = 0")).select("event_id", "agent")


@query(f"WITH {HISTORY} SELECT event_id, run FROM history WHERE run = (SELECT max(run) FROM history WHERE agent = 'purchase')")
def latest_run_findings(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf)
    last = report.latest_run(h.withColumnsRenamed({"run": "runId", "agent": "type"}), "purchase")
    return h.join(F.broadcast(last), "run", "left_semi").select("event_id", "run")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 3")
def top_n_committers(spark: SparkSession, sf: str) -> DataFrame:
    commits = table(spark, sf, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("email"), F.col("o_orderdate").alias("at"))
    return report.top_committers(commits, 3).select(F.col("path").alias("o_custkey"), F.col("email").alias("o_orderkey"), "rank")


@query(f"WITH {HISTORY} SELECT event_id FROM (SELECT event_id, coalesce(sum(cost) OVER (PARTITION BY run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM history) WHERE spent < 900")
def budget_running_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return report.running_budget(history(spark, sf), 900, ["ts", "event_id"], keys=["run"]).select("event_id")


@query(f"WITH {FINDINGS} SELECT idx, CASE WHEN severity IN ('CRITICAL', 'HIGH', 'HIGH_BUG') THEN 'error' WHEN severity IN ('MEDIUM', 'BUG') THEN 'warning' ELSE 'note' END AS level, 1 + idx % 90 AS start_line FROM findings")
def sarif_levels(spark: SparkSession, sf: str) -> DataFrame:
    rows = findings(spark, sf).withColumns({"title": F.col("slug"), "lines": F.array((1 + F.col("idx") % 90).cast("int"))})
    r = F.from_json("result", "struct<level:string,locations:array<struct<physicalLocation:struct<region:struct<startLine:bigint>>>>>")
    return sinks.sarif_results(rows).select("idx", r["level"].alias("level"), r["locations"][0]["physicalLocation"]["region"]["startLine"].alias("start_line"))


@query(f"WITH {FINDINGS} SELECT path AS file, severity, slug, (idx % 5) || ';' || (idx % 7 + 5) AS lines, coalesce(verdict, '') AS verdict FROM findings")
def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = findings(spark, sf).withColumns({"title": F.col("slug"), "confidence": F.lit(None).cast("string"), "lines": F.array(F.col("idx") % 5, F.col("idx") % 7 + 5)})
    return sinks.csv_rows(rows).select("file", "severity", "slug", "lines", "verdict")


@query(f"WITH {FINDINGS}, n AS (SELECT severity, count(*) AS n, {RANK} AS r FROM findings GROUP BY severity) SELECT string_agg(severity || ': ' || n, ', ' ORDER BY r DESC) AS line FROM n")
def comment_summary(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.comment_summary(findings(spark, sf))


@query("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-01-01')::BIGINT AS days_over FROM orders WHERE o_orderdate::DATE < DATE '1998-01-01'")
def stale_tasks(spark: SparkSession, sf: str) -> DataFrame:
    tasks = table(spark, sf, "orders").withColumn("review_due", F.to_date("o_orderdate"))
    return report.stale(tasks, F.to_date(F.lit("1998-01-01"))).select("o_orderkey", "days_over")


@query(f"WITH {FINDINGS} SELECT * FROM (SELECT path, 'finding-' || slug AS item, count(*) AS n FROM findings GROUP BY 1, 2 UNION ALL SELECT path, 'all', count(*) FROM findings GROUP BY 1)")
def grouped_totals(spark: SparkSession, sf: str) -> DataFrame:
    """By path and slug, and by path, in one pass."""
    rows = findings(spark, sf).withColumn("item", F.concat(F.lit("finding-"), "slug"))
    return rows.groupingSets([["path", "item"], ["path"]], "path", "item").agg(F.count("*").alias("n"), F.grouping("item").alias("g")).select("path", F.when(F.col("g") == 1, "all").otherwise(F.col("item")).alias("item"), "n")
