"""Queries of the investigation: queues, verdicts, consensus, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import investigate
from ..schemas import FINDING
from .common import batches_sql, files, query, table


@query(
    """WITH s AS (SELECT o_orderkey AS id, 'p' || o_custkey % 50 || '/f' || o_orderkey AS path, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'analyzed' ELSE 'error' END AS status, list(DISTINCT 's' || l_linenumber) AS slugs FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT path, status FROM s WHERE list_aggregate(slugs, 'count') > 0 AND status IN ('pending', 'error') AND list_has_any(slugs, ['s3', 's5']) AND len(list_filter(slugs, lambda x: x NOT IN ('s1', 's3'))) > 0 AND starts_with(path, 'p1') ORDER BY path LIMIT 200"""
)
def work_queue(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    c = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_set(F.concat(F.lit("s"), F.col("l_linenumber").cast("string")))), lambda s: F.struct(s.alias("vulnSlug"))).alias("candidates"))
    s = F.col("o_orderstatus")
    rows = o.join(c, "o_orderkey", "left").select(F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string"), F.lit("/f"), F.col("o_orderkey").cast("string")).alias("filePath"), F.when(s == "O", "pending").when(s == "F", "analyzed").otherwise("error").alias("status"), "candidates")
    return investigate.work_queue(rows, "p1", only=["s3", "s5"], skip=["s1", "s3"], limit=200).select(F.col("filePath").alias("path"), "status")


@query("SELECT user_id, list_has_any(list(event_type), ['purchase', 'error']) AS any_of, len(list_filter(list(value), lambda x: x <= 0)) = 0 AS all_of FROM events GROUP BY user_id")
def exists_forall(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("t"), F.collect_list("value").alias("v"))
    return rows.select("user_id", F.exists("t", lambda x: x.isin("purchase", "error")).alias("any_of"), F.forall("v", lambda x: x > 0).alias("all_of"))


@query(
    """WITH f AS (SELECT event_id, user_id % 20 AS path, event_type AS slug, CASE WHEN event_id % 2 = 0 THEN 'Title ' || day(ts) % 5 ELSE 'title  ' || day(ts) % 5 END AS title, 'agent' || event_id % 3 AS agent FROM events)
SELECT path, slug, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS key, array_to_string(list_sort(list_distinct(list(agent))), ',') AS agents, len(list_distinct(list(agent)))::BIGINT AS n_agents, min(event_id) AS first_id FROM f GROUP BY 1, 2, 3"""
)
def ensemble_consensus(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    day = (F.dayofmonth("ts") % 5).cast("string")
    rows = e.select((F.col("user_id") % 20).alias("path"), F.col("event_id").alias("finding_id"), F.col("event_type").alias("slug"), F.array(F.lit(1)).alias("lines"), F.concat(F.when(F.col("event_id") % 2 == 0, "Title ").otherwise("title  "), day).alias("title"), F.concat(F.lit("agent"), (F.col("event_id") % 3).cast("string")).alias("agent"))
    return investigate.consensus(rows).select("path", "slug", investigate.folded_title(F.col("title")).alias("key"), F.array_join("agents", ",").alias("agents"), "n_agents", "first_id")


VERDICTS = "v AS (SELECT l_orderkey AS path, l_linenumber AS idx, CASE l_linenumber % 5 WHEN 0 THEN 'true-positive' WHEN 1 THEN 'false-positive' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'fixed' END AS verdict, CASE WHEN l_partkey % 2 = 0 THEN 'CRITICAL' ELSE '?' END AS adjusted FROM lineitem WHERE l_suppkey % 3 <> 0)"


def _verdicts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf, "lineitem")
    base = li.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("idx"), F.lit("MEDIUM").alias("severity"), F.lit("text").alias("description"), F.when(F.col("l_tax") < 0.02, "fixed").alias("verdict"))
    k = F.col("l_linenumber") % 5
    v = li.where("l_suppkey % 3 <> 0").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("idx"), F.when(k == 0, "true-positive").when(k == 1, "false-positive").when(k == 2, "uncertain").when(k == 3, "fixed").alias("verdict"), F.when(F.col("l_partkey") % 2 == 0, "CRITICAL").otherwise("?").alias("adjusted"), F.lit("why").alias("reasoning"))
    return base, v.dropDuplicates(["path", "idx"])


# an order's lines can repeat a number in the tables at hand, so the oracle keeps one verdict of each place where they agree
@query(
    f"""WITH {VERDICTS}, one AS (SELECT path, idx, any_value(verdict) AS verdict, CASE WHEN count(DISTINCT adjusted) = 1 THEN any_value(adjusted) END AS adjusted, count(DISTINCT adjusted) AS n FROM v GROUP BY 1, 2)
SELECT count(*) AS findings, count(*) FILTER (WHERE one.verdict = 'uncertain') AS lowered FROM lineitem LEFT JOIN one ON l_orderkey = path AND l_linenumber = idx WHERE coalesce(one.verdict NOT IN ('false-positive', 'fixed'), true)"""
)
def skeptic_survival(spark: SparkSession, sf: str) -> DataFrame:
    base, v = _verdicts(spark, sf)
    return investigate.skeptic(base, v).agg(F.count("*").alias("findings"), F.count_if((F.col("severity") == "LOW") & F.col("description").contains("[skeptic: uncertain] why")).alias("lowered"))


@query(
    f"""WITH {VERDICTS}, one AS (SELECT path, idx, any_value(verdict) AS verdict FROM v GROUP BY 1, 2)
SELECT coalesce(CASE WHEN l_tax < 0.02 THEN 'fixed' END, one.verdict, 'none') AS verdict, count(*) AS findings FROM lineitem LEFT JOIN one ON l_orderkey = path AND l_linenumber = idx GROUP BY 1"""
)
def verdict_by_index(spark: SparkSession, sf: str) -> DataFrame:
    base, v = _verdicts(spark, sf)
    return investigate.apply_verdicts(base, v).groupBy(F.coalesce("verdict", F.lit("none")).alias("verdict")).agg(F.count("*").alias("findings"))


@query(
    """SELECT CASE WHEN user_id >= 140 THEN 'file is not in the batch' WHEN event_type = 'click' THEN 'unknown severity' WHEN event_id % 7 = 0 THEN 'unknown confidence' WHEN event_id % 11 = 0 THEN 'blank field' WHEN event_id % 13 = 0 THEN 'no lines' WHEN event_id % 100 + 1 > 40 THEN 'line outside the file' END AS problem, count(*) AS n FROM events GROUP BY 1"""
)
def envelope_validation(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    n = F.col("event_id")
    raw = F.to_json(F.struct(F.when(F.col("event_type") == "click", "?").otherwise("HIGH").alias("severity"), F.when(n % 7 == 0, "sure").otherwise("high").alias("confidence"), F.when(n % 11 == 0, "  ").otherwise("t").alias("title"), F.lit("s").alias("vulnSlug"), F.lit("d").alias("description"), F.when(n % 13 == 0, F.array().cast("array<int>")).otherwise(F.array((n % 100 + 1).cast("int"))).alias("lineNumbers")))
    rows = e.select(F.lit(0).alias("batch_id"), F.col("user_id").alias("path"), F.from_json(raw, FINDING).alias("finding"))
    files = e.where("user_id < 140").select(F.lit(0).alias("batch_id"), F.col("user_id").alias("path"), F.lit(40).alias("loc")).distinct()
    return investigate.validated(rows, files).groupBy("problem").agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT user_id AS path, event_type AS slug, 'day ' || day(ts) % 4 AS title, event_id % 2 AS late FROM events) SELECT path, count(DISTINCT (slug, title)) AS findings FROM f GROUP BY path")
def append_findings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    f = F.from_json(F.to_json(F.struct(F.col("event_type").alias("vulnSlug"), F.concat(F.lit("day "), (F.dayofmonth("ts") % 4).cast("string")).alias("title"))), FINDING)
    side = lambda k: e.where(f"event_id % 2 = {k}").groupBy(F.col("user_id").alias("path")).agg(F.collect_list(f).alias("findings"))
    return investigate.append_findings(side(0), side(1)).select("path", F.size("findings").cast("long").alias("findings"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'pending' WHEN event_id % 5 = 0 OR event_type = 'error' THEN 'error' ELSE 'analyzed' END AS status FROM events")
def status_machine(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf, "events").select("event_id", investigate.next_status(F.col("event_type") == "error", n % 5 == 0, n % 9 == 0).alias("status"))


@query(
    f"""WITH RECURSIVE {batches_sql(5)}, sized AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS n FROM batched)
SELECT batch_id, path, contains(content, '!!')::INT AS findings, round(0.5 / n, 6)::DOUBLE AS cost, 100 // n AS tokens FROM sized JOIN files USING (path)"""
)
def replay_investigation(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of documents' files through a backend that finds the first line of each file with a capital word."""
    batched = investigate.batches(files(spark, sf).select("path"), 5).join(files(spark, sf), "path")

    def backend(batch: int, paths: list[str], rows) -> dict:
        out = []
        for path, content in zip(rows["path"], rows["content"]):
            lines = [i + 1 for i, x in enumerate(content.split("\n")) if "!!" in x][:1]
            out.append({"filePath": path, "findings": [{"severity": "LOW", "vulnSlug": "shout", "title": "Shouting", "description": "shouts", "lineNumbers": lines, "confidence": "high"}] if lines else []})
        return {"results": out, "cost": 0.5, "tokens": 100, "duration_ms": 10}

    return investigate.investigate(batched, backend).select("batch_id", "path", F.size("findings").alias("findings"), F.round("cost", 6).alias("cost"), "tokens")


@query(f"WITH RECURSIVE {batches_sql(5)} SELECT batch_id, string_agg(path, ',' ORDER BY path) AS paths, 'reply ' || batch_id AS output FROM batched GROUP BY 1")
def replayed_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded replies, whose paths may stand in any order, meet the batches of their places."""
    batched = investigate.batches(files(spark, sf).select("path"), 5).select("batch_id", "path")
    told = batched.groupBy(F.col("batch_id").alias("position")).agg(F.sort_array(F.collect_list("path"), asc=False).alias("batch_paths"))
    told = told.withColumn("output", F.concat(F.lit("reply "), F.col("position").cast("string")))
    return investigate.replay(batched, told).select("batch_id", F.array_join("paths", ",").alias("paths"), "output")
