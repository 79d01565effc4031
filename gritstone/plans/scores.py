"""Queries of the scorer: joins with labels, precision and recall, statistics, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, score, stats
from ..operators.ordered import checkpoints
from .common import ISSUES, cands, issues, query, table

MATCH = f"""{ISSUES}, i AS (SELECT *, start_line - coalesce(tolerance, 3) AS low, end_line + coalesce(tolerance, 3) AS high FROM issues),
m AS (SELECT DISTINCT c.task_id, i.issue_id, c.cand_id, i.must_emit FROM cands c JOIN i ON c.task_id = i.task_id AND c.file = i.file AND list_contains(i.slugs, c.slug) AND c.line BETWEEN i.low AND i.high),
cl AS (SELECT c.*, EXISTS (SELECT 1 FROM m WHERE m.cand_id = c.cand_id AND m.task_id = c.task_id AND m.must_emit) AS tp FROM cands c),
fn AS (SELECT i.* FROM i WHERE must_emit AND NOT EXISTS (SELECT 1 FROM m WHERE m.task_id = i.task_id AND m.issue_id = i.issue_id)),
near AS (SELECT fn.task_id, fn.issue_id, arg_min(c.slug, (greatest(fn.low - c.line, c.line - fn.high, 0), c.line, c.cand_id)) AS near_slug, arg_min(c.line, (greatest(fn.low - c.line, c.line - fn.high, 0), c.line, c.cand_id)) AS near_line FROM fn JOIN cands c ON c.task_id = fn.task_id AND c.file = fn.file GROUP BY 1, 2),
fnn AS (SELECT fn.task_id, fn.issue_id, fn.severity, fn.slugs[1] AS slug, near_slug, near_line::BIGINT AS near_line, CASE WHEN near_slug IS NULL THEN 'no candidate with acceptable slug near issue' WHEN list_contains(fn.slugs, near_slug) THEN 'closest acceptable-slug candidate is outside tolerance' ELSE 'closest candidate has a non-acceptable slug' END AS reason FROM fn LEFT JOIN near USING (task_id, issue_id))"""


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classified candidates, missed issues, issues; the matches are found once and written."""
    c, i = cands(spark, sf), issues(spark, sf)
    checkpoints(spark)
    met = score.matches(c, i).checkpoint()
    return score.classify(c, i, matched=met), score.false_negatives(c, i, met), i


@query(f"WITH {MATCH} SELECT task_id, issue_id, cand_id FROM m")
def interval_join_labels(spark: SparkSession, sf: str) -> DataFrame:
    return score.matches(cands(spark, sf), issues(spark, sf)).select("task_id", "issue_id", "cand_id")


@query(f"WITH {MATCH} SELECT task_id, issue_id, severity, slug, near_slug, near_line, reason FROM fnn")
def nearest_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return score.false_negatives(cands(spark, sf), issues(spark, sf)).drop("file")


@query(
    f"""WITH {ISSUES}, d AS (SELECT 'task' || doc_id % 5 AS task_id, 'decoy' || doc_id AS decoy_id, doc_id AS file, 1 + doc_id % 3 AS line FROM labels)
SELECT c.cand_id, min(d.decoy_id) AS decoy_id FROM cands c JOIN d ON c.task_id = d.task_id AND c.file = d.file AND c.line = d.line AND c.slug IN ('short-line', 'capital-line') GROUP BY c.cand_id"""
)
def decoy_hits(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    decoys = table(spark, sf, "labels").select(F.concat(F.lit("task"), (d % 5).cast("string")).alias("task_id"), F.concat(F.lit("decoy"), d.cast("string")).alias("decoy_id"), d.alias("ord"), d.alias("file"), (1 + d % 3).cast("int").alias("line"), F.array(F.lit("short-line"), F.lit("capital-line")).alias("slugs"))
    return score.classify(cands(spark, sf), issues(spark, sf), decoys).where("decoy_id is not null").select("cand_id", "decoy_id")


CARD = """SELECT task_id, coalesce(c.n, 0)::BIGINT AS candidates, coalesce(tp, 0)::BIGINT AS tp, coalesce(d.n, 0)::BIGINT AS detectable, coalesce(f.n, 0)::BIGINT AS fn,
round(coalesce(tp / nullif(c.n, 0), 0), 6)::DOUBLE AS precision, round(coalesce((coalesce(d.n, 0) - coalesce(f.n, 0)) / nullif(d.n, 0), 0), 6)::DOUBLE AS recall
FROM (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE tp) AS tp FROM cl GROUP BY 1) c FULL JOIN (SELECT task_id, count(*) AS n FROM issues WHERE must_emit GROUP BY 1) d USING (task_id) FULL JOIN (SELECT task_id, count(*) AS n FROM fnn GROUP BY 1) f USING (task_id)"""


@query(f"WITH {MATCH} {CARD}")
def scanner_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return score.scorecard(*_parts(spark, sf)).withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query(f"WITH {MATCH} SELECT severity, count(*) AS detectable, round(1 - count(f.issue_id) / count(*), 6)::DOUBLE AS recall FROM issues i LEFT JOIN (SELECT DISTINCT issue_id FROM fnn) f ON i.issue_id = f.issue_id WHERE must_emit GROUP BY severity")
def recall_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    c, m, i = _parts(spark, sf)
    return score.scorecard(c.withColumn("severity", F.lit(None).cast("string")), m, i, ("severity",)).where("severity is not null and severity <> '' and detectable > 0").select("severity", "detectable", F.round("recall", 6).alias("recall"))


@query(f"WITH {MATCH} SELECT coalesce(a.task_id, b.task_id) AS task_id, coalesce(a.slug, b.slug) AS slug, coalesce(tp, 0)::BIGINT AS tp, coalesce(fp, 0)::BIGINT AS fp, coalesce(fn, 0)::BIGINT AS fn FROM (SELECT task_id, slug, count(*) FILTER (WHERE tp) AS tp, count(*) FILTER (WHERE NOT tp) AS fp FROM cl GROUP BY 1, 2) a FULL JOIN (SELECT task_id, slug, count(*) AS fn FROM fnn GROUP BY 1, 2) b ON a.task_id = b.task_id AND a.slug = b.slug")
def slug_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    c, m, _ = _parts(spark, sf)
    return score.by_slug(c, m)


@query(f"WITH {MATCH} SELECT slug, count(*) FILTER (WHERE tp) AS tp, count(*) FILTER (WHERE NOT tp) AS fp, round(count(*) FILTER (WHERE tp) / count(*), 6)::DOUBLE AS precision FROM cl GROUP BY slug HAVING count(*) FILTER (WHERE NOT tp) > 1 ORDER BY precision, fp DESC, slug LIMIT 1")
def worst_precision_slug(spark: SparkSession, sf: str) -> DataFrame:
    c, m, _ = _parts(spark, sf)
    return score.worst_precision(score.by_slug(c, m)).withColumn("precision", F.round("precision", 6))


@query(f"WITH {MATCH} SELECT slug, count(*) FILTER (WHERE severity IN ('HIGH', 'CRITICAL')) AS high, count(*) AS fn FROM fnn GROUP BY slug ORDER BY high DESC, fn DESC, slug LIMIT 1")
def worst_recall_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return score.worst_recall(_parts(spark, sf)[1])


@query(f"WITH {MATCH} SELECT task_id, issue_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY severity, issue_id) AS n FROM fnn) WHERE n <= 5")
def context_caps(spark: SparkSession, sf: str) -> DataFrame:
    return score.first_k(_parts(spark, sf)[1], ["task_id"], ["severity", "issue_id"], 5).select("task_id", "issue_id")


SIDES = """SELECT l_returnflag || l_linenumber AS slug, count(*) AS candidates, count(*) FILTER (WHERE l_tax < 0.05) AS tp, count(*) FILTER (WHERE l_tax >= 0.05) AS fp, count(*) FILTER (WHERE l_discount = 0.1) AS fn, count(*) FILTER (WHERE l_discount = 0.1 AND l_tax > 0.06) AS high_fn FROM lineitem WHERE {} GROUP BY 1"""
BEFORE_AFTER = f"b AS ({SIDES.format('l_orderkey % 2 = 0 AND l_linenumber < 7')}), a AS ({SIDES.format('l_orderkey % 2 = 1 AND l_linenumber > 1')})"


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    def side(where: str) -> DataFrame:
        li = table(spark, sf, "lineitem").where(where)
        return li.groupBy(F.concat(F.col("l_returnflag"), F.col("l_linenumber").cast("string")).alias("slug")).agg(F.count("*").alias("candidates"), F.count_if(F.col("l_tax") < 0.05).alias("tp"), F.count_if(F.col("l_tax") >= 0.05).alias("fp"), F.count_if(F.col("l_discount") == 0.1).alias("fn"), F.count_if((F.col("l_discount") == 0.1) & (F.col("l_tax") > 0.06)).alias("high_fn"))

    return side("l_orderkey % 2 = 0 and l_linenumber < 7"), side("l_orderkey % 2 = 1 and l_linenumber > 1")


@query(f"WITH {BEFORE_AFTER} SELECT coalesce(a.slug, b.slug) AS slug, coalesce(b.candidates, 0)::BIGINT AS candidates_b, coalesce(a.candidates, 0)::BIGINT AS candidates_a, (coalesce(a.tp, 0) - coalesce(b.tp, 0))::BIGINT AS tp_delta, (coalesce(a.fn, 0) - coalesce(b.fn, 0))::BIGINT AS fn_delta FROM a FULL JOIN b ON a.slug = b.slug")
def slug_full_outer_delta(spark: SparkSession, sf: str) -> DataFrame:
    d = gates.deltas(*_sides(spark, sf))
    return d.select("slug", "candidates_b", "candidates_a", (F.col("tp_a") - F.col("tp_b")).alias("tp_delta"), (F.col("fn_a") - F.col("fn_b")).alias("fn_delta"))


GATE = f"""WITH {BEFORE_AFTER}, d AS (SELECT coalesce(a.slug, b.slug) AS slug, a.slug IS NOT NULL AS ia, b.slug IS NOT NULL AS ib, coalesce(b.candidates, 0) AS cb, coalesce(a.candidates, 0) AS ca, coalesce(b.tp / nullif(b.tp + b.fp, 0), CASE WHEN b.slug IS NULL THEN 0 ELSE 1 END) AS pb, coalesce(a.tp / nullif(a.tp + a.fp, 0), CASE WHEN a.slug IS NULL THEN 0 ELSE 1 END) AS pa,
coalesce(b.tp / nullif(b.tp + b.fn, 0), CASE WHEN b.slug IS NULL THEN 0 ELSE 1 END) AS rb, coalesce(a.tp / nullif(a.tp + a.fn, 0), CASE WHEN a.slug IS NULL THEN 0 ELSE 1 END) AS ra, coalesce(b.high_fn, 0) AS hb, coalesce(a.high_fn, 0) AS ha FROM a FULL JOIN b ON a.slug = b.slug)
SELECT 'silenced' AS reason, slug FROM d WHERE slug = 'R1' AND cb > 0 AND ca = 0 UNION ALL SELECT 'target precision dropped', slug FROM d WHERE slug = 'R1' AND pa + 1e-9 < pb UNION ALL SELECT 'target recall dropped', slug FROM d WHERE slug = 'R1' AND ra + 1e-9 < rb
UNION ALL SELECT 'other precision dropped', slug FROM d WHERE slug <> 'R1' AND ib AND pb - pa > 0.05 + 1e-9 UNION ALL SELECT 'other recall dropped', slug FROM d WHERE slug <> 'R1' AND ha > hb
UNION ALL SELECT 'candidate budget', '' FROM (SELECT sum(ca) AS a, sum(cb) AS b FROM d) WHERE a > floor(b * 1.2 + 0.999999)"""


@query(GATE)
def precision_gate(spark: SparkSession, sf: str) -> DataFrame:
    return gates.precision_gate(*_sides(spark, sf), "R1")


@query(f"WITH {BEFORE_AFTER}, t AS (SELECT (SELECT sum(fn) FROM b WHERE slug IN ('A2', 'N2')) AS b, (SELECT sum(fn) FROM a WHERE slug IN ('A2', 'N2')) AS a) SELECT count(*) AS objections FROM t WHERE a >= b")
def recall_gate_target(spark: SparkSession, sf: str) -> DataFrame:
    found = gates.recall_gate(*_sides(spark, sf), ["A2", "N2"], "R7")
    return found.where("reason = 'target misses did not fall'").agg(F.count("*").alias("objections"))


@query("WITH b AS (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0), a AS (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 1) SELECT *, 'resolved' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'new' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def fp_fn_set_delta(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return score.set_delta(li.where("l_orderkey % 2 = 0"), li.where("l_orderkey % 2 = 1"), ["l_partkey", "l_linenumber"])


@query("SELECT event_type AS metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, round(median(value), 6) AS median FROM events GROUP BY 1")
def repeat_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = stats.repeat_stats(table(spark, sf, "events").withColumnRenamed("event_type", "metric"), ["metric"])
    return rows.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "stddev", "median")])


BOOT = """s AS (SELECT event_type AS metric, user_id, round(avg(value), 4) AS value FROM events GROUP BY 1, 2), v AS (SELECT metric, list(value ORDER BY user_id) AS v FROM s GROUP BY metric),
d AS (SELECT metric, v, b, unnest(range(0, len(v))) AS i FROM v, range(0, 1000) r(b)), m AS (SELECT metric, b, sum(v[1 + (('0x' || substr(md5('7|' || b || '|' || i), 1, 8))::BIGINT % len(v))]) / any_value(len(v)) AS mean FROM d GROUP BY 1, 2), o AS (SELECT metric, list_sort(list(mean)) AS l FROM m GROUP BY 1)"""


@query(f"WITH {BOOT} SELECT metric, round(l[1 + floor(0.025 * (len(l) - 1) + 0.5)::INT], 5) AS low, round(l[1 + floor(0.975 * (len(l) - 1) + 0.5)::INT], 5) AS high FROM o")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric"), "user_id").agg(F.round(F.avg("value"), 4).alias("value"))
    return stats.bootstrap_ci(s, "metric", "value", "user_id").select("metric", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query(f"WITH {BOOT}, c AS (SELECT metric, l[1 + floor(0.025 * (len(l) - 1) + 0.5)::INT] - 100 AS low, l[1 + floor(0.975 * (len(l) - 1) + 0.5)::INT] - 100 AS high FROM o) SELECT metric, CASE WHEN low > 5 THEN 'improved' WHEN high < -5 THEN 'regressed' ELSE 'inconclusive' END AS verdict FROM c")
def compare_verdict(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric"), "user_id").agg(F.round(F.avg("value"), 4).alias("value"))
    ci = stats.bootstrap_ci(s, "metric", "value", "user_id")
    return ci.select("metric", stats.verdict(F.col("low") - 100, F.col("high") - 100, 5.0, stats.direction(F.col("metric"))).alias("verdict"))


@query("WITH a AS (SELECT user_id % 100 AS path, list(DISTINCT event_type) AS c FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id % 120 + 20 AS path, list(DISTINCT event_type) AS c FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT count(*) FILTER (WHERE a.c IS NOT NULL AND b.c IS NOT NULL) AS shared, count(*) FILTER (WHERE b.c IS NULL) AS only_theirs, count(*) FILTER (WHERE a.c IS NULL) AS only_ours, count(*) FILTER (WHERE list_has_any(a.c, b.c)) AS aligned FROM a FULL JOIN b ON a.path = b.path")
def external_comparison(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    a = e.where("event_id % 2 = 0").select((F.col("user_id") % 100).alias("path"), F.col("event_type").alias("class"))
    b = e.where("event_id % 2 = 1").select((F.col("user_id") % 120 + 20).alias("path"), F.col("event_type").alias("class"))
    return score.external_comparison(a, b)
