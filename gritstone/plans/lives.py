"""Queries of runs and records over time, of the processor's scores and guards, and of report formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import gates, investigate, lifecycle, ordered, report, score, stats, tools
from ..schemas import FINDING, candidates_of, findings_of, history_of
from ..sources import sinks
from .common import FILES, FINDINGS, ISSUES, batches_sql, cands, files, findings, issues, query, redact_sql, table
from .scores import MATCH


def _text(c: str):
    return F.col(c).cast("string")


# orders as records of files: the status by the order's, every seventh is held by a run
RECORDS = "records AS (SELECT 'f' || o_orderkey AS path, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'analyzed' ELSE 'error' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'run' || o_custkey % 3 END AS held FROM orders)"


def records(spark: SparkSession, sf: str) -> DataFrame:
    s, held = F.col("o_orderstatus"), F.col("o_orderkey") % 7 == 0
    return table(spark, sf, "orders").select(F.concat(F.lit("f"), _text("o_orderkey")).alias("filePath"), F.when(s == "O", "pending").when(s == "F", "analyzed").otherwise("error").alias("status"), F.when(held, F.concat(F.lit("run"), (F.col("o_custkey") % 3).cast("string"))).alias("lockedByRunId"), F.when(held, "t0").alias("lockedAt"))


@query(f"WITH {RECORDS}, q AS (SELECT DISTINCT 'f' || l_orderkey AS path FROM lineitem WHERE l_quantity > 45) SELECT path, CASE WHEN q.path IS NULL THEN status ELSE 'processing' END AS status, CASE WHEN q.path IS NULL THEN held ELSE 'now' END AS held, CASE WHEN q.path IS NOT NULL THEN 't1' WHEN held IS NOT NULL THEN 't0' END AS at FROM records LEFT JOIN q USING (path)")
def locked_records(spark: SparkSession, sf: str) -> DataFrame:
    queue = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("f"), _text("l_orderkey")).alias("filePath"))
    return lifecycle.lock(records(spark, sf), queue, "now", "t1").select(F.col("filePath").alias("path"), "status", F.col("lockedByRunId").alias("held"), F.col("lockedAt").alias("at"))


@query(f"WITH {RECORDS} SELECT path, CASE WHEN held = 'run1' THEN 'done' ELSE status END AS status, nullif(held, 'run1') AS held, CASE WHEN held <> 'run1' THEN 't0' END AS at FROM records")
def released_records(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.release(records(spark, sf), "run1", F.lit("done")).select(F.col("filePath").alias("path"), "status", F.col("lockedByRunId").alias("held"), F.col("lockedAt").alias("at"))


@query(f"WITH {RECORDS} SELECT path, CASE status WHEN 'analyzed' THEN 'pending' ELSE status END AS status FROM records")
def requeued_records(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.requeue(records(spark, sf)).select(F.col("filePath").alias("path"), "status")


@query("""WITH o AS (SELECT l_suppkey AS k, count(*) FILTER (WHERE l_returnflag = 'A') AS analyses, count(*) FILTER (WHERE l_tax > 0.06) AS bad FROM lineitem WHERE l_suppkey % 2 = 0 AND l_quantity > 49 GROUP BY 1)
SELECT 'r' || s_suppkey AS run, CASE WHEN o.k IS NULL THEN CASE WHEN s_suppkey % 3 = 0 THEN 'done' ELSE 'running' END WHEN bad > 0 AND analyses = 0 THEN 'error' ELSE 'done' END AS phase, CASE WHEN o.k IS NOT NULL THEN 'now' WHEN s_suppkey % 3 = 0 THEN 'before' END AS completed FROM supplier LEFT JOIN o ON s_suppkey = k""")
def closed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that end, beside finished ones that stay as they are and others that go on."""
    name = lambda c: F.concat(F.lit("r"), _text(c)).alias("runId")
    over = F.col("s_suppkey") % 3 == 0
    runs = table(spark, sf, "supplier").select(name("s_suppkey"), F.when(over, "done").otherwise("running").alias("phase"), F.when(over, "before").alias("completedAt"))
    ended = table(spark, sf, "lineitem").where("l_suppkey % 2 = 0 and l_quantity > 49").groupBy(name("l_suppkey")).agg(F.count_if(F.col("l_returnflag") == "A").alias("analyses"), F.count_if(F.col("l_tax") > 0.06).alias("error_batches"))
    return lifecycle.close_run(runs, ended, "now").select(F.col("runId").alias("run"), "phase", F.col("completedAt").alias("completed"))


@query("""WITH c AS (SELECT 'c' || o_custkey AS path, 'n' || o_orderkey % 9 AS name, 'e' || o_orderkey AS email, o_orderdate AS at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, 'e' || o_orderkey) AS n FROM orders),
t AS (SELECT path, string_agg(name || ' ' || email, ',' ORDER BY n) AS people FROM c WHERE n <= 3 GROUP BY 1)
SELECT 'c' || c_custkey AS path, CASE WHEN c_custkey % 4 = 0 THEN 'known x' ELSE people END AS people, CASE WHEN c_custkey % 4 = 0 THEN 'before' WHEN people IS NOT NULL THEN 'now' END AS at FROM customer LEFT JOIN t ON path = 'c' || c_custkey""")
def enriched_records(spark: SparkSession, sf: str) -> DataFrame:
    """The latest committers of each file; files that have theirs are left alone."""
    k = F.col("c_custkey")
    shape = "struct<recentCommitters:array<struct<name:string,email:string,date:string>>,enrichedAt:string,ownership:struct<team:string>>"
    known = F.from_json(F.lit('{"recentCommitters":[{"name":"known","email":"x"}],"enrichedAt":"before"}'), shape)
    rows = table(spark, sf, "customer").select(F.concat(F.lit("c"), _text("c_custkey")).alias("filePath"), F.when(k % 4 == 0, known).alias("gitInfo"))
    commits = table(spark, sf, "orders").select(F.concat(F.lit("c"), _text("o_custkey")).alias("path"), F.concat(F.lit("n"), (F.col("o_orderkey") % 9).cast("string")).alias("name"), F.concat(F.lit("e"), _text("o_orderkey")).alias("email"), F.col("o_orderdate").alias("at"))
    out = lifecycle.enrich(rows, commits, "now", 3)
    people = F.array_join(F.transform("gitInfo.recentCommitters", lambda p: F.concat(p["name"], F.lit(" "), p["email"])), ",")
    return out.select(F.col("filePath").alias("path"), people.alias("people"), F.col("gitInfo.enrichedAt").alias("at"))


@query(f"WITH {FINDINGS} SELECT idx, path FROM findings WHERE severity IN ('CRITICAL', 'LOW') AND slug IN ('rule1', 'rule2', 'rule5')")
def patch_queue(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.patch_queue(findings(spark, sf), severities=["CRITICAL", "LOW"], slugs=["rule1", "rule2", "rule5"]).select("idx", "path")


@query(f"WITH {FINDINGS} SELECT idx FROM findings WHERE verdict IS NULL")
def not_judged(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.not_judged(findings(spark, sf), "verdict").select("idx")


@query("SELECT 's' || l_linenumber AS slug, count(*) AS candidates FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def doctor_slugs(spark: SparkSession, sf: str) -> DataFrame:
    each = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("s"), _text("l_linenumber")).alias("vulnSlug"))).alias("candidates"))
    return lifecycle.doctor(each, 5)


CLASS_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{name}'" for name, words in lifecycle.CLASSES) + " ELSE 'other' END"
WORDS = ["SQL statement", "cross-site scripting", "Server-Side request", "zip slip", "missing permission", "API key in log", "weak cipher", "resource exhaustion", "open redirect", "typo", "DOS of tokens", ""]
TITLES = f"titled AS (SELECT event_id, user_id, lower({WORDS!r}[1 + event_id % 12] || ' ' || {WORDS!r}[1 + user_id % 12]) AS t FROM events)"


def _titled(spark: SparkSession, sf: str) -> DataFrame:
    w = F.array(*[F.lit(x) for x in WORDS])
    cls = lifecycle.finding_class(F.get(w, (F.col("event_id") % 12).cast("int")), F.get(w, (F.col("user_id") % 12).cast("int")))
    return table(spark, sf, "events").select("event_id", "user_id", cls.alias("class"))


@query(f"WITH {TITLES} SELECT event_id, {CLASS_SQL} AS class FROM titled")
def finding_classes(spark: SparkSession, sf: str) -> DataFrame:
    return _titled(spark, sf).select("event_id", "class")


@query(f"WITH {TITLES}, c AS (SELECT *, {CLASS_SQL} AS class FROM titled) SELECT class, count(*) FILTER (WHERE user_id % 5 = 1) AS theirs, count(*) FILTER (WHERE user_id % 5 <> 1) AS ours FROM c GROUP BY 1")
def class_comparison(spark: SparkSession, sf: str) -> DataFrame:
    c = _titled(spark, sf)
    return score.class_counts(c.where("user_id % 5 = 1"), c.where("user_id % 5 <> 1"))


# every extension that some table of languages names, and some that none does
NAMES = sorted({e for t in (paths.LANGUAGES, paths.TAINT_LANGUAGES, paths.TREE_LANGUAGES) for es in t.values() for e in es} | {"txt", "PY", "Go", "", "d.ts", "py.bak"})


def _language_sql(languages: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN x IN ({', '.join(repr(e) for e in es)}) THEN '{name}'" for name, es in languages.items()) + f" ELSE {default} END"


@query(f"""WITH p AS (SELECT DISTINCT 'a.b/c' || doc_id % 13 || '.' || {NAMES!r}[1 + doc_id % {len(NAMES)}] AS path FROM documents),
e AS (SELECT path, lower(regexp_extract(path, '[.]([^./]*)$', 1)) AS x FROM p) SELECT path, regexp_extract(path, '^(.*)/', 1) AS dir, {_language_sql(paths.LANGUAGES, "'other'")} AS language, {_language_sql(paths.TAINT_LANGUAGES, "''")} AS taint, {_language_sql(paths.TREE_LANGUAGES, 'NULL')} AS tree FROM e""")
def path_languages(spark: SparkSession, sf: str) -> DataFrame:
    d, names = F.col("doc_id"), F.array(*[F.lit(x) for x in NAMES])
    p = F.concat(F.lit("a.b/c"), (d % 13).cast("string"), F.lit("."), F.get(names, (d % len(NAMES)).cast("int")))
    rows = table(spark, sf, "documents").select(p.alias("path")).distinct()
    return rows.select("path", paths.directory(F.col("path")).alias("dir"), paths.language(F.col("path")).alias("language"), paths.taint_language(F.col("path")).alias("taint"), paths.tree_language(F.col("path")).alias("tree"))


@query("SELECT count(*) AS runs, sum(o_custkey % 50)::DOUBLE AS totalCostUsd, sum(o_orderkey % 900)::BIGINT AS totalInputTokens, sum(o_orderkey % 70)::BIGINT AS totalOutputTokens, sum(o_custkey)::BIGINT AS totalDurationMs FROM orders")
def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return report.run_totals(table(spark, sf, "orders").select(F.struct((c % 50).cast("double").alias("totalCostUsd"), (k % 900).alias("totalInputTokens"), (k % 70).alias("totalOutputTokens"), c.alias("totalDurationMs")).alias("stats")))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 IN (0, 3) THEN 'held out' ELSE 'train' END AS side FROM orders")
def held_out_split(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("task_id"))
    train, held = gates.split_held_out(o, spark.createDataFrame([(0,), (3,)], "task_id long"))
    return train.withColumn("side", F.lit("train")).unionByName(held.withColumn("side", F.lit("held out"))).select("o_orderkey", "side")


@query("""WITH b AS (SELECT o_orderkey AS k, o_custkey % 9 AS a, o_orderstatus AS s FROM orders), c AS (SELECT o_orderkey + 5 AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey % 9 END AS a, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS s FROM (SELECT o_orderkey - 5 AS o_orderkey, o_custkey, o_orderstatus FROM orders)),
d AS (SELECT coalesce(b.k, c.k) AS k, b.k IS NULL OR c.k IS NULL OR b.a IS DISTINCT FROM c.a AS da, b.k IS NULL OR c.k IS NULL OR b.s IS DISTINCT FROM c.s AS ds FROM b FULL JOIN c ON b.k = c.k)
SELECT 'r' || k AS slug, 'a' AS field FROM d WHERE da AND k <> 7 UNION ALL SELECT 'r' || k, 's' FROM d WHERE ds""")
def rule_changes_out_of_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Changes between two tables of rules, made of orders, but for field `a` of rule r7, which may change."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") - 5
    slug = F.concat(F.lit("r"), _text("o_orderkey")).alias("slug")
    before = o.select(slug, (F.col("o_custkey") % 9).alias("a"), F.col("o_orderstatus").alias("s"))
    after = o.select(slug, F.when(k % 3 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") % 9).alias("a"), F.when(k % 4 != 0, F.col("o_orderstatus")).alias("s"))
    return gates.patch_in_scope(before, after, "r7", ["a"])


@query("""WITH c AS (SELECT DISTINCT 'p' || l_partkey % 300 AS path, 's' || l_linenumber AS slug, CASE WHEN l_linenumber % 2 = 0 THEN 'must_fire' ELSE 'must_not_fire' END AS expectation FROM lineitem), h AS (SELECT 'p' || l_partkey % 300 AS path, 's' || l_linenumber AS slug, count(*) AS hits FROM lineitem WHERE l_quantity > 48 GROUP BY 1, 2)
SELECT path, slug, expectation, coalesce(hits, 0)::BIGINT AS hits, CASE expectation WHEN 'must_fire' THEN hits IS NOT NULL ELSE hits IS NULL END AS ok FROM c LEFT JOIN h USING (path, slug)""")
def regression_results(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    where = [F.concat(F.lit("p"), (F.col("l_partkey") % 300).cast("string")).alias("path"), F.concat(F.lit("s"), _text("l_linenumber")).alias("slug")]
    cases = li.select(*where, F.when(F.col("l_linenumber") % 2 == 0, "must_fire").otherwise("must_not_fire").alias("expectation")).distinct()
    return score.regression_check(cases, li.where("l_quantity > 48").select(*where))


SIDE = "(SELECT DISTINCT l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = '{}' AND l_orderkey % 2 = {})"


@query(f"SELECT *, 'must_not_fire' AS expectation FROM (FROM {SIDE.format('A', 0)} EXCEPT FROM {SIDE.format('A', 1)}) UNION ALL SELECT *, 'must_fire' FROM (FROM {SIDE.format('R', 0)} EXCEPT FROM {SIDE.format('R', 1)})")
def mined_regression_cases(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    side = lambda flag, k: li.where(f"l_returnflag = '{flag}' and l_orderkey % 2 = {k}")
    return score.regression_cases(side("A", 0), side("A", 1), side("R", 0), side("R", 1), ["l_partkey", "l_linenumber"])


# a greedy choice depends on all before it in a file, so the oracle walks a file's findings one by one
GREEDY = f"""{ISSUES}, f AS (SELECT task_id, file, cand_id, slug, line, row_number() OVER (PARTITION BY task_id, file ORDER BY line, cand_id, slug) AS k FROM cands),
a AS (SELECT task_id, file, list({{'id': issue_id, 'slugs': slugs, 'low': start_line - coalesce(tolerance, 3), 'high': end_line + coalesce(tolerance, 3)}} ORDER BY issue_id) AS a FROM issues GROUP BY 1, 2),
r AS (SELECT DISTINCT task_id, file, 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::BIGINT AS cand_id, NULL::VARCHAR AS answer_id FROM f UNION ALL
SELECT task_id, file, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, cand_id, pick FROM (SELECT f.task_id, f.file, f.k, f.cand_id, r.used, list_filter(a.a, lambda x: list_contains(x.slugs, f.slug) AND f.line BETWEEN x.low AND x.high AND NOT list_contains(r.used, x.id))[1].id AS pick
FROM r JOIN f ON f.task_id = r.task_id AND f.file = r.file AND f.k = r.k + 1 LEFT JOIN a ON a.task_id = r.task_id AND a.file = r.file)),
got AS (SELECT task_id, file, cand_id, answer_id FROM r WHERE k > 0)"""


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    slack = F.coalesce("tolerance", F.lit(3))
    return issues(spark, sf).select("task_id", "file", F.col("issue_id").alias("ord"), F.col("issue_id").alias("answer_id"), "severity", "slugs", (F.col("start_line") - slack).cast("int").alias("low"), (F.col("end_line") + slack).cast("int").alias("high"))


@query(f"WITH RECURSIVE {GREEDY} SELECT task_id, file, cand_id::VARCHAR AS finding_id, answer_id FROM got")
def greedy_match(spark: SparkSession, sf: str) -> DataFrame:
    """Findings one to one to answers; each choice depends on the ones before."""
    return score.greedy(cands(spark, sf).withColumnRenamed("cand_id", "finding_id"), _answers(spark, sf))


PROCESSOR = f"""{GREEDY}, p AS (SELECT task_id, count(*) AS produced FROM cands GROUP BY 1), e AS (SELECT task_id, count(*) AS expected FROM issues GROUP BY 1),
s AS (SELECT g.task_id, count(*) AS matches, count(*) FILTER (WHERE i.severity = CASE WHEN g.cand_id % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END) AS same_severity FROM got g JOIN issues i ON i.task_id = g.task_id AND i.issue_id = g.answer_id GROUP BY 1),
b AS (SELECT i.task_id, count(*) AS backed, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM got g WHERE g.task_id = i.task_id AND g.answer_id = i.issue_id)) AS backed_matches FROM issues i WHERE EXISTS (SELECT 1 FROM cands c WHERE c.task_id = i.task_id AND c.file = i.file AND list_contains(i.slugs, c.slug) AND c.line BETWEEN i.start_line - coalesce(tolerance, 3) AND i.end_line + coalesce(tolerance, 3)) GROUP BY 1),
o AS (SELECT 'task' || doc_id % 5 AS task_id, count(*) FILTER (WHERE toxic = 1) AS refusals, count(*) AS batches FROM labels GROUP BY 1),
card AS (SELECT o.task_id, coalesce(produced, 0) AS produced, coalesce(expected, 0) AS expected, coalesce(matches, 0) AS matches, coalesce(same_severity, 0) AS same_severity, coalesce(backed, 0) AS backed, coalesce(backed_matches, 0) AS backed_matches, refusals, batches FROM o LEFT JOIN p USING (task_id) LEFT JOIN e USING (task_id) LEFT JOIN s USING (task_id) LEFT JOIN b USING (task_id))"""


def _card(spark: SparkSession, sf: str) -> DataFrame:
    c, a = cands(spark, sf), _answers(spark, sf)
    f = c.select("task_id", F.col("cand_id").alias("finding_id"), F.when(F.col("cand_id") % 2 == 0, "HIGH").otherwise("MEDIUM").alias("severity"), "file", "slug", "line")
    said = table(spark, sf, "labels").groupBy(F.concat(F.lit("task"), (F.col("doc_id") % 5).cast("string")).alias("task_id")).agg(F.count_if(F.col("toxic") == 1).alias("refusals"), F.count("*").alias("batches"))
    return score.processor_scorecard(f.select("task_id", _text("finding_id").alias("finding_id"), "severity"), score.greedy(f, a), a, c, said)


RATES = {"precision": ("matches", "produced"), "recall": ("matches", "expected"), "recall_given_candidate": ("backed_matches", "backed"), "severity_accuracy": ("same_severity", "matches"), "refusal_rate": ("refusals", "batches")}
RATE_SQL = ", ".join(f"round(coalesce({{0}}{a}{{1}} / nullif({{0}}{b}{{1}}, 0), 0), 6)::DOUBLE AS {k}" for k, (a, b) in RATES.items())


@query(f"WITH RECURSIVE {PROCESSOR} SELECT *, {RATE_SQL.format('', '')} FROM card")
def processor_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return _card(spark, sf).withColumns({k: F.round(k, 6) for k in RATES})


@query(f"WITH RECURSIVE {PROCESSOR} SELECT {RATE_SQL.format('sum(', ')')} FROM card")
def micro_scores(spark: SparkSession, sf: str) -> DataFrame:
    return score.micro(_card(spark, sf), RATES).select(*[F.round(k, 6).alias(k) for k in RATES])


@query("WITH o AS (SELECT o_custkey AS t, count(*) FILTER (WHERE o_orderstatus = 'P') AS refusals, count(*) AS produced FROM orders GROUP BY 1) SELECT t AS task_id, 'more refusals than expected' AS problem FROM o WHERE refusals > t % 2 UNION ALL SELECT t, 'fewer findings than expected' FROM o WHERE produced < 8 + t % 5")
def expectation_guards(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("task_id")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("refusals"), F.count("*").alias("produced"))
    t = F.col("c_custkey")
    return score.guards(scored, table(spark, sf, "customer").select(t.alias("task_id"), (t % 2).alias("expected_refusals"), (8 + t % 5).alias("least_findings")))


@query("SELECT array_to_string(list_sort(list(DISTINCT 'agent' || user_id % 30)), ',') AS agents FROM events WHERE user_id % 4 > 1")
def agent_inventory(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    return score.inventory(table(spark, sf, "events").select(F.when(u % 4 == 0, None).when(u % 4 == 1, " ").otherwise(F.concat(F.lit("agent"), (u % 30).cast("string"))).alias("agent")), "agent").select(F.array_join("agent", ",").alias("agents"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN l_tax < l_discount ELSE l_tax > l_discount END AS better FROM lineitem")
def improved_metrics(spark: SparkSession, sf: str) -> DataFrame:
    lower = stats.direction(F.when(F.col("l_linenumber") == 1, "refusal_rate").otherwise("recall")) == "lower"
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", score.improved(F.col("l_discount"), F.col("l_tax"), lower).alias("better"))


DIFF = """s AS (SELECT event_type AS metric, user_id % 2 AS side, user_id, round(avg(value), 4) AS value FROM events GROUP BY 1, 2, 3), v AS (SELECT metric, side, list(value ORDER BY user_id) AS v FROM s GROUP BY 1, 2),
d AS (SELECT metric, side, v, b, unnest(range(0, len(v))) AS i FROM v, range(0, 1000) r(b)), m AS (SELECT metric, side, b, sum(v[1 + (('0x' || substr(md5(CASE side WHEN 0 THEN '7a|' ELSE '7b|' END || b || '|' || i), 1, 8))::BIGINT % len(v))]) / any_value(len(v)) AS mean FROM d GROUP BY 1, 2, 3),
o AS (SELECT x.metric, list_sort(list(y.mean - x.mean)) AS l FROM m x JOIN m y ON x.metric = y.metric AND x.b = y.b AND x.side = 0 AND y.side = 1 GROUP BY 1)"""


@query(f"WITH {DIFF} SELECT metric, round(l[1 + floor(0.025 * (len(l) - 1) + 0.5)::INT], 5) AS low, round(l[1 + floor(0.975 * (len(l) - 1) + 0.5)::INT], 5) AS high FROM o")
def bootstrap_difference(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric"), "user_id").agg(F.round(F.avg("value"), 4).alias("value"))
    d = stats.bootstrap_diff(s.where("user_id % 2 = 0"), s.where("user_id % 2 = 1"), "metric", "value", "user_id")
    return d.select("metric", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


LONG = """(SELECT *, 't' || idx AS title, [idx % 5, 9] AS lines, 'd' || idx % 3 AS description FROM findings)"""


def _long(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("idx")
    return findings(spark, sf).withColumns({"title": F.concat(F.lit("t"), k.cast("string")), "lines": F.array((k % 5).cast("int"), F.lit(9)), "description": F.concat(F.lit("d"), (k % 3).cast("string"))})


@query(f"WITH {FINDINGS}, l AS (SELECT *, '- **' || title || '** `' || slug || '` — ' || path || ':' || array_to_string(lines, ',') || chr(10) || '  ' || description AS s FROM {LONG}) SELECT severity, max({'CASE severity ' + ' '.join(f'WHEN {chr(39)}{s}{chr(39)} THEN {r}' for s, r in (('CRITICAL', 6), ('HIGH', 5), ('MEDIUM', 3), ('BUG', 2), ('LOW', 1))) + ' END'})::INT AS rank, md5('## ' || severity || chr(10) || chr(10) || string_agg(s, chr(10) ORDER BY path, idx) || chr(10)) AS section FROM l GROUP BY severity")
def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.markdown_report(_long(spark, sf)).withColumn("section", F.md5("section"))


@query(f"WITH {FINDINGS} SELECT '{{\"filePath\":\"' || path || '\",\"finding\":{{\"idx\":' || idx || ',\"slug\":\"' || slug || '\",\"severity\":\"' || severity || '\",\"run\":\"' || run || '\"' || CASE WHEN verdict IS NULL THEN '' ELSE ',\"verdict\":\"' || verdict || '\"' END || ',\"title\":\"' || title || '\",\"lines\":[' || array_to_string(lines, ',') || '],\"description\":\"' || description || '\"}}}}' AS value FROM {LONG}")
def json_findings(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.json_rows(_long(spark, sf).drop("price", "at"))


@query(f"WITH {FINDINGS} SELECT substr(sha256(path || chr(10) || slug || chr(10) || tail), 1, 16) AS finding_id, path, slug, severity, sha256(path || chr(10) || title || chr(10) || slug || chr(10) || run || chr(10) || tail) AS evidence, CASE verdict WHEN 'fixed' THEN 'remediated' WHEN 'false-positive' THEN verdict WHEN 'accepted-risk' THEN verdict ELSE 'open' END AS status FROM (SELECT *, array_to_string(lines, chr(10)) || chr(10) AS tail FROM {LONG})")
def compliance_findings(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.compliance_findings(_long(spark, sf).withColumn("file_hash", F.col("title")))


@query("SELECT o_orderkey, printf('%.4f', o_totalprice) AS cost, printf('%.2f', o_totalprice / 7) AS pct, printf('%.6f', o_totalprice / 1000) AS metric FROM orders")
def spend_formats(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", sinks.money(p).alias("cost"), sinks.percent(p / 7).alias("pct"), sinks.fixed6(p / 1000).alias("metric"))


@query("""SELECT 'project' || o_custkey % 4 AS project, 'f' || o_orderkey AS path, 'finding' AS kind, (k - 1)::INT AS idx, 's' || k AS what FROM orders, range(1, 4) r(k) WHERE k <= o_orderkey % 4 UNION ALL SELECT 'project' || o_custkey % 4, 'f' || o_orderkey, 'candidate', 0, 'c' || o_custkey || ':' || CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE o_orderkey::VARCHAR END FROM orders
UNION ALL SELECT 'project' || o_custkey % 4, 'f' || o_orderkey, 'history', 0, 'run' || o_custkey FROM orders""")
def flattened_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records taken apart: findings with their places, candidates with their first line, analyses."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    made = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.from_json(F.to_json(F.struct(F.concat(F.lit("s"), i.cast("string")).alias("vulnSlug"))), FINDING))
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("project"), (c % 4).cast("string")).alias("projectId"), F.concat(F.lit("f"), k.cast("string")).alias("filePath"), F.slice(made, 1, (k % 4).cast("int")).alias("findings"),
        F.array(F.struct(F.concat(F.lit("c"), c.cast("string")).alias("vulnSlug"), F.when(k % 2 == 0, F.array().cast("array<int>")).otherwise(F.array(k.cast("int"))).alias("lineNumbers"), F.lit("x").alias("snippet"), F.lit("p").alias("matchedPattern"))).alias("candidates"),
        F.array(F.struct(F.concat(F.lit("run"), c.cast("string")).alias("runId"))).alias("analysisHistory"),
    )
    a = findings_of(rows).select("project", "path", F.lit("finding").alias("kind"), "idx", F.col("vulnSlug").alias("what"))
    b = candidates_of(rows).select("project", "path", F.lit("candidate").alias("kind"), "idx", F.concat("slug", F.lit(":"), F.coalesce(_text("line"), F.lit("-"))).alias("what"))
    return a.unionByName(b).unionByName(history_of(rows).select("project", "path", F.lit("history").alias("kind"), F.col("pos").alias("idx"), F.col("runId").alias("what")))


@query("SELECT event_id, event_id % 3 = 0 AS strict FROM events")
def strict_reply_keys(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    made = F.when(n % 3 == 0, F.to_json(F.struct(n.alias("a"), F.lit(1).alias("b")))).otherwise(F.to_json(F.struct(n.alias("a"), F.lit(1).alias("c"))))
    return table(spark, sf, "events").select("event_id", investigate.strict_keys(made, ["a", "b"]).alias("strict"))


NUMBERED = "array_to_string(list_transform(string_split(" + redact_sql("content") + ", chr(10)), lambda x, i: lpad(i::VARCHAR, 5, ' ') || ' ' || x), chr(10))"


@query(f"""WITH {FILES}, n AS (SELECT path, content, row_number() OVER (ORDER BY path) AS k FROM files),
e AS (SELECT o_custkey AS k, string_agg('[' || o_orderkey || '] severity=HIGH slug=rule lines=[' || o_orderkey % 5 || ' 9] title=t' || o_orderkey || chr(10) || '    description: d' || chr(10), '' ORDER BY o_orderkey) AS each FROM orders GROUP BY 1)
SELECT path, md5('File: ' || path || chr(10) || 'Code:' || chr(10) || {NUMBERED} || chr(10) || chr(10) || 'Findings to revalidate:' || chr(10) || each) AS said FROM n JOIN e USING (k)""")
def recheck_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of a second look at documents as files, with a customer's orders as each file's findings."""
    f, k = files(spark, sf), F.col("o_orderkey")
    made = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), k.cast("int").alias("idx"), F.lit("HIGH").alias("severity"), F.lit("rule").alias("slug"), F.array((k % 5).cast("int"), F.lit(9)).alias("lines"), F.concat(F.lit("t"), k.cast("string")).alias("title"), F.lit("d").alias("description"))
    own = made.join(ordered.ranked(f.select("path"), "path", name="k").withColumn("k", F.col("k") + 1), "k").drop("k")
    return investigate.recheck_prompt(f, own).select("path", F.md5("user").alias("said"))


ASCII = "regexp_replace(content, '[^\n -~]', '?', 'g')"
#: read (path, shown): the answers to (path, content, first, last) of `asked`, over texts of single bytes
READ = f"""l AS (SELECT path, first, size, n, unnest(ls) AS x, unnest(range(1, n + 1)) AS i FROM (SELECT *, len(ls) AS n FROM (SELECT path, first, last, length(content) AS size, string_split(regexp_replace(left(content, 16384), chr(10) || '$', ''), chr(10)) AS ls FROM asked))),
m AS (SELECT path, greatest(first, 1) AS a, CASE WHEN last < 1 OR last > n THEN n ELSE last END AS b, size, i, lpad(i::VARCHAR, 6, ' ') || '  ' || {redact_sql('x')} || chr(10) AS x FROM l JOIN (SELECT path, last FROM asked) USING (path)),
h AS (SELECT *, path || ':' || a || '-' || b || chr(10) AS head FROM m WHERE i BETWEEN a AND b),
s AS (SELECT *, length(head) + sum(length(x)) OVER (PARTITION BY path ORDER BY i) AS upto FROM h),
read AS (SELECT path, any_value(head) || string_agg(x, '' ORDER BY i) || CASE WHEN max(upto) >= 16384 THEN 'results truncated - refine your query' || chr(10) ELSE '' END || CASE WHEN any_value(size) > 16384 THEN 'source truncated at tool byte limit' || chr(10) ELSE '' END AS shown FROM s WHERE upto - length(x) < 16384 OR i = a GROUP BY path
UNION ALL SELECT path, path || ': no lines in requested range' || chr(10) FROM m GROUP BY path HAVING any_value(a) > any_value(b))"""


def _ascii(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).withColumn("content", F.regexp_replace(F.replace("content", F.lit("\r\n"), F.lit("\n")), r"[^\n -~]", "?"))


@query(f"WITH {FILES}, asked AS (SELECT path, {ASCII} AS content, length(path) * 7 % 11 AS first, CASE WHEN length(content) % 3 = 0 THEN 0 ELSE length(content) % 50 END AS last FROM files), {READ} SELECT path, md5(shown) AS shown FROM read")
def tool_read_file(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of documents as files, some empty, some to the end, long texts cut."""
    n = F.length(F.replace("content", F.lit("\r\n"), F.lit("\n")))
    wanted = files(spark, sf).select("path", (F.length("path") * 7 % 11).alias("first"), F.when(n % 3 == 0, 0).otherwise(n % 50).alias("last"))
    return tools.read_file(_ascii(spark, sf), wanted).select("path", F.md5("shown").alias("shown"))


@query(f"WITH {FILES}, asked AS (SELECT path, {ASCII} AS content, length(path) % 9 - 3 AS first, length(path) % 9 + 5 AS last FROM files), {READ} SELECT path, shown FROM read")
def tool_read_around(spark: SparkSession, sf: str) -> DataFrame:
    places = files(spark, sf).select("path", (F.length("path") % 9 + 1).alias("line"))
    return tools.read_around(_ascii(spark, sf), places, 4).select("path", "shown")


# the scripted model of a batch: what it does follows from the batch's number
@query(f"""WITH RECURSIVE {batches_sql(5)}, b AS (SELECT batch_id, count(*) AS n FROM batched GROUP BY 1),
e AS (SELECT *, CASE batch_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 8 END AS turns FROM b)
SELECT path, batch_id % 6 > 0 AS refused, CASE batch_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'cost cap reached during agentic investigation' WHEN 2 THEN 'model returned text without report_findings' WHEN 3 THEN 'tool call cap reached during agentic investigation' WHEN 4 THEN 'too large' ELSE 'max tool turns reached' END AS reason,
round(turns * CASE batch_id % 6 WHEN 1 THEN 0.5 ELSE 0.125 END / n, 6)::DOUBLE AS cost, CASE WHEN batch_id % 6 = 0 THEN 1 ELSE 0 END AS findings FROM batched JOIN e USING (batch_id)""")
def tool_loops(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of documents' files through a scripted model that reads, searches and then reports, or fails in each way."""
    f = files(spark, sf)
    batched = investigate.batches(f.select("path"), 5).join(f, "path")

    def ask(batch: int, paths: list[str], rows, turns: list) -> dict:
        read = {"name": "read_file", "args": {"path": paths[0]}}
        end = {0: len(turns) == 2, 2: True, 3: len(turns) == 1, 4: True}.get(batch % 6, False)
        said: dict = {"cost": 0.5 if batch % 6 == 1 else 0.125, "tokens": 10, "calls": [read, {"name": "grep", "args": {"pattern": "a"}}, {"name": "nothing", "args": {}}]}
        if not end:
            return said
        if batch % 6 == 2:
            return said | {"calls": [], "text": "done"}
        if batch % 6 == 3:
            return said | {"calls": [read] * 9}
        if batch % 6 == 4:
            return said | {"report": {"refusal": "too large"}}
        # a report counts what the tools have answered
        told = [x["content"] for t in turns for x in t if not x["error"]]
        found = [{"severity": "LOW", "vulnSlug": "read", "title": f"{len(told)} answers", "description": "d", "lineNumbers": [1], "confidence": "low"}] if len(told) == 4 else []
        return said | {"calls": [{"name": "report_findings", "args": {"results": [{"filePath": p, "findings": found} for p in paths]}}]}

    out = investigate.investigate(batched, tools.tool_loop(ask, most_usd=2.0))
    return out.select("path", "refused", "reason", F.round("cost", 6).alias("cost"), F.size("findings").alias("findings"))


@query("""WITH a AS (SELECT l_orderkey AS position, l_linenumber AS ord, sum(l_quantity) AS weight, 'o' || l_linenumber AS output FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(weight) OVER (PARTITION BY position ORDER BY ord) AS upto, sum(weight) OVER (PARTITION BY position) AS total FROM a)
SELECT position, arg_min(output, ord) AS output FROM c WHERE upto > ('0x' || substr(md5('7|' || position), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * total GROUP BY 1""")
def weighted_replies(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("position"), F.col("l_linenumber").alias("ord")).agg(F.sum("l_quantity").alias("weight"))
    return investigate.weighted_pick(rows.withColumn("output", F.concat(F.lit("o"), _text("ord"))))


@query("SELECT c_custkey AS position, 'recorded reply was not consumed' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)")
def unused_replies(spark: SparkSession, sf: str) -> DataFrame:
    batched = table(spark, sf, "orders").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("batch_id"))
    return score.unused_replies(batched, table(spark, sf, "customer").select(F.col("c_custkey").alias("position")))


@query(f"""WITH {ISSUES}, d AS (SELECT 'task' || doc_id % 5 AS task_id, doc_id, 1 + doc_id % 3 AS line FROM labels), i AS (SELECT *, start_line - coalesce(tolerance, 3) AS low, end_line + coalesce(tolerance, 3) AS high FROM issues WHERE must_emit)
SELECT task_id, count(*) AS decoys, count(*) FILTER (WHERE hit) AS flagged, round(count(*) FILTER (WHERE hit) / count(*), 6)::DOUBLE AS rate FROM (SELECT task_id, EXISTS (SELECT 1 FROM cands c WHERE c.file = d.doc_id AND c.line = d.line AND c.slug IN ('short-line', 'capital-line') AND NOT EXISTS (SELECT 1 FROM i WHERE i.file = c.file AND list_contains(i.slugs, c.slug) AND c.line BETWEEN i.low AND i.high)) AS hit FROM d) GROUP BY 1""")
def decoy_rates(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    decoys = table(spark, sf, "labels").select(F.concat(F.lit("task"), (d % 5).cast("string")).alias("task_id"), F.concat(F.lit("decoy"), d.cast("string")).alias("decoy_id"), d.alias("ord"), d.alias("file"), (1 + d % 3).cast("int").alias("line"), F.array(F.lit("short-line"), F.lit("capital-line")).alias("slugs"))
    return score.decoy_rate(score.classify(cands(spark, sf), issues(spark, sf), decoys), decoys).withColumn("rate", F.round("rate", 6))


@query(f"WITH {MATCH}, w AS (SELECT slug FROM fnn GROUP BY slug ORDER BY count(*) FILTER (WHERE severity IN ('HIGH', 'CRITICAL')) DESC, count(*) DESC, slug LIMIT 1) SELECT task_id, issue_id, severity FROM fnn JOIN w USING (slug)")
def worst_recall_members(spark: SparkSession, sf: str) -> DataFrame:
    return score.worst_members(score.false_negatives(cands(spark, sf), issues(spark, sf))).select("task_id", "issue_id", "severity")


@query(f"""WITH RECURSIVE {GREEDY}, x AS (SELECT slug, count(*) FILTER (WHERE answer_id IS NOT NULL) AS tp, count(*) FILTER (WHERE answer_id IS NULL) AS fp FROM got JOIN (SELECT cand_id, slug FROM cands) USING (cand_id) GROUP BY 1),
y AS (SELECT slugs[1] AS slug, count(*) AS fn FROM issues i WHERE NOT EXISTS (SELECT 1 FROM got g WHERE g.task_id = i.task_id AND g.answer_id = i.issue_id) GROUP BY 1),
z AS (SELECT coalesce(x.slug, y.slug) AS slug, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM x FULL JOIN y ON x.slug = y.slug)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall FROM z""")
def processor_by_slug(spark: SparkSession, sf: str) -> DataFrame:
    f, a = cands(spark, sf).withColumn("finding_id", _text("cand_id")), _answers(spark, sf)
    return score.processor_by_slug(f, score.greedy(f, a), a).withColumns({k: F.round(k, 6) for k in ("precision", "recall")})


@query("SELECT 'r' || lpad(o_orderkey::VARCHAR, 9, '0') AS run FROM orders ORDER BY 1 DESC LIMIT 10")
def newest_runs(spark: SparkSession, sf: str) -> DataFrame:
    return report.newest_runs(table(spark, sf, "orders").select(F.concat(F.lit("r"), F.lpad(_text("o_orderkey"), 9, "0")).alias("runId"))).select(F.col("runId").alias("run"))
