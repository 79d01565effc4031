"""How the tables at hand stand in for the engine's own, in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import TAINT_LANGUAGES
from ..functions.text import REDACTIONS, TAINT, TAINT_ANY
from ..rules.load import PACKS, Rule, read_packs
from ..rules.regex import glob_to_java
from ..sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EXTENSIONS = {"en": "ts", "fr": "py", "de": "go", "es": "rs"}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL of the same result."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_rules() -> list[Rule]:
    return read_packs([PACKS / "corpus.toml"])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: source/doc_id.ext, the extension by the language."""
    ext = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in EXTENSIONS.items()], F.lit("txt"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.col("text").alias("content"))


FILES = (
    "files AS (SELECT source || '/' || doc_id || '.' || CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSIONS.items()) + " ELSE 'txt' END AS path, replace(text, chr(13) || chr(10), chr(10)) AS content FROM documents)"
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def redact_sql(x: str) -> str:
    for pattern, by in REDACTIONS:
        x = f"regexp_replace({x}, {q(pattern)}, {q(by.replace('$1', chr(92) + '1'))}, 'g')"
    return x


def hits_sql(pattern: str, where: str = "true") -> str:
    """(path, content, line) of every match of a pattern in files."""
    return f"""SELECT path, content, (1 + len(p) - len(replace(p, chr(10), '')))::INT AS line FROM (
      SELECT path, content, array_to_string(c[1:k], '') AS p FROM (
        SELECT path, content, c, unnest(range(1, len(c))) AS k FROM (
          SELECT path, content, string_split(regexp_replace(content, {q(pattern)}, chr(1) || '\\0', 'g'), chr(1)) AS c FROM files WHERE {where})))"""


def candidates_sql(rules: list[Rule]) -> str:
    parts = []
    for r in rules:
        globs = [" OR ".join(f"regexp_matches(path, {q(glob_to_java(g))})" for g in r.file_patterns)] if r.file_patterns else []
        where = " AND ".join([*[f"({g})" for g in globs], *[f"regexp_matches(content, {q(p)})" for p in r.require_content], *[f"NOT regexp_matches(path, {q(p)})" for p in r.exclude_path_patterns]]) or "true"
        for p in r.patterns:
            keep = " AND ".join(f"NOT regexp_matches(snippet, {q(s)})" for s in r.suppress_patterns) or "true"
            if r.require_taint_within:
                keep += f" AND EXISTS (SELECT 1 FROM tainted t WHERE t.path = hit.path AND abs(t.n - hit.line) <= {r.require_taint_within})"
            parts.append(
                f"""SELECT DISTINCT path, {q(r.slug)} AS slug, line, {q(r.label or p)} AS label, {redact_sql('snippet')} AS snippet FROM (
  SELECT path, line, array_to_string(string_split(content, chr(10))[greatest(line - {r.snippet_before}, 1):line + {r.snippet_after}], chr(10)) AS snippet
  FROM ({hits_sql(p, where)})) hit WHERE {keep}"""
            )
    return "candidates AS (" + "\nUNION\n".join(parts) + ")"


def tainted_sql() -> str:
    """tainted (path, n): the lines of files that bring input in, by the patterns of the file's language."""
    ext = {e: name for name, exts in TAINT_LANGUAGES.items() for e in exts}
    one = lambda patterns: f"regexp_matches(t, {q('|'.join(f'(?:{p})' for p in patterns))})"
    by = " ".join(f"WHEN {q(e)} THEN {one(TAINT[name])}" for e, name in ext.items())
    return f"""tainted AS (SELECT path, n FROM (SELECT path, lower(regexp_extract(path, '[.]([^./]*)$', 1)) AS x, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM files)
WHERE CASE x {by} ELSE {one(TAINT_ANY)} END)"""


def batches_sql(most: int) -> str:
    """batched (path, batch_id): whole packing of directories into batches, chunk by chunk."""
    return f"""{FILES}, c AS (SELECT path, dir, (row_number() OVER (PARTITION BY dir ORDER BY path) - 1) // {most} AS chunk FROM (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files)),
o AS (SELECT dir, chunk, count(*) AS n, row_number() OVER (ORDER BY dir, chunk) AS i FROM c GROUP BY 1, 2),
f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS id, 0::BIGINT AS held, -1::BIGINT AS mine UNION ALL SELECT o.i, CASE WHEN held + n <= {most} THEN id WHEN held = 0 THEN id + 1 ELSE id + 2 END, CASE WHEN held + n <= {most} THEN held + n ELSE 0 END, CASE WHEN held + n <= {most} OR held = 0 THEN id ELSE id + 1 END FROM f JOIN o ON o.i = f.i + 1),
batched AS (SELECT c.path, f.mine AS batch_id FROM c JOIN o ON c.dir = o.dir AND c.chunk = o.chunk JOIN f ON f.i = o.i)"""


#: events as analyses and findings: users are runs, days stand for files.
HISTORY = "history AS (SELECT event_id, 'user' || user_id AS run, event_type AS agent, strftime(ts, '%Y-%m-%d') AS path, value AS cost, ts FROM events)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("run"), F.col("event_type").alias("agent"), F.date_format("ts", "yyyy-MM-dd").alias("path"), F.col("value").alias("cost"), "ts", F.col("event_id").alias("pos"), F.lit("process").alias("phase")
    )


SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "BUG"]
#: orders as findings: the priority's number is the severity, the clerk's customer the slug.
FINDINGS = """findings AS (SELECT o_orderkey AS idx, 'c' || o_custkey % 40 AS path, 'rule' || o_custkey % 7 AS slug, CASE left(o_orderpriority, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' WHEN '4' THEN 'LOW' ELSE 'BUG' END AS severity,
  strftime(o_orderdate, '%Y%m') AS run, CASE o_orderkey % 6 WHEN 0 THEN 'false-positive' WHEN 1 THEN 'fixed' WHEN 2 THEN 'true-positive' WHEN 3 THEN 'accepted-risk' WHEN 4 THEN 'uncertain' END AS verdict, o_totalprice AS price, o_orderdate AS at FROM orders)"""
RANK = "CASE severity WHEN 'CRITICAL' THEN 6 WHEN 'HIGH' THEN 5 WHEN 'HIGH_BUG' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'BUG' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n = F.substring("o_orderpriority", 1, 1)
    sev = F.when(n == "1", "CRITICAL").when(n == "2", "HIGH").when(n == "3", "MEDIUM").when(n == "4", "LOW").otherwise("BUG")
    k = F.col("o_orderkey") % 6
    verdict = F.when(k == 0, "false-positive").when(k == 1, "fixed").when(k == 2, "true-positive").when(k == 3, "accepted-risk").when(k == 4, "uncertain")
    return o.select(F.col("o_orderkey").alias("idx"), F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")).alias("path"), F.concat(F.lit("rule"), (F.col("o_custkey") % 7).cast("string")).alias("slug"), sev.alias("severity"), F.date_format("o_orderdate", "yyyyMM").alias("run"), verdict.alias("verdict"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("at"))


#: labels as an answer key over candidates of documents: one issue for each toxic document, on its first lines.
ISSUES = """issues AS (SELECT 'task' || doc_id % 5 AS task_id, 'issue' || doc_id AS issue_id, doc_id AS file, CASE doc_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity, 1 AS start_line, 2 + doc_id % 4 AS end_line,
  CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 1 END AS tolerance, CASE WHEN doc_id % 3 = 0 THEN ['long-line', 'short-line'] ELSE ['capital-line'] END AS slugs, doc_id % 7 <> 0 AS must_emit FROM labels WHERE quality = 0 OR toxic = 1),
cands AS (SELECT 'task' || doc_id % 5 AS task_id, doc_id * 100000 + p * 10 + k AS cand_id, doc_id AS file, slug, p::INT AS line FROM (
  SELECT doc_id, p, unnest([CASE WHEN len(l) > 120 THEN 'long-line' END, CASE WHEN len(l) < 30 THEN 'short-line' END, CASE WHEN regexp_matches(l, '[A-Z]{3}') THEN 'capital-line' END]) AS slug, unnest([0, 1, 2]) AS k FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents)) WHERE slug IS NOT NULL)"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").where("quality = 0 or toxic = 1").select(
        F.concat(F.lit("task"), (d % 5).cast("string")).alias("task_id"), F.concat(F.lit("issue"), d.cast("string")).alias("issue_id"), d.alias("file"), F.when(d % 3 == 0, "HIGH").when(d % 3 == 1, "CRITICAL").otherwise("MEDIUM").alias("severity"), F.lit(1).alias("start_line"), (2 + d % 4).alias("end_line"),
        F.when(d % 2 == 0, None).otherwise(F.lit(1)).cast("int").alias("tolerance"), F.when(d % 3 == 0, F.array(F.lit("long-line"), F.lit("short-line"))).otherwise(F.array(F.lit("capital-line"))).alias("slugs"), (d % 7 != 0).alias("must_emit"),
    )


def cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "l"))
    kinds = F.array(F.when(F.length("l") > 120, "long-line"), F.when(F.length("l") < 30, "short-line"), F.when(F.col("l").rlike("[A-Z]{3}"), "capital-line"))
    rows = rows.select("doc_id", (F.col("i") + 1).alias("p"), F.posexplode(kinds).alias("k", "slug")).where("slug is not null")
    return rows.select(F.concat(F.lit("task"), (F.col("doc_id") % 5).cast("string")).alias("task_id"), (F.col("doc_id") * 100000 + F.col("p") * 10 + F.col("k")).alias("cand_id"), F.col("doc_id").alias("file"), "slug", F.col("p").cast("int").alias("line"))
