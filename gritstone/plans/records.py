"""Queries over whole records: verdicts, priorities, merged agents and redaction inside their arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records
from ..schemas import FINDING, HISTORY, RECORD
from .common import query, redact_sql, table

#: orders as records, their lines as findings in order; every fourth has been judged and triaged before.
LINES = """f AS (SELECT l_orderkey AS path, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS idx, 's' || l_partkey % 2 AS slug, CASE l_suppkey % 2 WHEN 0 THEN 'Open  DOOR ' ELSE 'open door' END AS title, [l_linenumber % 2, 5] AS lines, 'run' || l_linenumber % 4 AS run, l_linenumber % 4 = 0 AS old FROM lineitem)"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    n, text = F.col("l_linenumber").cast("int"), lambda c: c.cast("string")
    # null fields are left out of the JSON, so the structs' other fields are null
    later = F.when(n % 4 == 0, F.struct(F.lit("old").alias("verdict"), F.lit("old").alias("priority"), F.lit("as before").alias("reasoning")))
    finding = F.struct(
        F.lit("LOW").alias("severity"), F.concat(F.lit("s"), text(F.col("l_partkey") % 2)).alias("vulnSlug"), F.when(F.col("l_suppkey") % 2 == 0, "Open  DOOR ").otherwise("open door").alias("title"), F.array(F.lit(5), n % 2).alias("lineNumbers"),
        F.concat(F.lit("run"), text(n % 4)).alias("producedByRunId"), later.alias("revalidation"), later.alias("triage"),
    )
    got = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.to_json(finding).alias("f")))).alias("f"))
    got = got.select(text(F.col("l_orderkey")).alias("filePath"), F.transform("f", lambda x: F.from_json(x["f"], FINDING)).alias("findings"))
    return spark.createDataFrame([], RECORD).unionByName(got, allowMissingColumns=True)


#: answers by place: some name places that do not exist, some the same place; line and supplier tell which came last.
ANSWERS = """a AS (SELECT l_orderkey AS path, (l_linenumber * l_partkey % 6 - 1)::INT AS idx, max_by({'word': CASE l_linenumber % 5 WHEN 0 THEN 'true-positive' WHEN 1 THEN 'false-positive' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'accepted-risk' ELSE 'fixed' END, 'part': l_suppkey, 'up': CASE WHEN l_suppkey % 3 = 0 THEN 'HIGH' END}, l_linenumber * 1000000 + l_suppkey) AS a FROM lineitem WHERE l_suppkey % 3 <> 1 GROUP BY 1, 2)"""


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber") % 5
    word = F.when(n == 0, "true-positive").when(n == 1, "false-positive").when(n == 2, "uncertain").when(n == 3, "accepted-risk").otherwise("fixed")
    why = F.concat(F.lit("it logs password = "), F.col("l_suppkey").cast("string"), F.lit(" there"))
    return table(spark, sf, "lineitem").where("l_suppkey % 3 <> 1").select(
        F.col("l_orderkey").cast("string").alias("filePath"), (F.col("l_linenumber") * F.col("l_partkey") % 6 - 1).cast("int").alias("index"), (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("ord"), word.alias("verdict"), why.alias("reasoning"),
        F.when(F.col("l_suppkey") % 3 == 0, "HIGH").alias("adjustedSeverity"), F.concat(F.lit("P"), n.cast("string")).alias("priority"), word.alias("exploitability"), F.lit(None).cast("string").alias("impact"),
    )


def _shown(rows: DataFrame, *fields) -> DataFrame:
    """(path, n, findings): each record's findings as one text."""
    each = lambda f: F.concat_ws("/", *[F.coalesce(x(f).cast("string"), F.lit("-")) for x in fields])
    return rows.select(F.col("filePath").cast("long").alias("path"), F.size("findings").alias("n"), F.array_join(F.transform("findings", each), "|").alias("findings"))


@query(f"""WITH {LINES}, {ANSWERS} SELECT path, count(*)::INT AS n, string_agg(CASE WHEN old THEN 'old/as before/-/-/-' WHEN a IS NULL THEN '-/-/-/-/-' ELSE a.word || '/it logs password = [REDACTED] there/' || coalesce(a.up, '-') || '/r7/t7' END, '|' ORDER BY idx) AS findings FROM f LEFT JOIN a USING (path, idx) GROUP BY path""")
def revalidated_records(spark: SparkSession, sf: str) -> DataFrame:
    out = records.revalidated(_records(spark, sf), _answers(spark, sf), "r7", "t7")
    v = lambda name: lambda f: f["revalidation"][name]
    return _shown(out, v("verdict"), v("reasoning"), v("adjustedSeverity"), v("runId"), v("revalidatedAt"))


@query(f"""WITH {LINES}, {ANSWERS.replace("'part': l_suppkey", "'part': 'P' || l_linenumber % 5")} SELECT path, count(*)::INT AS n, string_agg(CASE WHEN a IS NOT NULL THEN a.part || '/' || a.word || '/-/t8' WHEN old THEN 'old/-/-/-' ELSE '-/-/-/-' END, '|' ORDER BY idx) AS findings FROM f LEFT JOIN a USING (path, idx) GROUP BY path""")
def triaged_records(spark: SparkSession, sf: str) -> DataFrame:
    """Forced, so that what has been triaged before is triaged again."""
    out = records.triaged(_records(spark, sf), _answers(spark, sf), "t8", force=True)
    t = lambda name: lambda f: f["triage"][name]
    return _shown(out, t("priority"), t("exploitability"), t("impact"), t("triagedAt"))


@query(f"""WITH {LINES}, e AS (SELECT *, CASE run WHEN 'run1' THEN 'beta' WHEN 'run2' THEN 'alpha' WHEN 'run3' THEN 'alpha' END AS agent FROM f), k AS (SELECT path, slug, lines, min(idx) AS idx, array_to_string(list_sort(list_distinct(list(agent))), '+') AS agents FROM e WHERE agent IS NOT NULL GROUP BY 1, 2, 3)
SELECT path, count(*)::INT AS n, string_agg(e.slug || '/' || title || '/' || run || '/' || CASE WHEN agent IS NULL THEN '-' ELSE agents END, '|' ORDER BY idx) AS findings FROM e LEFT JOIN k USING (path, idx) WHERE agent IS NULL OR k.idx IS NOT NULL GROUP BY path""")
def merged_records(spark: SparkSession, sf: str) -> DataFrame:
    """An ensemble of three runs and two agents; run0 is not of it."""
    out = records.merged_agents(_records(spark, sf), {"run1": "beta", "run2": "alpha", "run3": "alpha"})
    return _shown(out, lambda f: f["vulnSlug"], lambda f: f["title"], lambda f: f["producedByRunId"], lambda f: F.array_join(f["agreeingAgents"], "+"))


@query(f"""WITH d AS (SELECT doc_id AS path, {redact_sql('text')} AS clean, {redact_sql("'token: ' || doc_id || ' ' || source")} AS short FROM documents) SELECT path, sha256(clean) AS snippet, short AS label, sha256(clean) AS title, short AS triage, CASE WHEN path % 2 = 0 THEN sha256(clean) END AS verdict, short AS stderr, short AS skipped FROM d""")
def redacted_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records with a document's text wherever agents and scans write texts; a record without a verdict gets none."""
    short = F.concat(F.lit("token: "), F.col("doc_id").cast("string"), F.lit(" "), F.col("source"))
    finding = F.struct(F.col("text").alias("title"), F.struct(short.alias("reasoning")).alias("triage"), F.when(F.col("doc_id") % 2 == 0, F.struct(F.col("text").alias("reasoning"))).alias("revalidation"))
    entry = F.struct(short.alias("codexStderr"), F.struct(F.array(F.struct(F.lit("x").alias("filePath"), short.alias("reason"))).alias("skipped")).alias("refusal"))
    none = F.lit(None).cast("array<int>")
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("filePath"), F.array(F.struct(F.lit("s").alias("vulnSlug"), none.alias("lineNumbers"), F.col("text").alias("snippet"), short.alias("matchedPattern"))).alias("candidates"),
        F.array(F.from_json(F.to_json(finding), FINDING)).alias("findings"), F.array(F.from_json(F.to_json(entry), HISTORY)).alias("analysisHistory"),
    )
    out = records.redacted(spark.createDataFrame([], RECORD).unionByName(rows, allowMissingColumns=True))
    c, f, h = (F.col(x)[0] for x in ("candidates", "findings", "analysisHistory"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select(F.col("filePath").cast("long").alias("path"), sha(c["snippet"]).alias("snippet"), c["matchedPattern"].alias("label"), sha(f["title"]).alias("title"), f["triage"]["reasoning"].alias("triage"), sha(f["revalidation"]["reasoning"]).alias("verdict"), h["codexStderr"].alias("stderr"), h["refusal"]["skipped"][0]["reason"].alias("skipped"))
