"""Queries of reviews, version control, comments and prompts, and of rules with odd patterns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, gates, investigate, report, review, scan
from ..rules.load import Rule, TreePattern, frame, patched, read_packs, rules_of
from ..sources import git, sinks
from .common import FILES, FINDINGS, HISTORY, candidates_sql, corpus_rules, files, findings, history, q, query, table, tainted_sql
from .scores import BEFORE_AFTER, GATE

CLOSEST = """f AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_quantity::INT) AS finding_id, l_linenumber % 3 AS task_id, l_partkey % 50 AS file, l_quantity::INT * 6 + l_orderkey % 5 AS line FROM lineitem),
a AS (SELECT o_orderkey % 3 AS task_id, o_custkey % 49 AS file, o_orderkey AS ord, 'a' || o_orderkey AS answer_id, o_orderkey % 300 AS low, o_orderkey % 300 + o_custkey % 9 AS high FROM orders)"""


@query(f"WITH {CLOSEST} SELECT finding_id, closest FROM (SELECT f.finding_id, a.answer_id AS closest, row_number() OVER (PARTITION BY f.finding_id ORDER BY greatest(a.low - f.line, f.line - a.high, 0), a.ord) AS n FROM f LEFT JOIN a ON f.task_id = a.task_id AND f.file = a.file) WHERE n = 1")
def closest_answer(spark: SparkSession, sf: str) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    f = li.select(F.concat_ws("-", *[F.col(c).cast("int").cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")]).alias("finding_id"), (F.col("l_linenumber") % 3).cast("long").alias("task_id"), (F.col("l_partkey") % 50).cast("long").alias("file"), (F.col("l_quantity").cast("int") * 6 + F.col("l_orderkey") % 5).alias("line")).distinct()
    a = o.select((F.col("o_orderkey") % 3).cast("long").alias("task_id"), (F.col("o_custkey") % 49).cast("long").alias("file"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("answer_id"), (F.col("o_orderkey") % 300).alias("low"), (F.col("o_orderkey") % 300 + F.col("o_custkey") % 9).alias("high"))
    return review.closest_answers(f, a).select("finding_id", "closest")


BY_SLUG = "SELECT 'm' || l_suppkey % 7 AS slug, l_linestatus AS task_id, count(*) FILTER (WHERE l_returnflag = 'R') AS tp, count(*) FILTER (WHERE l_returnflag = 'A') AS fp, count(*) FILTER (WHERE l_returnflag = 'N') AS fn, count(*) FILTER (WHERE l_returnflag <> 'N') AS candidates FROM lineitem GROUP BY 1, 2"


@query(f"WITH s AS ({BY_SLUG}), t AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(candidates)::BIGINT AS candidates FROM s WHERE slug = 'm3') SELECT 'm3' AS slug, *, round(coalesce(tp / nullif(candidates, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall FROM t")
def slug_review_summary(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    s = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("m"), (F.col("l_suppkey") % 7).cast("string")).alias("slug"), F.col("l_linestatus").alias("task_id")).agg(F.count_if(flag == "R").alias("tp"), F.count_if(flag == "A").alias("fp"), F.count_if(flag == "N").alias("fn"), F.count_if(flag != "N").alias("candidates"))
    return review.slug_review(s, "m3").withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


@query("SELECT 'suppliers' AS sets, (SELECT count(*) FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag <> 'R')) + (SELECT count(*) FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag <> 'R' EXCEPT SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R')) = 0 AS equal UNION ALL SELECT 'orders', (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) + (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0")
def set_equality(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    a = review.equal_sets(li.where("l_returnflag = 'R'"), li.where("l_returnflag <> 'R'"), ["l_suppkey"])
    b = review.equal_sets(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), ["k"])
    return a.select(F.lit("suppliers").alias("sets"), "equal").unionByName(b.select(F.lit("orders").alias("sets"), "equal"))


@query("SELECT o_orderkey, ['x' || o_custkey % 3, 'y'] AS got, list_sort(list_distinct(['x' || o_custkey % 3, 'y'])) = list_sort(list_distinct(['y', 'x' || o_orderkey % 3, 'y'])) AS same FROM orders")
def same_files(spark: SparkSession, sf: str) -> DataFrame:
    x = lambda c: F.concat(F.lit("x"), (F.col(c) % 3).cast("string"))
    got = F.array(x("o_custkey"), F.lit("y"))
    return table(spark, sf, "orders").select("o_orderkey", got.alias("got"), review.same_strings(got, F.array(F.lit("y"), x("o_orderkey"), F.lit("y"))).alias("same"))


@query("SELECT sum(o_custkey % 100)::DOUBLE AS cost, sum(o_orderkey % 1000)::BIGINT AS input_tokens, sum(o_orderkey % 77)::BIGINT AS output_tokens, sum(o_custkey % 9)::BIGINT AS duration_ms, sum(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END)::BIGINT AS analyses, sum(o_orderkey % 3)::BIGINT AS findings, count(*) FILTER (WHERE o_orderstatus = 'P') AS error_batches, sum(o_custkey % 100) >= 1000 AS budget_exhausted, 'done' AS phase FROM orders")
def run_outcome(spark: SparkSession, sf: str) -> DataFrame:
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    rows = table(spark, sf, "orders").select((c % 100).cast("double").alias("cost"), (k % 1000).alias("input_tokens"), (k % 77).alias("output_tokens"), (c % 9).alias("duration_ms"), F.when(s == "F", 2).otherwise(0).alias("analyses"), (k % 3).alias("findings"), F.when(s == "P", "failed").otherwise("ok").alias("state"))
    return review.outcome(rows, 1000)


@query("WITH r AS (SELECT DISTINCT 'user' || user_id AS run, 'agent' || user_id % 4 AS agent FROM events WHERE user_id % 2 = 0) SELECT event_id, agent FROM (SELECT event_id, 'user' || user_id AS run FROM events) JOIN r USING (run)")
def ensemble_members(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("run"))
    runs = e.where("user_id % 2 = 0").select("run", F.concat(F.lit("agent"), (F.col("user_id") % 4).cast("string")).alias("agent"))
    return review.of_ensemble(e.select("event_id", "run"), runs).select("event_id", "agent")


@query("SELECT 'c' || o_custkey AS path, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ord, 'clerk' || o_custkey % 9 AS name, 'u' || o_orderkey || '@a.example' AS email, strftime(o_orderdate, '%Y-%m-%d') AS at FROM orders")
def git_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Logs made of customers' orders, with a line that is none between them."""
    line = F.concat(F.lit("clerk"), (F.col("o_custkey") % 9).cast("string"), F.lit("\tu"), F.col("o_orderkey").cast("string"), F.lit("@a.example\t"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    logs = table(spark, sf, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))).alias("x"))
    return git.commits(logs.select("path", F.array_join(F.transform("x", lambda x: x["l"]), "\nno commit\n").alias("log")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'f' || o_custkey || ':' || o_orderkey || ': no blame data' ELSE 'f' || o_custkey || ':' || o_orderkey || ' commit=c' || o_orderkey || ' author=' || o_clerk || ' <<' || o_custkey || '@a.example>> author-time=' || o_orderkey || ' summary=' || o_comment END AS said FROM (SELECT *, 'made by ' || o_clerk AS o_comment FROM (SELECT o_orderkey, o_custkey, 'clerk' || o_custkey % 9 AS o_clerk FROM orders))")
def git_blame(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    who = F.concat(F.lit("clerk"), (F.col("o_custkey") % 9).cast("string"))
    out = F.concat(F.lit("c"), k, F.lit(" 1 1 1\nauthor "), who, F.lit("\nauthor-mail <"), c, F.lit("@a.example>\nauthor-time "), k, F.lit("\nsummary made by "), who, F.lit("\n\tcode summary x"))
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", git.blame_text(F.concat(F.lit("f"), c), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(out)).alias("said"))


@query(f"""WITH {FINDINGS} SELECT idx, '### `' || CASE severity WHEN 'CRITICAL' THEN 'CRIT' WHEN 'HIGH' THEN 'HIGH' WHEN 'MEDIUM' THEN 'MED ' WHEN 'BUG' THEN 'BUG ' ELSE 'LOW ' END || '` — ' || severity || ' **t' || idx || '**' || chr(10) || '- file: `' || path || '` (lines [' || idx % 5 || ' 9])' || chr(10) || '- slug: `' || slug || '`' || chr(10) || '- confidence: `high`' || chr(10)
|| CASE WHEN verdict IS NOT NULL THEN '- revalidation: `' || verdict || '`' || chr(10) ELSE '' END || chr(10) || 'd' || chr(10) || chr(10) || '**Fix:** r' || chr(10) || chr(10) AS part FROM findings""")
def comment_parts(spark: SparkSession, sf: str) -> DataFrame:
    f = findings(spark, sf).withColumns({"title": F.concat(F.lit("t"), F.col("idx").cast("string")), "lines": F.array((F.col("idx") % 5).cast("int"), F.lit(9)), "confidence": F.lit("high"), "description": F.lit("d"), "recommendation": F.lit("r")})
    return sinks.comment_parts(f).select("idx", "part")


@query(f"WITH {FINDINGS} SELECT idx, 'File: ' || path || chr(10) || 'severity=' || severity || ' slug=' || slug || ' lines=[' || idx % 5 || '] title=t' || idx || chr(10) || 'description: d' || chr(10) AS user FROM findings")
def triage_prompts(spark: SparkSession, sf: str) -> DataFrame:
    f = findings(spark, sf).withColumns({"title": F.concat(F.lit("t"), F.col("idx").cast("string")), "lines": F.array((F.col("idx") % 5).cast("int")), "description": F.lit("d")})
    return investigate.triage_prompt(f).select("idx", "user")


@query("""SELECT '{"batchPaths":["f' || o_custkey || '","g"],"output":{"results":[' || o_orderkey || ']}}' AS value FROM orders WHERE o_orderkey % 4 <> 0""")
def recorded_replies(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.array(F.concat(F.lit("f"), F.col("o_custkey").cast("string")), F.lit("g")).alias("batch_paths"), F.concat(F.lit('{"results":['), k.cast("string"), F.lit("]}")).alias("output"), (k % 4 != 0).alias("ok"))
    return sinks.recorded(rows)


OPEN = [
    Rule("open-class", patterns=[r"[A-Z][\s\S]{2,30}?[!$]", r"\n[^\S\n]*[a-z]"]), Rule("no-space", patterns=[r"[x\S]{14,}"], suppress_patterns=[r"[^\S]{3}"]),
]


@query(f"WITH {FILES}, {candidates_sql(OPEN)} SELECT path, slug, line, label, md5(snippet) AS snippet FROM candidates")
def open_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes that hold what is no space."""
    return scan.candidates(files(spark, sf), OPEN).withColumn("snippet", F.md5("snippet"))


BOTH = [Rule("made-eval", file_patterns=["**/*.{py,js}"], patterns=[r"\beval\s*\("], label="text", tree_patterns=[TreePattern("python", '(Call func: (Name id: _ @f)) @call (#eq? @f "eval")', label="call", primary_capture="call")])]


@query("""WITH t AS (SELECT doc_id, len(regexp_replace(text, '[^\\n]', '', 'g')) + 2 AS n FROM documents) SELECT 'f' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.js' END AS path, CASE WHEN doc_id % 2 = 0 THEN 'call' ELSE 'text' END AS label, (n + k)::INT AS line FROM t, (SELECT unnest([0, 1]) AS k) WHERE doc_id % 2 = 1 OR (k = 1 AND doc_id % 5 <> 0)""")
def both_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """A rule with a pattern and a tree pattern over documents as comments, a string and a call: files of the tree's language
    are judged by the tree alone."""
    plain = F.regexp_replace("text", r"[^\n -~]", "?")
    d = F.col("doc_id")
    py = d % 2 == 0
    content = F.concat(F.when(py, "# ").otherwise("// "), F.replace(plain, F.lit("\n"), F.when(py, "\n# ").otherwise("\n// ")), F.lit("\ny = 'eval(x)'\nx = eval(y)\n"), F.when(py & (d % 5 == 0), "def broken(:\n").otherwise(""))
    made = table(spark, sf, "documents").select(F.concat(F.lit("f"), d.cast("string"), F.when(py, ".py").otherwise(".js")).alias("path"), content.alias("content"))
    return scan.candidates(made, BOTH).unionByName(audit.tree_candidates(made, BOTH)).select("path", "label", "line")


PLAIN_RULES = [r for r in read_packs() if r.patterns and not r.tree_patterns]
TAINT_RULES = [r for r in PLAIN_RULES if r.require_taint_within]


@query(f"WITH {FILES}, {tainted_sql()}, {candidates_sql(PLAIN_RULES)} SELECT path, slug, line, label, snippet FROM candidates")
def scan_all_packs(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule of the packs but tree rules, over all documents as files."""
    return scan.candidates(files(spark, sf), PLAIN_RULES)


#: By extension: lines that bring input in, and lines that use something.
SOURCES = {"py": "q = input()", "go": "q := r.URL.Query()", "ts": "const q = req.query.x", "rs": "let q = env::var(k);", "js": "q = process.argv"}
SINKS = {"py": ["os.system(q)", "requests.get(q)", "open(q)"], "go": ["os.ReadFile(q)", "http.ServeFile(w, q)", "x()"], "ts": ["res.redirect(q)", "fetch(q)", "new RegExp(q)"], "rs": ["x()"] * 3, "js": ["readFile(q)", "location.href", "x()"]}
#: documents as source files of five languages: a text's lines stand between an input and a use, so they are near or not.
CODE = f"""files AS (SELECT 'f' || doc_id || '.' || x AS path, source || chr(10) || replace(text, chr(13) || chr(10), chr(10)) || chr(10) || sink[1 + doc_id % 3] || chr(10) AS content FROM (SELECT *, CASE doc_id % 5 {' '.join(f"WHEN {i} THEN {q(x)}" for i, x in enumerate(SOURCES))} END AS x,
  CASE doc_id % 5 {' '.join(f"WHEN {i} THEN {q(x)}" for i, x in enumerate(SOURCES.values()))} END AS source, CASE doc_id % 5 {' '.join(f"WHEN {i} THEN [{', '.join(map(q, x))}]" for i, x in enumerate(SINKS.values()))} END AS sink FROM (SELECT doc_id, text FROM documents)))"""


@query(f"WITH {CODE}, {tainted_sql()}, {candidates_sql(TAINT_RULES)} SELECT path, slug, line, label, md5(snippet) AS snippet FROM candidates")
def taint_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The packs' rules that need input nearby, by the patterns of each language."""
    k = (F.col("doc_id") % 5).cast("int")
    pick = lambda values: F.get(F.array(*values), k)
    sink = F.get(pick([F.array(*map(F.lit, x)) for x in SINKS.values()]), (F.col("doc_id") % 3).cast("int"))
    content = F.concat(pick(map(F.lit, SOURCES.values())), F.lit("\n"), F.col("text"), F.lit("\n"), sink, F.lit("\n"))
    made = table(spark, sf, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), pick(map(F.lit, SOURCES))).alias("path"), content.alias("content"))
    return scan.candidates(made, TAINT_RULES).withColumn("snippet", F.md5("snippet"))


@query(f"WITH {HISTORY} SELECT event_id FROM (SELECT event_id, coalesce(sum(cost::DECIMAL(18, 4)) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM history) WHERE spent < 5000")
def budget_global_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf).withColumn("cost", F.col("cost").cast("decimal(18,4)"))
    return report.running_budget(h, 5000, ["ts", "event_id"]).select("event_id")


#: Patches of the rules for texts: (slug, decision, values); the last takes most of another rule's candidates away.
PATCHES = [("symbol-noise", "suppress_pattern", [r"\*\*\*"]), ("shouting-run", "file_patterns", ["**/*.ts", "**/*.py"]), ("symbol-noise", "suppress_pattern", ["(?i)license"]), ("shouting-run", "file_patterns", ["**/*.go", "**/*.ts"]), ("pipe-table", "require_content", ["qq"])]
_AFTER = {"symbol-noise": {"suppress_patterns": ["(?i)license", r"\*\*\*"]}, "shouting-run": {"file_patterns": ["**/*.go", "**/*.ts"]}, "pipe-table": {"require_content": ["qq"]}}
PATCHED = [replace(r, **_AFTER.get(r.slug, {})) for r in corpus_rules()]


def _patch_side(name: str, rules: list[Rule]) -> str:
    """A side of the gate: candidates in documents of low quality are right, all others are false alarms."""
    found = candidates_sql(rules).replace("candidates AS", f"c{name} AS", 1)
    return f"""{found}, s{name} AS (SELECT slug, doc_id, quality, toxic FROM c{name} LEFT JOIN labels ON doc_id = regexp_extract(path, '/([0-9]+)[.]', 1)::BIGINT),
{name} AS (SELECT slug, count(*) AS candidates, count(*) FILTER (WHERE quality = 0) AS tp, count(*) FILTER (WHERE quality IS DISTINCT FROM 0) AS fp, (SELECT count(*) FROM labels WHERE quality = 0) - count(DISTINCT doc_id) FILTER (WHERE quality = 0) AS fn, (SELECT count(*) FROM labels WHERE quality = 0 AND toxic = 1) - count(DISTINCT doc_id) FILTER (WHERE quality = 0 AND toxic = 1) AS high_fn FROM s{name} GROUP BY slug)"""


PATCH_SIDES = f"{FILES}, {_patch_side('b', corpus_rules())}, {_patch_side('a', PATCHED)}"


def _patch_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Scores before and after; the rules are patched as a table."""
    labels, rules = table(spark, sf, "labels"), corpus_rules()
    patches = spark.createDataFrame([(i, *p) for i, p in enumerate(PATCHES)], "ord int, slug string, decision string, values array<string>")
    low = F.col("quality") == 0
    high = low & (F.col("toxic") == 1)
    bad = labels.agg(F.count_if(low).alias("n"), F.count_if(high).alias("high")).first()

    def side(own: list[Rule]) -> DataFrame:
        found = scan.candidates(files(spark, sf), own).select("slug", F.regexp_extract("path", "/([0-9]+)[.]", 1).cast("long").alias("doc_id")).join(labels, "doc_id", "left")
        missed = [(F.lit(n) - F.count_distinct(F.when(which, F.col("doc_id")))).alias(name) for name, n, which in (("fn", bad.n, low), ("high_fn", bad.high, high))]
        return found.groupBy("slug").agg(F.count("*").alias("candidates"), F.count_if(low).alias("tp"), F.count_if(~F.coalesce(low, F.lit(False))).alias("fp"), *missed)

    return side(rules), side(rules_of(patched(frame(spark, rules), patches), rules))


@query(GATE.replace(f"WITH {BEFORE_AFTER}", f"WITH {PATCH_SIDES}").replace("'R1'", "'symbol-noise'"))
def patched_rule_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Rules are patched, scanned before and after, scored against the labels, and judged by the gate."""
    return gates.precision_gate(*_patch_sides(spark, sf), "symbol-noise")


@query(f"WITH {PATCH_SIDES} SELECT coalesce(a.slug, b.slug) AS slug, {', '.join(f'coalesce({x}.{c}, 0)::BIGINT AS {c}_{x}' for x in 'ba' for c in ('candidates', 'tp', 'fp', 'fn'))} FROM a FULL JOIN b ON a.slug = b.slug")
def patched_rule_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return gates.deltas(*_patch_sides(spark, sf)).select("slug", *[f"{c}_{x}" for x in "ba" for c in ("candidates", "tp", "fp", "fn")])


#: What a prompt says of technologies and of rules, by their names.
HINTS = {"go": "Handlers take a request and a writer.", "react": "Text is escaped unless it is told not to be.", "rails": "Parameters are filtered by permit."}
NOTES = {"credential-assignment": "Test values are no findings.", "contact-address": "Addresses of roles are harmless.", "pipe-table": "Tables are data.", "unused-rule": "Nothing."}
_HEAD = "\n".join(f"- {HINTS[t]}" for t in ("rails", "go"))


@query(f"""WITH {FILES}, {candidates_sql(corpus_rules())}, b AS (SELECT path, regexp_extract(path, '/([0-9]+)[.]', 1)::BIGINT % 40 AS batch_id FROM files), n(slug, note) AS (VALUES {', '.join(f"({q(k)}, {q(v)})" for k, v in NOTES.items())}),
s AS (SELECT DISTINCT batch_id, slug FROM b JOIN candidates USING (path)) SELECT b.batch_id, {q(_HEAD)} || chr(10) || coalesce(string_agg('- ' || s.slug || ': ' || note, chr(10) ORDER BY s.slug) FILTER (WHERE note IS NOT NULL), '') AS system FROM (SELECT DISTINCT batch_id FROM b) b LEFT JOIN s USING (batch_id) LEFT JOIN n USING (slug) GROUP BY b.batch_id""")
def prompt_hints(spark: SparkSession, sf: str) -> DataFrame:
    """The heads of prompts: hints of the project's technologies, and the notes of the rules that have found something in a
    batch. Batches are documents whose ids leave the same rest, as no packing is asked for here."""
    own = files(spark, sf)
    batched = own.withColumn("batch_id", F.regexp_extract("path", "/([0-9]+)[.]", 1).cast("long") % 40)
    found = scan.candidates(own, corpus_rules()).select("path", "line", "slug", "label")
    return investigate.prompt(batched, found, ["rails", "perl", "go"], HINTS, NOTES).select("batch_id", "system")
