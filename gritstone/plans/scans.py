"""Queries of the scanner: rules over documents, filters, hashes, languages, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, gate, investigate, scan
from ..rules.load import Gate, Rule, TreePattern, frame
from ..rules.regex import glob_to_java
from ..sources import tables
from .common import FILES, batches_sql, candidates_sql, corpus_rules, files, hits_sql, q, query, redact_sql, table

CANDS = candidates_sql(corpus_rules())


@query(f"WITH {FILES}, {CANDS} SELECT path, slug, line, label, snippet FROM candidates")
def scan_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return scan.candidates(files(spark, sf), corpus_rules())


@query(f"WITH {FILES}, {CANDS} SELECT slug, count(*) AS candidates, count(DISTINCT path) AS files FROM candidates GROUP BY slug")
def candidates_by_slug(spark: SparkSession, sf: str) -> DataFrame:
    found = scan.candidates(files(spark, sf), corpus_rules())
    return found.groupBy("slug").agg(F.count("*").alias("candidates"), F.count_distinct("path").alias("files"))


@query(f"WITH {FILES}, {CANDS} SELECT path, count(*) AS candidates FROM candidates GROUP BY path")
def candidates_per_file(spark: SparkSession, sf: str) -> DataFrame:
    return scan.candidates(files(spark, sf), corpus_rules()).groupBy("path").agg(F.count("*").alias("candidates"))


@query(f"WITH {FILES}, {CANDS} SELECT path, slug, line, label FROM (SELECT *, row_number() OVER (PARTITION BY path, slug ORDER BY line, label) AS n FROM candidates) WHERE n = 1")
def scan_dedupe_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    found = scan.candidates(files(spark, sf), corpus_rules())
    return scan.first_wins(found, ["path", "slug"], ["line", "label"]).select("path", "slug", "line", "label")


STRICT = [Rule("strict", patterns=[r"\b[Tt]h\w+"], require_content=[r"!!", r"\bAND\b|\band\b"], exclude_path_patterns=[r"^src[0-4]/"], suppress_patterns=[r"\d"], label="th", snippet_before=2, snippet_after=1)]


@query(f"WITH {FILES}, {candidates_sql(STRICT)} SELECT path, line, md5(snippet) AS snippet_md5 FROM candidates")
def scan_require_exclude_suppress(spark: SparkSession, sf: str) -> DataFrame:
    return scan.candidates(files(spark, sf), STRICT).select("path", "line", F.md5("snippet").alias("snippet_md5"))


@query(
    f"""WITH {FILES}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM files),
hot AS (SELECT path, n FROM l WHERE regexp_matches(t, '(?i)\\bpassword\\b|@')), hit AS (SELECT DISTINCT path, line FROM ({hits_sql('[A-Z][a-z]+ing')}))
SELECT path, line FROM hit WHERE EXISTS (SELECT 1 FROM hot WHERE hot.path = hit.path AND abs(hot.n - hit.line) <= 2)"""
)
def taint_proximity(spark: SparkSession, sf: str) -> DataFrame:
    rows = files(spark, sf).withColumn("l", text.lines(F.col("content")))
    from ..rules.regex import to_java

    hot = F.filter(F.transform("l", lambda x, i: F.when(x.rlike(to_java(r"(?i)\bpassword\b|@")), i + 1)), lambda i: i.isNotNull())
    rows = rows.withColumn("hot", hot).where(F.size("hot") > 0)
    hits = F.filter(F.array_distinct(text.match_lines(F.col("content"), "[A-Z][a-z]+ing")), lambda n: text.near(F.col("hot"), n, 2))
    return rows.select("path", F.explode(hits).alias("line"))


@query(f"SELECT 'd' || doc_id AS id, md5({redact_sql('text')}) AS md5 FROM documents UNION ALL SELECT 'p' || page_id, md5({redact_sql('html')}) FROM pages")
def redact_secrets(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("t"))
    pages = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("t"))
    return tables.spread(docs.unionByName(pages)).select("id", F.md5(text.redact(F.col("t"))).alias("md5"))


@query(
    f"""WITH {FILES}, h AS (SELECT path, content, sha256(content) AS hash, regexp_extract(path, '(\\d+)\\.', 1)::INT AS id FROM files)
SELECT path, hash AS file_hash, id % 3 <> 0 AND id % 5 <> 0 AS hit FROM h"""
)
def file_hash_cache(spark: SparkSession, sf: str) -> DataFrame:
    now = files(spark, sf)
    n = F.regexp_extract("path", r"(\d+)\.", 1).cast("int")
    known = now.where(n % 3 != 0).select("path", scan.content_hash(F.when(n % 5 == 0, F.lit("changed")).otherwise(F.col("content"))).alias("file_hash"), F.lit(scan.pack_hash(corpus_rules())).alias("pack_hash"))
    hit, miss = scan.split_cached(now, known, corpus_rules())
    return hit.select("path", "file_hash", F.lit(True).alias("hit")).unionByName(miss.select("path", "file_hash", F.lit(False).alias("hit")))


@query(
    f"""WITH {FILES}, {CANDS}, k AS (SELECT path, CASE WHEN regexp_extract(path, '/(\\d+)', 1)::INT % 2 = 0 THEN slug || '|' || label || '|' || line END AS k FROM candidates),
o AS (SELECT DISTINCT path, k FROM k WHERE k IS NOT NULL), n AS (SELECT DISTINCT path, slug || '|' || label || '|' || line AS k FROM candidates WHERE line % 2 = 1)
SELECT path, count(*) AS candidates FROM (SELECT * FROM o UNION SELECT * FROM n) GROUP BY path"""
)
def candidate_upsert(spark: SparkSession, sf: str) -> DataFrame:
    found = scan.candidates(files(spark, sf), corpus_rules())
    meta = lambda d, run: scan.records(d).withColumns({"file_hash": F.lit("h"), "pack_hash": F.lit("p"), "run_id": F.lit(run), "status": F.lit("pending")})
    old = meta(found.where(F.regexp_extract("path", r"/(\d+)", 1).cast("int") % 2 == 0), "1")
    return scan.upsert(old, meta(found.where("line % 2 = 1"), "2")).select("path", F.size("candidates").cast("long").alias("candidates"))


@query(
    f"""WITH {FILES}, {CANDS}, h AS (SELECT DISTINCT path FROM candidates)
SELECT CASE regexp_extract(f.path, '\\.(\\w+)$', 1) WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' ELSE 'other' END AS language, count(*) AS files, count(h.path) AS with_candidates FROM files f LEFT JOIN h ON f.path = h.path GROUP BY 1"""
)
def language_stats(spark: SparkSession, sf: str) -> DataFrame:
    every = files(spark, sf)
    return scan.language_stats_of(every, corpus_rules())


GLOBS = ["*.example.com/**/8*", "**/{en,de}/*[0-4]?page=*", "shop.*/fr/**", "*/de/???*"]
# the shapes of GLOBS for RE2
GLOB_RE = [r"(?s)^[^/]*\.example\.com/(?:[^/]+/)*8[^/]*$", r"(?s)^(?:[^/]+/)*(?:en|de)/[^/]*[0-4][^/]page=[^/]*$", r"(?s)^shop\.[^/]*/fr/.*$", r"(?s)^[^/]*/de/[^/][^/][^/][^/]*$"]


@query("WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages) " + " UNION ALL ".join(f"SELECT page_id, {i} AS glob FROM u WHERE regexp_matches(path, '{g}')" for i, g in enumerate(GLOB_RE)))
def glob_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    hits = F.array(*[F.when(F.col("path").rlike(glob_to_java(g)), F.lit(i)) for i, g in enumerate(GLOBS)])
    return rows.select("page_id", F.explode(hits).alias("glob")).where("glob is not null")


GATED = [
    Rule("free", patterns=["x"]), Rule("by-tech", patterns=["x"], requires=Gate(tech=["src1", "nothing"])), Rule("no-tech", patterns=["x"], requires=Gate(tech=["nothing"])),
    Rule("by-file", patterns=["x"], requires=Gate(sentinel_files=["src1?/*.py"])), Rule("by-content", patterns=["x"], requires=Gate(sentinel_files=["*/1*.rs", "src2/*.go"], sentinel_contains=["(?i)qqqq", "[A-Z]"])),
    Rule("not-content", patterns=["x"], requires=Gate(tech=["nothing"], sentinel_files=["src3/*.ts"], sentinel_contains=["qqqq"])),
]


@query(
    f"""WITH {FILES}, f AS (SELECT path, content FROM files), first AS (SELECT g, arg_min(content, path) AS c FROM (SELECT content, path, g FROM f JOIN (VALUES ('a', '^src1[^/]/[^/]*\\.py$'), ('b', '^[^/]*/1[^/]*\\.rs$'), ('c', '^src2/[^/]*\\.go$'), ('d', '^src3/[^/]*\\.ts$')) v(g, p) ON regexp_matches(path, p)) GROUP BY g)
SELECT 'free' AS slug, true AS active UNION ALL SELECT 'by-tech', count(*) > 0 FROM documents WHERE source = 'src1' UNION ALL SELECT 'no-tech', false
UNION ALL SELECT 'by-file', count(*) > 0 FROM first WHERE g = 'a' UNION ALL SELECT 'by-content', count(*) > 0 FROM first WHERE g IN ('b', 'c') AND regexp_matches(c, '(?i)qqqq|[A-Z]') UNION ALL SELECT 'not-content', count(*) > 0 FROM first WHERE g = 'd' AND regexp_matches(c, 'qqqq')"""
)
def gate_eval(spark: SparkSession, sf: str) -> DataFrame:
    every = files(spark, sf)
    tech = table(spark, sf, "documents").agg(F.sort_array(F.collect_set("source")).alias("tags"))  # a project's technologies are few
    return gate.evaluate(frame(spark, GATED), tech, every).select("slug", "active")


@query(
    f"""WITH {FILES}, {CANDS}, n AS (SELECT path, count(*) AS c FROM candidates GROUP BY path), l AS (SELECT path, rtrim(content, chr(10)) AS b FROM files),
k AS (SELECT path, CASE WHEN b = '' THEN 0 ELSE len(b) - len(replace(b, chr(10), '')) + 1 END::BIGINT AS loc FROM l)
SELECT k.path, loc, coalesce(c, 0)::BIGINT AS candidates, round(CASE WHEN loc > 0 THEN coalesce(c, 0) / (loc / 1000.0) ELSE 0 END, 6)::DOUBLE AS per_kloc FROM k LEFT JOIN n ON k.path = n.path"""
)
def loc_density(spark: SparkSession, sf: str) -> DataFrame:
    every = files(spark, sf)
    return scan.density_of(every, corpus_rules()).withColumn("per_kloc", F.round("per_kloc", 6))


@query(
    f"""WITH {FILES}, {CANDS}, n AS (SELECT path, count(*) AS c FROM candidates GROUP BY path), l AS (SELECT path, rtrim(content, chr(10)) AS b FROM files),
k AS (SELECT path, CASE WHEN b = '' THEN 0 ELSE len(b) - len(replace(b, chr(10), '')) + 1 END AS loc FROM l)
SELECT k.path, c AS candidates FROM k JOIN n ON k.path = n.path WHERE loc > 0 AND c / (loc / 1000.0) > 400"""
)
def candidate_explosion(spark: SparkSession, sf: str) -> DataFrame:
    every = files(spark, sf)
    return scan.density_of(every, corpus_rules()).where("per_kloc > 400").select("path", "candidates")


@query(
    """WITH t AS (SELECT doc_id, text FROM documents), m AS (SELECT doc_id, string_agg(printf('%5d', n) || ' ' || l, chr(10) ORDER BY n) AS s FROM (SELECT doc_id, unnest(string_split("""
    + redact_sql("text")
    + """, chr(10))) AS l, generate_subscripts(string_split("""
    + redact_sql("text")
    + """, chr(10)), 1) AS n FROM t) GROUP BY doc_id) SELECT doc_id, md5(s) AS source_md5 FROM m"""
)
def prompt_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.numbered_source(F.col("text"))).alias("source_md5"))


@query(f"WITH {FILES}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line FROM files) SELECT path, line, text FROM l WHERE regexp_matches(text, '(?i)\\bthe\\b.*\\bof\\b') ORDER BY path, line LIMIT 100")
def tool_grep(spark: SparkSession, sf: str) -> DataFrame:
    return investigate.grep(files(spark, sf), r"(?i)\bthe\b.*\bof\b")


@query(
    f"""WITH {FILES}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1)::INT AS n FROM files), p AS (SELECT DISTINCT path, line FROM ({hits_sql('[A-Z]{5}')}))
SELECT p.path, p.line, n AS at, text FROM p JOIN l ON p.path = l.path AND abs(n - line) <= 2"""
)
def tool_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    every = files(spark, sf)
    places = every.select("path", F.explode(F.array_distinct(text.match_lines(F.col("content"), "[A-Z]{5}"))).alias("line"))
    return investigate.neighbours(every, places, 2)


@query("SELECT doc_id, substr(sha256(source || chr(0) || lang || chr(0) || doc_id), 1, 16) AS finding_id, substr(sha256(source || chr(10) || lang || chr(10) || (doc_id % 50) || chr(10)), 1, 16) AS compliance_id FROM documents")
def finding_ids(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.report import compliance_id, finding_id

    return table(spark, sf, "documents").select("doc_id", F.sha2(F.concat(F.col("source"), F.lit("\u0000"), F.col("lang"), F.lit("\u0000"), F.col("doc_id").cast("string")), 256).substr(1, 16).alias("f"), finding_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("finding_id"), compliance_id(F.col("source"), F.col("lang"), F.array((F.col("doc_id") % 50).cast("int"))).alias("compliance_id")).drop("f")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def extract_json(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    return table(spark, sf, "events").select("event_id", F.get_json_object(text.json_of(reply), "$.k").try_cast("bigint").alias("k"))


@query("SELECT source, doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 7)::INT AS chunk FROM documents")
def dir_chunks(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf, "documents").select("source", "doc_id", F.floor((F.row_number().over(w) - 1) / 7).cast("int").alias("chunk"))


@query(f"WITH RECURSIVE {batches_sql(7)} SELECT path, batch_id FROM batched")
def dir_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Whole packing of directories into batches of seven."""
    return investigate.batches(files(spark, sf).select("path"), 7).select("path", "batch_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 8")
def max_turn_cap(spark: SparkSession, sf: str) -> DataFrame:
    return investigate.turn_caps(table(spark, sf, "conversations")).select("conv_id", "turn", "role")


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def role_turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"))


CODE = [Rule("made-eval", file_patterns=["**/*.py"], tree_patterns=[TreePattern("python", '(Call func: (Name id: _ @f)) @call (#match? @f "^(?:eval|exec)$")', label="eval", primary_capture="call", prefilter_patterns=["eval|exec"])])]


@query("SELECT 'd' || doc_id % 10 || '/f' || doc_id || '.py' AS path, 'made-eval' AS slug, (3 + len(regexp_replace(text, '[^\\n]', '', 'g')) + doc_id % 4)::INT AS line FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0")
def tree_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as comments of source files with code made from their numbers: calls, the same names as plain words, and files that cannot be parsed."""
    d = F.col("doc_id")
    n = (d % 4).cast("int")
    call = F.when(d % 3 == 0, "y = eval(x)\n").otherwise("y = 'eval(x)'  # exec(x)\n")
    content = F.concat(F.lit("# "), F.regexp_replace(F.regexp_replace("text", r"[^\n -~]", "?"), "\n", "\n# "), F.lit("\nx = 1\n"), F.repeat(F.lit("z = x\n"), n), call, F.when(d % 5 == 0, "def broken(:\n").otherwise(""))
    made = table(spark, sf, "documents").select(F.concat(F.lit("d"), (d % 10).cast("string"), F.lit("/f"), d.cast("string"), F.lit(".py")).alias("path"), content.alias("content"))
    return audit.tree_candidates(made, CODE).select("path", "slug", "line")


@query("SELECT 'f' || doc_id || '.rs' AS path, (2 + len(regexp_replace(text, '[^\\n]', '', 'g')) + doc_id % 3)::INT AS line FROM documents WHERE doc_id % 4 IN (0, 3)")
def route_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as comments before routes made from their numbers: an open handler, one that takes an identity, one that checks, one elsewhere."""
    d = F.col("doc_id")
    handler = F.when(d % 4 == 0, 'async fn h(x: T) { let s = "}"; save(x); }').when(d % 4 == 1, "pub async fn h(me: CurrentUser) { save(me); }").when(d % 4 == 2, 'async fn h(x: T) -> R { let s = "{"; require_admin(x); }').otherwise("async fn other(me: Session) { }")
    content = F.concat(F.lit("// "), F.regexp_replace(F.regexp_replace("text", r"[^\n -~]", "?"), "\n", "\n// "), F.lit("\n"), F.repeat(F.lit("\n"), (d % 3).cast("int")), F.lit('.route("/x", post(h))\n.route("/y", get(h))\n'), handler)
    made = table(spark, sf, "documents").select(F.concat(F.lit("f"), d.cast("string"), F.lit(".rs")).alias("path"), content.alias("content"))
    return audit.route_audit(made).select("path", "line")


#: documents as manifests of one project, with a word of a framework in some
NAMES = ["package.json", "go.mod", "Gemfile", "requirements.txt", "Cargo.toml", "notes.txt"]
HINTS = ['"react"', "labstack/echo", "'rails'", "Flask", "axum", '"koa"', "gin-gonic/gin", ""]


def _tech_sql() -> str:
    made = f"SELECT list_extract({NAMES!r}, 1 + (doc_id % {len(NAMES)})::INT) AS name, text || chr(10) || list_extract([{', '.join(q(h) for h in HINTS)}], 1 + (doc_id // {len(NAMES)} % {len(HINTS)})::INT) AS content FROM documents"
    parts = [f"SELECT {q(gate.MANIFESTS[n])} AS tag FROM m WHERE name = {q(n)}" for n in NAMES if n in gate.MANIFESTS]
    for n in NAMES:
        low = "lower(content)" if n == "requirements.txt" else "content"
        parts += [f"SELECT {q(tag)} FROM m WHERE name = {q(n)} AND ({' OR '.join(f'contains({low}, {q(p)})' for p in probes)})" for tag, probes in gate.PROBES.get(n, {}).items()]
    return f"WITH m AS ({made}) " + " UNION ".join(parts)


@query(_tech_sql())
def tech_detect(spark: SparkSession, sf: str) -> DataFrame:
    d, n = F.col("doc_id"), len(NAMES)
    pick = lambda values, i: F.get(F.array(*[F.lit(x) for x in values]), i.cast("int"))
    made = table(spark, sf, "documents").select(pick(NAMES, d % n).alias("path"), F.concat("text", F.lit("\n"), pick(HINTS, F.floor(d / n) % len(HINTS))).alias("content"))
    return gate.detect(made).select(F.explode("tags").alias("tag"))


IGNORED = ["*.html", "/en/", "!keep.html", "shop/*", "# note", "de/**/x*"]


@query(
    """WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS p FROM pages) SELECT page_id, CASE WHEN regexp_matches(p, '(?s)^de/(?:[^/]+/)*x[^/]*(?:/.*)?$') THEN true WHEN regexp_matches(p, '(?s)^shop/[^/]*(?:/.*)?$') THEN true
WHEN regexp_matches(p, '(?s)^(?:[^/]+/)*keep\\.html(?:/.*)?$') THEN false WHEN regexp_matches(p, '(?s)^en/.+$') THEN true WHEN regexp_matches(p, '(?s)^(?:[^/]+/)*[^/]*\\.html(?:/.*)?$') THEN true ELSE false END AS ignored FROM u"""
)
def ignore_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/?", "").alias("p"))
    return rows.select("page_id", tables.ignored(F.col("p"), tables.gitignore(IGNORED)).alias("ignored"))


@query("SELECT doc_id, 'src/' || source || '.py,docs/' || lang || '.md' AS files FROM documents")
def diff_files(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda p: F.concat(F.lit("diff --git a/"), p, F.lit(" b/"), p, F.lit("\n--- a/"), p, F.lit("\n+++ b/"), p, F.lit("\n@@ -1 +1 @@\n-a\n+b\n"))
    diff = F.concat(one(F.concat(F.lit("src/"), "source", F.lit(".py"))), one(F.concat(F.lit("docs/"), "lang", F.lit(".md"))), F.lit("+++ b/../escape\n"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.diff_files(diff), ",").alias("files"))
