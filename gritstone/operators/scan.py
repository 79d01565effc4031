"""From files to candidates: every rule over every file in one pass, without a shuffle.

Rules are data for the driver only: each becomes a column with literal patterns, and all of them are evaluated on a
file's row while it is in memory. The plan is a scan, a projection and one explode, whatever the number of rules.

A pattern is only searched in a text that holds one of the literals that it cannot match without (rules.literals), which
is a search for bytes; and each set of path patterns is tested once a file, for all rules that have it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..rules.literals import needed
from ..rules.load import Rule, pack_hash
from ..rules.regex import any_of, glob_to_java, to_java

CANDIDATE = "struct<slug:string,line:int,label:string,snippet:string>"


def _quoted(s: str) -> str:
    """A string as a SQL literal; a dollar is written as a code, for `${` would be taken for a variable."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


# A rule is written as one SQL expression: hundreds of rules are then parsed in the JVM, where building them column by
# column would take some ten calls for each operator.
def _holds(pattern: str) -> str:
    """Whether the content holds a match, by its literals first."""
    words = sorted(needed(pattern) or ())
    search = f"content rlike {_quoted(to_java(pattern))}"
    if not words:
        return search
    return f"({' OR '.join(f'contains({"__low" if folded else "content"}, {_quoted(w)})' for w, folded in words)}) AND {search}"


def _path_test(patterns: tuple[str, ...]) -> str:
    return f"path rlike {_quoted('|'.join(f'(?:{glob_to_java(g)})' for g in patterns))}"


def path_sets(rules: list[Rule]) -> list[tuple[str, ...]]:
    """The distinct sets of path patterns, in order."""
    return list(dict.fromkeys(tuple(r.file_patterns) for r in rules if r.file_patterns))


def rule_tests(rule: Rule, sets: list[tuple[str, ...]]) -> str:
    """Cheap tests first: the path, then what the content must hold."""
    tests = []
    if rule.file_patterns:
        tests.append(f"__paths[{sets.index(tuple(rule.file_patterns))}]")
    if rule.exclude_path_patterns:
        tests.append(f"NOT path rlike {_quoted(any_of(rule.exclude_path_patterns))}")
    tests += [_holds(p) for p in rule.require_content]
    return " AND ".join(tests) or "true"


def prepared(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Files (path, content) with what the rules' expressions share: lines, lines with input, the content in lower case
    and the outcome of each set of path patterns."""
    rows = files.select("path", text.normalised(F.col("content")).alias("content"))
    rows = rows.withColumn("__lines", text.lines(F.col("content")))
    if any(r.require_taint_within for r in rules):
        rows = rows.withColumn("__taint", text.tainted_lines(F.col("content"), F.col("__lines"), paths.taint_language(F.col("path"))))
    if any(folded for r in rules for p in (*r.patterns, *r.require_content) for _, folded in needed(p) or ()):
        # the long s and the Kelvin sign match s and k where case does not matter
        rows = rows.withColumn("__low", F.replace(F.replace(F.lower("content"), F.lit("\u017f"), F.lit("s")), F.lit("\u212a"), F.lit("k")))
    sets = path_sets(rules)
    return rows.withColumn("__paths", F.expr(f"array({', '.join(map(_path_test, sets))})")) if sets else rows


def _hits(rule: Rule, pattern: str) -> str:
    """The candidates of one pattern in one file, as text.match_lines and text.snippet have them."""
    mark = _quoted(text.SENTINEL)
    marked = f"regexp_replace(replace(content, {mark}, ' '), {_quoted(to_java(pattern))}, {_quoted(text.SENTINEL + '$0')})"
    hits = f"array_distinct(flatten(transform(split({marked}, '\\n', -1), (x, i) -> array_repeat(i + 1, length(x) - length(replace(x, {mark}, ''))))))"
    if rule.require_taint_within:
        hits = f"filter({hits}, n -> exists(__taint, t -> abs(t - n) <= {int(rule.require_taint_within)}))"
    first = f"greatest(n - {int(rule.snippet_before)}, 1)"
    shown = f"array_join(slice(__lines, {first}, least(n + {int(rule.snippet_after)}, size(__lines)) - {first} + 1), '\\n')"
    made = f"transform({hits}, n -> named_struct('slug', {_quoted(rule.slug)}, 'line', n, 'label', {_quoted(rule.label or pattern)}, 'snippet', {shown}))"
    if rule.suppress_patterns:
        made = f"filter({made}, c -> NOT c.snippet rlike {_quoted(any_of(rule.suppress_patterns))})"
    # most files do not hold most patterns
    return f"CASE WHEN {_holds(pattern)} THEN {made} ELSE array() END"


def _found(rule: Rule, sets: list[tuple[str, ...]]) -> Column:
    """The candidates of one rule in one file: an array without repetitions of (slug, label, line). Files in a language
    for which the rule has tree patterns are judged by these alone."""
    found = f"flatten(array({', '.join(_hits(rule, p) for p in rule.patterns)}))"
    if len(rule.patterns) > 1:
        found = f"array_distinct({found})"
    trees = sorted({e for t in rule.tree_patterns for e in paths.TREE_LANGUAGES.get(t.language, [])})
    tests = rule_tests(rule, sets)
    if trees:
        tests += f" AND NOT lower(regexp_extract(path, {_quoted(paths.EXTENSION)}, 1)) IN ({', '.join(map(_quoted, trees))})"
    return F.expr(f"CASE WHEN {tests} THEN {found} ELSE cast(array() AS array<{CANDIDATE}>) END")


def candidates(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """(path, slug, line, label, snippet) of all rules' regular expressions over files (path, content).

    A match inside a label's line counts once for a rule; snippets are redacted. Null contents have no candidates.
    """
    rules = [r for r in rules if r.patterns]
    if not rules:
        return files.limit(0).select("path", F.lit("").alias("slug"), F.lit(0).alias("line"), F.lit("").alias("label"), F.lit("").alias("snippet"))
    sets = path_sets(rules)
    found = prepared(files, rules).select("path", F.explode(F.flatten(F.array(*[_found(r, sets) for r in rules]))).alias("c"))
    return found.select("path", "c.slug", "c.line", "c.label", text.redact(F.col("c.snippet")).alias("snippet"))


def candidate_key(slug: Column, label: Column, lines: Column) -> Column:
    """The identity of a candidate over scans."""
    return F.concat_ws("|", slug, label, F.array_join(lines.cast("array<string>"), ","))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def records(found: DataFrame) -> DataFrame:
    """(path, candidates): one row a file, its candidates in order of line and label."""
    c = F.struct("line", "label", "slug", "snippet")
    rows = found.groupBy("path").agg(F.array_sort(F.collect_list(c)).alias("c"))
    made = F.transform("c", lambda x: F.struct(x["slug"].alias("vulnSlug"), F.array(x["line"]).alias("lineNumbers"), x["snippet"].alias("snippet"), x["label"].alias("matchedPattern")))
    return rows.select("path", made.alias("candidates"))


def content_hash(content: Column) -> Column:
    return F.sha2(text.normalised(content), 256)


def marked_cached(files: DataFrame, known: DataFrame | None, rules: list[Rule], force: bool = False) -> DataFrame:
    """`files` with file_hash, pack_hash and cached: whether content and rule pack are those of the last scan, `known`:
    (path, file_hash, pack_hash). Only hashes meet in the join; with `force` or nothing known no file is cached."""
    hashed = files.withColumn("file_hash", content_hash(F.col("content"))).withColumn("pack_hash", F.lit(pack_hash(rules)))
    if force or known is None:
        return hashed.withColumn("cached", F.lit(False))
    same = known.select("path", "file_hash", "pack_hash").distinct().withColumn("cached", F.lit(True))
    both = hashed.join(same, ["path", "file_hash", "pack_hash"], "left")
    return both.select(*hashed.columns, F.coalesce("cached", F.lit(False)).alias("cached"))


def split_cached(files: DataFrame, known: DataFrame, rules: list[Rule], force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): files whose content and rule pack are those of the last scan, and the others."""
    both = marked_cached(files, known, rules, force)
    return both.where("cached").drop("cached"), both.where("not cached").drop("cached")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records (path, candidates, file_hash, pack_hash, run_id, status) after a scan: old candidates stay, new ones are
    appended by their identity, the scan's metadata are replaced, and a status once set is kept."""
    o, n = old.alias("o"), new.alias("n")
    none = F.array().cast(new.schema["candidates"].dataType)
    had, got = F.coalesce("o.candidates", none), F.coalesce("n.candidates", none)
    key = lambda c: candidate_key(c["vulnSlug"], c["matchedPattern"], c["lineNumbers"])
    fresh = F.filter(got, lambda c: ~F.exists(had, lambda x: key(x) == key(c)))
    later = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return o.join(n, F.col("o.path") == F.col("n.path"), "full_outer").select(
        F.coalesce("n.path", "o.path").alias("path"), F.concat(had, fresh).alias("candidates"), later("file_hash"), later("pack_hash"), later("run_id"), F.coalesce("o.status", "n.status", F.lit("pending")).alias("status")
    )


def language_stats(files: DataFrame, found: DataFrame) -> DataFrame:
    """(language, files, with_candidates) by the paths' extensions."""
    hit = found.select("path").distinct().withColumn("hit", F.lit(1))
    return files.join(hit, "path", "left").groupBy(paths.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.count("hit").alias("with_candidates"))


def counted(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """(path, loc, candidates) of each file, counted where its row is: no shuffle. The counts come out of an array of one, so a
    filter on them is not moved below it, where every rule would be evaluated in its place once more."""
    rules = [r for r in rules if r.patterns]
    rows, sets = prepared(files, rules), path_sets(rules)
    n = reduce(lambda a, b: a + b, [F.coalesce(F.size(_found(r, sets)), F.lit(0)) for r in rules], F.lit(0))
    return rows.select("path", F.inline(F.array(F.struct(text.line_count(F.col("content")).cast("long").alias("loc"), n.cast("long").alias("candidates")))))


def density_of(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """density() of what the rules find."""
    return counted(files, rules).withColumn("per_kloc", F.when(F.col("loc") > 0, F.col("candidates") / (F.col("loc") / 1000)).otherwise(F.lit(0.0)))


def language_stats_of(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """language_stats() of what the rules find: only the languages' counts are shuffled."""
    return counted(files, rules).groupBy(paths.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.count_if(F.col("candidates") > 0).alias("with_candidates"))


def density(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, loc, candidates, per_kloc); 0 where a file has no lines."""
    n = found.groupBy("path").agg(F.count("*").alias("candidates"))
    rows = files.select("path", text.line_count(F.col("content")).cast("long").alias("loc")).join(n, "path", "left")
    rows = rows.withColumn("candidates", F.coalesce("candidates", F.lit(0)).cast("long"))
    return rows.withColumn("per_kloc", F.when(F.col("loc") > 0, F.col("candidates") / (F.col("loc") / 1000)).otherwise(F.lit(0.0)))
