import re

import duckdb
import pytest
from pyspark.sql import functions as F

from gritstone.rules import literals
from gritstone.rules.load import Gate, Rule, frame, lint, override, pack_hash, read_packs, rule_of, select
from gritstone.rules.regex import UnsupportedPattern, glob_to_java, to_java

PATTERNS = [r"\ba", r"(?i)é\w", r"a$", r"(?m)^\w+$", r"\s+\S", r"[\s,]+x?", r"[[:upper:]]{2,}", r"(?P<w>th)\w*", r"(?i:THE)\B", r"[^a-z\n]+", r".{3}$", r"a|e\.", r"[]x]", r"\Qa.b\E|on", r"(?s)a.{0,3}b", r"a[\s\S]{2}e", r"[x\S]+y", r"[^\S\n]+", r"[^\Sa]t", r"[\S]+", r"[\S\n]{3}", r"<[\s\S]*?>", r"[^\S]", r"\bth\b", r"(?i)\bKe\b|\bß", r"\b(?:the|of|and)\b", r"\b(?:t|[aé])\w", r"ea?\b", r"\ba?n", r"\b\w+n\b", r"\x65\b", r"(?i)\bs\w*", r"\d\b", r"\b(?:on)?e"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_matches_like_re2(spark, sf, pattern):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150).unionByName(spark.createDataFrame([(-1, "a\nb\n", "x", "s", 3), (-2, "a\r\nb a\x0bé  É_", "x", "s", 3), (-3, "", "x", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    have = {r[0]: r[1] for r in docs.select("doc_id", F.md5(F.regexp_replace("text", F.lit(to_java(pattern)), F.lit("<$0>")))).collect()}
    rows = docs.select("doc_id", "text").toPandas()
    want = dict(duckdb.execute("select doc_id, md5(regexp_replace(text, $1, '<\\0>', 'g')) from rows", [pattern]).fetchall())
    assert have == want and len(rows) == len(want)


@pytest.mark.parametrize("bad", [r"(?=x)", r"(?<!x)y", r"(a)\1", "[a", "(?>a)", "[[:foo:]]"])
def test_rejects_what_re2_lacks(bad):
    with pytest.raises(UnsupportedPattern):
        to_java(bad)


@pytest.mark.parametrize(
    "glob, yes, no",
    [("**/*.py", ["a.py", "x/y/a.py"], ["a.pyc", "py"]), ("src/*.ts", ["src/a.ts"], ["src/b/a.ts", "a.ts"]), ("a/**", ["a/b", "a/b/c"], ["b/a"]), ("*.{js,ts}", ["a.js", "b.ts"], ["a.jsx", "d/a.js"]), ("[!a]?.md", ["bc.md"], ["ac.md", "b.md"]), ("**/Dockerfile", ["Dockerfile", "x/Dockerfile"], ["Dockerfile.x"])],
)
def test_globs(glob, yes, no):
    p = re.compile(glob_to_java(glob).replace(r"\z", r"\Z"))
    assert all(p.search(x) for x in yes) and not any(p.search(x) for x in no)


def test_packs_load_and_lint(spark):
    rules = read_packs()
    assert len(rules) >= 23 and len({r.slug for r in rules}) == len(rules)
    assert frame(spark, rules).count() == len(rules)
    assert lint([{"slug": "a", "patterns": ["x*"]}, {"slug": "a", "patterns": ["(?=x)"]}, {"slug": "b", "patterns": ["x"], "noise_tier": "noisy", "file_patterns": ["**/*"]}, {"slug": "c"}]) == [
        ("a", "pattern can match nothing"), ("a", "duplicate slug"), ("a", "a: (?=x): lookaround and atomic groups are not in RE2"), ("b", "noisy without a gate or required content"), ("b", "glob takes every file"), ("c", "c: no patterns"),
    ]


def test_defaults_overrides_and_hash():
    a = rule_of({"slug": "a", "patterns": ["x"], "snippet_before": 0, "noise_tier": ""})
    assert (a.snippet_before, a.snippet_after, a.noise_tier) == (1, 5, "normal")
    b = Rule("b", patterns=["y"], requires=Gate(tech=["go"]))
    newer = Rule("a", patterns=["z"])
    assert [r.patterns for r in override([a, b], [newer])] == [["z"], ["y"]]
    assert [r.slug for r in select([a, b], only=["b", "a"], exclude=["a"])] == ["b"]
    assert pack_hash([a, b]) == pack_hash([b, a]) != pack_hash([newer, b])


@pytest.mark.parametrize(
    "pattern, want",
    [
        (r"\beval\s*\(", {("eval", False)}), (r"(?i)\bPassword\b", {("password", False), ("password", True)}), (r"(?:alpha|beta)x", {("alpha", False), ("beta", False)}), (r"(?:alpha|b)", None), (r"a{1,3}bcd?", None), (r"(?:exec){2}", {("exec", False)}),
        (r"(?:exec)?(", None), (r"[Tt]oken", {("oken", False)}), (r"(?i:KEY)=value", {("=value", False)}), (r"str(?:cpy|cat)\(", {("strc", False)}), (r"\d+", None), (r"(?P<n>named)", {("named", False)}), (r"ab", None), (r"(?i)stra\x{DF}e", None),
    ],
)
def test_literals_that_a_pattern_needs(pattern, want):
    found = literals.needed(pattern)
    if want is None:
        assert found is None
    else:
        assert found and found <= want


def test_literals_lose_no_match(spark):
    """Texts in which letters stand in other cases, as long s or Kelvin sign, or beside each other, with and without the index."""
    from gritstone.operators import scan

    rules = [Rule(f"r{i}", patterns=[p], snippet_before=0, snippet_after=0) for i, p in enumerate([r"(?i)\bsecret_key\b", r"pass(?:word|wd)", r"(?i)token|(?:api){2}", r"x(?i:mask)y", r"(?i)stra(?:ss|ß)e"])]
    texts = ["ſecret_Key SECRET_KEY", "passwd password PASSWORD", "TOKEN apiapi APIapi toKen", "xMaſKy XMASKY xmasky", "STRASSE straße ſtrasse", "", None, "nothing"]
    files = spark.createDataFrame([(f"f{i}", t and t.replace(" ", "\n")) for i, t in enumerate(texts)], "path string, content string")

    def hits():
        return sorted((r.path, r.slug, r.line) for r in scan.candidates(files, rules).collect())

    with_index = hits()
    real, scan.needed = scan.needed, lambda p: None
    try:
        assert hits() == with_index and len(with_index) >= 9
    finally:
        scan.needed = real


def test_patches_of_the_rule_table(spark):
    from gritstone.rules.load import patched, rules_of

    rules = [Rule("a", patterns=["x"], suppress_patterns=["s"], file_patterns=["*.py"]), Rule("b", patterns=["y"], requires=Gate(tech=["go"]))]
    schema = "ord int, slug string, decision string, values array<string>"
    rows = [(0, "a", "suppress_pattern", ["t"]), (1, "a", "suppress_pattern", ["s", "u"]), (2, "a", "file_patterns", ["*.go"]), (3, "a", "file_patterns", ["*.rs"]), (4, "b", "requires_tech", ["go", "gin"]), (5, "b", "require_content", ["need"]), (6, "b", "file_patterns", [])]
    got = {r.slug: r for r in rules_of(patched(frame(spark, rules), spark.createDataFrame(rows, schema)), rules)}
    assert got["a"].suppress_patterns == ["s", "t", "u"] and got["a"].file_patterns == ["*.rs"] and got["a"].patterns == ["x"]
    assert got["b"].requires.tech == ["go", "gin"] and got["b"].require_content == ["need"] and got["b"].file_patterns == []
    for bad in ((0, "none", "file_patterns", ["*"]), (0, "a", "delete", ["x"])):
        with pytest.raises(Exception, match="cannot apply a patch"):
            patched(frame(spark, rules), spark.createDataFrame([bad], schema)).collect()
    with pytest.raises(ValueError):
        rules_of(patched(frame(spark, rules), spark.createDataFrame([(0, "a", "suppress_pattern", [r"\C"])], schema)), rules)


def test_signs_alone_are_literals():
    assert literals.needed(r"(?i)\b[a-z0-9._%+-]+@[a-z0-9-]+\.[a-z]{2,}\b") == {("@", False)}
    assert literals.needed(r"[A-Z]{4,}!!") == {("!!", False)} and literals.needed(r"a b") == {("a b", False)} and literals.needed(r"ab") is None


def test_taint_patterns_are_literals_and_find_the_same_lines(spark):
    from pyspark.sql import functions as F

    from gritstone.functions import text

    rows = [(k, t) for k in ("go", "python", "rust", "none") for t in ("a\nx = os.environ\nq := r.Body\nJson <T>\ninput (", "nothing\nhere", "", None)]
    out = spark.createDataFrame(rows, "k string, t string").withColumn("n", text.tainted_lines(F.col("t"), text.lines(F.col("t")), F.col("k")))
    got = [r.n for r in out.collect()]
    assert got == [[3], [], [], None, [2, 5], [], [], None, [4], [], [], None, [2], [], [], None]
    # a pattern that a row chooses would be compiled for each line
    assert "CASE WHEN (k" not in out._jdf.queryExecution().analyzed().toString().split("RLIKE(", 1)[1].split(")", 1)[0] and out._jdf.queryExecution().analyzed().toString().count("RLIKE(") > 5


def test_a_filter_on_counts_does_not_evaluate_the_rules_again(spark):
    from gritstone.operators import scan
    from gritstone.plans.common import corpus_rules

    files = spark.createDataFrame([("a/b.py", "x\nWORD!! WORD!!\n\n"), ("a/c.py", None), ("a/d.py", "")], "path string, content string")
    dense = scan.density_of(files, corpus_rules()).where("per_kloc > 400")
    plan = dense._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Z]{4,}!!(?:") == scan.density_of(files, corpus_rules())._jdf.queryExecution().optimizedPlan().toString().count("[A-Z]{4,}!!(?:")
    assert [(r.path, r.loc, r.candidates) for r in dense.collect()] == [("a/b.py", 2, 1)]
