"""Columns over texts: lines, line numbers of matches, snippets, redaction, taint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.literals import needed
from ..rules.regex import any_of, to_java

SENTINEL = "\u0001"

REDACTED = "[REDACTED]"
# fixed values: the patterns of secrets, applied in this order
REDACTIONS = [
    (r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", REDACTED),
    (r"\beyJ[a-zA-Z0-9_-]{8,}\.[a-zA-Z0-9_-]{8,}\.[a-zA-Z0-9_-]{8,}\b", REDACTED),
    (r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-(?:proj-|live-|test-)?[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{35}|AKIA[0-9A-Z]{16})\b", REDACTED),
    (r"""(?i)(\b(?:authorization|proxy-authorization)\s*[:=]\s*(?:bearer|basic)\s+)[^\s"',;]+""", "$1" + REDACTED),
    (r"""(?i)(\b(?:api[_-]?key|access[_-]?token|refresh[_-]?token|client[_-]?secret|secret(?:_value)?|password|private[_-]?key|credential|token|key)\s*[:=]\s*)(?:\[REDACTED\]|\"[^\"]*\"|'[^']*'|`[^`]*`|[^\s,;)}\]]+)""", "$1" + REDACTED),
]
#: Texts without any of these cannot hold a secret; the test is much cheaper than the five replacements.
_HINT = r"(?iu)private key|eyJ|gh[pousr]_|xox|sk-|AIza|AKIA|authorization|key|token|secret|password|credential"

# fixed values: expressions that bring input into a program, by language
TAINT = {
    "go": [r"\br\s*\.URL\s*\.Query\s*\(", r"\br\s*\.Form\b", r"\br\s*\.PostForm\b", r"\br\s*\.Header\s*\.Get\s*\(", r"\br\s*\.Body\b", r"\brequest\s*\.URL\s*\.Query\s*\(", r"\bflag\s*\.(?:Arg|Args|String|Bool|Int|Float64)\s*\(", r"\bos\s*\.Args\b", r"\bos\s*\.Getenv\s*\("],
    "typescript": [r"\breq\s*\.(?:body|query|params|headers|cookies|url)\b", r"\brequest\s*\.(?:body|query|params|headers|cookies|url)\b", r"\bctx\s*\.(?:request|req|params|query)\b", r"\bprocess\s*\.env\b", r"\bprocess\s*\.argv\b", r"\blocation\s*\.(?:search|hash|pathname|href)\b", r"\bwindow\s*\.location\b"],
    "javascript": [r"\breq\s*\.(?:body|query|params|headers|cookies|url)\b", r"\brequest\s*\.(?:body|query|params|headers|cookies|url)\b", r"\bprocess\s*\.env\b", r"\bprocess\s*\.argv\b", r"\blocation\s*\.(?:search|hash|pathname|href)\b"],
    "python": [r"\brequest\s*\.(?:args|form|json|values|cookies|headers|data|files)\b", r"\bos\s*\.environ\b", r"\bos\s*\.getenv\s*\(", r"\bsys\s*\.argv\b", r"\binput\s*\(", r"\bflask\.request\b"],
    "ruby": [r"\bparams\s*\[", r"\brequest\s*\.(?:parameters|env|headers|cookies)\b", r"\bENV\s*\[", r"\bARGV\b"],
    "java": [r"\.getParameter\s*\(", r"\.getHeader\s*\(", r"\.getQueryString\s*\(", r"\.getInputStream\s*\(", r"\.getReader\s*\(", r"@RequestParam\b", r"@RequestBody\b", r"@PathVariable\b", r"@RequestHeader\b", r"System\s*\.getenv\s*\("],
    "kotlin": [r"\.getParameter\s*\(", r"\.getHeader\s*\(", r"@RequestParam\b", r"@RequestBody\b", r"@PathVariable\b", r"System\s*\.getenv\s*\(", r"\bintent\s*\.(?:getStringExtra|getData|extras)\b"],
    "rust": [r"\bweb::Path\s*<", r"\bweb::Query\s*<", r"\bweb::Json\s*<", r"\bweb::Form\s*<", r"\bJson\s*<", r"\bForm\s*<", r"\bQuery\s*<", r"\bPath\s*<", r"\benv::args\s*\(", r"\benv::var\s*\(", r"\breq\s*\.headers\s*\("],
    "php": [r"\$_GET\s*\[", r"\$_POST\s*\[", r"\$_REQUEST\s*\[", r"\$_COOKIE\s*\[", r"\$_SERVER\s*\[", r"\$_FILES\s*\[", r"getenv\s*\("],
    "swift": [r"URLComponents\s*\(", r"\.queryItems\b", r"\bProcessInfo\s*\.processInfo\s*\.environment\b", r"CommandLine\.arguments\b", r"UserDefaults\s*\."],
    "csharp": [r"\.Request\s*\.(?:Query|Form|Headers|Cookies|Body)\b", r"\[FromBody\]", r"\[FromQuery\]", r"\[FromRoute\]", r"Environment\s*\.GetEnvironmentVariable\s*\("],
}
TAINT_ANY = [r"\breq\s*\.(?:body|query|params|headers|cookies)\b", r"\brequest\s*\.(?:args|form|json|parameters|getParameter)\b", r"\.getenv\s*\(", r"\bos\s*\.environ\b", r"\bENV\s*\[", r"\$_(?:GET|POST|REQUEST|COOKIE|SERVER)\s*\[", r"@RequestParam\b", r"@RequestBody\b"]


def normalised(text: Column) -> Column:
    """Line ends as "\\n"; a carriage return on its own stays."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    """Lines of a file without its trailing line ends; 0 for an empty one."""
    body = F.regexp_replace(text, r"\n+\z", "")
    return F.when(body == "", F.lit(0)).otherwise(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1)


def match_lines(text: Column, pattern: str) -> Column:
    """The 1-based line of every match of an RE2 pattern, in order, matches leftmost and not overlapping.

    A sentinel is put before every match, and each line gives its number as often as it holds the sentinel.
    """
    clean = F.replace(text, F.lit(SENTINEL), F.lit(" "))
    marked = F.regexp_replace(clean, F.lit(to_java(pattern)), F.lit(SENTINEL + "$0"))
    held = lambda x: F.length(x) - F.length(F.replace(x, F.lit(SENTINEL), F.lit("")))
    return F.flatten(F.transform(F.split(marked, "\n", -1), lambda x, i: F.array_repeat(i + 1, held(x))))


def snippet(all_lines: Column, line: Column, before: int, after: int) -> Column:
    """The lines from `before` above to `after` below, clamped to the file."""
    first = F.greatest(line - before, F.lit(1))
    last = F.least(line + after, F.size(all_lines))
    return F.array_join(F.slice(all_lines, first, last - first + 1), "\n")


def redact(text: Column) -> Column:
    """Secrets replaced; doing it twice changes nothing more."""
    out = text
    for pattern, by in REDACTIONS:
        out = F.regexp_replace(out, F.lit(to_java(pattern)), F.lit(by))
    return F.when(text.rlike(_HINT), out).otherwise(text)


def tainted_lines(content: Column, all_lines: Column, language: Column) -> Column:
    """The 1-based lines of `content` that bring input into the program, by the patterns of `language`, generic where it has
    none. Each language's patterns are a literal, as a pattern that comes with the row is compiled for every line; lines are
    only searched in a text that holds a literal which one of the patterns needs."""

    def hits(patterns: list[str]) -> Column:
        found = F.filter(F.transform(all_lines, lambda x, i: F.when(x.rlike(any_of(patterns)), i + 1)), lambda i: i.isNotNull())
        words = [needed(p) for p in patterns]
        if not all(words) or any(folded for w in words for _, folded in w):
            return found
        may = reduce(lambda a, b: a | b, [F.contains(content, F.lit(x)) for x in sorted({x for w in words for x, _ in w})])
        return F.when(may, found).otherwise(F.when(content.isNotNull(), F.array().cast("array<int>")))

    out = F.when(F.lit(False), F.array().cast("array<int>"))
    for name, patterns in TAINT.items():
        out = out.when(language == name, hits(patterns))
    return out.otherwise(hits(TAINT_ANY))


def near(found: Column, line: Column, radius: int) -> Column:
    """Whether any of the lines `found` is within `radius` of `line`."""
    return F.exists(found, lambda t: F.abs(t - line) <= radius)


def json_of(text: Column) -> Column:
    """The JSON inside a reply: a json fence, any fence, or from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```json\s*\n?(.*?)```", 1)
    other = F.regexp_extract(text, r"(?s)```[A-Za-z0-9_-]*\s*\n?(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    found = F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(other, F.lit("")), F.nullif(braces, F.lit("")))
    return F.regexp_replace(found, r"\A\s+|\s+\z", "")


def numbered_source(text: Column) -> Column:
    """Redacted text with a number of five places before each line."""
    return F.array_join(F.transform(lines(redact(text)), lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 5, " "), F.lit(" "), x)), "\n")


def diff_files(diff: Column) -> Column:
    """The distinct safe paths that a unified diff touches, in order."""
    heads = F.filter(lines(diff), lambda x: x.startswith("+++ b/") | x.rlike(r"^diff --git a/.* b/"))
    paths = F.transform(heads, lambda x: F.when(x.startswith("+++ b/"), F.substring(x, 7, 1 << 20)).otherwise(F.regexp_extract(x, r" b/(.*)$", 1)))
    return F.array_distinct(F.filter(paths, safe_path))


def safe_path(path: Column) -> Column:
    """Relative, with forward slashes, without empty, dot or dot-dot segments and NUL."""
    return ~path.rlike(r"\A\z|\A/|\A[A-Za-z]:|\\|\x00|//|/\z|(?:\A|/)\.{1,2}(?:/|\z)")
