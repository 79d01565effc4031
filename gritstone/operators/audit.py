"""Two matchers that need more than regular expressions: routes without an identity, and queries over syntax trees."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..rules.load import Rule
from .ordered import small_batches

# fixed values: a writing route, and the signs that a handler knows its caller
ROUTE = re.compile(r"""\.route\s*\(\s*"[^"]+"\s*,\s*(?:post|put|delete|patch)\s*\(\s*([A-Za-z_]\w*)\s*\)\s*\)""", re.S | re.A)
IDENTITY = re.compile(r"\b(?:authenticated|authentication|authcontext|authclaims|claims|principal|session|current_?user|identity)\b", re.I | re.A)
CHECK_CALL = re.compile(r"\b(?:require|verify|authorize|authenticate|ensure)[A-Za-z_]*\s*\(", re.I | re.A)
_TOKEN = re.compile(r"""\\.|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[{}]""", re.S)


def block_end(source: str, brace: int) -> int:
    """Where the block that opens at `brace` closes; quoted braces do not count."""
    depth = 0
    for m in _TOKEN.finditer(source, brace):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                return m.start()
    return len(source)


def open_routes(source: str) -> list[int]:
    """Lines of writing routes whose handler in the same file takes no identity and checks nothing; routes to handlers
    of other files count as open."""
    out = []
    for route in ROUTE.finditer(source):
        head = re.search(rf"(?:pub\s+)?async\s+fn\s+{re.escape(route[1])}\s*\((.*?)\)\s*(?:->[^{{]+)?\{{", source, re.S)
        if head and (IDENTITY.search(head[1]) or CHECK_CALL.search(source[head.end() : block_end(source, head.end() - 1)])):
            continue
        out.append(source.count("\n", 0, route.start()) + 1)
    return out


def route_audit(files: DataFrame, slug: str = "route-without-auth", label: str = "writing route without a known identity check") -> DataFrame:
    """Candidates of open_routes over Rust files (path, content). The files are filtered before Python sees any."""
    small_batches(files.sparkSession)

    @F.pandas_udf("array<int>")
    def look(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(open_routes)

    rows = files.where(F.col("path").endswith(".rs") & F.col("content").rlike(r"\.route\s*\("))
    rows = rows.select("path", text.normalised(F.col("content")).alias("content")).withColumn("line", F.explode(look("content")))
    return rows.select("path", F.lit(slug).alias("slug"), "line", F.lit(label).alias("label"), text.redact(text.snippet(text.lines(F.col("content")), F.col("line"), 2, 10)).alias("snippet"))


@dataclass
class Shape:
    """A node of a tree query: a kind or `_` (or alternatives), fields and children that it must have, and a capture."""

    kinds: list[str] = field(default_factory=list)
    fields: list[tuple[str, Shape]] = field(default_factory=list)
    children: list[Shape] = field(default_factory=list)
    options: list[Shape] = field(default_factory=list)
    capture: str = ""


@dataclass
class Query:
    shape: Shape
    predicates: list[tuple[str, str, str]]
    captures: list[str]


_LEX = re.compile(r"""\s*(?:;[^\n]*\n\s*)*("(?:\\.|[^"\\])*"|[()\[\]]|@[\w.-]+|#[\w-]+\?|[\w-]+:|[\w.-]+|\S)""")
PREDICATES = ("eq?", "not-eq?", "match?", "not-match?")


def parse_query(source: str) -> Query:
    """An S-expression query; ValueError for open brackets, unknown predicates and queries without a capture."""
    tokens = [m[1] for m in _LEX.finditer(source.strip())]
    at = 0
    predicates: list[tuple[str, str, str]] = []
    captures: list[str] = []

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise ValueError("query ends early")
        at += 1
        return tokens[at - 1]

    def captured(s: Shape) -> Shape:
        while peek().startswith("@"):
            s.capture = take()[1:]
            captures.append(s.capture)
        return s

    def node() -> Shape:
        t = take()
        if t == "[":
            s = Shape()
            while peek() != "]":
                s.options.append(node())
            take()
            return captured(s)
        if t in ("_",):
            return captured(Shape(["_"]))
        if t != "(":
            raise ValueError(f"unexpected {t}")
        s = Shape([take()])
        while peek() != ")":
            t = peek()
            if t == "(" and at + 1 < len(tokens) and tokens[at + 1].startswith("#"):
                predicate()
            elif t.endswith(":"):
                name = take()[:-1]
                s.fields.append((name, node()))
            elif t.startswith("@"):
                captures.append(take()[1:])
                s.capture = captures[-1]
            else:
                s.children.append(node())
        take()
        return captured(s)

    def predicate() -> None:
        take()
        name = take()[1:]
        if name not in PREDICATES:
            raise ValueError(f"unsupported predicate {name}")
        a, b = take(), take()
        if take() != ")":
            raise ValueError("predicates take two arguments")
        predicates.append((name, a.lstrip("@"), b[1:-1].replace('\\"', '"').replace("\\\\", "\\") if b[0] == '"' else "@" + b.lstrip("@")))

    root = node()
    while at < len(tokens):
        if peek() == "(":
            predicate()
        else:
            raise ValueError(f"unexpected {peek()}")
    if not captures:
        raise ValueError("a query needs a capture")
    return Query(root, predicates, captures)


def _fits(node: ast.AST | str, s: Shape, got: dict) -> Iterator[dict]:
    """Every way in which a node has a shape, as captures."""
    if s.options:
        for o in s.options:
            for g in _fits(node, o, got):
                yield g | ({s.capture: node} if s.capture else {})
        return
    if s.kinds != ["_"] and (not isinstance(node, ast.AST) or type(node).__name__ != s.kinds[0]):
        return
    ways = [got | ({s.capture: node} if s.capture else {})]
    for name, sub in s.fields:
        value = getattr(node, name, None)
        values = value if isinstance(value, list) else [value] if value is not None else []
        ways = [g for w in ways for v in values for g in _fits(v, sub, w)]
    for sub in s.children:
        ways = [g for w in ways for v in (ast.iter_child_nodes(node) if isinstance(node, ast.AST) else ()) for g in _fits(v, sub, w)]
    yield from ways


def run_query(tree: ast.AST, query: Query, source: str) -> Iterator[dict]:
    """The captures of every match that passes the predicates; a capture that is absent compares as empty."""

    def words(x) -> str:
        return x if isinstance(x, str) else (ast.get_source_segment(source, x) or "") if isinstance(x, ast.AST) else ""

    for node in ast.walk(tree):
        for got in _fits(node, query.shape, {}):
            for name, a, b in query.predicates:
                left, right = words(got.get(a)), words(got.get(b[1:])) if b.startswith("@") else b
                if (left == right if "eq" in name else re.search(right, left) is not None) == name.startswith("not-"):
                    break
            else:
                yield got


def tree_candidates(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Candidates of the rules' tree patterns. Python files have a parser here; files of other languages have none and
    give nothing, as files do that cannot be parsed. Paths and cheap patterns are tested before anything is parsed."""
    plans = [(r.slug, t.label or r.label or r.slug, parse_query(t.query), t.primary_capture or parse_query(t.query).captures[0], t.snippet_capture, r, t) for r in rules for t in r.tree_patterns if t.language == "python"]
    from .scan import path_sets, prepared, rule_tests

    own = [p[5] for p in plans]
    sets = path_sets(own)
    rows = prepared(files.where(paths.tree_language(F.col("path")) == "python"), own)
    if not plans:
        return rows.limit(0).select("path", F.lit("").alias("slug"), F.lit(0).alias("line"), F.lit("").alias("label"), F.lit("").alias("snippet"))
    from ..rules.regex import any_of

    def wanted(r: Rule, t):
        ok = F.expr(rule_tests(r, sets))
        return ok & F.col("content").rlike(any_of(t.prefilter_patterns)) if t.prefilter_patterns else ok

    mask = F.array(*[wanted(p[5], p[6]) for p in plans])
    rows = rows.withColumn("mask", mask).where(F.exists("mask", lambda x: x))
    compiled = [p[:5] for p in plans]

    small_batches(files.sparkSession)

    @F.pandas_udf("array<struct<plan:int,line:int,at:int>>")
    def look(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, masks in parts:
            out = []
            for source, on in zip(sources, masks):
                found = []
                try:
                    tree = ast.parse(source)
                except (SyntaxError, ValueError, RecursionError):
                    out.append(found)
                    continue
                for k, (_, _, query, primary, shown) in enumerate(compiled):
                    if on[k]:
                        for got in run_query(tree, query, source):
                            node = got.get(primary)
                            if isinstance(node, ast.AST) and hasattr(node, "lineno"):
                                found.append({"plan": k, "line": node.lineno, "at": getattr(got.get(shown), "lineno", node.lineno)})
                out.append(found)
            yield pd.Series(out)

    rows = rows.select("path", text.lines(F.col("content")).alias("l"), F.explode(look("content", "mask")).alias("m"))
    parts = None
    for k, (slug, label, *_, rule, _) in enumerate(plans):
        shown = text.snippet(F.col("l"), F.col("m.at"), rule.snippet_before, rule.snippet_after)
        one = rows.where(F.col("m.plan") == k).select("path", F.lit(slug).alias("slug"), F.col("m.line").alias("line"), F.lit(label).alias("label"), shown.alias("snippet"))
        if rule.suppress_patterns:
            one = one.where(~F.col("snippet").rlike(any_of(rule.suppress_patterns)))
        parts = one if parts is None else parts.unionByName(one)
    return parts.dropDuplicates(["path", "slug", "label", "line"]).withColumn("snippet", text.redact(F.col("snippet")))
