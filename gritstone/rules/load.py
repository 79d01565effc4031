"""Rule packs: TOML in, checked rules out; selection, overrides, the pack's hash and lint."""

from __future__ import annotations

import hashlib
import json
import tomllib
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .regex import UnsupportedPattern, glob_to_java, to_java

TIERS = {"precise": 0, "normal": 1, "noisy": 2}
PACKS = Path(__file__).parent / "packs"


@dataclass
class Gate:
    tech: list[str] = field(default_factory=list)
    sentinel_files: list[str] = field(default_factory=list)
    sentinel_contains: list[str] = field(default_factory=list)


@dataclass
class TreePattern:
    language: str
    query: str
    label: str = ""
    primary_capture: str = ""
    snippet_capture: str = ""
    prefilter_patterns: list[str] = field(default_factory=list)


@dataclass
class Rule:
    slug: str
    description: str = ""
    noise_tier: str = "normal"
    file_patterns: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    tree_patterns: list[TreePattern] = field(default_factory=list)
    suppress_patterns: list[str] = field(default_factory=list)
    require_content: list[str] = field(default_factory=list)
    exclude_path_patterns: list[str] = field(default_factory=list)
    snippet_before: int = 1
    snippet_after: int = 5
    label: str = ""
    require_taint_within: int = 0
    requires: Gate = field(default_factory=Gate)

    def check(self) -> Rule:
        """Raise ValueError where the rule cannot run."""
        if not self.slug.strip():
            raise ValueError("a rule needs a slug")
        if not self.patterns and not self.tree_patterns:
            raise ValueError(f"{self.slug}: no patterns")
        if self.noise_tier not in TIERS:
            raise ValueError(f"{self.slug}: unknown tier {self.noise_tier}")
        for p in (*self.patterns, *self.suppress_patterns, *self.require_content, *self.exclude_path_patterns, *self.requires.sentinel_contains):
            try:
                to_java(p)
            except UnsupportedPattern as e:
                raise ValueError(f"{self.slug}: {p}: {e}") from e
        for g in self.file_patterns:
            glob_to_java(g)
        return self


def rule_of(row: dict) -> Rule:
    """A rule of one TOML table; a snippet size of 0 counts as unset, an empty tier as normal."""
    known = {k: v for k, v in row.items() if k in Rule.__dataclass_fields__}
    known["requires"] = Gate(**row.get("requires", {}))
    known["tree_patterns"] = [TreePattern(**x) for x in row.get("tree_patterns", [])]
    known["noise_tier"] = row.get("noise_tier") or "normal"
    known["snippet_before"] = row.get("snippet_before") or 1
    known["snippet_after"] = row.get("snippet_after") or 5
    return Rule(**known).check()


def read_packs(paths: Iterable[Path] | None = None) -> list[Rule]:
    """The rules of packs in order; a later rule of one slug replaces the earlier one in its place."""
    found: dict[str, Rule] = {}
    for path in sorted(PACKS.glob("*.toml")) if paths is None else paths:
        for row in tomllib.loads(Path(path).read_text(encoding="utf-8")).get("rule", []):
            rule = rule_of(row)
            found[rule.slug] = rule
    return list(found.values())


def override(rules: list[Rule], more: Iterable[Rule]) -> list[Rule]:
    found = {r.slug: r for r in rules}
    found.update({r.slug: r for r in more})
    return list(found.values())


def select(rules: list[Rule], only: Iterable[str] = (), exclude: Iterable[str] = ()) -> list[Rule]:
    """Without the excluded slugs, and then only the named ones where any are named."""
    only, exclude = set(only), set(exclude)
    return [r for r in rules if r.slug not in exclude and (not only or r.slug in only)]


def pack_hash(rules: list[Rule]) -> str:
    """A digest of all rules, whatever their order."""
    h = hashlib.sha256()
    for r in sorted(rules, key=lambda r: r.slug):
        h.update(r.slug.encode() + b"\n" + json.dumps(asdict(r), sort_keys=True).encode() + b"\0")
    return h.hexdigest()


def frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a small table, one row each, in order."""
    rows = [(i, r.slug, r.description, r.noise_tier, TIERS[r.noise_tier], r.file_patterns, r.patterns, r.suppress_patterns, r.require_content, r.exclude_path_patterns, r.snippet_before, r.snippet_after, r.label, r.require_taint_within, r.requires.tech, r.requires.sentinel_files, r.requires.sentinel_contains) for i, r in enumerate(rules)]
    return spark.createDataFrame(
        rows,
        "ord int, slug string, description string, noise_tier string, tier_rank int, file_patterns array<string>, patterns array<string>, suppress_patterns array<string>, require_content array<string>, exclude_path_patterns array<string>, snippet_before int, snippet_after int, label string, require_taint_within int, tech array<string>, sentinel_files array<string>, sentinel_contains array<string>",
    )


#: What a decision about a rule changes: the field of its row, and whether values are added or replace what is there.
DECISIONS = {"suppress_pattern": ("suppress_patterns", "add"), "require_content": ("require_content", "add"), "file_patterns": ("file_patterns", "replace"), "requires_tech": ("tech", "add")}


def patched(rules: DataFrame, patches: DataFrame) -> DataFrame:
    """`rules` (of frame()) after patches (ord, slug, decision, values) of DECISIONS, in order. Values that a rule has are
    not added again; of several that replace the last counts; null and empty values change nothing. A patch of an unknown
    decision, or of a rule that is not there, is an error."""
    unknown = F.raise_error(F.concat(F.lit("cannot apply a patch to "), F.coalesce("slug", F.lit("?")), F.lit(": "), F.coalesce("decision", F.lit("?")))).cast("string")
    known = patches.join(rules.select("slug", F.lit(True).alias("__rule")), "slug", "left")
    known = known.withColumn("decision", F.when(F.col("__rule") & F.col("decision").isin(*DECISIONS), F.col("decision")).otherwise(unknown)).where(F.size("values") > 0)
    per = lambda d: F.array_sort(F.collect_list(F.when(F.col("decision") == d, F.struct("ord", "values"))))
    by = known.groupBy("slug").agg(*[F.transform(per(d), lambda x: x["values"]).alias(f"__{d}") for d in DECISIONS])
    out = rules.join(by, "slug", "left")
    for decision, (field, how) in DECISIONS.items():
        told = F.coalesce(f"__{decision}", F.array().cast("array<array<string>>"))
        more = F.array_except(F.flatten(told), F.col(field))
        out = out.withColumn(field, F.concat(field, more) if how == "add" else F.coalesce(F.try_element_at(told, F.lit(-1)), F.col(field)))
    return out.select(rules.columns)


def rules_of(table: DataFrame, originals: list[Rule]) -> list[Rule]:
    """The rules of a table like frame()'s, checked again; what a row does not have is the original's."""
    have = {r.slug: r for r in originals}
    rows = [r.asDict() for r in table.orderBy("ord").collect()]  # a row a rule
    gate = ("tech", "sentinel_files", "sentinel_contains")
    return [replace(have[r["slug"]], **{k: v for k, v in r.items() if k in Rule.__dataclass_fields__}, requires=Gate(*[r[k] for k in gate])).check() for r in rows]


def lint(rows: list[dict]) -> list[tuple[str, str]]:
    """(slug, problem) of raw rule tables: what would not load, repeated slugs, noisy rules without a gate, globs that
    take every file, patterns that can match nothing."""
    import re

    out, seen = [], set()
    for row in rows:
        slug = row.get("slug", "")
        if slug in seen:
            out.append((slug, "duplicate slug"))
        seen.add(slug)
        try:
            rule = rule_of(row)
        except (ValueError, TypeError) as e:
            out.append((slug, str(e)))
            continue
        if rule.noise_tier == "noisy" and not (rule.requires.tech or rule.requires.sentinel_files or rule.require_content):
            out.append((slug, "noisy without a gate or required content"))
        if any(g in ("*", "**", "**/*") for g in rule.file_patterns):
            out.append((slug, "glob takes every file"))
        for p in rule.patterns:
            try:
                if re.compile(p).match(""):
                    out.append((slug, "pattern can match nothing"))
            except re.error:
                pass
    return out
