"""Changes inside whole records: second looks, triage, agreement of several agents, and secrets. The arrays of a record
are rewritten where they are; nothing is taken apart and put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import TRIAGE, VERDICT
from .investigate import folded_title

#: (filePath, ord, index, …): answers to the findings of a record by their places; ord tells which came last.
VERDICT_ANSWERS = "filePath string, index int, verdict string, reasoning string, adjustedSeverity string"
TRIAGE_ANSWERS = "filePath string, index int, priority string, exploitability string, impact string, reasoning string"


def _clean(x: Column, *names: str) -> Column:
    for name in names:
        x = x.withField(name, text.redact(x[name]))
    return x


def clean_finding(f: Column) -> Column:
    """A finding without secrets in what agents wrote: title, description, recommendation and the reasons of later looks."""
    f = _clean(f, "title", "description", "recommendation")
    return f.withField("triage", _clean(f["triage"], "reasoning")).withField("revalidation", _clean(f["revalidation"], "reasoning"))


def _clean_entry(h: Column) -> Column:
    refusal = _clean(h["refusal"], "reason", "raw")
    refusal = refusal.withField("skipped", F.transform(refusal["skipped"], lambda s: _clean(s, "reason")))
    return _clean(h, "codexStderr").withField("refusal", refusal)


def redacted(records: DataFrame) -> DataFrame:
    """Records without secrets in any text that a scan or an agent has put there. It is to stand wherever records are read
    or written: older ones may hold what is redacted now. Twice is as once; nulls stay null."""
    return records.withColumns({
        "candidates": F.transform("candidates", lambda c: _clean(c, "snippet", "matchedPattern")), "findings": F.transform("findings", clean_finding), "analysisHistory": F.transform("analysisHistory", _clean_entry),
    })


def _answered(records: DataFrame, answers: DataFrame, field: str, value: Column, kind: str, force: bool) -> DataFrame:
    """`field` of each finding that an answer names set to `value`. A record's answers are one map by place, no larger
    than its findings; of several to one place the last counts, and places that do not exist change nothing."""
    last = answers.where("index >= 0").groupBy("filePath", "index").agg(F.max_by(value.cast(kind), "ord").alias("v"))
    by = last.groupBy("filePath").agg(F.map_from_entries(F.collect_list(F.struct("index", "v"))).alias("__by"))

    def given(f: Column, i: Column) -> Column:
        new = F.try_element_at("__by", i)
        free = new.isNotNull() if force else new.isNotNull() & f[field].isNull()
        return F.when(free, f.withField(field, new)).otherwise(f)

    out = records.join(by, "filePath", "left")
    return out.withColumn("findings", F.when(F.col("__by").isNull(), F.col("findings")).otherwise(F.transform("findings", given))).select(records.columns)


def revalidated(records: DataFrame, answers: DataFrame, run: str, at: str, model: str = "replay", force: bool = False) -> DataFrame:
    """`records` with the verdicts of `answers` (VERDICT_ANSWERS and ord): verdict, redacted reasoning, adjusted severity,
    time, run and model. Findings that have a verdict keep it unless forced."""
    value = F.struct(F.col("verdict"), text.redact(F.col("reasoning")).alias("reasoning"), F.col("adjustedSeverity"), F.lit(at).alias("revalidatedAt"), F.lit(run).alias("runId"), F.lit(model).alias("model"))
    return _answered(records, answers, "revalidation", value, VERDICT, force)


def triaged(records: DataFrame, answers: DataFrame, at: str, model: str = "replay", force: bool = False) -> DataFrame:
    """`records` with the priorities of `answers` (TRIAGE_ANSWERS and ord). Findings that have one keep it unless forced."""
    value = F.struct("priority", "exploitability", "impact", text.redact(F.col("reasoning")).alias("reasoning"), F.lit(at).alias("triagedAt"), F.lit(model).alias("model"))
    return _answered(records, answers, "triage", value, TRIAGE, force)


def merged_agents(records: DataFrame, agents: dict[str, str]) -> DataFrame:
    """`records` in which the findings of an ensemble's runs (`agents`: run to agent) are one where they are alike: of equal
    slug, lines in any order, and title but for case and blanks. The first stays, with all their agents in order; findings
    of other runs stay as they are. An ensemble has a few runs."""
    known = F.create_map(*[F.lit(x) for pair in agents.items() for x in pair])
    agent = lambda f: F.try_element_at(known, f["producedByRunId"])
    name = lambda f: F.struct(f["vulnSlug"].alias("slug"), F.array_sort(f["lineNumbers"]).alias("lines"), folded_title(f["title"]).alias("title"), agent(f).alias("agent"))
    same = lambda a, b: a["slug"].eqNullSafe(b["slug"]) & a["lines"].eqNullSafe(b["lines"]) & a["title"].eqNullSafe(b["title"])
    named = records.withColumn("__k", F.transform("findings", name))

    def one(f: Column, i: Column) -> Column:
        mine = F.get("__k", i)
        alike = F.filter("__k", lambda k: k["agent"].isNotNull() & same(k, mine))
        said = F.array_sort(F.array_distinct(F.filter(F.transform(alike, lambda k: k["agent"]), lambda a: a != "")))
        return F.when(mine["agent"].isNull(), f).otherwise(f.withField("agreeingAgents", said))

    def first(f: Column, i: Column) -> Column:
        mine = F.get("__k", i)
        return mine["agent"].isNull() | ~F.exists(F.slice("__k", F.lit(1), i), lambda k: k["agent"].isNotNull() & same(k, mine))

    return named.withColumn("findings", F.filter(F.transform("findings", one), first)).select(records.columns)
