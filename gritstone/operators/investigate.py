"""From candidates to findings: the work queue, batches, the pluggable investigation, and what follows from its replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..schemas import FINDING, severity_rank
from .ordered import ranked

REPLY = f"batch_id long, path string, findings array<{FINDING}>, cost double, tokens long, duration_ms long, refused boolean, reason string"
CONFIDENCE = ("high", "medium", "low")


def work_queue(records: DataFrame, prefix: str = "", only: list[str] = (), skip: list[str] = (), direct: list[str] = (), marker: int | None = None, agent: str | None = None, limit: int | None = None) -> DataFrame:
    """The records to investigate, those with candidates first, then by path.

    Named paths are taken as they are. Otherwise a record needs candidates and a status of pending or error, must hold
    one of the `only` slugs and something besides the `skip` slugs, and must not have been seen by this wave's agent.
    """
    slugs = F.transform("candidates", lambda c: c["vulnSlug"])
    if direct:
        out = records.where(F.col("filePath").isin(*direct))
    else:
        out = records.where((F.size("candidates") > 0) & F.col("status").isin("pending", "error"))
        if only:
            out = out.where(F.exists(slugs, lambda s: s.isin(*only)))
        if skip:
            out = out.where(~F.forall(slugs, lambda s: s.isin(*skip)))
    if prefix:
        out = out.where(F.col("filePath").startswith(prefix))
    if marker is not None:
        seen = F.exists("analysisHistory", lambda h: (h["reinvestigateMarker"] == marker) & (h["agentType"] == (agent or "")) & (h["phase"] != "revalidate"))
        out = out.where(~F.coalesce(seen, F.lit(False)))
    out = out.orderBy(F.size("candidates") <= 0, "filePath")
    return out.limit(limit) if limit else out


def chunks(files: DataFrame, most: int, path: str = "path") -> DataFrame:
    """`files` with dir and chunk: each directory's files in path order, `most` to a chunk. Places come from sorted ranges of
    all files, so a directory with very many is in many tasks."""
    rows = ranked(files.withColumn("dir", paths.directory(F.col(path))), "dir", path, name="__at")
    first = rows.groupBy("dir").agg(F.min("__at").alias("__first"))
    return rows.join(first, "dir").withColumn("chunk", F.floor((F.col("__at") - F.col("__first")) / most).cast("int")).drop("__at", "__first")


#: Chunks in a block, which is packed in one row.
BLOCK = 256


def _pack(state: Column, n: Column, most: int) -> tuple[Column, Column, Column]:
    """Pack a chunk of `n` files in a state (id, held): its batch, and the state after it."""
    fits = state["held"] + n <= most
    mine = state["id"] + F.when(fits | (state["held"] == 0), 0).otherwise(1)
    return mine, F.when(fits, state["id"]).otherwise(mine + 1), F.when(fits, state["held"] + n).otherwise(0)


def batches(files: DataFrame, most: int, path: str = "path") -> DataFrame:
    """`files` with batch_id: chunks of directories in order, small neighbours packed together.

    A chunk that does not fit into the open batch closes it and is a batch of its own. What a batch is depends on all
    before it, but only through the number of files that it holds, and that is at most `most`. So a block of chunks is a
    table from that number to the batches it adds and the number after it; such tables can be put behind each other in
    any grouping. The blocks' tables are joined with those one, two, four, … blocks before them, until each covers all
    before it, and each block is then packed from its true start. No file is moved for that but by the last join.
    """
    most = max(1, most)
    rows = chunks(files, most, path)
    sizes = rows.groupBy("dir", "chunk").agg(F.count("*").cast("int").alias("n"))
    placed = ranked(sizes, "dir", "chunk").withColumn("block", F.floor(F.col("rank") / BLOCK))
    blocks = placed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("rank", "dir", "chunk", "n"))).alias("c")).checkpoint()
    after = lambda s, c: F.struct(*[x.alias(k) for k, x in zip(("id", "held"), _pack(s, c["n"], most)[1:])])
    state = lambda id_, held: F.struct(id_.cast("long").alias("id"), held.cast("int").alias("held"))
    ends = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda h: F.aggregate("c", state(F.lit(0), h), after))
    upto = blocks.select("block", F.posexplode(ends).alias("start", "end")).select("block", "start", "end.id", "end.held").checkpoint()
    far, last = 1, blocks.agg(F.max("block")).first()[0] or 0
    while far <= last:
        before = upto.select((F.col("block") + far).alias("block"), F.col("start").alias("from"), F.col("id").alias("more"), F.col("held").alias("start"))
        both = upto.join(before, ["block", "start"]).select("block", F.col("from").alias("start"), (F.col("id") + F.col("more")).alias("id"), "held")
        upto = upto.where(F.col("block") < far).unionByName(both).checkpoint()
        far *= 2
    starts = upto.where("start = 0").select((F.col("block") + 1).alias("block"), "id", "held")
    begin = F.struct(F.array().cast("array<bigint>").alias("ids"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.coalesce("held", F.lit(0)).cast("int").alias("held"))

    def place(s: Column, c: Column) -> Column:
        mine, id_, held = _pack(s, c["n"], most)
        return F.struct(F.array_append(s["ids"], mine).alias("ids"), id_.alias("id"), held.alias("held"))

    ids = blocks.join(starts, "block", "left").select("c", F.aggregate("c", begin, place, lambda s: s["ids"]).alias("ids"))
    ids = ids.select(F.explode(F.arrays_zip("c", "ids")).alias("x")).select("x.c.dir", "x.c.chunk", F.col("x.ids").alias("batch_id"))
    return rows.join(ids, ["dir", "chunk"])


#: Batches that go to Python in one group.
TOGETHER = 32


def investigate(batched: DataFrame, backend: Callable[[int, list[str], pd.DataFrame], dict]) -> DataFrame:
    """Run `backend(batch_id, paths, rows)` on each batch: REPLY, one row for each of the batch's files.

    The backend returns {results: [{filePath, findings}], cost, tokens, duration_ms, refused, reason}. A batch is one
    small group, and TOGETHER of them go to Python at once; files that the reply leaves out get no findings, costs are
    shared equally.
    """
    names = [f.split(":")[0] for f in ("severity", "vulnSlug", "title", "description", "lineNumbers", "recommendation", "confidence", "triage", "revalidation", "producedByRunId", "agreeingAgents")]

    def run(rows: pd.DataFrame) -> list[tuple]:
        batch, files = int(rows["batch_id"].iloc[0]), sorted(rows["path"])
        reply = backend(batch, files, rows)
        got: dict[str, list] = {p: [] for p in files}
        for r in reply.get("results", []):
            if r["filePath"] in got:
                got[r["filePath"]] += [{n: f.get(n) for n in names} for f in r.get("findings", [])]
        n = len(files)
        return [(batch, p, got[p], reply.get("cost", 0.0) / n, reply.get("tokens", 0) // n, reply.get("duration_ms", 0) // n, bool(reply.get("refused")), reply.get("reason", "")) for p in files]

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        # no row in two batches: each batch's rows are its own frame
        out = [x for _, own in rows.groupby("batch_id", sort=True, dropna=False) for x in run(own.reset_index(drop=True))]
        return pd.DataFrame(out, columns=["batch_id", "path", "findings", "cost", "tokens", "duration_ms", "refused", "reason"])

    return batched.groupBy(F.floor(F.col("batch_id") / TOGETHER)).applyInPandas(together, REPLY)


def replay(batched: DataFrame, replies: DataFrame) -> DataFrame:
    """(batch_id, paths, output) from recorded replies: the reply of the batch's place, whose paths must be the same.
    A missing or different one is an error."""
    own = batched.groupBy("batch_id").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    both = own.join(replies, F.col("batch_id") == F.col("position"), "left")
    problem = F.when(F.col("position").isNull(), F.concat(F.lit("no reply for batch "), F.col("batch_id").cast("string"))).when(F.sort_array("batch_paths") != F.col("paths"), F.concat(F.lit("paths differ in batch "), F.col("batch_id").cast("string")))
    return both.select("batch_id", "paths", F.when(problem.isNotNull(), F.raise_error(problem).cast("string")).otherwise(F.col("output")).alias("output"))


def weighted_pick(alternatives: DataFrame, seed: int = 7) -> DataFrame:
    """One alternative (position, ord, weight, output) of each position, with probability by weight. The draw comes from
    a hash that any engine with MD5 can repeat. Alternatives of one reply are few."""
    total = Window.partitionBy("position")
    upto = total.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("position").cast("string"))), 1, 13)
    u = F.conv(digits, 16, 10).cast("long") / float(1 << 52)
    rows = alternatives.withColumn("upto", F.sum("weight").over(upto)).withColumn("all", F.sum("weight").over(total)).where(F.col("upto") > u * F.col("all"))
    return rows.groupBy("position").agg(F.min_by("output", "ord").alias("output"))


def parse_reply(replies: DataFrame, column: str = "output") -> DataFrame:
    """The findings of a reply's JSON, fenced or not, one row each: (batch_id, path, finding)."""
    body = F.from_json(text.json_of(F.col(column)), f"struct<results:array<struct<filePath:string,findings:array<{FINDING}>>>>")
    rows = replies.select("batch_id", F.explode(body["results"]).alias("r"))
    return rows.select("batch_id", F.col("r.filePath").alias("path"), F.explode("r.findings").alias("finding"))


def validated(findings: DataFrame, files: DataFrame) -> DataFrame:
    """`findings` (batch_id, path, finding) with `problem`, null where the finding is sound: its file is of the batch,
    severity and confidence are known, title, description and slug are not blank, lines exist and lie in the file."""
    f = F.col("finding")
    known = files.select("batch_id", "path", F.col("loc"))
    rows = findings.join(known, ["batch_id", "path"], "left")
    blank = F.trim(F.coalesce(f["title"], F.lit(""))).isin("") | F.trim(F.coalesce(f["vulnSlug"], F.lit(""))).isin("") | F.trim(F.coalesce(f["description"], F.lit(""))).isin("")
    problem = (
        F.when(F.col("loc").isNull(), "file is not in the batch").when(severity_rank(f["severity"]) == 0, "unknown severity").when(~F.coalesce(f["confidence"].isin(*CONFIDENCE), F.lit(False)), "unknown confidence").when(blank, "blank field")
        .when(F.coalesce(F.size(f["lineNumbers"]), F.lit(0)) < 1, "no lines").when(F.exists(f["lineNumbers"], lambda n: (n < 1) | (n > F.col("loc"))), "line outside the file")
    )
    return rows.withColumn("problem", problem).drop("loc")


def strict_keys(json: Column, allowed: list[str]) -> Column:
    """Whether a JSON object has no other keys than these."""
    return F.size(F.array_except(F.json_object_keys(json), F.array(*[F.lit(k) for k in allowed]))) == 0


def append_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, findings): new findings behind the old, the first of each slug and title staying."""
    a = old.select("path", F.posexplode("findings").alias("i", "f")).withColumn("late", F.lit(0))
    b = new.select("path", F.posexplode("findings").alias("i", "f")).withColumn("late", F.lit(1))
    w = Window.partitionBy("path", "f.vulnSlug", "f.title").orderBy("late", "i")
    kept = a.unionByName(b).withColumn("n", F.row_number().over(w)).where("n = 1")
    got = kept.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("late", "i", F.to_json("f").alias("f")))), lambda x: F.from_json(x["f"], FINDING)).alias("findings"))
    names = old.select("path").unionByName(new.select("path")).distinct()
    return names.join(got, "path", "left").withColumn("findings", F.coalesce("findings", F.array().cast(f"array<{FINDING}>")))


def next_status(refused: Column, failed: Column, stopped: Column) -> Column:
    """Where a record that was being processed goes: back to pending when the run was stopped, to error on failure or
    refusal, else to analyzed."""
    return F.when(stopped, "pending").when(failed | refused, "error").otherwise("analyzed")


def apply_verdicts(findings: DataFrame, verdicts: DataFrame, force: bool = False) -> DataFrame:
    """`findings` (path, idx, verdict, …) with the verdicts (path, idx, verdict) of their places; judged ones are kept
    unless forced. Places that do not exist change nothing."""
    v = verdicts.select("path", "idx", F.col("verdict").alias("__new"))
    out = findings.join(v, ["path", "idx"], "left")
    return out.withColumn("verdict", F.coalesce("__new", "verdict") if force else F.coalesce("verdict", "__new")).drop("__new")


def skeptic(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What survives a second look: confirmed ones stay, with an adjusted severity where one is given; false alarms and
    fixed ones go; uncertain ones stay as LOW; those without a verdict stay. A reason is appended to the description."""
    v = verdicts.select("path", "idx", F.col("verdict").alias("__v"), F.col("adjusted").alias("__s"), F.col("reasoning").alias("__r"))
    rows = findings.join(v, ["path", "idx"], "left")
    rows = rows.where(~F.coalesce(F.col("__v").isin("false-positive", "fixed"), F.lit(False)))
    severity = F.when(F.col("__v") == "uncertain", "LOW").when((F.col("__v") == "true-positive") & (severity_rank(F.col("__s")) > 0), F.col("__s")).otherwise(F.col("severity"))
    note = F.when(F.col("__v").isin("true-positive", "uncertain") & (F.trim(F.coalesce("__r", F.lit(""))) != ""), F.concat("description", F.lit("\n\n[skeptic: "), "__v", F.lit("] "), "__r")).otherwise(F.col("description"))
    return rows.withColumn("severity", severity).withColumn("description", note).drop("__v", "__s", "__r")


def folded_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))


def consensus(findings: DataFrame) -> DataFrame:
    """(path, slug, lines, title, agents, n_agents, first_id) of findings (path, finding_id, slug, lines, title, agent):
    alike are those of one file, slug, set of lines and title but for case and blanks."""
    rows = findings.withColumn("lines", F.array_sort("lines")).withColumn("key", folded_title(F.col("title")))
    out = rows.groupBy("path", "slug", "lines", "key").agg(F.sort_array(F.collect_set("agent")).alias("agents"), F.min("finding_id").alias("first_id"), F.min_by("title", "finding_id").alias("title"))
    return out.withColumn("n_agents", F.size("agents").cast("long")).drop("key")


def prompt(files: DataFrame, candidates: DataFrame, tags: list[str], hints: dict[str, str], notes: dict[str, str]) -> DataFrame:
    """(batch_id, system, user): the framework hints of the tags in order, the notes of the batch's slugs, and for each
    file its candidates and numbered, redacted source."""
    head = "\n".join(f"- {hints[t]}" for t in tags if t in hints)
    note = F.array(*[F.struct(F.lit(k).alias("slug"), F.lit(v).alias("note")) for k, v in sorted(notes.items())]) if notes else None
    c = candidates.groupBy("path").agg(F.array_sort(F.collect_set(F.struct("line", "slug", "label"))).alias("c"))
    rows = files.join(c, "path", "left")
    listed = F.array_join(F.transform(F.coalesce("c", F.array().cast(rows.schema["c"].dataType)), lambda x: F.concat(F.lit("- line "), x["line"].cast("string"), F.lit(": "), x["slug"], F.lit(" ("), x["label"], F.lit(")"))), "\n")
    block = F.concat(F.lit("## "), F.col("path"), F.lit("\n"), listed, F.lit("\n\n"), text.numbered_source(F.col("content")), F.lit("\n"))
    rows = rows.select("batch_id", "path", block.alias("b"), F.transform("c", lambda x: x["slug"]).alias("s"))
    got = rows.groupBy("batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "b"))), lambda x: x["b"]), "\n").alias("user"), F.array_distinct(F.flatten(F.collect_list("s"))).alias("slugs"))
    used = F.array_join(F.transform(F.filter(note, lambda n: F.array_contains("slugs", n["slug"])), lambda n: F.concat(F.lit("- "), n["slug"], F.lit(": "), n["note"])), "\n") if notes else F.lit("")
    return got.select("batch_id", F.concat(F.lit(head), F.lit("\n"), used).alias("system"), "user")


# fixed values: what a second look may answer
VERDICTS = ("true-positive", "false-positive", "fixed", "uncertain")
RECHECK = "Check each finding against the file as it is now and answer with one of: " + ", ".join(VERDICTS) + ". Give a reason; give adjustedSeverity only where the severity should change."
DOUBT = "Try to refute each finding: look for the check, the escaping or the unreachable path that makes it harmless, and name it. Answer with one of: " + ", ".join(VERDICTS) + ". A finding that you cannot refute is a true-positive."
TRIAGE = "Triage one finding. Answer with priority (P0, P1, P2, skip), exploitability (trivial, moderate, difficult), impact (critical, high, medium, low) and a short reasoning."


def _described(f: Column) -> Column:
    shown = F.concat(F.lit("["), F.array_join(f["lines"].cast("array<string>"), " "), F.lit("]"))
    return F.concat(F.lit("severity="), f["severity"], F.lit(" slug="), f["slug"], F.lit(" lines="), shown, F.lit(" title="), text.redact(f["title"]))


def recheck_prompt(files: DataFrame, findings: DataFrame, doubt: bool = False) -> DataFrame:
    """(path, system, user): for each file with findings (path, idx, severity, slug, lines, title, description) its
    numbered, redacted source and its findings in order."""
    f = F.struct("idx", "severity", "slug", "lines", "title", "description")
    own = findings.groupBy("path").agg(F.array_sort(F.collect_list(f)).alias("f"))
    each = F.transform("f", lambda x: F.concat(F.lit("["), x["idx"].cast("string"), F.lit("] "), _described(x), F.lit("\n    description: "), text.redact(F.coalesce(x["description"], F.lit(""))), F.lit("\n")))
    user = F.concat(F.lit("File: "), F.col("path"), F.lit("\nCode:\n"), text.numbered_source(F.col("content")), F.lit("\n\nFindings to revalidate:\n"), F.array_join(each, ""))
    return files.join(own, "path").select("path", F.lit(DOUBT if doubt else RECHECK).alias("system"), user.alias("user"))


def triage_prompt(findings: DataFrame) -> DataFrame:
    """(path, idx, system, user) for each finding."""
    f = F.struct("severity", "slug", "lines", "title")
    user = F.concat(F.lit("File: "), F.col("path"), F.lit("\n"), _described(f), F.lit("\ndescription: "), text.redact(F.coalesce("description", F.lit(""))), F.lit("\n"))
    return findings.select("path", "idx", F.lit(TRIAGE).alias("system"), user.alias("user"))


def grep(files: DataFrame, pattern: str, most: int = 100) -> DataFrame:
    """(path, line, text) of the lines that an RE2 pattern hits, the first `most` in order."""
    from ..rules.regex import to_java

    rows = files.select("path", F.posexplode(text.lines(F.col("content"))).alias("i", "text")).where(F.col("text").rlike(to_java(pattern)))
    return rows.select("path", (F.col("i") + 1).alias("line"), "text").orderBy("path", "line").limit(most)


def callers(files: DataFrame, symbol: str, most: int = 100) -> DataFrame:
    return grep(files, rf"\b{''.join(c if c.isalnum() or c == '_' else chr(92) + c for c in symbol)}\s*\(", most)


def neighbours(files: DataFrame, places: DataFrame, radius: int = 10) -> DataFrame:
    """(path, line, at, text): the lines around places (path, line), at most 80 to each side."""
    radius = min(radius, 80)
    # a file's places meet it once, and only the lines around them leave it
    at = places.select("path", "line").distinct().groupBy("path").agg(F.collect_list("line").alias("__at"))
    rows = files.join(at, "path").select("path", "__at", text.lines(F.col("content")).alias("__l"))

    def around(line: Column, every: Column) -> Column:
        first, last = F.greatest(line - radius, F.lit(1)).cast("int"), F.least(line + radius, F.size(every)).cast("int")
        shown = F.slice(every, first, F.greatest(last - first + 1, F.lit(0)))
        return F.transform(shown, lambda x, i: F.struct(line.alias("line"), (first + i).alias("at"), x.alias("text")))

    each = F.flatten(F.transform("__at", lambda n: around(n, F.col("__l"))))
    return rows.select("path", F.explode(each).alias("x")).select("path", "x.line", "x.at", "x.text")


def turn_caps(turns: DataFrame, most: int = 8) -> DataFrame:
    """The first `most` turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def split_agents(runs: Iterator[str]) -> list[str]:
    """Agents of an ensemble, in order, without repetitions."""
    return list(dict.fromkeys(x.strip() for x in runs if x.strip()))
