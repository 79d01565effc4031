"""What an investigator may look at, and the bounded loop in which it asks for it."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import REDACTIONS
from .ordered import small_batches

# fixed values: bytes of a source and of an answer, lines to each side, turns and calls; texts of answers and refusals
MOST_BYTES = 16 * 1024
MOST_RADIUS = 80
MOST_TURNS = 8
MOST_CALLS = 8
NO_LINES = "{}: no lines in requested range\n"
CUT_ANSWER = "results truncated - refine your query\n"
CUT_SOURCE = "source truncated at tool byte limit\n"
COST_CAP = "cost cap reached during agentic investigation"
CALL_CAP = "tool call cap reached during agentic investigation"
TURN_CAP = "max tool turns reached"
NO_CALL = "model returned no tool call"
TEXT_ONLY = "model returned text without report_findings"
REPORT = "report_findings"

_SECRETS = [(re.compile(p), by.replace("$1", r"\1")) for p, by in REDACTIONS]


def redacted(text: str) -> str:
    for pattern, by in _SECRETS:
        text = pattern.sub(by, text)
    return text


def shown(path: str, content: str, first: int = 0, last: int = 0) -> str:
    """Numbered, redacted lines `first` to `last` of a file's first bytes; 0 stands for the file's own ends."""
    source = content.encode("utf-8", "surrogatepass")
    lines = source[:MOST_BYTES].decode("utf-8", "replace").removesuffix("\n").split("\n") if source else []
    first = max(first, 1)
    if last < 1 or last > len(lines):
        last = len(lines)
    if first > last:
        return NO_LINES.format(path)
    out = [f"{path}:{first}-{last}\n"]
    size = len(out[0].encode())
    for n in range(first, last + 1):
        out.append(f"{n:6d}  {redacted(lines[n - 1])}\n")
        size += len(out[-1].encode("utf-8", "replace"))
        if size >= MOST_BYTES:
            out.append(CUT_ANSWER)
            break
    if len(source) > MOST_BYTES:
        out.append(CUT_SOURCE)
    return "".join(out)


def _shown(path: pd.Series, content: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([shown(p, c or "", int(a), int(b)) for p, c, a, b in zip(path, content, first, last)], dtype=object)


def read_file(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (path, first, last) with `shown`, the answer to each; files that do not exist have none."""
    small_batches(files.sparkSession)
    rows = wanted.join(files.select("path", F.substring("content", 1, MOST_BYTES + 1).alias("__c")), "path")
    return rows.withColumn("shown", F.pandas_udf(_shown, "string")("path", "__c", "first", "last")).drop("__c")


def read_around(files: DataFrame, places: DataFrame, radius: int) -> DataFrame:
    """`places` (path, line) with `shown`, the lines around each."""
    radius = min(max(radius, 0), MOST_RADIUS)
    # a first line of 0 or less is the file's first
    return read_file(files, places.withColumns({"first": F.col("line") - radius, "last": F.col("line") + radius})).drop("first", "last")


def local_tools(rows: pd.DataFrame) -> dict[str, Callable[[dict], str]]:
    """The tools over a batch's own files (path, content), by name; a tool raises ValueError where it cannot answer."""
    held = dict(zip(rows["path"], rows["content"]))

    def content(path: str) -> str:
        if path not in held:
            raise ValueError(f"no such file: {path}")
        return held[path] or ""

    def around(args: dict) -> str:
        line, radius = int(args["line"]), int(args["radius"])
        if line < 1 or radius < 0:
            raise ValueError("line must be >= 1 and radius >= 0")
        radius = min(radius, MOST_RADIUS)
        return shown(args["path"], content(args["path"]), line - radius, line + radius)

    def search(pattern: str) -> str:
        hit = re.compile(pattern)
        found = [f"{p}:{n}: {redacted(x)}\n" for p in sorted(held) for n, x in enumerate((held[p] or "").split("\n"), 1) if hit.search(x)]
        return "".join(found[:100]) or "no matches\n"

    return {
        "read_file": lambda a: shown(a["path"], content(a["path"]), int(a.get("start_line", 0)), int(a.get("end_line", 0))), "read_neighbors": around,
        "grep": lambda a: search(a["pattern"]), "find_callers": lambda a: search(rf"\b{re.escape(a['symbol'])}\s*\("),
    }


def tool_loop(ask: Callable, most_usd: float = 0.0, most_turns: int = MOST_TURNS, most_calls: int = MOST_CALLS) -> Callable:
    """A backend for `investigate` that lets a model call tools until it reports.

    `ask(batch, paths, rows, turns)` gives one reply: {report, calls: [{name, args}], text, cost, tokens}, where `turns`
    are the calls and answers so far. A report, given at once or as a call, ends the loop; it is {results} or {refusal}.
    Reaching the cost, a reply without calls, too many calls or turns ends it as a refusal with that reason.
    """

    def backend(batch: int, paths: list[str], rows: pd.DataFrame) -> dict:
        tools, turns = local_tools(rows), []
        spent = {"cost": 0.0, "tokens": 0, "turns": 0}

        def refused(reason: str) -> dict:
            return spent | {"results": [], "refused": True, "reason": redacted(reason)}

        def reported(report: dict) -> dict:
            return refused(report["refusal"]) if report.get("refusal") else spent | {"results": report.get("results", [])}

        def answer(call: dict) -> dict:
            tool = tools.get(call["name"])
            if tool is None:
                return {"content": f'unknown tool "{call["name"]}"', "error": True}
            try:
                return {"content": tool(call["args"]), "error": False}
            except (ValueError, KeyError, TypeError, re.error) as e:
                return {"content": redacted(str(e)), "error": True}

        for n in range(1, most_turns + 1):
            said = ask(batch, paths, rows, turns)
            calls = said.get("calls") or []
            spent = {"cost": spent["cost"] + said.get("cost", 0.0), "tokens": spent["tokens"] + said.get("tokens", 0), "turns": n}
            if said.get("report"):
                return reported(said["report"])
            if 0 < most_usd <= spent["cost"]:
                return refused(COST_CAP)
            if not calls:
                return refused(TEXT_ONLY if said.get("text") else NO_CALL)
            if len(calls) > most_calls:
                return refused(CALL_CAP)
            answers = []
            for call in calls:
                if call["name"] == REPORT:
                    return reported(call["args"])
                answers.append({"call": call["name"], **answer(call)})
            turns.append(answers)
        return refused(TURN_CAP)

    return backend
