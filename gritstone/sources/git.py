"""What version control prints, as tables. `logs` and `blames` run it where the files are; the others read its output from
a column."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines


def _git(root: str, *args: str) -> str:
    """What a command prints; nothing where it fails, takes over five seconds or there is no git."""
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=5, check=True).stdout.decode("utf-8", "replace")
    except (OSError, subprocess.SubprocessError):
        return ""


def logs(files: DataFrame, root: str, n: int = 5) -> DataFrame:
    """(path, log): the last `n` commits of each file (path), for `commits`. The root must be a folder that executors
    see, as for a walk. Files travel by their names only."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            yield pd.DataFrame({"path": rows["path"], "log": [_git(root, "log", f"-{n}", "--pretty=%an%x09%ae%x09%aI", "--", p) for p in rows["path"]]})

    return files.select("path").distinct().mapInPandas(run, "path string, log string")


def blames(places: DataFrame, root: str) -> DataFrame:
    """(path, line, output): porcelain of each place (path, line), for `blame`; empty where there is none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            yield rows.assign(output=[_git(root, "blame", "--line-porcelain", "-L", f"{n},{n}", "--", p) for p, n in zip(rows["path"], rows["line"])])

    return places.select("path", F.col("line").cast("int").alias("line")).distinct().mapInPandas(run, "path string, line int, output string")


def commits(logs: DataFrame, path: str = "path", log: str = "log") -> DataFrame:
    """(path, ord, name, email, at) from logs of one file each, a commit a line as name, email and ISO time with tabs
    between; other lines are skipped. `ord` counts from the latest commit, 0."""
    rows = logs.select(F.col(path).alias("path"), F.posexplode(F.filter(lines(F.col(log)), lambda x: F.size(F.split(x, "\t")) == 3)).alias("ord", "line"))
    p = F.split("line", "\t")
    return rows.select("path", "ord", p[0].alias("name"), p[1].alias("email"), p[2].alias("at"))


def blame(output: Column) -> Column:
    """The porcelain output of one line as a struct of commit, author, mail, time and summary; null where there is none."""
    every = lines(output)
    commit = F.nullif(F.split(F.get(every, F.lit(0)), r"\s+")[0], F.lit(""))
    field = lambda name: F.coalesce(F.regexp_extract(F.get(F.filter(every, lambda x: x.startswith(name + " ")), F.lit(0)), f"^{name} (.*)$", 1), F.lit(""))
    return F.when(commit.isNotNull(), F.struct(commit.alias("commit"), field("author").alias("author"), field("author-mail").alias("mail"), field("author-time").alias("time"), field("summary").alias("summary")))


def blame_text(path: Column, line: Column, output: Column) -> Column:
    """One line for a prompt."""
    b = blame(output)
    place = F.concat(path, F.lit(":"), line.cast("string"))
    said = F.concat(place, F.lit(" commit="), b["commit"], F.lit(" author="), b["author"], F.lit(" <"), b["mail"], F.lit("> author-time="), b["time"], F.lit(" summary="), b["summary"])
    return F.coalesce(said, F.concat(place, F.lit(": no blame data")))
