"""Sources: project trees, records, runs, replies and findings of other tools."""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import paths, text
from ..operators.records import redacted
from ..rules.regex import glob_to_java

# fixed values: folders and extensions that a walk leaves out
SKIP_DIRS = ["node_modules", ".git", ".hg", ".svn", "dist", "build", "out", ".next", ".nuxt", ".turbo", ".cache", "coverage", "__pycache__", ".pytest_cache", ".mypy_cache", "target", "vendor", ".terraform", ".venv", "venv", ".tox", "deps", "Pods", ".idea", ".vscode"]
SKIP_EXTENSIONS = ["md", "lock", "log", "map", "ico", "png", "jpg", "jpeg", "gif", "webp", "svg", "pdf", "zip", "tar", "gz", "exe", "dll", "so", "dylib", "woff", "woff2", "ttf"]
MOST_BYTES = 1 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Deal a table out over the cores where its files give fewer splits than there are cores; larger tables, which
    have more splits than that, are left as they are and not shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def gitignore(lines: list[str]) -> list[tuple[str, bool]]:
    """(pattern, ignored) of a .gitignore's lines, in order; the last that matches decides."""
    out = []
    for raw in lines:
        line = raw.rstrip("\n").rstrip()
        if not line or line.startswith("#"):
            continue
        ignored = not line.startswith("!")
        line = line.lstrip("!").removeprefix("\\")
        only_dir = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        glob = line.removeprefix("/") if anchored else f"**/{line}"
        body = glob_to_java(glob).removesuffix(r"\z")
        out.append((body + ("/.+" if only_dir else "(?:/.*)?") + r"\z", ignored))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    out = F.lit(False)
    for pattern, yes in rules:
        out = F.when(path.rlike(pattern), F.lit(yes)).otherwise(out)
    return out


def walk(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, content) of a project's files: without the folders and kinds that are left out, minified scripts, files
    over 1 MiB and what the root's .gitignore names. Size and name are tested before anything is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MOST_BYTES)
    base = re.sub(r"/+$", "", root.split("://")[-1])
    rel = F.regexp_replace(F.col("path"), r"^[a-z]+:/+", "/")
    rel = F.substring(rel, len("/" + base.lstrip("/")) + 2, 1 << 20)
    files = files.withColumn("path", rel)
    skip = "|".join(re.escape(d) for d in SKIP_DIRS)
    files = files.where(~F.col("path").rlike(rf"(?:^|/)(?:{skip})/") & ~paths.extension(F.col("path")).isin(SKIP_EXTENSIONS) & ~F.col("path").endswith(".min.js"))
    if ignore:
        files = files.where(~ignored(F.col("path"), gitignore(ignore)))
    return files.select("path", text.normalised(F.decode("content", "UTF-8")).alias("content"))


def explicit(spark: SparkSession, names: list[str]) -> DataFrame:
    """Given paths, trimmed, with forward slashes, distinct and sorted."""
    rows = spark.createDataFrame([(x,) for x in names], "path string")
    clean = rows.select(F.replace(F.trim("path"), F.lit("\\"), F.lit("/")).alias("path")).where("path <> ''")
    return clean.distinct().orderBy("path")


def restrict(files: DataFrame, wanted: DataFrame) -> DataFrame:
    return files.join(wanted, "path", "left_semi")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All file records below a folder, one JSON document each; malformed ones are skipped, and secrets in older records are
    redacted as they are read."""
    rows = spark.read.schema(f"{schemas.RECORD}, _corrupt string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    return redacted(rows.where("filePath is not null").drop("_corrupt"))


def point(records: DataFrame, project: str, path: str) -> DataFrame:
    """The record of one file, or no row."""
    return records.where((F.col("projectId") == project) & (F.col("filePath") == path))


def put(records: DataFrame, new: DataFrame) -> DataFrame:
    """`records` with those of `new` in place of the ones of the same project and path."""
    return records.join(new, ["projectId", "filePath"], "left_anti").select(records.columns).unionByName(new)


# fixed values: names of the settings file, in order
CONFIG_NAMES = ("gritstone.config.toml", ".gritstone/config.toml", "gritstone.toml")


def find_config(start: str) -> str | None:
    """The settings file of a folder or of the nearest folder above it."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        for name in CONFIG_NAMES:
            if (folder / name).is_file():
                return str(folder / name)
    return None


def read_config(path: str) -> dict:
    """The settings; each project needs an id and a root, relative to the file's folder."""
    doc = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    if not doc.get("projects"):
        raise ValueError(f"{path}: no projects")
    for p in doc["projects"]:
        if not str(p.get("id", "")).strip() or not str(p.get("root", "")).strip():
            raise ValueError(f"{path}: a project needs id and root")
    return doc


def named_paths(spark: SparkSession, names: str = "", names_from: str | None = None, diff: str | None = None) -> DataFrame | None:
    """The files that a call names: a comma-joined list, a file with one a line, or those that a unified diff touches;
    None where it names none and all files are meant. Unsafe paths are an error."""
    if sum(map(bool, (names, names_from, diff))) > 1:
        raise ValueError("name files in one way only")
    if diff:
        got = [r[0] for r in spark.createDataFrame([(Path(diff).read_text(encoding="utf-8"),)], "d string").select(F.explode(text.diff_files(F.col("d")))).collect()]
    elif names or names_from:
        got = names.split(",") if names else Path(names_from).read_text(encoding="utf-8").splitlines()
    else:
        return None
    rows = explicit(spark, got) if got else spark.createDataFrame([], "path string")
    bad = rows.where(~text.safe_path(F.col("path"))).first()
    if bad:
        raise ValueError(f"unsafe path {bad[0]!r}")
    return rows


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(schemas.RUN).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.where("runId is not null").orderBy(F.desc("runId"))


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """Recorded replies, one a line, in order: (position, batch_paths, output as JSON). Key case does not matter; a
    malformed line is an error, a blank one is skipped."""
    where = ["_metadata.file_path", "_metadata.file_block_start"]
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col(where[0]).alias("file"), F.col(where[1]).alias("at"), F.monotonically_increasing_id().alias("m"))
    # lines are counted within the blocks in which the file is read, and the blocks before them once for each block
    inside = Window.partitionBy("file", "at").orderBy("m")
    told = F.when(F.trim("value") != "", 1).otherwise(0)
    lines = raw.withColumn("n", F.row_number().over(inside)).withColumn("k", F.sum(told).over(inside))
    blocks = raw.groupBy("file", "at").agg(F.count("*").alias("n"), F.sum(told).alias("k"))
    earlier = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)
    # a row a block
    blocks = blocks.select("file", "at", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"before_{c}") for c, w in (("n", earlier.partitionBy("file")), ("k", earlier))])
    rows = lines.where(F.trim("value") != "").join(blocks, ["file", "at"])
    rows = rows.select((F.col("n") + F.col("before_n")).alias("n"), (F.col("k") + F.col("before_k") - 1).cast("long").alias("position"), F.col("value").alias("line"))
    keys = F.json_object_keys("line")
    find = lambda name: F.filter(keys, lambda k: F.lower(k) == name)[0]
    line = F.when(keys.isNull(), F.raise_error(F.concat(F.lit(f"{path}:"), F.col("n").cast("string")))).otherwise(F.col("line"))
    rows = rows.select("position", line.alias("line"))
    m = F.from_json("line", "map<string,string>")
    return rows.select("position", F.from_json(F.try_element_at(m, find("batchpaths")), "array<string>").alias("batch_paths"), F.try_element_at(m, find("output")).alias("output"))


def read_findings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Findings of another tool (title, description, relevant_paths joined by " | "): one row a path."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select("title", "description", F.explode(F.split("relevant_paths", r" \| ")).alias("path")).withColumn("path", F.trim("path")).where("path <> ''")


def regression_cases(spark: SparkSession, path: str) -> DataFrame:
    """(slug, expectation, content, path, reason) of a TOML file of [[case]] tables."""
    rows = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("case", [])
    return spark.createDataFrame([(r["slug"], r["expectation"], r["content"], r.get("file_path", "case.txt"), r.get("reason", "")) for r in rows], "slug string, expectation string, content string, path string, reason string")
