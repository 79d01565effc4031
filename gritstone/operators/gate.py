"""Which rules are active for a project: technologies and sentinel files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..rules.load import Rule
from ..rules.regex import glob_to_java, to_java

# fixed values: manifests, the tag each sets, and contents that set more
MANIFESTS = {
    "package.json": "node", "requirements.txt": "python", "pyproject.toml": "python", "setup.py": "python", "Gemfile": "ruby", "go.mod": "go", "Cargo.toml": "rust", "composer.json": "php",
    "pom.xml": "jvm", "build.gradle": "jvm", "build.gradle.kts": "jvm", "Dockerfile": "docker", "tsconfig.json": "typescript", "Chart.yaml": "helm",
}
PROBES = {
    "package.json": {
        "nextjs": ['"next"', '"@vercel/next"'], "react": ['"react"'], "express": ['"express"'], "fastify": ['"fastify"'], "nestjs": ['"@nestjs/core"'], "koa": ['"koa"'], "hapi": ['"@hapi/hapi"'],
        "hono": ['"hono"'], "remix": ['"remix"', '"@remix-run/'], "sveltekit": ['"@sveltejs/kit"'], "svelte": ['"svelte"', '"@sveltejs/'], "astro": ['"astro"'], "solidstart": ['"@solidjs/start"'],
        "nuxt": ['"nuxt"'], "graphql": ['"graphql"', '"@apollo/server"'], "typescript": ['"typescript"'],
    },
    "requirements.txt": {x: [x] for x in ("django", "fastapi", "flask", "starlette")},
    "pyproject.toml": {x: [x] for x in ("django", "fastapi", "flask", "starlette")},
    "setup.py": {x: [x] for x in ("django", "fastapi", "flask", "starlette")},
    "Gemfile": {"rails": ["'rails'", '"rails"'], "sinatra": ["'sinatra'"]},
    "go.mod": {"gin": ["gin-gonic/gin"], "echo": ["labstack/echo"], "fiber": ["gofiber/fiber"], "chi": ["go-chi/chi"]},
    "Cargo.toml": {"axum": ["axum"], "rocket": ["rocket"], "warp": ["warp"], "actix": ["actix-web"]},
}
NESTED = ("package.json", "Cargo.toml", "tsconfig.json", "Chart.yaml")
MOST_NESTED, DEEPEST = 64, 6


def detect(files: DataFrame) -> DataFrame:
    """One row (tags, sentinels) of a project's files (path, content), both sorted and distinct.

    Manifests count at the root; of nested ones the first 64 in path order, down to depth 6. The manifests are few;
    only their names and the tags found are collected.
    """
    name = F.element_at(F.split("path", "/"), -1)
    depth = F.size(F.split("path", "/")) - 1
    known = files.where(name.isin(list(MANIFESTS)) | F.col("path").startswith(".github/workflows/") | F.col("path").endswith(".svelte")).select("path", name.alias("name"), depth.alias("depth"), F.col("content"))
    roots = known.where("depth = 0 or path like '.github/workflows/%'")
    nested = known.where((F.col("depth").between(1, DEEPEST)) & (F.col("name").isin(list(NESTED)) | F.col("path").endswith(".svelte")))
    nested = nested.orderBy("path").limit(MOST_NESTED)
    lower = F.when(F.col("name").isin("requirements.txt", "pyproject.toml", "setup.py"), F.lower("content")).otherwise(F.col("content"))
    tags = F.array()
    for manifest, tag in MANIFESTS.items():
        more = [F.array(F.lit(tag))] + [F.when(F.exists(F.array(*[F.lit(p) for p in probes]), lambda p: F.contains(lower, p)), F.array(F.lit(t))) for t, probes in PROBES.get(manifest, {}).items()]
        tags = F.when(F.col("name") == manifest, F.flatten(F.filter(F.array(*more), lambda x: x.isNotNull()))).otherwise(tags)
    tags = F.when(F.col("path").startswith(".github/workflows/"), F.array(F.lit("github-actions"))).when(F.col("path").endswith(".svelte"), F.array(F.lit("svelte"), F.lit("typescript"))).otherwise(tags)
    rows = roots.unionByName(nested).select("path", "name", F.explode(tags).alias("tag"))
    quiet = F.when(F.col("tag") == "jvm", None).otherwise(F.when(F.col("path").startswith(".github/workflows/"), F.lit(".github/workflows")).otherwise(F.col("path")))
    return rows.agg(F.sort_array(F.collect_set("tag")).alias("tags"), F.sort_array(F.collect_set(quiet)).alias("sentinels"))


def evaluate(rules: DataFrame, tech: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """`rules` (of rules.load.frame) with `active`: no gate, or a technology in common, or a sentinel file that is there
    and holds one of the needed contents where any are named. Rules are few; the file table is read once."""
    tags = tech.select("tags").first()["tags"]
    have = F.array(*[F.lit(t) for t in tags]) if tags else F.array().cast("array<string>")
    free = (F.size("tech") == 0) & (F.size("sentinel_files") == 0)
    active = free | F.arrays_overlap("tech", have)
    if files is None:
        return rules.withColumn("active", active)
    globs = {g for r in rules.select("sentinel_files").collect() for g in r[0]}
    pairs = [(g, glob_to_java(g)) for g in sorted(globs)]
    wanted = rules.where(F.size("sentinel_files") > 0).select("slug", F.posexplode("sentinel_files").alias("i", "glob"), "sentinel_contains")
    hits = None
    if pairs:
        # of a glob's files only the first in path order counts: one aggregate over the paths, then those files alone
        firsts = files.agg(*[F.min(F.when(F.col("path").rlike(p), F.col("path"))).alias(f"g{i}") for i, (_, p) in enumerate(pairs)]).first()
        first_of = [(g, firsts[i]) for i, (g, _) in enumerate(pairs) if firsts[i] is not None]
        shapes = rules.sparkSession.createDataFrame(first_of, "glob string, path string")
        found = files.where(F.col("path").isin(sorted({p for _, p in first_of}))).join(F.broadcast(shapes), "path").select("glob", "content")
        contents = sorted({p for r in rules.select("sentinel_contains").collect() for p in r[0]})
        held = [F.when(F.col("content").rlike(to_java(p)), F.lit(p)) for p in contents]
        none = F.array().cast("array<string>")
        found = found.select("glob", F.filter(F.array(*held), lambda x: x.isNotNull()).alias("held") if held else none.alias("held"))
        ok = (F.size("sentinel_contains") == 0) | F.arrays_overlap("sentinel_contains", "held")
        hits = wanted.join(found, "glob").where(ok).select("slug").distinct().withColumn("__hit", F.lit(True))
    if hits is None:
        return rules.withColumn("active", active)
    return rules.join(hits, "slug", "left").withColumn("active", active | F.coalesce("__hit", F.lit(False))).drop("__hit")


def active_rules(rules: list[Rule], tags: list[str], paths: list[str] = ()) -> tuple[list[Rule], list[Rule]]:
    """(active, skipped) on the driver, for gates that need no file's content."""
    import re

    def on(r: Rule) -> bool:
        g = r.requires
        if not g.tech and not g.sentinel_files:
            return True
        if set(g.tech) & set(tags):
            return True
        shapes = [re.compile(glob_to_java(x).replace(r"\z", r"\Z")) for x in g.sentinel_files]
        return any(s.search(p) for s in shapes for p in paths) and not g.sentinel_contains

    return [r for r in rules if on(r)], [r for r in rules if not on(r)]


