"""Languages and other attributes that follow from a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: languages of the statistics by extension
LANGUAGES = {
    "svelte": ["svelte"], "typescript": ["ts", "tsx"], "javascript": ["js", "jsx", "mjs", "cjs"], "python": ["py"], "ruby": ["rb"], "go": ["go"], "rust": ["rs"], "java": ["java"], "kotlin": ["kt", "kts"], "csharp": ["cs"],
    "php": ["php"], "swift": ["swift"], "elixir": ["ex", "exs"], "erlang": ["erl"], "clojure": ["clj", "cljs"], "crystal": ["cr"], "scala": ["scala"], "c": ["c", "h"], "cpp": ["cpp", "cc", "hpp"], "dart": ["dart"],
}
# fixed values: languages whose sources of input are known, by extension
TAINT_LANGUAGES = {
    "go": ["go"], "typescript": ["ts", "tsx"], "javascript": ["js", "jsx", "mjs", "cjs"], "python": ["py"], "ruby": ["rb"], "java": ["java"], "kotlin": ["kt", "kts"], "rust": ["rs"], "php": ["php"], "swift": ["swift"], "csharp": ["cs"],
}
# fixed values: languages of syntax trees, by extension
TREE_LANGUAGES = {
    "go": ["go"], "typescript": ["ts"], "tsx": ["tsx"], "javascript": ["js", "mjs", "cjs"], "jsx": ["jsx"], "python": ["py"], "java": ["java"], "kotlin": ["kt", "kts"], "rust": ["rs"], "swift": ["swift"], "c": ["c", "h"], "cpp": ["cc", "cpp", "cxx", "hpp"],
}


EXTENSION = r"\.([^./]*)\z"


def extension(path: Column) -> Column:
    """The lower-case extension of the last segment, or the empty string."""
    return F.lower(F.regexp_extract(path, EXTENSION, 1))


def _lookup(path: Column, table: dict[str, list[str]], default: str | None) -> Column:
    pairs = [F.lit(x) for name, exts in table.items() for e in exts for x in (e, name)]
    found = F.try_element_at(F.create_map(*pairs), extension(path))
    return found if default is None else F.coalesce(found, F.lit(default))


def language(path: Column) -> Column:
    return _lookup(path, LANGUAGES, "other")


def taint_language(path: Column) -> Column:
    return _lookup(path, TAINT_LANGUAGES, "")


def tree_language(path: Column) -> Column:
    return _lookup(path, TREE_LANGUAGES, None)


def directory(path: Column) -> Column:
    """Everything before the last slash; "." at the root."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*\z", 1), F.lit("")), F.lit("."))
