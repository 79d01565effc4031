"""Boilerplate lines by their frequency within a site.

A line's pages are counted within its host, not over the corpus: navigation, legal lines and slogans are frequent on
their own site only. A line is boilerplate where more than `ratio` of the host's pages hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import sha_key, staged

#: Low, as navigation need not stand on every page; copied pages are protected by `once`, not by the ratio.
RATIO = 0.02
#: A line on one page only is not repeated, whatever the host's size.
LEAST_PAGES = 2


def boilerplate(pages: DataFrame, host: str, lines: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, line, pages, of): the lines of each host that more than `ratio` of its `of` pages hold. `lines` is an array
    column of texts or hashes; null lines do not count."""
    each = pages.select(F.col(host).alias("host"), F.explode(F.array_distinct(lines)).alias("line")).where("line is not null")
    counts = each.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    total = pages.groupBy(F.col(host).alias("h")).agg(F.count("*").alias("of"))
    return counts.join(total, F.col("host").eqNullSafe(F.col("h"))).where(F.col("pages") > ratio * F.col("of")).select("host", "line", "pages", "of")


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, mark: bool = False, once: bool = False) -> DataFrame:
    """`docs` with boilerplate lines removed from the text, and with `mark` also n_lines and n_dropped.

    Lines end at "\\n"; they are compared without blanks at their ends, and blank lines are never boilerplate. A page
    counts once for a line that it repeats; all copies of the line go. Pages with a null host form one host; a null
    text has no lines and stays null. Repeated rows and copies count as pages of their own; with
    `once` pages of a host that have the same lines count as one, in the lines' pages and in the host's, so that copies
    cannot turn their own lines into boilerplate. An empty table gives an empty one. Long texts are taken whole. Other
    columns pass through, but for n_lines and n_dropped, which `mark` replaces; names that begin with __ are reserved.
    Lines and rows are told apart by 128 bits of SHA-256; only these of lines are shuffled for the counts, and texts move
    once, to meet the places of their dropped lines.
    """
    clean = F.transform(F.split(F.col(text), "\n", -1), lambda x: F.trim(x))
    hashed = F.transform(clean, lambda x: F.when(x == "", None).otherwise(F.substring(F.unhex(F.sha2(x.cast("binary"), 256)), 1, 16)))
    rid = sha_key(id_col, text, host)
    narrow = docs.select(rid.alias("rid"), F.col(host).alias("host"), hashed.alias("lines"))
    counted = narrow.select("host", "lines").distinct() if once else narrow
    bad = boilerplate(counted, "host", "lines", ratio, least_pages).select(F.col("host").alias("bad_host"), F.col("line").alias("bad_line"))
    bad = staged(bad, "boilerplate")
    hits = narrow.select("rid", "host", F.posexplode("lines").alias("p", "line")).where("line is not null")
    hits = hits.join(bad, F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("line") == F.col("bad_line")), "left_semi")
    places = hits.groupBy("rid").agg(F.collect_set("p").alias("__gone")).withColumnRenamed("rid", "__rid")
    both = docs.withColumn("__rid", rid).join(places, "__rid", "left")
    all_lines = F.split(F.col(text), "\n", -1)
    # the lines are split once for the row and picked by their places, so the work is linear in them
    rest = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    kept = F.transform(F.array(all_lines), lambda lines: F.array_join(F.transform(rest(lines), lambda i: F.get(lines, i)), "\n"))[0]
    out = both.withColumn("__new", F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept))
    extra = [F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped")] if mark else []
    skip = {"n_lines", "n_dropped"} if mark else set()
    return out.select(*[F.col("__new").alias(text) if c == text else F.col(c) for c in docs.columns if c not in skip], *extra)
