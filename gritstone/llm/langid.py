"""Language of a page by Bayesian fusion of evidence.

The text's likelihood under each language comes from hashed byte trigrams. The declared markup language and the
address suffix enter by their likelihoods under each language, and the host by a prior: the host's own soft counts
smoothed to its domain's, and these to the corpus's. All three tables are grouped sums of the texts' posteriors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import prepare, staged
from .vecwords import LOWER, flat, in_pieces, small

BINS = 1 << 14
#: Trigrams overlap, so their evidence counts this much less.
TEMPER = 6.0
#: Pseudo-counts of the level above in a host's and a domain's prior, and of the evidence tables.
HOST_WEIGHT, DOMAIN_WEIGHT, SMOOTH = 8.0, 32.0, 0.5


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each byte trigram of each text, blanks folded, and the row of each."""
    data, at = flat(column)
    data = np.where(LOWER[data] < 65, 32, LOWER[data]).astype(np.uint32)
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = (row[:-2] == row[2:]) & (code != 0x202020)
    return ((code[ok] * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64), row[:-2][ok]


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # BINS x languages

    def likelihood(self, column: pa.Array) -> np.ndarray:
        bins, row = trigrams(column)
        rows = len(column)
        return np.stack([np.bincount(row, self.logp[bins, j], rows) for j in range(len(self.langs))], 1) / TEMPER


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Trigram tables of all rows of `docs` with a language. The languages are few; one row of BINS counts each comes
    to the driver."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in small(batches):
            bins, row = trigrams(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for name in set(langs.tolist()):
                total[name] = total.get(name, np.zeros(BINS, np.int64)) + np.bincount(bins[(langs == name)[row]], minlength=BINS)
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "bin", "n"])

    got = docs.where(F.col(lang).isNotNull()).select(lang, F.col(text).cast("binary").alias("t")).mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(got["lang"].unique())
    table = np.full((BINS, max(1, len(langs))), 0.5)
    for j, name in enumerate(langs):
        mine = got[got["lang"] == name]
        table[mine["bin"], j] += mine["n"]
    return Model(langs or ["und"], np.log(table / table.sum(0)))


def identify(pages: DataFrame, model: Model) -> DataFrame:
    """(id, host, lang, confidence, text_lang) for rows (id, text, host, markup, suffix) of `pages`.

    Any column may be null: a null text has no likelihood, null markup or suffix is a value of its own, rows with a null
    host share one host. The host's domain is its last two labels. `markup` is compared by its first two letters,
    lower-cased. Ties go to the language that sorts first. Repeated rows are judged each and count each for their host.
    Empty and blank texts have no trigrams and are judged by the other evidence. Very long texts are read whole, in pieces.
    An empty table gives an empty one. Further columns are not looked at, whatever their names.
    """
    prepare(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    langs, n = model.langs, len(model.langs)

    @F.pandas_udf("array<double>")
    def likelihood(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in parts:
            yield pd.Series([row for part in in_pieces(t, shared.value.likelihood) for row in part])

    markup = F.lower(F.substring("markup", 1, 2))
    host = F.coalesce("host", F.lit(""))
    domain = F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)
    rows = pages.select("id", host.alias("host"), domain.alias("domain"), F.coalesce(markup, F.lit("")).alias("markup"), F.coalesce("suffix", F.lit("")).alias("suffix"), likelihood(F.col("text").cast("binary")).alias("ll"))
    top = F.array_max("ll")
    weight = F.transform("ll", lambda x: F.exp(x - top))
    rows = staged(rows.withColumn("post", F.transform(weight, lambda x: x / F.aggregate(weight, F.lit(0.0), lambda a, b: a + b))), "likelihoods")
    soft = lambda: [F.sum(F.col("post")[i]).alias(f"n{i}") for i in range(n)]
    array = lambda: F.array(*[F.col(f"n{i}") for i in range(n)])
    by_host = rows.groupBy("host", "domain").agg(*soft())
    by_domain = by_host.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(n)])
    everything = by_domain.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0.0)).alias(f"n{i}") for i in range(n)]).first()
    total = sum(everything) or 1.0
    prior = F.array(*[F.lit((x + SMOOTH) / (total + SMOOTH * n)) for x in everything])

    def smoothed(counts, above, weight):
        size = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(counts, above, lambda c, p: (c + weight * p) / (size + weight))

    domains = by_domain.select("domain", smoothed(array(), prior, DOMAIN_WEIGHT).alias("above"))
    # written, so that the join's sides are dealt for it alone and a large host can be split
    hosts = staged(by_host.join(domains, "domain").select("host", smoothed(array(), F.col("above"), HOST_WEIGHT).alias("prior")), "hosts")

    def evidence(col):
        """log P(value | language) up to a constant of the value."""
        g = staged(rows.groupBy(col).agg(*soft()), col)
        values = g.count()
        return g.select(F.col(col).alias(f"__{col}"), F.array(*[F.log((F.col(f"n{i}") + SMOOTH) / F.lit(everything[i] + SMOOTH * values)) for i in range(n)]).alias(f"{col}_ll"))

    marks, ends = evidence("markup"), evidence("suffix")
    both = rows.join(hosts, "host").join(marks, F.col("markup") == F.col("__markup")).join(ends, F.col("suffix") == F.col("__suffix"))
    fused = F.array(*[F.col("ll")[i] + F.log(F.col("prior")[i]) + F.col("markup_ll")[i] + F.col("suffix_ll")[i] for i in range(n)])
    both = both.withColumn("fused", fused)
    names = F.array(*[F.lit(x) for x in langs])
    best = F.array_max("fused")
    norm = F.aggregate(F.transform("fused", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, b: a + b)
    return both.select("id", "host", F.get(names, F.array_position("fused", best).cast("int") - 1).alias("lang"), (1 / norm).alias("confidence"), F.get(names, F.array_position("ll", F.array_max("ll")).cast("int") - 1).alias("text_lang"))


def page_rows(pages: DataFrame) -> DataFrame:
    """The columns of identify() from (page_id, url, html)."""
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ")
    return pages.select(F.col("page_id").alias("id"), text.alias("text"), F.lower(host).alias("host"), F.nullif(F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang=["']?([A-Za-z]{2,3})""", 1), F.lit("")).alias("markup"), F.nullif(F.regexp_extract(F.lower(host), r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"))
