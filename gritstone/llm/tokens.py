"""Token counts of whole texts under a public tokenizer, looked up map-side in two tiers.

A pre-token is what stands between two places over which no piece of the vocabulary reaches; its number of tokens never
depends on what is around it. The first tier is a table of the corpus's frequent pre-tokens and their lengths, found by a
mergeable sketch and broadcast; its size is a parameter. The second is a cache in each worker, of a bounded number of
entries, which encodes what it lacks. No pre-token is shuffled, and the counts do not depend on what either tier holds.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import prepare

#: Entries of the broadcast table, of a sketch and of a worker's cache; longer pre-tokens are encoded each time.
FREQUENT, TRACKED, CACHED, LONGEST = 10_000, 40_000, 300_000, 64
#: Characters of a text that are cut into pre-tokens at once.
STRETCH = 1 << 20
SPACE = "▁"
_GAP = re.compile(r"(?<=[^ \n]) (?=[^ \n])")


class Lengths(dict):
    """Tokens of pre-tokens, which are written as a text in which a space stands before them, or as "\\n" and what follows
    it up to the next space or line. A missing one is encoded and kept while there is room."""

    def __init__(self, model: bytes, frequent: dict[str, int], room: int = CACHED):
        super().__init__(frequent)
        self.frequent, self.room = frequent, room
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces) or self.sp.normalize(" x　ａ  \t y ") != f"{SPACE * 2}x　ａ{SPACE * 2}\t{SPACE}y{SPACE}":
            raise ValueError("pieces of this model reach over spaces or lines, or it rewrites texts")
        #: Neighbours that some piece joins; between others a very long pre-token can be cut.
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def __missing__(self, key: str) -> int:
        if len(key) > LONGEST:
            return self.long(key)
        if len(self) >= self.room:
            self.clear()
            self.update(self.frequent)
        n = self[key] = self.encode(key)
        return n

    def encode(self, key: str) -> int:
        if not key:
            return 1  # a space alone
        # no space is put before what follows a line's end, but the encoder puts one before every text
        return len(self.sp.encode(key)) - (key[0] == "\n")

    def long(self, key: str, limit: int = 1 << 16) -> int:
        """A pre-token of any length, in parts that no piece joins."""
        n, a = 0, 0
        while True:
            b = next((i for i in range(a + limit, len(key)) if key[i - 1 : i + 1] not in self.joined and key[i - 1] != " "), len(key))
            n += self.encode(key[:b]) if not a else self.encode("\n" + key[a:b]) - 1
            if b == len(key):
                return n
            a = b

    def of(self, text: str | None) -> int:
        """The tokens of a whole text."""
        if not text:
            return 0
        if SPACE in text:
            text = text.replace(SPACE, " ")  # the two are one to the model
        n, a = 0, 0
        while len(text) - a > STRETCH:
            gap = _GAP.search(text, a + STRETCH)
            if not gap:
                break
            n += self.stretch(text[a : gap.start()])
            a = gap.end()
        return n + self.stretch(text[a:] if a else text)

    def stretch(self, text: str) -> int:
        parts = text.replace("\n", " \n").split(" ")
        return sum(map(self.__getitem__, spaced(parts) if "" in parts else parts))


def spaced(parts: list[str]) -> Iterator[str]:
    """Parts of which some are empty: spaces go to the word after them, or stand alone before a line's end or the text's."""
    blanks = 0
    for p in parts:
        if not p:
            blanks += 1
            continue
        if p[0] == "\n":
            if blanks:
                yield " " * (blanks - 1)
            yield p
        else:
            yield " " * blanks + p
        blanks = 0
    if blanks:
        yield " " * (blanks - 1)


def frequent(docs: DataFrame, text: str, most: int = FREQUENT, tracked: int = TRACKED) -> list[str]:
    """Some `most` pre-tokens of all texts, by a sketch of bounded size. A group of tasks has its own sketch, tasks g*g to
    (g+1)*(g+1)-1 group g, so there are no more groups, and no more than twice the tasks in one, than the root of their number."""
    parts = docs.select(F.floor(F.sqrt(F.spark_partition_id())).alias("g"), F.explode(F.split(F.replace(F.col(text), F.lit("\n"), F.lit(" \n")), " ")).alias("p")).where(F.length("p") <= LONGEST)
    each = parts.groupBy("g").agg(F.expr(f"approx_top_k(p, {most}, {tracked})").alias("top")).select(F.inline("top"))
    best = each.groupBy("item").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "item").limit(most)
    return [r.item for r in best.collect()]  # `most` rows


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, text: str = "text", most: int = FREQUENT, room: int = CACHED) -> DataFrame:
    """`docs` with n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens).

    `model` is the path of a sentencepiece model on the driver; the workers get its bytes, so they need no file. Texts are
    encoded as the library does by default, special strings as ordinary text, nothing added or cut. A model whose pieces
    reach over spaces or lines, or which rewrites texts, is refused with an error.

    Null texts are empty, with 0 bytes and tokens; blank ones have the tokens of their spaces. Repeated rows stay. Very long
    texts are read whole, in stretches that end between pre-tokens; a very long pre-token in parts that no piece joins. An
    empty table gives an empty one. Other columns pass through, but for those named like the new ones, which are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(model, "rb") as f:
        body = f.read()
    here = Lengths(body, {})
    keys = frequent(docs, text, most)
    shared, name = spark.sparkContext.broadcast((body, keys, [here.encode(k) for k in keys])), uuid.uuid4().hex

    @F.pandas_udf("long")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = worker_cache(name, shared, room)
        for t in parts:
            yield t.map(lengths.of).astype("int64")

    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    out = docs.select(*keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


#: The table that this worker has now; it stays for the tasks that follow.
_cache: dict[str, Lengths] = {}


def worker_cache(name: str, shared, room: int) -> Lengths:
    if name not in _cache:
        body, keys, n = shared.value
        _cache.clear()
        _cache[name] = Lengths(body, dict(zip(keys, n)), room)
    return _cache[name]
