"""Spelling variants: words at distance one, by a self-join of vocabulary tries with active-node sets.

Two words of six or more characters that differ by one edit share their first three characters or their last three. So
the vocabulary is dealt twice by a prefix of three, as it is and reversed, and each part is a trie of its own. Down a
trie go the active pairs: nodes (x, y) whose prefixes differ by one edit. They start at the siblings under one node (a
replaced character) and at a node and its child (an inserted one), and go on only under equal characters, all pairs of a
level in one step. A pair of nodes that both end words is a pair of near words; each is found once.

A prefix with very many words is taken one level down by Spark itself: its pairs that begin at the node are met by their
common rest, which has one word a character, and the words go on under a prefix that is longer by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import prepare, staged
from .vecwords import LOWER, bounds, crc32, flat, small

#: Characters of the prefix by which the tries are dealt; words have twice as many at least.
PREFIX = 3
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[192:] = True


def run_counts(ids: list, texts: list, modulus: int, least: int) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts and their numbers, as Latin-1. A run of letters loses the character that its checksum names
    if `modulus` divides the checksum of id and run; then those of fewer than `least` characters go."""
    data, at = flat(pa.array([(t or "").encode("latin-1", "replace") for t in texts], pa.binary()))
    data = LOWER[data]
    start, end, first = bounds(data, at, ~_LETTER)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = crc32(data, start, end, before[doc], latin=True)
    size = end - start
    hit = np.flatnonzero(h % np.uint32(modulus) == 0)
    inside = np.zeros(len(data) + 1, np.int32)
    lost = start[hit] + h[hit] % size[hit].astype(np.uint32)
    size[hit] -= 1
    long = size >= least
    np.add.at(inside, start[long], 1)
    np.add.at(inside, end[long], -1)
    take = np.cumsum(inside[:-1]) > 0
    take[lost] = False
    offsets = np.concatenate(([0], np.cumsum(size[long]))).astype(np.int64)
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[take]))])
    met = runs.value_counts()
    return met.field(0).cast(pa.binary()), met.field(1).to_numpy()


class Forest:
    """Tries of words that are sorted within their parts. Levels count from where the part's common prefix ends."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, part: np.ndarray):
        node, alive = np.unique(part, return_inverse=True)[1], np.arange(len(start))
        n = int(node[-1]) + 1 if len(node) else 0
        #: For each level: the word that ends at a node or -1; the edges to the next level by child: parent, character.
        self.term: list[np.ndarray] = []
        self.parent: list[np.ndarray] = []
        self.char: list[np.ndarray] = []
        while n:
            over = start[alive] == end[alive]
            term = np.full(n, -1, np.int64)
            term[node[over]] = alive[over]
            self.term.append(term)
            alive, node = alive[~over], node[~over]
            key = node * 256 + data[start[alive]]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            self.parent.append(key[new] >> 8)
            self.char.append((key[new] & 255).astype(np.uint8))
            node = np.cumsum(new) - 1
            n = int(new.sum())
            start = start.copy()
            start[alive] += 1

    def down(self, level: int, x: np.ndarray, y: np.ndarray, other: int, bar: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The pairs under equal characters of x's children (nodes of `level`) and y's (nodes of `other`); not under those in `bar`."""
        if not len(x) or level >= len(self.parent) or other >= len(self.parent):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        parent, char = self.parent[level], self.char[level]
        lo, hi = np.searchsorted(parent, x), np.searchsorted(parent, x, side="right")
        n = hi - lo
        pair = np.repeat(np.arange(len(x)), n)
        child = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        keys = self.parent[other] * 256 + self.char[other]
        want = y[pair] * 256 + char[child]
        at = np.searchsorted(keys, want)
        ok = at < len(keys)
        ok[ok] = keys[at[ok]] == want[ok]
        if bar is not None:
            ok &= char[child] != bar[pair]
        return child[ok], at[ok]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The words at distance one whose first difference lies below the common prefix, each pair once."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.zeros(0, np.int64)
        same, more = (none, none), (none, none)  # a character replaced; one inserted, so that y is a level lower
        for level, term in enumerate(self.term):
            parent, char = self.parent[level], self.char[level]
            lower = self.term[level + 1] if level + 1 < len(self.term) else none
            for (x, y), ends in ((same, term), (more, lower), ((parent, np.arange(len(parent))), lower)):
                both = (term[x] >= 0) & (ends[y] >= 0)
                out.append((term[x[both]], ends[y[both]]))
            # an inserted character is taken as the last of equal ones, so that a pair has one path
            fresh = self.down(level, parent, np.arange(len(parent)), level + 1, char)
            more = tuple(map(np.concatenate, zip(self.down(level, *more, level + 1), fresh)))
            n = np.searchsorted(parent, parent, side="right") - np.arange(len(parent)) - 1
            left = np.repeat(np.arange(len(parent)), n)
            right = left + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            same = tuple(map(np.concatenate, zip(self.down(level, *same, level), (left, right))))
        return tuple(map(np.concatenate, zip(*out))) if out else (none, none)


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of `rows` rows or more that end where a key ends. Rows come sorted by their first column."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        total += len(batch)
        if total < rows:
            continue
        key = batch.column(0)
        cuts = np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False))
        if len(cuts):
            at = int(cuts[-1]) + 1
            held[-1] = batch.slice(0, at)
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [batch.slice(at)], len(batch) - at
    if total:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def near_pairs(words: DataFrame, most: int = 1 << 17, block: int = 1 << 16) -> DataFrame:
    """(a, b): the ids of all words at distance one, each pair once. `words`: (id: long, word: string of Latin-1 letters,
    six characters or more, distinct). A part of more than `most` words is taken down by Spark, level by level.
    An empty table gives an empty one; a word without near ones is in no pair."""
    prepare(words.sparkSession)

    def latin(c: Column) -> Column:
        return F.encode(c, "ISO-8859-1")

    sides = [words.select(F.concat(F.lit(side), F.substring(w, 1, PREFIX)).alias("key"), w.alias("w"), "id") for side, w in (("f", F.col("word")), ("b", F.reverse("word")))]
    tries = sides[0].unionByName(sides[1])
    found = []
    while True:
        # the parts that are too large for a task are few, and so are their rows; they are written, as they are read thrice
        large = tries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key")
        deep = staged(tries.join(large, "key", "left_semi"), "large-tries")
        if deep.isEmpty():
            break
        tries = tries.join(large, "key", "left_anti")
        at = F.length("key")  # the side's letter is one more than the prefix, and substring() counts from 1
        c, rest = F.substring("w", at, F.lit(1)), F.expr("substring(w, length(key) + 1)")
        whole = deep.select("key", F.lit("").alias("c"), F.expr("substring(w, length(key))").alias("rest"), "w", "id")
        cut = deep.where(F.length("w") >= at).select("key", c.alias("c"), rest.alias("rest"), "w", "id")
        met = cut.unionByName(whole)
        m, n = met.alias("m"), cut.alias("n")
        # at most one word a character; an inserted character is not followed by itself
        on = (F.col("m.key") == F.col("n.key")) & (F.col("m.rest") == F.col("n.rest")) & (F.col("m.c") < F.col("n.c")) & ((F.col("m.c") != "") | ~F.startswith("n.rest", "n.c"))
        here = m.join(n, on)
        far = F.startswith("m.key", F.lit("f")) | (F.right("m.w", F.lit(PREFIX)) != F.right("n.w", F.lit(PREFIX)))
        found.append(here.where(far).select(F.col("m.id").alias("a"), F.col("n.id").alias("b")))
        tries = tries.unionByName(deep.where(F.length("w") >= at).select(F.concat("key", c).alias("key"), "w", "id"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches, block):
            key, ids = batch.column(0), batch.column(2).to_numpy()
            data, at = flat(batch.column(1))
            part = np.concatenate(([0], np.cumsum(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False))))
            depth = np.diff(flat(key)[1]) - 1
            a, b = Forest(data, at[:-1] + depth, at[1:], part).pairs()
            back = flat(key)[0][flat(key)[1][:-1]] == ord("b")
            # those that agree in their first characters have been found forward
            first = np.stack([data[at[1:] - 1 - k] for k in range(PREFIX)])
            keep = ~back[a] | (first[:, a] != first[:, b]).any(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[keep]]), pa.array(ids[b[keep]])], ["a", "b"])

    dealt = tries.select(latin(F.col("key")).alias("key"), latin(F.col("w")).alias("w"), "id").repartition("key").sortWithinPartitions("key", "w")
    out = dealt.mapInArrow(join, "a long, b long")
    for more in found:
        out = out.unionByName(more)
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text", modulus: int = 199, least_chars: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): runs of `[A-Za-z\\u00C0-\\u00FF]`, A-Z lowered, with a character dropped where `modulus` divides the CRC-32
    of "<id>:<run>"; those of `least_chars` characters and `least_count` occurrences or more."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found, n = run_counts(batch.column(0).to_pylist(), batch.column(1).to_pylist(), modulus, least_chars)
            yield pa.RecordBatch.from_arrays([found, pa.array(n)], ["w", "n"])

    each = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text).cast("string").alias("t")).mapInArrow(count, "w binary, n long")
    return each.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count).select(F.decode("w", "ISO-8859-1").alias("word"), "n")


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): where one gets from each id of `forms` (id, form) by following forms to the last. Every step at least
    doubles the length of what a row has followed; forms lead to more frequent words, so there are no circles."""
    now = staged(forms.select("id", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        far = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        now = staged(now.join(far, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return now.select("id", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", modulus: int = 199, least_chars: int = 6, least_count: int = 5, ratio: int = 5, most: int = 1 << 17) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of `vocabulary`, each with its form, the most frequent of the words at
    distance one (ties: the first in code-point order), if that is `ratio` times as frequent, and the last of its forms' forms.

    Null, empty and blank texts have no words, and an empty table gives an empty one. Repeated rows count each. A null id
    is the empty string in the checksum. Long texts are read whole; a run of any length is a word. Other columns are not
    looked at, whatever their names.
    """
    if least_chars < 2 * PREFIX:
        raise ValueError(f"words of fewer than {2 * PREFIX} characters need share neither prefix nor suffix")
    # sorted as they are written, so the ids stand in code-point order
    known = staged(vocabulary(docs, id_col, text, modulus, least_chars, least_count).orderBy("word").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    near = staged(near_pairs(known.select("id", "word"), most), "near-words")
    size = known.select(F.col("id").alias("b"), "n")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(size, "b")
    best = both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "b")).alias("best"))
    linked = staged(known.join(best, "id", "left").withColumn("form", F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best.b"))), "linked")
    last = roots(linked.where("form is not null").select("id", "form"))
    named = linked.join(last, "id", "left")
    spelt = lambda id_, name: known.select(F.col("id").alias(id_), F.col("word").alias(name))
    named = named.join(spelt("form", "form_word"), "form", "left").join(spelt("root", "root_word"), "root", "left")
    return named.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), -F.col("best.n")).alias("form_n"))
