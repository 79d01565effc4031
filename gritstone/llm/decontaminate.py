"""Benchmark passages in documents, by a Wu-Manber search over words.

The patterns of one length are searched together. A shift table, indexed by a hash of two neighbouring words, says how
far the window's end may move on without passing an occurrence; where it says zero, the window's suffix hash picks a
bucket of test strings and these are compared word by word and then byte by byte. Python would be slow at moving one
window, so the texts of a batch are cut into overlapping stretches and all their windows move in step, as arrays.

The tables of a benchmark of up to BROADCAST_WORDS words go to every worker whole. Of a larger one only the shift tables
and a table of bits over the windows' hashes do, whose sizes are fixed; windows of documents that pass both are probes,
and are shuffled to the test strings of their hash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import prepare, sha_key, staged
from .vecwords import NOT_ALNUM, P_WORDS, U, Words, in_pieces, scramble, small, words

#: Words of a benchmark that is broadcast whole.
BROADCAST_WORDS = 200_000
STRETCH = 512
#: Entries of a shift table, and bits over the hashes of windows, as powers of two.
TABLE_BITS, HASH_BITS = 18, 27


def whole(grid: np.ndarray) -> np.ndarray:
    """A hash of each row of word hashes."""
    x = np.zeros(len(grid), U)
    for j in range(grid.shape[1]):
        x = scramble(x * U(P_WORDS) + grid[:, j])
    return x


def block(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """The entry of two neighbouring words, or of one, in a shift table."""
    return ((b if a is None else scramble(a * U(3) + b)) >> U(64 - TABLE_BITS)).astype(np.int64)


def shifts(grid: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Entries of the shift table and how far a window may move on where it ends in them."""
    m = grid.shape[1]
    for j in range(min(2, m) - 1, m):
        yield block(grid[:, j - 1] if m > 1 else None, grid[:, j]), m - 1 - j


def ends_at(w: Words, m: int, shift: np.ndarray) -> np.ndarray:
    """The first words of all windows of `m` words over whose end the shift table does not move."""
    h, size = w.hash, np.diff(w.first)
    rows = np.flatnonzero(size >= m)
    # window ends m-1 .. size-1 of each row, STRETCH of them to a stretch
    n = -(-(size[rows] - m + 1) // STRETCH)
    row = np.repeat(rows, n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    end = w.first[row] + m - 1 + k * STRETCH
    stop = np.minimum(end + STRETCH, w.first[row + 1])
    hits = []
    while len(end):
        move = shift[block(h[end - 1] if m > 1 else None, h[end])].astype(np.int64)
        if not move.all():
            hits.append(end[move == 0])
        end = end + np.maximum(move, 1)
        live = end < stop
        end, stop = end[live], stop[live]
    return np.concatenate(hits) - m + 1 if hits else np.zeros(0, np.int64)


class Search:
    """Patterns of one length m, as runs of word hashes. `items`: for each distinct pattern, the numbers of its items."""

    def __init__(self, grid: np.ndarray, texts: list[list[bytes]], items: list[np.ndarray]):
        self.m = m = grid.shape[1]
        order = np.argsort(suffix := whole(grid))
        self.suffix, self.grid = suffix[order], grid[order]
        self.texts, self.items = [texts[i] for i in order], [items[i] for i in order]
        self.shift = np.full(1 << TABLE_BITS, max(1, m - 1), np.uint16)
        for entry, far in shifts(grid):
            np.minimum.at(self.shift, entry, np.uint16(far))

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each occurrence: its first word in `w` and the pattern's number."""
        at = ends_at(w, self.m, self.shift)
        if not len(at):
            return at, at
        seen = w.hash[at[:, None] + np.arange(self.m)]
        key = whole(seen)
        p = np.minimum(np.searchsorted(self.suffix, key), len(self.suffix) - 1)
        ok = (self.suffix[p] == key) & (self.grid[p] == seen).all(1)
        at, p = at[ok], p[ok]
        good = np.fromiter((all(w.text(a + j) == t for j, t in enumerate(self.texts[q])) for a, q in zip(at.tolist(), p.tolist())), bool, len(at))
        return at[good], p[good]


def compile_block(texts: list[str | None], numbers: list[int], window: int) -> list[Search]:
    """The searches of some items: all windows of `window` words, and shorter items as they are."""
    w = words(pa.array(texts, pa.string()), NOT_ALNUM, lower=True)
    by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for i, number in enumerate(numbers):
        ws = [w.text(j) for j in range(w.first[i], w.first[i + 1])]
        m = min(window, len(ws))
        for j in range(len(ws) - m + 1) if m else ():
            by_length[m][tuple(ws[j : j + m])].add(number)
    out = []
    for m, found in sorted(by_length.items()):
        keys = sorted(found)
        flat = words(pa.array([b" ".join(k) for k in keys], pa.binary()), NOT_ALNUM)
        out.append(Search(flat.hash.reshape(-1, m), [list(k) for k in keys], [np.array(sorted(found[k])) for k in keys]))
    return out


def _looker(shared):
    """A pandas UDF that searches texts for the items of one block."""

    def search(column: pa.Array) -> pd.DataFrame:
        searches, names = shared.value
        w = words(column, NOT_ALNUM, lower=True)
        spans: dict[int, set] = defaultdict(set)
        items: dict[int, set] = defaultdict(set)
        for s in searches:
            at, p = s.find(w)
            row = w.doc[at]
            for r, a, q in zip(row.tolist(), (at - w.first[row]).tolist(), p.tolist()):
                spans[r].add((a << 32) | (a + s.m))
                items[r].update(s.items[q].tolist())
        rows = range(len(column))
        return pd.DataFrame({"n_words": np.diff(w.first), "items": [sorted({names[i] for i in items[r]}) if r in items else [] for r in rows], "hits": [sorted(spans[r]) if r in spans else [] for r in rows]})

    @F.pandas_udf("n_words long, items array<string>, hits array<long>")
    def look(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in parts:
            yield pd.concat([*in_pieces(t, search)], ignore_index=True) if len(t) else search(pa.array([], pa.binary()))

    return look


def windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(m, h, words, item, entry, far): each window of the items with its hash, its words joined by blanks, and what it
    sets in the shift table."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            w = words(batch.column(1), NOT_ALNUM, lower=True)
            size = np.diff(w.first)
            for m in sorted({min(window, n) for n in size.tolist()} - {0}):
                rows = np.flatnonzero(size >= window if m == window else size == m)
                n = size[rows] - m + 1
                row = np.repeat(rows, n)
                at = w.first[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                grid = w.hash[at[:, None] + np.arange(m)]
                said = [b" ".join(w.text(a + j) for j in range(m)) for a in at.tolist()]
                moves = list(shifts(grid))
                entry = np.stack([e for e, _ in moves], axis=1).ravel()
                ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(moves))
                far = np.tile(np.array([f for _, f in moves], np.int32), len(at))
                cols = [pa.array(np.full(len(at), m, np.int32)), pa.array(whole(grid).view(np.int64)), pa.array(said, pa.binary()), batch.column(0).take(pa.array(row)), pa.ListArray.from_arrays(ends, pa.array(entry)), pa.ListArray.from_arrays(ends, pa.array(far))]
                yield pa.RecordBatch.from_arrays(cols, ["m", "h", "words", "item", "entry", "far"])

    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(cut, "m int, h long, words binary, item string, entry array<long>, far array<int>")


def probed(docs: DataFrame, benchmark: DataFrame, window: int, text: str, item_id: str, item_text: str) -> DataFrame:
    """(key, items, hits) of the texts that hold windows of a benchmark of any size; key is sha_key of the text."""
    spark = docs.sparkSession
    tests = staged(windows(benchmark, item_id, item_text, window), "windows")
    lengths = sorted(r.m for r in tests.select("m").distinct().collect())  # `window` rows at most
    least = tests.select("m", F.explode(F.arrays_zip("entry", "far")).alias("x")).groupBy("m", "x.entry").agg(F.min("x.far").alias("far"))
    shift = {m: np.full(1 << TABLE_BITS, max(1, m - 1), np.uint16) for m in lengths}
    bits = np.zeros(1 << (HASH_BITS - 3), np.uint8)
    # the tables' sizes are fixed, so what comes to the driver is bounded by them
    m, entry, far = (c.to_numpy() for c in least.toArrow().columns)
    for x in lengths:
        shift[x][entry[m == x]] = far[m == x]
    byte = F.shiftrightunsigned("h", 64 - HASH_BITS + 3).alias("byte")
    set_ = F.bit_or(F.expr(f"shiftleft(1, cast(shiftrightunsigned(h, {64 - HASH_BITS}) & 7 as int))"))
    at, have = (c.to_numpy() for c in tests.groupBy(byte).agg(set_.alias("set")).toArrow().columns)
    bits[at] = have
    shared = spark.sparkContext.broadcast((shift, bits))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, bits = shared.value
        for batch in small(batches):
            w = words(batch.column(1), NOT_ALNUM, lower=True)
            for m, table in shift.items():
                at = ends_at(w, m, table)
                h = whole(w.hash[at[:, None] + np.arange(m)]) if len(at) else np.zeros(0, U)
                ok = (bits[(h >> U(64 - HASH_BITS + 3)).astype(np.int64)] >> ((h >> U(64 - HASH_BITS)) & U(7)).astype(np.uint8)) & 1 == 1
                at, h = at[ok], h[ok]
                row = w.doc[at]
                said = [b" ".join(w.text(a + j) for j in range(m)) for a in at.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.full(len(at), m, np.int32)), pa.array(h.view(np.int64)), pa.array(said, pa.binary()), pa.array(at - w.first[row])], ["key", "m", "h", "said", "at"])

    probes = docs.select(sha_key(text).alias("key"), F.col(text).cast("binary").alias("t")).mapInArrow(probe, "key binary, m int, h long, said binary, at long")
    met = probes.join(tests.select("m", "h", "words", "item"), ["m", "h"]).where(F.col("said") == F.col("words"))
    hit = F.expr("shiftleft(at, 32) | (at + m)")
    return met.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(F.collect_set(hit)).alias("hits"))


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """`docs` with n_words, n_hit, items (sorted ids of the items that occur, as strings), hits (ranges of words hit,
    each as first * 2**32 + end).

    Words are runs of ASCII letters, digits and all non-ASCII characters, A-Z lowered. A window is `window` consecutive
    words of an item; a shorter item is one window; items without words never occur. Null, empty and blank texts have no
    words. Items with a null id count under the empty string; repeated ids count once. An empty benchmark hits nothing, an
    empty table gives an empty one. Very long texts are read whole, in stretches. Repeated rows are marked each. Columns of
    `docs` with the names of new ones are replaced; others, of any type, pass through.
    """
    spark = docs.sparkSession
    prepare(spark)
    keep = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "hits")]
    body = F.col(text).cast("binary")
    some = benchmark.agg(F.sum(F.length(item_text) / 2 + 1)).first()[0] or 0
    if some <= broadcast_words:
        rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), item_text).collect()
        shared = spark.sparkContext.broadcast((compile_block([r[1] for r in rows], list(range(len(rows))), window), [r[0] for r in rows]))
        out = docs.select(*keep, _looker(shared)(body).alias("__b")).select(*keep, "__b.*")
    else:
        # rows of one text have the same hits, so they meet them by the text
        met = staged(probed(docs.select(text), benchmark, window, text, item_id, item_text), "hits").withColumnRenamed("key", "__key")
        empty = spark.sparkContext.broadcast(([], []))
        counted = docs.select(*keep, sha_key(text).alias("__key"), _looker(empty)(body)["n_words"].alias("n_words"))
        none = F.array().cast("array<string>")
        out = counted.join(met, "__key", "left").select(*keep, "n_words", F.coalesce("items", none).alias("items"), F.coalesce("hits", none.cast("array<bigint>")).alias("hits"))
    # the ranges are sorted by where they begin
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(have, x):
        a, b = F.shiftright(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))
        return F.struct(F.greatest(have["end"], b).alias("end"), (have["n"] + F.greatest(F.lit(0).cast("long"), b - F.greatest(a, have["end"]))).alias("n"))

    return out.select(*keep, "n_words", "items", "hits", F.aggregate("hits", start, add, lambda x: x["n"]).alias("n_hit"))
