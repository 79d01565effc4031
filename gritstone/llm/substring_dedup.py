"""Exact removal of repeated word runs, found by recompression.

Words are symbols. In each round runs of one symbol become one symbol, and then adjacent symbols of classes "left" and
"right" become one; a new symbol's name is a hash of what it stands for, so that all workers name alike without
talking to each other. For each symbol the span of words is kept on which its making depended. Equal windows of words
hold equal symbols wherever that span lies inside the window, so each window can choose one of them (highest level
first, then greatest name, then leftmost) as its mark, and equal windows choose equal marks. Consecutive windows with
one mark are a segment. Marks that occur once in the corpus settle their windows as unique. Segments with equal marks
and equal words are repeats at once; the windows of the others that share a mark are compared one by one, by their
128-bit hashes. Both comparisons take two hashes that come from the words' bytes independently. Nothing pairs up the members of a group, and no window is left out: a word itself is a symbol whose
span is inside every window that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import prepare, sha_key, staged
from .vecwords import P_WORDS2, SPACE, Runs, U, scramble, small, words

FAR = 1 << 40


def _round(sym, lo, hi, doc, t):
    """One round of naming runs and pairs. lo, hi: the words on which a symbol depends, end exclusive."""
    n = len(sym)
    head = np.ones(n, bool)
    head[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, n))
    s, d = sym[at], doc[at]
    s = np.where(size > 1, scramble(s ^ (size.astype(U) * U(P_WORDS2))), s)
    same = d[1:] == d[:-1]
    # a run ends where its neighbours differ, so it depends on the nearest symbol of each side
    left, right = np.full(len(s), -FAR), np.full(len(s), FAR)
    left[1:][same] = lo[at[1:] - 1][same]
    right[:-1][same] = hi[at[1:]][same]
    lo, hi = np.minimum(np.minimum.reduceat(lo, at), left), np.maximum(np.maximum.reduceat(hi, at), right)
    is_left = (scramble(s ^ U(0xABCD + t)) & U(1)) == 0
    pair = np.zeros(len(s), bool)
    pair[:-1] = is_left[:-1] & ~is_left[1:] & same
    second = np.zeros(len(s), bool)
    second[1:] = pair[:-1]
    # a symbol that stays alone depends on the neighbour that it might have joined
    left, right = np.full(len(s), -FAR), np.full(len(s), FAR)
    left[1:][same] = lo[:-1][same]
    right[:-1][same] = hi[1:][same]
    lo = np.where(~is_left & ~second, np.minimum(lo, left), lo)
    hi2 = np.where(is_left, np.maximum(hi, right), hi)
    lo2 = lo.copy()
    lo2[:-1][pair[:-1]] = np.minimum(lo[:-1], lo[1:])[pair[:-1]]
    name = s.copy()
    name[:-1][pair[:-1]] = scramble(s[:-1] * U(P_WORDS2) + scramble(s[1:] + U(t)))[pair[:-1]]
    keep = ~second
    return name[keep], lo2[keep], hi2[keep], d[keep]


def _cover(a, b, rank, n, width):
    """For each of n places the greatest rank of the ranges [a, b] over it, or -1. The ranks ascend; b - a < width."""
    top = max(1, int(width).bit_length())
    at = [np.full(n, -1, np.int32) for _ in range(top)]
    k = np.floor(np.log2(b - a + 1)).astype(np.int64)
    for j in range(top):
        m = k == j
        for x in (a[m], b[m] - (1 << j) + 1):
            got = np.full(n, -1, np.int32)
            got[x] = rank[m]  # ascending, so the last one written is the greatest
            np.maximum(at[j], got, out=at[j])
    for j in range(top - 1, 0, -1):
        half = 1 << (j - 1)
        np.maximum(at[j - 1], at[j], out=at[j - 1])
        np.maximum(at[j - 1][half:], at[j][:-half], out=at[j - 1][half:])
    return at[0]


def segments(h: np.ndarray, other: np.ndarray, doc: np.ndarray, first: np.ndarray, window: int, rounds: int):
    """h, other: two independent hashes of each word. Returns (mark, two content hashes, row, first window, last window) of
    each segment; window starts count from the row's first word."""
    n = len(h)
    n_row = np.diff(first)[doc]
    place = np.arange(n) - first[doc]
    start_ok = place <= n_row - window
    levels = [(h, np.arange(n), np.arange(n) + 1, doc)]
    for t in range(rounds):
        levels.append(_round(*levels[-1], t))
    runs = Runs(h)
    mark = np.zeros(n, U)
    which = np.full(n, -1, np.int64)
    open_ = start_ok.copy()
    base = 0
    for level in range(rounds, -1, -1):
        sym, lo, hi, d = levels[level]
        a, b = np.maximum(hi - window, first[d]), np.minimum(lo, first[d + 1] - window)
        ok = (a <= b) & (lo >= first[d]) & (hi <= first[d + 1])
        count = np.concatenate(([0], np.cumsum(open_)))
        ok[ok] = count[b[ok] + 1] > count[a[ok]]
        a, b, lo, hi, sym = a[ok], b[ok], lo[ok], hi[ok], sym[ok]
        if len(a):
            key = scramble(sym ^ runs.of(lo, hi) ^ U(level))
            order = np.argsort(key)
            s = key[order]
            tie = np.zeros(len(s), bool)
            tie[1:] = s[1:] == s[:-1]
            tie[:-1] |= tie[1:].copy()
            if tie.any():  # of equal names in one window the leftmost is to win, so it comes last
                sub = order[tie]
                order[tie] = sub[np.lexsort((-lo[sub], key[sub]))]
            won = _cover(a[order], b[order], np.arange(len(a), dtype=np.int32), n, window)
            got = open_ & (won >= 0)
            chosen = order[won[got]]
            mark[got] = key[chosen]
            which[got] = base + chosen
            open_ &= ~got
            base += len(a)
        if not open_.any():
            break
    p = np.flatnonzero(start_ok)
    if not len(p):
        z = np.zeros(0, np.int64)
        return mark[p], mark[p], mark[p], z, z, z
    new = np.ones(len(p), bool)
    new[1:] = (which[p[1:]] != which[p[:-1]]) | (p[1:] != p[:-1] + 1) | (doc[p[1:]] != doc[p[:-1]])
    s = p[new]
    e = p[np.append(np.flatnonzero(new)[1:], len(p)) - 1]
    return mark[s], runs.of(s, e + window), Runs(other, P_WORDS2).of(s, e + window), doc[s], place[s], place[e]


def _long_rows(column, window):
    """The words of rows that have a whole window, and those rows' places in the batch."""
    w, other = words(column, SPACE), words(column, SPACE, other=True).hash
    size = np.diff(w.first)
    rows = np.flatnonzero(size >= window)
    keep = (size >= window)[w.doc]
    return w.hash[keep], other[keep], np.repeat(np.arange(len(rows)), size[rows]), np.concatenate(([0], np.cumsum(size[rows]))), rows


def packed(c: Column) -> Column:
    """Texts as they travel: compressed one by one, about a third less than what the shuffle makes of them."""

    @F.pandas_udf("binary")
    def pack(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        z = zstandard.ZstdCompressor(3)
        for t in parts:
            yield t.map(lambda x: z.compress(x or b""))

    return pack(c)


def repeated_spans(docs: DataFrame, window: int = 35, rounds: int = 2, text: str = "text") -> DataFrame:
    """(rid, spans): for each row of `docs` (rid: binary, text) with repeated windows, their ranges of window starts, each
    as first * 2**32 + last. Rows that share a rid must share their text, as those of a hash of it do; they count as two
    documents. Segments and windows are equal by two independent 64-bit hashes of their words' bytes."""
    prepare(docs.sparkSession)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            h, other, doc, first, rows = _long_rows(batch.column(1), window)
            if len(rows):
                key, one, two, d, a, b = segments(h, other, doc, first, window, rounds)
                rid = batch.column(0).take(pa.array(rows[d]))
                yield pa.RecordBatch.from_arrays([rid, *[pa.array(x.view(np.int64)) for x in (key, one, two)], pa.array((a << 32) | b)], ["rid", "mark", "c1", "c2", "span"])

    seg = staged(docs.select("rid", F.col(text).cast("binary").alias("text")).mapInArrow(mark, "rid binary, mark long, c1 long, c2 long, span long"), "segments")
    same = seg.groupBy("mark", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.xxhash64("rid", "span")).alias("one"))
    # marks with one segment are settled; of the others, each distinct content is kept once with its count
    shared = same.groupBy("mark").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).where("all > 1")
    state = staged(same.join(shared, "mark").select("mark", "c1", "c2", "n", "one", (F.col("kinds") > 1).alias("mixed")), "shared-marks")
    found = staged(
        seg.join(state, ["mark", "c1", "c2"]).select("rid", "span", (F.col("n") > 1).alias("whole"), (F.col("mixed") & (F.xxhash64("rid", "span") == F.col("one"))).alias("compare")).where("whole or compare"), "shared-segments"
    )

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, other, doc, first, rows = _long_rows(pa.array(map(zstandard.decompress, batch.column(1).to_pylist()), pa.binary()), window)
            spans = batch.column(2).take(pa.array(rows))
            flat_spans, size = spans.flatten().to_numpy(zero_copy_only=False), np.diff(spans.offsets.to_numpy())
            if not len(flat_spans):
                continue
            a, b = flat_spans >> 32, flat_spans & 0xFFFFFFFF
            n = b - a + 1
            row = np.repeat(np.repeat(np.arange(len(rows)), size), n)
            p = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = first[row] + p
            one, two = Runs(h).of(at, at + window), Runs(other, P_WORDS2).of(at, at + window)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[row])), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(p)], ["rid", "h1", "h2", "p"])

    ask = found.where("compare").groupBy("rid").agg(F.collect_set("span").alias("spans"))
    spelt = staged(docs.select("rid", packed(F.col(text).cast("binary")).alias("packed")).join(ask, "rid").select("rid", "packed", "spans").mapInArrow(spell, "rid binary, h1 long, h2 long, p long"), "compared-windows")
    twice = spelt.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    # the copies of a compared segment share its windows, so a repeated window is marked in the segment that was compared
    more = spelt.join(twice, ["h1", "h2"]).select("rid", F.expr("shiftleft(p, 32) | p").alias("span"))
    return found.where("whole").select("rid", "span").unionByName(more).groupBy("rid").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, window: int = 35, rounds: int = 2, text: str = "text", id_col: str | None = "doc_id") -> DataFrame:
    """`docs` without its text and with columns n_words, n_removed and kept (the words that remain, joined by single spaces).

    A word goes if a window of `window` words over it also starts anywhere else in the input, in the same row too.
    Null texts have no words and the empty string is kept; rows shorter than a window keep all. Repeated rows are two
    documents, so both lose what they share; so do rows that share an id. Null ids are allowed. Other columns pass
    through; columns of the input that are called like a new one are replaced. Very long texts are taken whole, and an empty
    table gives an empty one. Rows are told apart by 128 bits of the SHA-256 of id and text.
    """
    key = [id_col] if id_col else []
    new = ("n_words", "n_removed", "kept")
    named = docs.drop(*new).withColumn("__rid", sha_key(*key, text))
    rest = [c for c in docs.columns if c not in (*new, text)]
    spans = repeated_spans(named.select(F.col("__rid").alias("rid"), F.col(text).alias("text")), window, rounds)

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in parts:
            out = []
            for t, x in zip(texts, found):
                ws = zstandard.decompress(t).split()
                n, gone = len(ws), 0
                if x is not None and len(x):
                    x = np.asarray(x)
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, x >> 32, 1)
                    np.add.at(edge, (x & 0xFFFFFFFF) + window, -1)
                    drop = np.cumsum(edge)[:-1] > 0
                    gone = int(drop.sum())
                    ws = [w for w, d in zip(ws, drop.tolist()) if not d]
                out.append((n, gone, b" ".join(ws).decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    moved = named.select(*rest, "__rid", packed(F.col(text).cast("binary")).alias("__packed"))
    both = moved.join(spans.select(F.col("rid").alias("__rid"), F.col("spans").alias("__spans")), "__rid", "left")
    return both.withColumn("__cut", cut("__packed", "__spans")).select(*rest, "__cut.*")
