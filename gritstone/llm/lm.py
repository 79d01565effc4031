"""Language-model scores from a log-frequency Bloom filter in shards.

All pairs of neighbouring words of the training texts are counted, exactly and without a floor. A pair's count is
quantised to a power of two and the pair is entered once for each level up to its own; a count is read back by probing
level after level until one is missing. The filter has a fixed number of bits an entry, so it grows with the corpus: it
is cut by hash into shards of a bounded number of training tokens. A worker loads one shard at a time and the probes of
the texts are sent to it, packed, in place of sending all shards to every worker; one shuffle takes the probes there and
a second one takes the sums back to where their texts' rows wait. Nothing is joined and no row needs an id.

Words' counts are exact. The most frequent words, at most HEAD of them because each has at least N / HEAD of the N
tokens, are broadcast; the others stand in the shards. A frequent word's pairs are dealt by the pair, so that no word is
hot; a rare word's pairs by the word, so that its count is found beside them.

The model is p(b|a) = (c(ab) + k p(b)) / (c(a) + k) with p(b) = (c(b) + 0.1) / (N + 0.1 (V + 1)): pairs smoothed by a
Dirichlet prior of weight k over the words. Each token of a text is the context of one token (the end also comes before
the first word), so the denominators are summed where each word's own count is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import prepare, staged
from .vecwords import P_WORDS2, SPACE, U, scramble, small, words

#: Words in the broadcast at most; a place among them has PLACE bits.
PLACE = 20
HEAD = 1 << PLACE
#: Training tokens a shard, and shards at most (20 bits of a hash pick one).
SHARD_TOKENS, MOST_SHARDS = 1 << 21, 1 << 20
#: Spark's partitions at most; beyond, a partition has several shards, taken one after the other.
PARTITIONS = 20_000
#: Weight of the words' own probabilities, in tokens.
PRIOR = 100.0
BITS_A_ENTRY, PROBES = 16, 8
END = np.array([0xE0D0F7E87], U)
CHUNK = 2_000_000
#: Numbers in one packed row at most.
ROW = 8192
FOLDS = 10
#: Bits of a pair's name within its shard: of some two million names at most one in 2,000 is taken for another, about as by
#: the filter.
LOW = 32
BLOBS = "shard int, kind byte, chunk long, a binary, b binary, c binary"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all rows with an end after each row's; the row of each; where each row starts."""
    w = words(column, SPACE, lower=True)
    rows = len(w.first) - 1
    n = np.diff(w.first) + 1
    first = np.concatenate(([0], np.cumsum(n)))
    h = np.empty(first[-1], U)
    row = np.repeat(np.arange(rows), n)
    last = np.zeros(len(h), bool)
    last[first[1:] - 1] = True
    h[~last] = w.hash
    h[last] = END[0]
    return h, row, first


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct tokens with their counts, in chunks."""
    held, n = [], 0

    def flush():
        k, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "n"])

    for batch in small(batches, 0):
        x = tokens(batch.column(0))[0]
        held.append(x)
        n += len(x)
        if n >= CHUNK:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


@dataclass
class Filter:
    bits: np.ndarray  # packed
    size: int  # of bits, a power of two; 0 where nothing is entered

    @staticmethod
    def of(pair: np.ndarray, count: np.ndarray, block: int = 1 << 18) -> Filter:
        level = levels_of(count)
        size = 1 << max(10, int(BITS_A_ENTRY * (level + 1).sum()).bit_length())
        flat = np.zeros(size, bool)
        for j in range(int(level.max(initial=-1)) + 1):
            some = pair[level >= j]
            for a in range(0, len(some), block):
                for at in Filter.places(some[a : a + block], j, size):
                    flat[at] = True
        return Filter(np.packbits(flat, bitorder="little"), size)

    @staticmethod
    def places(pair: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
        x = scramble(pair + np.full(1, level, U) * U(P_WORDS2))
        a, b = x & U(0xFFFFFFFF), (x >> U(32)) | U(1)
        for k in range(PROBES):
            yield ((a + b * U(k)) & U(size - 1)).astype(np.int64)

    def has(self, pair: np.ndarray, level: int) -> np.ndarray:
        x = scramble(pair + np.full(1, level, U) * U(P_WORDS2))
        a, b = x & U(0xFFFFFFFF), (x >> U(32)) | U(1)
        out = np.zeros(len(pair), bool)
        left = np.arange(len(pair))
        for k in range(PROBES):
            at = ((a[left] + b[left] * U(k)) & U(self.size - 1)).astype(np.int64)
            left = left[((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)]
        out[left] = True
        return out

    def counts(self, pair: np.ndarray) -> np.ndarray:
        """Each pair's quantised count: 0 where the filter lacks it."""
        found = np.zeros(len(pair), np.int64)
        open_ = np.arange(len(pair)) if self.size else np.zeros(0, np.int64)
        level = 0
        while len(open_):
            open_ = open_[self.has(pair[open_], level)]
            level += 1
            found[open_] = level
        return np.where(found > 0, 2.0 ** (found - 1), 0.0)


def levels_of(count: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(count, 1)) + 1e-9).astype(np.int64)


@dataclass
class Head:
    """What every worker has: the frequent words' counts and the totals."""

    n: int
    v: int
    word: np.ndarray  # hashes, sorted
    count: np.ndarray
    shards: int
    prior: float
    chunk: int = CHUNK
    row: int = ROW

    def own(self, count: np.ndarray) -> np.ndarray:
        """A word's own probability."""
        return (count + 0.1) / (self.n + 0.1 * (self.v + 1))

    @property
    def shift(self) -> int:
        return max(1, len(self.word).bit_length())

    @cached_property
    def start(self) -> np.ndarray:
        return np.searchsorted(self.word, np.arange(1 << (self.shift + 1), dtype=U) << U(63 - self.shift))

    def place(self, h: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.full(len(h), -1)
        last = len(self.word) - 1
        p = np.minimum(self.start[(h >> U(63 - self.shift)).astype(np.int64)], last)
        below = np.flatnonzero(self.word[p] < h)
        while len(below):
            p[below] += 1
            below = below[p[below] <= last]
            below = below[self.word[p[below]] < h[below]]
        p = np.minimum(p, last)
        return np.where(self.word[p] == h, p, -1)

    @cached_property
    def rank(self) -> np.ndarray:
        """Of each place the word's number by falling count: small for most tokens, so its high bytes compress."""
        out = np.empty(len(self.word), np.int64)
        out[np.argsort(-self.count, kind="stable")] = np.arange(len(self.word))
        return out

    @cached_property
    def ranked(self) -> np.ndarray:
        return np.sort(self.count)[::-1]

    def by_word(self, h: np.ndarray) -> np.ndarray:
        return ((scramble(h + U(P_WORDS2)) >> U(44)) * U(self.shards)) >> U(20)

    def pairs(self, before: np.ndarray, h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard of each pair, and its name there."""
        x = scramble(before * U(P_WORDS2) + scramble(h))
        return np.where(place >= 0, ((x >> U(44)) * U(self.shards)) >> U(20), self.by_word(h)), x & U((1 << LOW) - 1)


def _before(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[first[:-1]] = END[0]
    return out


def narrow(x: np.ndarray, width: int, planes: bool = False) -> bytes:
    """The lowest `width` bytes of each number; with `planes` all first bytes before all second ones, which compresses."""
    b = x.astype(U).view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(b.T if planes else b).tobytes()


def wide(data: bytes, width: int, planes: bool = False) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = b.reshape(width, -1).T if planes else b.reshape(-1, width)
    return out.view(U)[:, 0]


class Rows:
    """Packed rows on their way to a batch."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, shard: int, kind: int, chunk: int, a=b"", b=b"", c=b"") -> None:
        self.rows.append((shard, kind, chunk, *(x if isinstance(x, bytes) else x.tobytes() for x in (a, b, c))))

    def batch(self) -> pa.RecordBatch:
        cols, self.rows = list(zip(*self.rows)) or [[]] * 6, []
        kinds = (pa.int32(), pa.int8(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], ["shard", "kind", "chunk", "a", "b", "c"])


def _cuts(shard: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of sorted shards, `most` at a time."""
    edge = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        for i in range(a, b, most):
            yield int(shard[a]), i, min(b, i + most)


_MOST = (1 << 20) - 1


def _pair_counts(batches: Iterator[pa.RecordBatch], m: Head) -> Iterator[pa.RecordBatch]:
    """Kind 1: a is the distinct pairs of some shard in a chunk, as differences of their sorted names, b their counts."""
    held, n = [], 0

    def flush():
        out = Rows()
        key, c = np.unique(np.concatenate(held), return_counts=True)
        more = -(-c // _MOST)
        if (more > 1).any():
            key, c = np.repeat(key, more), np.repeat(-(-c // more), more)  # a little too many of some millions
        shard, name = (key >> U(LOW)).astype(np.int64), key & U((1 << LOW) - 1)
        for s, i, j in _cuts(shard, m.row):
            out.add(s, 1, 0, narrow(np.diff(name[i:j], prepend=U(0)), 4, True), narrow(c[i:j], 3, True))
        return out.batch()

    for batch in small(batches, 0):
        h, _, first = tokens(batch.column(0))
        before = _before(h, first)
        for a in range(0, len(h), m.chunk):
            x = h[a : a + m.chunk]
            shard, name = m.pairs(before[a : a + m.chunk], x, m.place(x))
            held.append((shard << U(LOW)) | name)
            n += len(x)
            if n >= m.chunk:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


def _rare_words(batches: Iterator[pa.RecordBatch], m: Head) -> Iterator[pa.RecordBatch]:
    """Kind 0: a and b are words and counts."""
    for batch in batches:
        h, c = batch.column(0).to_numpy(zero_copy_only=False).view(U), batch.column(1).to_numpy(zero_copy_only=False)
        shard = m.by_word(h).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        out = Rows()
        for s, i, j in _cuts(shard[order], m.row):
            out.add(s, 0, 0, h[order[i:j]], c[order[i:j]].astype(np.int64))
        if out.rows:
            yield out.batch()


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a shard, kind 0: the filter's bits, the rare words sorted, their counts. Rows come sorted by shard."""
    now, pairs, rare, size = None, [], [], 0

    def merged() -> list:
        name, c = (np.concatenate(x) for x in zip(*pairs))
        order = np.argsort(name)
        name, c = name[order], c[order]
        at = np.flatnonzero(np.diff(name, prepend=U(0)) | (np.arange(len(name)) == 0).astype(U))
        return [(name[at], np.add.reduceat(c, at))]

    def done():
        f = Filter.of(*merged()[0]) if pairs else Filter(np.zeros(0, np.uint8), 0)
        h, c = (np.concatenate(x) for x in zip(*rare)) if rare else (np.zeros(0, U), np.zeros(0, np.int64))
        order = np.argsort(h)
        out = Rows()
        out.add(now, 0, 0, f.bits, h[order], c[order])
        return out.batch()

    for batch in batches:
        for shard, kind, _, a, b, _ in zip(*(x.to_pylist() for x in batch.columns)):
            if now is not None and shard != now:
                yield done()
                pairs, rare, size = [], [], 0
            now = shard
            if kind == 0:
                rare.append((np.frombuffer(a, U), np.frombuffer(b, np.int64)))
            else:
                pairs.append((np.cumsum(wide(a, 4, True)), wide(b, 3, True).astype(np.int64)))
                size += len(b) // 3
                if size > 4 * CHUNK:
                    pairs, size = merged(), 0
    if now is not None:
        yield done()


@dataclass
class Model:
    head: Head
    shards: DataFrame  # a row a shard

    @property
    def n(self) -> int:
        return self.head.n


def _dealt(rows: DataFrame, shards: int, by: str = "shard") -> DataFrame:
    return rows.repartition(max(1, min(shards, PARTITIONS)), by).sortWithinPartitions(by, "kind")


def train(docs: DataFrame, text: str = "text", head: int = HEAD, prior: float = PRIOR, shard_tokens: int = SHARD_TOKENS, chunk: int = CHUNK, row: int = ROW) -> Model:
    """The model of all rows of `docs`, whole texts; null texts are empty, repeated rows count each. An empty table knows
    nothing. Other columns are not looked at."""
    spark = docs.sparkSession
    prepare(spark)
    body = docs.select(F.col(text).cast("binary").alias("t"))
    counts = staged(body.mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # at most `head` words can have n / head of the n tokens
    least = -(-n // min(head, HEAD - 1)) if n else 1
    top = counts.where(F.col("c") >= least).toArrow()
    word, count = top.column(0).to_numpy().view(U), top.column(1).to_numpy()
    order = np.argsort(word)
    shards = max(1, min(MOST_SHARDS, -(-n // shard_tokens)))
    model = Head(n, v, word[order], count[order], shards, prior, chunk, row)
    shared = spark.sparkContext.broadcast(model)
    pairs = body.mapInArrow(lambda b: _pair_counts(b, shared.value), BLOBS)
    rare = counts.where(F.col("c") < least).mapInArrow(lambda b: _rare_words(b, shared.value), BLOBS)
    return Model(model, staged(_dealt(pairs.unionByName(rare), shards).mapInArrow(_build, BLOBS), "shards"))


def _probes(batches: Iterator[pa.RecordBatch], m: Head, batch_text: int) -> Iterator[pa.RecordBatch]:
    """For each piece of a batch: kind 1, probes of frequent words; kind 2, of rare words (a: differences of rows, b: how
    many of each, c: the probes' names and the words' ranks or hashes; all by byte planes); kind 3, the kept columns, what the head knows of each row, the number of other rows sent."""
    part = TaskContext.get().partitionId()
    for number, batch in enumerate(small(batches, batch_text)):
        column = batch.column(batch_text)
        h, row, first = tokens(column)
        seal = xxhash.xxh64(h.tobytes(), seed=number).intdigest() >> 20
        chunk = (part << 44 ^ seal) & ((1 << 63) - 1)
        before = _before(h, first)
        rows = len(column)
        known, base, score = np.zeros(rows), np.zeros(rows), np.zeros(rows)
        out, sent = Rows(), 0
        for i in range(0, len(h), m.chunk):
            x, r = h[i : i + m.chunk], row[i : i + m.chunk]
            place = m.place(x)
            got = place >= 0
            c = m.count[place[got]] if len(m.count) else np.zeros(0)
            log = np.log10(m.own(c))
            known += np.bincount(r[got], minlength=rows)
            base += np.bincount(r[got], log, rows)
            score += np.bincount(r[got], log + np.log10(m.prior) - np.log10(c + m.prior), rows)
            shard, name = m.pairs(before[i : i + m.chunk], x, place)
            order = np.argsort(shard, kind="stable")
            for kind, some in ((1, order[got[order]]), (2, order[~got[order]])):
                name_, other = name[some], m.rank[place[some]] if kind == 1 else x[some]
                for s, a, b in _cuts(shard[some].astype(np.int64), m.row):
                    at = r[some[a:b]]
                    edge = np.flatnonzero(np.diff(at, prepend=-1))
                    out.add(s, kind, chunk, narrow(np.diff(at[edge], prepend=0), 4, True), narrow(np.diff(edge, append=b - a), 4, True), narrow(name_[a:b], 4, True) + (narrow(other[a:b], 3, True) if kind == 1 else other[a:b].tobytes()))
                    sent += 1
        sink = pa.BufferOutputStream()
        kept = pa.RecordBatch.from_arrays(batch.columns[:batch_text], batch.schema.names[:batch_text]) if batch_text else None
        if kept is not None:
            with pa.ipc.new_stream(sink, kept.schema) as w:
                w.write_batch(kept)
        about = np.stack((np.diff(first).astype(float), known, base, score))
        out.add(chunk % m.shards, 3, chunk, sink.getvalue().to_pybytes(), about, np.array([sent], np.int64))
        yield out.batch()


def _answers(batches: Iterator[pa.RecordBatch], m: Head) -> Iterator[pa.RecordBatch]:
    """Of the probes of each packed row, summed by text: kind 1 with a: differences of rows, b: sums of known, base and score. Rows come
    sorted by shard, its filter first. Kind 3 passes."""
    now = None
    for batch in batches:
        out = Rows()
        for shard, kind, chunk, a, b, c in zip(*(x.to_pylist() for x in batch.columns)):
            if shard != now:
                now, f, word, count = shard, Filter(np.zeros(0, np.uint8), 0), np.zeros(0, U), np.zeros(0, np.int64)
            if kind == 0:
                f, word, count = Filter(np.frombuffer(a, np.uint8), 8 * len(a)), np.frombuffer(b, U), np.frombuffer(c, np.int64)
                continue
            if kind == 3:
                out.add(shard, 0, chunk, a, b, c)
                continue
            n = wide(b, 4, True).astype(np.int64)
            at, total = np.cumsum(n) - n, int(n.sum())
            name, other = wide(c[: 4 * total], 4, True), c[4 * total :]
            if kind == 1:
                had = f.counts(name)
                own = m.prior * m.own(m.ranked[wide(other, 3, True).astype(np.int64)])
                known = base = np.zeros(total)
                score = np.where(had > 0, np.log10(had + own) - np.log10(own), 0.0)
            else:
                h = np.frombuffer(other, U)
                p = np.minimum(np.searchsorted(word, h), max(0, len(word) - 1))
                seen = np.where(word[p] == h, count[p], 0) if len(word) else np.zeros(len(h), np.int64)
                had = np.zeros(len(h))
                had[seen > 0] = f.counts(name[seen > 0])
                known, base = (seen > 0).astype(float), np.log10(m.own(seen))
                score = np.log10(had + m.prior * m.own(seen)) - np.log10(seen + m.prior)
            out.add(shard, 1, chunk, a, np.stack([np.add.reduceat(x, at) for x in (known, base, score)]))
        if out.rows:
            yield out.batch()


def _gathered(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The texts' rows with their sums. Rows come sorted by chunk, what was kept of it first."""
    now, kept, about, left = None, None, None, 0

    def done():
        if left:
            raise RuntimeError("a chunk of texts lacks some of its sums: the input's rows came in another order when a task was repeated")
        cols = [pa.array(about[0].astype(np.int64)), pa.array(np.rint(about[1]).astype(np.int64)), pa.array(about[2]), pa.array(about[3])]
        return pa.RecordBatch.from_arrays([*(kept.columns if kept is not None else []), *cols], names)

    for batch in batches:
        for _, kind, chunk, a, b, c in zip(*(x.to_pylist() for x in batch.columns)):
            if kind == 0:
                if now is not None:
                    yield done()
                now, left = chunk, int(np.frombuffer(c, np.int64)[0])
                kept = pa.ipc.open_stream(a).read_next_batch() if a else None
                about = np.frombuffer(b, float).reshape(4, -1).copy()
                continue
            if chunk != now:
                raise RuntimeError("sums of a chunk of texts whose rows are not there")
            about[1:, np.cumsum(wide(a, 4, True).astype(np.int64))] += np.frombuffer(b, float).reshape(3, -1)
            left -= 1
    if now is not None:
        yield done()


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without the text, with n_tokens, n_known, base_score and score (log10 probabilities of the whole text). Null
    texts are empty, repeated rows are scored each, ties are nothing special, an empty table gives an empty one. Columns
    with the names of new ones are replaced; others pass through, whatever their names and types."""
    spark = docs.sparkSession
    prepare(spark)
    m, shards = spark.sparkContext.broadcast(model.head), model.head.shards
    new = ["n_tokens", "n_known", "base_score", "score"]
    cols = [c for c in docs.columns if c not in new and c != text]
    at = len(cols)
    rows = docs.select(*cols, F.col(text).cast("binary").alias("__text"))
    probes = rows.mapInArrow(lambda b: _probes(b, m.value, at), BLOBS)
    answers = _dealt(model.shards.unionByName(probes), shards).mapInArrow(lambda b: _answers(b, m.value), BLOBS)
    made = [T.StructField(c, k) for c, k in zip(new, (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()))]
    return _dealt(answers, shards, "chunk").mapInArrow(lambda b: _gathered(b, cols + new), T.StructType([*docs.select(*cols).schema.fields, *made]))


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score: all rows, learning from those whose
    crc32(id as text) mod `folds` is not 0; rows with a null id are learnt from. Null and empty texts have the end only.
    Repeated rows are learnt from and scored each."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
    rows = docs.select(F.col(id_col), held.alias("held_out"), F.col(text).alias("text"))
    model = train(rows.where(~F.col("held_out")), "text")
    return score(rows, model, "text").withColumn("train_tokens", F.lit(model.n).cast("long")).select(id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
