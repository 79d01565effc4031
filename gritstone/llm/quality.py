"""A generalised additive model with pairwise interactions, by cyclic boosting of shallow trees on binned features.

Each round goes through the features in turn and fits a tree of up to four leaves to the loss's gradient over one
feature's bins; its leaf values are added to that feature's lookup table at a small rate, so that each feature can
only explain what the others leave. The pairs that reduce the remaining loss most then get tables of two dimensions in
the same way. A score is the sum of a few looked-up values, whatever the number of trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import prepare, staged
from .vecwords import SPACE, bounds, flat, in_pieces

FEATURES = ("log_words", "word_len", "upper", "digit", "mark", "odd_mark", "bar", "comma", "stop_end", "non_ascii", "distinct", "line_len", "repeat_byte", "symbol_word", "upper_word", "lines")
#: Labelled rows of the sample that the model is fitted on, at most. They are those of least hash.
SAMPLE = 20_000
THRESHOLD = 0.3

_UP, _DIG, _ODD, _MARK = (np.zeros(256, np.int64) for _ in range(4))
_UP[65:91] = 1
_DIG[48:58] = 1
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _MARK[_c] = 1
        if chr(_c) not in ".,;:'\"-()?!/":
            _ODD[_c] = 1


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; a text without words has zeros."""
    data, at = flat(column)
    start, end, first = bounds(data, at, SPACE)
    rows = len(at) - 1
    size, n = np.maximum(np.diff(at), 1), np.diff(first)

    def per_byte(x):
        c = np.concatenate(([0], np.cumsum(x)))
        return (c[at[1:]] - c[at[:-1]]) / size

    def per_word(x):
        c = np.concatenate(([0.0], np.cumsum(x)))
        return (c[first[1:]] - c[first[:-1]]) / np.maximum(n, 1)

    last, initial = data[end - 1] if len(end) else data[:0], data[start] if len(start) else data[:0]
    odd = np.concatenate(([0], np.cumsum(_ODD[data])))
    ups = np.concatenate(([0], np.cumsum(_UP[data])))
    length = end - start
    newline = data == 10
    lines = np.rint(per_byte(newline) * size) + 1
    same = np.zeros(len(data), np.int64)
    same[1:] = (data[1:] == data[:-1]) & (_MARK[data[1:]] > 0)
    # distinct words by a cheap code, enough for a feature
    word = _word_code(data, start, end)
    doc = np.repeat(np.arange(rows), n)
    order = np.lexsort((word, doc))
    new = np.ones(len(word), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=rows)
    out = np.stack(
        [
            np.log1p(n), per_word(length), per_byte(_UP[data]), per_byte(_DIG[data]), per_byte(_MARK[data]), per_byte(_ODD[data]), per_byte(data == 124), per_byte(data == 44),
            per_word(np.isin(last, (46, 33, 63))), per_byte(data >= 128), distinct / np.maximum(n, 1), np.log1p(size / lines), per_byte(same), per_word(odd[end] - odd[start] > 0),
            per_word((ups[end] - ups[start] >= 2) & (_UP[initial] > 0)), np.log1p(lines),
        ], 1,
    )
    out[n == 0] = 0
    return out


def _word_code(data, start, end):
    """A cheap code of each word from its first four and last bytes and its length."""
    if not len(start):
        return np.zeros(0, np.int64)
    code = end - start
    top = len(data) - 1
    for k in range(4):
        code = code * 257 + np.where(start + k < end, data[np.minimum(start + k, top)], 0)
    return code * 257 + data[end - 1]


@dataclass
class Model:
    cuts: list[np.ndarray]
    main: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    bias: float = 0.0

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.bias)
        for j, t in enumerate(self.main):
            z += t[b[j]]
        for i, j, t in self.pairs:
            z += t[b[i] // 4, b[j] // 4]
        return 1 / (1 + np.exp(-z))


def _leaf(g, h):
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Value of each bin under a best-first tree over ordered bins with gradient and hessian sums g and h."""
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    parts = [(0, len(g))]

    def split(a, b):
        k = np.arange(a + 1, b)
        if not len(k):
            return 0.0, a
        gl, hl, gt, ht = cg[k] - cg[a], ch[k] - ch[a], cg[b] - cg[a], ch[b] - ch[a]
        gain = np.where((hl > 1) & (ht - hl > 1), _gain(gl, hl) + _gain(gt - gl, ht - hl) - _gain(gt, ht), 0.0)
        i = int(np.argmax(gain))
        return float(gain[i]), int(k[i])

    while len(parts) < leaves:
        best = max(((*split(a, b), a, b) for a, b in parts), key=lambda x: x[0])
        if best[0] <= 1e-9:
            break
        _, k, a, b = best
        parts.remove((a, b))
        parts += [(a, k), (k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts one axis once and then each side of the other axis once."""
    best, value = 0.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, a.shape[0]):
            v = np.zeros_like(a)
            gain = -_gain(a.sum(), b.sum())
            for rows in (slice(0, k), slice(k, None)):
                t = _tree(a[rows].sum(0), b[rows].sum(0), 2)
                v[rows] = t
                gs, hs = a[rows].sum(0), b[rows].sum(0)
                for x in np.unique(t):
                    gain += _gain(gs[t == x].sum(), hs[t == x].sum())
            if gain > best:
                best, value = gain, (v.T if flip else v).copy()
    return best, value


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, pairs: int = 4, pair_rounds: int = 20) -> Model:
    """Fit on features x and labels y of 0 and 1. No rows or one class only: a constant."""
    m = Model([np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    p = (y.sum() + 0.5) / (len(y) + 1)
    m.bias = float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        return m
    m.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    m.main = [np.zeros(len(c) + 1) for c in m.cuts]
    b = m.bins(x)
    z = np.full(len(y), m.bias)
    for _ in range(rounds):
        for j, t in enumerate(m.main):
            q = 1 / (1 + np.exp(-z))
            step = rate * _tree(np.bincount(b[j], y - q, len(t)), np.bincount(b[j], q * (1 - q), len(t)), 4)
            t += step
            z += step[b[j]]
    coarse = [v // 4 for v in b]
    width = [(len(t) - 1) // 4 + 1 for t in m.main]

    def grids(i, j):
        q = 1 / (1 + np.exp(-z))
        k, n = coarse[i] * width[j] + coarse[j], width[i] * width[j]
        return np.bincount(k, y - q, n).reshape(width[i], width[j]), np.bincount(k, q * (1 - q), n).reshape(width[i], width[j])

    ranked = sorted(((_cross(*grids(i, j))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:pairs]
    tables = {(i, j): np.zeros((width[i], width[j])) for gain, i, j in ranked if gain > 0}
    for _ in range(pair_rounds):
        for (i, j), t in tables.items():
            step = rate * _cross(*grids(i, j))[1]
            t += step
            z += step[coarse[i], coarse[j]]
    m.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return m


def featurise(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and `x`, the features of each row's whole text."""
    prepare(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def make(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in parts:
            yield pd.Series([row for part in in_pieces(t, features) for row in part])

    return docs.select(*keep, make(F.col(text).cast("binary")).alias("x"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, sample: int = SAMPLE) -> Model:
    """The model of the labelled rows of `docs` outside the held-out fold, from `sample` of them at most: those whose
    hashed id is least, so that reruns agree. The sample is taken from the ids; features are made of its texts only.
    Rows without a label are left out; a label given twice counts by its least value, an id given twice by the text of
    least hash."""
    rows = docs.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != 0)
    known = labels.where(F.col(label).isNotNull()).groupBy(id_col).agg(F.min(label).alias("y"))
    usable = rows.select(id_col).distinct().join(known, id_col).select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)).alias("h"), F.col(id_col).alias("id"), "y")
    usable = staged(usable, "labelled")
    # all but a little more than the sample goes before the sort
    part = min(1.0, 1.5 * sample / max(1, usable.count()))
    chosen = usable.where(F.col("h") <= int(part * (1 << 20))).orderBy("h", "id").limit(sample)
    body = F.col(text).cast("binary")
    texts = rows.select(F.col(id_col).alias("id"), body.alias("t"), F.xxhash64(body).alias("k")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id").agg(F.first("h").alias("h"), F.first("y").alias("y"), F.min_by("t", "k").alias("t"))
    got = featurise(texts, "t", ("id", "h", "y")).orderBy("h", "id").toPandas()
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got["y"].to_numpy(float) if len(got) else np.zeros(0))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, threshold: float = THRESHOLD, keep: tuple[str, ...] | None = None) -> DataFrame:
    """id_col (or `keep`), held_out, score and predicted for every row of `docs`.

    Labels are learnt from rows whose crc32(id as text) mod `folds` is not 0; a null id is never held out. Null, empty
    and blank texts have features of zero and are scored like others. Repeated rows are scored each. Only features of
    the whole text enter a score, however long it is. Other columns of `docs` are not looked at; those named in `keep`
    pass through. An empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select(id_col, text), labels, id_col, text, label, folds))

    @F.pandas_udf("double")
    def score_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in parts:
            yield pd.Series([z for part in in_pieces(t, lambda c: model.value.score(features(c))) for z in part], dtype="float64")

    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
    scored = docs.select(*(keep or (id_col,)), held.alias("held_out"), score_text(F.col(text).cast("binary")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
