"""Near duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints at most 2 bits apart have a common value at most 1 bit from each. So every distinct fingerprint sends
out itself and its one-bit variants; those that meet under a variant are linked. A group under one variant holds one
ball of radius 1 at most, 65 fingerprints of 64 bits, whatever the data; copies of one fingerprint are folded before
that. Members are linked in a chain, not in pairs: all of them are within 2 bits of each other, so the chain has the
same components.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .session import prepare, staged
from .vecwords import SPACE, Runs, U, scramble, small, words


_GAP = re.compile(rb"[\x09-\x0D\x20]")


def _stretches(text: bytes, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased in ASCII, in stretches of about `limit` bytes."""
    a = 0
    while a < len(text):
        found = _GAP.search(text, a + limit)
        b = found.start() if found else len(text)
        yield text[a:b].lower().split()
        a = b


def shingle_hashes(text: bytes | None, width: int, seed: int = 42, limit: int = 1 << 20) -> Iterator[np.ndarray]:
    """XXH64 of each run of `width` words, lower-cased in ASCII and joined by spaces; of all words where there are fewer.
    A long text gives several arrays."""
    held: list[bytes] = []
    digest, short = xxhash.xxh64_intdigest, True
    for more in _stretches(text or b"", limit):
        ws = held + more
        if len(ws) >= width:
            line = b" ".join(ws)
            end = [e + i for i, e in enumerate(accumulate(map(len, ws)))]
            start = [0, *(e + 1 for e in end)]
            yield np.array([digest(line[a:b], seed) for a, b in zip(start, end[width - 1 :])], U)
            short = False
        held = ws[max(0, len(ws) - width + 1) :] if not short else ws
    if short and held:
        yield np.array([digest(b" ".join(held), seed)], U)


def majority(parts: Iterable[np.ndarray], block: int = 1 << 16) -> np.uint64:
    """Bit i is set where more than half of the hashes have it set; zero where there are none."""
    bits, n = np.zeros(64, np.int64), 0
    for h in parts:
        n += len(h)
        for a in range(0, len(h), block):
            bits += np.unpackbits(h[a : a + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * bits > n, bitorder="little").view(U)[0]


def fingerprint(width: int = 3, seed: int = 42):
    """A pandas UDF: text as binary to its SimHash, as a signed long. Null and empty texts give zero."""

    @F.pandas_udf("long")
    def make(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in parts:
            yield pd.Series(np.array([majority(shingle_hashes(x, width, seed)) for x in t], U).view(np.int64), dtype="int64")

    return make


def ball_links(prints: DataFrame, bits: int = 64, value: str = "fp", band: str | None = None) -> DataFrame:
    """(a, b): chains of distinct values of `prints` at most 2 bits apart within each band."""
    masks = F.array(*[F.lit(0)] + [F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(bits)])
    keys = [band] if band else []
    balls = prints.select(*keys, F.col(value).alias("b"), F.explode(masks).alias("m")).select(*keys, (F.col("b").bitwiseXOR(F.col("m"))).alias("variant"), "b")
    met = balls.withColumn("a", F.lag("b").over(Window.partitionBy(*keys, "variant").orderBy("b")))
    return met.where(F.col("a").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id_col, fp, component_id): one row for each row of `docs`; the fingerprints at most 2 bits apart are linked, and
    component_id is the least id that can be reached.

    Texts without words (null, empty, blank) have fingerprint zero and are linked like others. Repeated rows give
    repeated rows. Null ids keep their row; a component with null ids only has a null component_id. Long texts are read
    whole, in stretches; a bit that exactly half of the shingles set is 0. Other columns are not looked at, whatever
    their names; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    prints = staged(docs.select(id_col, fingerprint(width, seed)(F.col(text).cast("binary")).alias("fp")), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(ball_links(nodes.select("fp")))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written before the join, so that a very large component can be split there
    smallest = staged(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    classes = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(id_col, "fp", "component_id")


#: For edited copies: so many independent fingerprints, each of BITS bits under a key.
BANDS, BITS = 12, 16
_ODD = [(x * 0x9E3779B97F4A7C15) % (1 << 64) | 1 for x in range(1, 4 * BANDS)]


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """For each row the distinct 64-bit hashes of its `width`-word shingles, sorted; of all words where there are fewer."""
    w = words(column, SPACE, lower=True)
    runs, size = Runs(w.hash), np.diff(w.first)
    out = []
    for r, n in enumerate(size.tolist()):
        a = np.arange(w.first[r], w.first[r] + max(1, n - width + 1)) if n else np.zeros(0, np.int64)
        out.append(np.unique(runs.of(a, np.minimum(a + width, w.first[r] + n))))
    return out


def keyed_prints(sets: list[np.ndarray], bands: int = BANDS, block: int = 1 << 18) -> np.ndarray:
    """For each set of shingles `bands` numbers: 48 bits of a key, the least of the shingles in an order of the band, and
    a SimHash of 16 bits. Empty sets have the same numbers."""
    n = np.array([len(x) for x in sets], np.int64)
    full = np.flatnonzero(n)
    key, prints = np.zeros((len(sets), bands), U), np.zeros((len(sets), bands), np.uint16)
    if len(full):
        h = np.concatenate([sets[r] for r in full])
        at = np.concatenate(([0], np.cumsum(n[full])))
        for k in range(bands):
            key[full, k] = np.minimum.reduceat(h * U(_ODD[k]), at[:-1])
        per = 64 // BITS
        for g in range(0, bands, per):
            bits = np.zeros((len(full), 64), np.int64)
            for a in range(0, len(h), block):
                x = scramble(h[a : a + block] + U(_ODD[bands + g // per]))
                first, last = np.searchsorted(at, a, side="right") - 1, np.searchsorted(at, a + len(x), side="left")
                cut = np.maximum(at[first:last] - a, 0)
                bits[first:last] += np.add.reduceat(np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), cut, axis=0, dtype=np.int64)
            set_ = np.packbits(2 * bits > n[full][:, None], axis=1, bitorder="little").view(np.uint16)
            prints[full, g : g + per] = set_[:, : bands - g]
    key = scramble(key + np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return ((key & ~U(0xFFFF)) | prints.astype(U)).view(np.int64)


def bitmap(shingles: np.ndarray, bits: int = 1024) -> np.ndarray:
    """Which values the shingles' lowest bits have. A shingle whose bit another text lacks isn't in that text."""
    has = np.zeros(bits, bool)
    has[(shingles & U(bits - 1)).astype(np.int64)] = True
    return np.packbits(has, bitorder="little").view(np.int64)


def text_key(text: str = "text") -> Column:
    """SHA-256 of a text; empty for null."""
    return F.coalesce(F.unhex(F.sha2(F.col(text).cast("binary"), 256)), F.lit(b""))


def row_key(id_col: Column, sha: Column) -> Column:
    """A key of a row that is never null; rows with the same id and text share it, others don't."""
    named = F.coalesce(F.concat(F.lit("="), id_col.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(named, F.lit(":"), F.hex(sha)).cast("binary"), 256))


#: A group is compared if at most OTHERS of its texts are outside its largest class; a larger one is divided by BRANCHES
#: of each text's shingles, chosen from one of the SLICES of the SAMPLE of its shingles with the least hashes.
OTHERS, BRANCHES, SAMPLE, SLICES = 8, 4, 64, 10


def small_groups(members: DataFrame, samples: DataFrame, others: int = OTHERS, branches: int = BRANCHES) -> DataFrame:
    """The groups of divided_groups()."""
    return divided_groups(members, samples, others, branches)[0]


def divided_groups(members: DataFrame, samples: DataFrame, others: int = OTHERS, branches: int = BRANCHES) -> tuple[DataFrame, DataFrame | None]:
    """Groups of texts of several classes, none with more than `others` texts outside its largest class, as (key, node,
    root, top, shared, size); `top` is that class. And, whole, those that had to be divided, as (key, node, root, shared,
    size): a division can part two similar texts, so what is left there is for rest_links().

    `members`: (key, node, root, shared, size); keys that differ in their last BITS bits only are one group where it has
    to be divided. Of each text's `samples` (node, sample) a slice is looked at, another one for each group, and of that
    those shingles count that two texts of the group have, but not more than half of them, so what all the group's texts share does not keep them together. A text goes into the groups
    of `branches` such shingles, the least under as many orders; similar texts choose alike, and what they choose in
    several bands is one group. From then on each division at least halves a group.
    """
    done, whole, deep = None, None, False
    while True:
        each = members.groupBy("key", "root").agg(F.count("*").alias("c"))
        sizes = each.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("top"))
        sizes = staged(sizes.select("key", "n", F.col("top.root").alias("top"), (F.col("n") - F.col("top.c")).alias("others")).where("others > 0"), "group-sizes")
        fit = members.join(sizes.where(F.col("others") <= others).select("key", "top"), "key").select("key", "node", "root", "top", "shared", "size")
        done = fit if done is None else done.unionByName(fit)
        large = sizes.where(F.col("others") > others).select("key", "n")
        if large.isEmpty():
            return staged(done, "small-groups"), whole
        rows = members.join(large, "key")
        if not deep:
            rows = rows.withColumn("key", F.shiftright("key", BITS)).select("key", "node", "root", "shared", "size").distinct()
            rows = rows.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key")
        rows = staged(rows, "large-groups")
        whole = whole or rows.select("key", "node", "root", "shared", "size")
        mine = F.pmod(F.xxhash64("key"), F.lit(SLICES))
        opened = rows.join(samples, "node").select("key", "node", "n", F.explode(F.filter("sample", lambda s: F.pmod(s, F.lit(SLICES)) == mine)).alias("s"))
        df = opened.groupBy("key", "s").agg(F.count("*").alias("df"), F.first("n").alias("n")).where("df > 1 and 2 * df <= n").select("key", "s")
        orders = [F.min(F.struct(F.xxhash64("s", F.lit(i)).alias("h"), "s")).alias(f"o{i}") for i in range(branches)]
        picked = opened.join(df, ["key", "s"]).groupBy("key", "node").agg(*orders)
        picked = picked.select("key", "node", F.explode(F.array_distinct(F.array(*[F.col(f"o{i}.s") for i in range(branches)]))).alias("s"))
        members = staged(rows.join(picked, ["key", "node"]).select((F.xxhash64("key", "s") if deep else F.col("s")).alias("key"), "node", "root", "shared", "size").distinct(), "divided-groups")
        deep = True


def cross_pairs(groups: DataFrame, possible) -> DataFrame:
    """(a, b, asize, bsize): pairs of different classes in `groups` that are `possible`; every pair has a text outside the
    largest class, so a group forms at most `others` pairs for each of its texts."""
    m, n = groups.where("root <> top").alias("m"), groups.alias("n")
    once = (F.col("n.root") == F.col("n.top")) | (F.col("m.node") < F.col("n.node"))
    at = lambda x: {"shared": F.col(f"{x}.shared"), "size": F.col(f"{x}.size")}
    met = n.join(m, (F.col("m.key") == F.col("n.key")) & once & (F.col("m.root") != F.col("n.root")) & possible(at("m"), at("n")))
    first = F.col("m.node") < F.col("n.node")
    pick = lambda x, y, c: F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
    return met.select(pick("m", "n", "node").alias("a"), pick("n", "m", "node").alias("b"), pick("m", "n", "size").alias("asize"), pick("n", "m", "size").alias("bsize"))


def joining_links(a: list[np.ndarray], b: list[np.ndarray], roots: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets a[i] and b[j] with a Jaccard similarity of `similarity` or more, of these only what joins sets
    that `roots` and the pairs before leave apart. b[j] is met by a[i] if after[1][j] > after[0][i]. Bitmaps, as wide as the
    sets' sizes ask for, are compared first, with all of b at once."""
    na, nb = (np.array([len(x) for x in y], np.int64) for y in (a, b))
    width = 1 << int(np.clip(8 * (na.sum() + nb.sum()) // (len(a) + len(b)), 64, 1 << 16) - 1).bit_length()
    abits, bbits = (np.array([bitmap(x, width).view(U) for x in y]) for y in (a, b))
    held = np.bitwise_count(bbits).sum(1, dtype=np.int64)
    numbers, place = np.unique(np.concatenate(roots), return_inverse=True)
    parent, out = list(range(len(numbers))), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(a)):
        # what too small or too large sets cannot share, and what is of this class from the start
        near = np.flatnonzero((after[1] > after[0][i]) & (np.minimum(na[i], nb) >= similarity * np.maximum(na[i], nb)) & (roots[1] != roots[0][i]))
        both = np.bitwise_count(bbits[near] & abits[i]).sum(1, dtype=np.int64)
        most = np.minimum(na[i] - np.bitwise_count(abits[i]).sum(dtype=np.int64) + both, nb[near] - held[near] + both)
        for j in near[(1 + similarity) * most + 1e-6 >= similarity * (na[i] + nb[near])].tolist():
            x, y = find(place[i]), find(place[len(a) + j])
            if x == y:
                continue
            n = len(np.intersect1d(a[i], b[j], assume_unique=True))
            if n >= similarity * (na[i] + nb[j] - n):
                parent[x] = y
                out.append((i, j))
    return out


def rest_links(whole: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float, most: int = 1 << 21) -> DataFrame:
    """(a, b): links between texts of different classes in groups that were divided, so that no pair is lost there.

    `whole`: (key, node, size); `roots`: (node, root), the classes so far; `sets`: (node, s). Each text outside a group's
    largest class meets all texts of the group. Both sides are cut by hash into parts of about `most` shingles, and each
    pair of parts is one task's work, so neither rows nor memory grow with a group's square. A pair of parts gives only
    links that join what is apart, fewer than it has texts.
    """
    rows = whole.select("key", "node", "size").join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    each = rows.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("size").alias("w"))
    tops = each.groupBy("key").agg(F.sum("c").alias("n"), F.sum("w").alias("w"), F.max(F.struct("c", "root", "w")).alias("t"))
    parts = lambda w: F.ceil((w + 1) / most).cast("int")
    tops = staged(tops.where(F.col("n") > F.col("t.c")).select("key", F.col("t.root").alias("top"), parts(F.col("w") - F.col("t.w")).alias("ni"), parts(F.col("w")).alias("nj")), "rest-groups")
    rows = rows.join(tops, "key").withColumn("outer", F.col("root") != F.col("top"))
    mine, every = (lambda n: F.pmod(F.xxhash64("node"), n).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    left = rows.where("outer").select("key", "node", "root", "outer", F.lit(True).alias("asks"), mine(F.col("ni")).alias("i"), every("nj").alias("j"))
    right = rows.select("key", "node", "root", "outer", F.lit(False).alias("asks"), every("ni").alias("i"), mine(F.col("nj")).alias("j"))
    dealt = left.unionByName(right).join(sets.select("node", "s"), "node")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group["asks"].to_numpy(zero_copy_only=False)
        s, node, root, outer = np.array([*(x.values.to_numpy().view(U) for x in group["s"]), None], object)[:-1], group["node"].to_numpy(), group["root"].to_numpy(), group["outer"].to_numpy(zero_copy_only=False)
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        # two texts outside the largest class are both asked for: the lesser one asks
        after = (node[a], np.where(outer[b], node[b], np.iinfo(np.int64).max))
        found = joining_links(list(s[a]), list(s[b]), (root[a], root[b]), after, similarity) if len(a) and len(b) else []
        return pa.table({"a": pa.array([node[a[i]] for i, _ in found], pa.int64()), "b": pa.array([node[b[j]] for _, j in found], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def edited_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, bands: int = BANDS, choose: bool = False) -> DataFrame:
    """(id_col, component_id), and with `choose` (rid, stays): near duplicates whose sets of `width`-word shingles have a
    Jaccard similarity of `similarity` or more.

    Candidates: texts whose keyed fingerprints are at most 2 bits apart in one of `bands` bands, found by ball hashing.
    At similarity 0.8 a pair has one key with probability 0.8 and 16 bits at most 2 apart with 0.55, so one of 12 bands
    holds it with 0.999, whatever the edits' places; unrelated texts have no common key, however many there are.

    Verification in three rounds, the first two over pairs of distinct texts that collide. First each text is compared with one
    other, that of its groups which has the smallest part of shingles that no other text has: the original of a set of
    edited copies stands there. Then colliding pairs of texts which are not of one class yet are compared, but for
    pairs that cannot be similar by the numbers of their shared shingles and by a bitmap of each text. A group with many
    texts outside its largest class is divided first (see `small_groups`), so the pairs that are formed are at most OTHERS
    for each text in a group, and the copies of one original cost one comparison each.

    Equal texts (by SHA-256) are folded first; blank and null texts are one class. Long texts are read whole, in
    stretches. Repeated rows and null ids keep their rows, an empty table gives an empty one; other columns are not
    looked at. `rid` is row_key() of the row; rows of one key only stay in each class, those of its least id, null
    being the last, ties by the text's hash.
    """
    prepare(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            prints = keyed_prints(shingle_sets(batch.column(1), width), bands)
            at = pa.array(np.arange(len(prints) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(at, pa.array(prints.ravel()))], ["id", "sha", "prints"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = shingle_sets(batch.column(1), width)
            cols = [pa.array([f(x) for x in sets], pa.list_(pa.int64())) for f in (lambda x: x.view(np.int64), bitmap)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["node", "s", "bits"])

    id_type = docs.schema[id_col].dataType.simpleString()
    body, sha = F.col(text).cast("binary").alias("t"), text_key(text).alias("sha")
    one = staged(docs.select(F.col(id_col).alias("id"), body, sha).mapInArrow(make, f"id {id_type}, sha binary, prints array<long>"), "prints")
    reps = one.groupBy("sha").agg(F.min("id").alias("id"), F.first("prints").alias("prints"))
    reps = staged(reps.withColumn("node", F.monotonically_increasing_id()), "distinct-texts")
    masks = F.array(*[F.lit(0).cast("long")] + [F.lit(1 << i).cast("long") for i in range(BITS)])
    # only prints whose key another text has are varied
    keyed = reps.select("node", F.explode("prints").alias("p")).withColumn("k", F.shiftright("p", BITS))
    met = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    balls = keyed.join(met, "k").select("node", "p", F.explode(masks).alias("m")).select("node", F.col("p").bitwiseXOR(F.col("m")).alias("key"))
    balls = staged(balls, "balls")
    shared_by = balls.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    groups = staged(balls.join(shared_by, "key"), "groups")
    # one row of each text that collides with another
    need = groups.select("node").distinct().join(reps, "node").select("node", row_key(F.col("id"), F.col("sha")).alias("rid"))
    chosen = docs.select(body, row_key(F.col(id_col), sha).alias("rid")).join(need, "rid").dropDuplicates(["rid"])
    sets = staged(chosen.select("node", "t").mapInArrow(spread, "node long, s array<long>, bits array<long>"), "shingles")
    alone = sets.select("node", F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("u"))
    stats = sets.select("node", F.size("s").alias("size")).join(alone, "node", "left").select("node", "size", (F.col("size") - F.coalesce("u", F.lit(0))).alias("shared"))
    # a text of which too little stands anywhere else has no partner
    able = staged(stats.where(F.col("shared") + 1e-6 >= similarity * F.col("size")).withColumn("own", 1 - F.col("shared") / F.greatest("size", F.lit(1))), "able")
    members = staged(groups.join(able, "node"), "members")

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        def jaccard(x, y) -> float:
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0

        return pd.Series([jaccard(x, y) for x, y in zip(a, b)], dtype="float64")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), "s"), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("s2")), "b")
        return both.select("a", "b", alike("s", "s2").alias("j")).where(F.col("j") >= similarity).select("a", "b")

    def possible(m, n) -> Column:
        """What two texts can share at most suffices."""
        return (1 + similarity) * F.least(m["shared"], n["shared"]) + 1e-6 >= similarity * (m["size"] + n["size"])

    best = members.groupBy("key").agg(F.min(F.struct("own", "node", "shared", "size")).alias("head"))
    heads = members.join(best, "key").groupBy("node", "shared", "size").agg(F.min("head").alias("head"))
    heads = heads.where((F.col("head.node") != F.col("node")) & possible({"shared": F.col("shared"), "size": F.col("size")}, F.col("head")))
    roots = components(verified(staged(heads.select(F.col("node").alias("a"), F.col("head.node").alias("b")), "heads")))
    classed = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), "shared", "size")
    narrow, whole = divided_groups(classed, sets.select("node", F.slice("s", 1, SAMPLE).alias("sample")))
    pairs = staged(cross_pairs(narrow, possible).distinct(), "colliding")
    bits = sets.select("node", "bits")
    pairs = pairs.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("abits")), "a").join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bbits")), "b")

    def most(x: str, y: str) -> dict:
        """What text x can share with y at most, by the bitmaps."""
        lacks = F.zip_with(f"{x}bits", f"{y}bits", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return {"shared": F.col(f"{x}size") - F.aggregate(lacks, F.lit(0), lambda p, q: p + q), "size": F.col(f"{x}size")}

    pairs = staged(pairs.where(possible(most("a", "b"), most("b", "a"))).select("a", "b"), "likely")
    edges = lambda: roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(edges().unionByName(verified(pairs)))
    if whole is not None:
        roots = components(edges().unionByName(rest_links(whole, roots, sets, similarity)))
    named = reps.join(roots, "node", "left").select("sha", "id", F.coalesce("root", "node").alias("root"))
    # written before the join, so that a very large component can be split there
    smallest = staged(named.groupBy("root").agg(F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull(), "id", "sha")).alias("least")), "components")
    classes = named.join(smallest, "root").select("sha", "component_id", (F.col("sha") == F.col("least.sha")).alias("first"))
    rows = one.select("id", "sha").join(classes, "sha")
    if not choose:
        return rows.select(F.col("id").alias(id_col), "component_id")
    stays = F.col("first") & F.col("id").eqNullSafe(F.col("component_id"))
    return rows.select(F.col("id").alias(id_col), "component_id", row_key(F.col("id"), F.col("sha")).alias("rid"), stays.alias("stays"))
