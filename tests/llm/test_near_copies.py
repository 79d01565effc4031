"""Near copies on a site of templated pages: the pairs that are formed, and planted copies."""

import random

from pyspark.sql import functions as F

from gritstone.llm import simhash


def site(n, copies, seed=5):
    """Pages that share 120 words and draw 4 of 60 passages of 20; then copies of some with one to eight words replaced."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(60_000):05d}"
    template, passages = [word() for _ in range(120)], [[word() for _ in range(20)] for _ in range(60)]
    out = [template + sum((passages[k] for k in rnd.sample(range(60), 4)), []) for _ in range(n)]
    planted = []
    for _ in range(copies):
        i = rnd.randrange(n)
        t = list(out[i])
        for _ in range(rnd.randint(1, 8)):
            t[rnd.randrange(len(t))] = word()
        planted.append((i, len(out)))
        out.append(t)
    return [" ".join(t) for t in out], planted


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def run(spark, monkeypatch, n):
    texts, planted = site(n, n // 5)
    seen = []

    def watched(groups, possible):
        each = groups.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.expr("root <> top")).alias("others"))
        seen.append(each.agg(F.sum("n"), F.sum(F.col("n") * F.col("others")), F.max("others")).first())
        return real(groups, possible)

    real = simhash.cross_pairs
    monkeypatch.setattr(simhash, "cross_pairs", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in simhash.edited_copies(docs).collect()}
    monkeypatch.setattr(simhash, "cross_pairs", real)
    s = [shingles(t) for t in texts]
    alike = {(a, b): len(s[a] & s[b]) / len(s[a] | s[b]) for a, b in planted}
    above, under = [p for p, j in alike.items() if j >= 0.8], [p for p, j in alike.items() if j < 0.8]
    caught = [sum(got[a] == got[b] for a, b in x) for x in (above, under)]
    # no page is joined to one that is not similar to some page of its class
    for i, root in got.items():
        assert root == i or any(len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8 for j in range(len(s)) if got[j] == root and j != i), i
    return seen[0], (len(above), caught[0]), (len(under), caught[1])


def test_pairs_formed_grow_with_the_pages_and_planted_copies_are_caught(spark, monkeypatch):
    small, large = run(spark, monkeypatch, 750), run(spark, monkeypatch, 3000)
    for (rows, formed, others), (n, caught), under in (small, large):
        print("rows", rows, "pairs formed", formed, "planted at 0.8 or more", n, caught, "under", under)
        assert others <= simhash.OTHERS and formed <= simhash.OTHERS * rows
        assert caught >= 0.98 * n and n > 50
    assert large[0][1] < 6 * small[0][1]


def test_a_divided_group_keeps_classes_apart_and_similar_texts_together(spark):
    # 90 texts: 70 hashes are common to all, 20 to three texts each, 10 are their own
    common = list(range(1000, 1070))
    sample = {i: common + [10_000 + 100 * (i // 3) + k for k in range(20)] + [50_000 + 100 * i + k for k in range(10)] for i in range(90)}
    members = spark.createDataFrame([(7 << simhash.BITS | i % 2, i, i, 90, 100) for i in range(90)], "key long, node long, root long, shared int, size int")
    got = simhash.small_groups(members, spark.createDataFrame(list(sample.items()), "node long, sample array<long>"), others=4).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.key, set()).add(r.node)
    assert {frozenset(g) for g in groups.values()} == {frozenset(range(3 * k, 3 * k + 3)) for k in range(30)}


def test_no_pair_of_a_divided_group_is_lost(spark):
    # all texts share 172 words; the two of a pair share eight of their last 28 besides, so few shingles tell the pairs apart
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(60_000):05d}"
    template, texts = [word() for _ in range(172)], []
    for _ in range(200):
        own = [word() for _ in range(8)]
        texts += [" ".join(template + own + [word() for _ in range(20)]) for _ in range(2)]
    s = [shingles(t) for t in texts]
    alike = [(i, j) for i in range(len(s)) for j in range(i) if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])]
    least = list(range(len(s)))
    for i, j in alike:
        least[i] = min(least[i], least[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in simhash.edited_copies(docs).collect()}
    assert len(alike) == 200 and [got[i] for i in range(len(s))] == least


def test_joining_links_are_exact_and_make_a_forest():
    import numpy as np

    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 63, 120).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rnd.permutation(120)[: 120 - k]], rnd.integers(0, 1 << 63, k).astype(np.uint64)])) for k in rnd.integers(0, 40, 150)]
    sets += [rnd.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 0, 1, 5, 300)]
    node = np.arange(len(sets))
    found = simhash.joining_links(sets, sets, (node, node), (node, node), 0.8)

    def classes(pairs):
        root = node.tolist()
        for _ in range(len(sets)):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    jaccard = lambda x, y: len(np.intersect1d(x, y)) / max(1, len(np.union1d(x, y))) if len(x) or len(y) else 1
    want = [(i, j) for i in node for j in node[i + 1 :] if jaccard(sets[i], sets[j]) >= 0.8]
    assert set(found) <= set(want) and classes(found) == classes(want)
    assert len(found) == len(sets) - len(set(classes(want))) < len(want)
