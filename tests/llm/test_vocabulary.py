"""Spelling variants, token counts and importance resampling against plain versions and odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gritstone.llm import queries as Q
from gritstone.llm import resample, spelling, tokens
from gritstone.llm.vecwords import crc32

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_checksums():
    rnd = random.Random(1)
    ws = ["".join(rnd.choice("abcdéÀz") for _ in range(rnd.choice([0, 1, 2, 9, 63, 64, 65, 200]))) for _ in range(300)]
    before = np.array([zlib.crc32(str(i).encode()) for i in range(len(ws))], np.uint32)
    for latin in (False, True):
        enc = [w.encode("latin-1" if latin else "utf-8") for w in ws]
        end = np.cumsum([len(e) for e in enc])
        got = crc32(np.frombuffer(b"".join(enc), np.uint8), end - [len(e) for e in enc], end, before, latin)
        assert got.tolist() == [zlib.crc32(w.encode(), int(p)) for w, p in zip(ws, before)]


def test_op12_is_the_library_on_whole_texts(spark, sf, sp):
    got = {r.doc_id: r for r in Q.queries()["op12_token_counts"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = len(sp.encode(d.text or ""))
        assert (got[d.doc_id].n_bytes, got[d.doc_id].n_tokens, got[d.doc_id].over_limit) == (len((d.text or "").encode()), n, n > 4096)


def test_tokens_of_odd_texts(spark, sp):
    rnd = random.Random(4)
    odd = ["", " ", "  ", "\n", " \n", "\n ", "a", " a", "a ", "a  b", "a \n b", "\n\n\na", "   \n   x  \n", "</s> <s> <unk> <0x0A>", "▁a▁▁b ▁", "日本語 テキスト", "x" * 300, "\r\n\t a　b", "é́ ﬁ \x00 ퟿", "word\n" * 50]
    odd += ["".join(rnd.choice([" ", "  ", "\n", "▁", "ab", "the", "é", "日", ".", "0", "\t", "☃"]) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    here = tokens.Lengths(open(MODEL, "rb").read(), {}, room=50)
    for t in odd:
        assert here.of(t) == len(sp.encode(t)), repr(t)
    assert len(here) <= 50
    long = "abc defgh  ij\n" * 200_000
    assert here.of(long) == len(sp.encode(long))
    # a pre-token of any length, in parts that no piece joins
    run = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/日本") for _ in range(20_000))
    for key in (run, "\n" + run, "  " + run):
        assert here.long(key, 500) == here.encode(key)
    rows = [(i, t, "old") for i, t in enumerate([*odd, None])] + [(None, "two words", "old"), (0, "", "old")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumn("item", F.lit(1)).repartition(5)
    got = tokens.count_tokens(docs, MODEL, limit=10, most=20)
    assert got.columns == ["doc_id", "text", "item", "n_bytes", "n_tokens", "over_limit"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (len(sp.encode(r.text or "")), len((r.text or "").encode()), len(sp.encode(r.text or "")) > 10)
    assert tokens.count_tokens(docs.limit(0), MODEL).count() == 0


def test_token_counts_shuffle_no_texts(spark, sf):
    plan = tokens.count_tokens(spark.read.parquet(f"{sf}/documents.parquet"), MODEL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def plain_variants(rows, modulus=199, least=6, count=5, ratio=5):
    n = Counter()
    for i, text in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = r.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % modulus == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= least:
                n[r] += 1
    n = {w: c for w, c in n.items() if c >= count}
    letters = sorted({c for w in n for c in w})
    near, form = {}, {}
    for w in n:
        cut = {w[:i] + w[i + 1 :] for i in range(len(w))}
        put = {w[:i] + c + w[i + j :] for i in range(len(w) + 1) for c in letters for j in (0, 1)}
        near[w] = sorted((cut | put) & set(n) - {w})
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1 << 17, 12])
def test_variants_match_all_pairs(spark, most):
    """Also where Spark takes large tries down, level by level."""
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randint(6, 9))) for _ in range(60)]
    weight = [rnd.choice([1, 1, 6, 40]) for _ in base]
    rows = [(i, " ".join(rnd.choices(base, weight, k=80)) + rnd.choice(["", "\n", " 日本 x1y ", "Ébabab-ABABAB"])) for i in range(120)]
    rows += [(None, "babababa " * 6), (5, None), (6, ""), (7, " \n"), (7, "aaaaaaa aaaaaaaa " * 5), (7, "aaaaaaa aaaaaaaa " * 5), (8, "x" * 90 + " " + "x" * 91)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "id": F.lit(2)}).repartition(4)
    got = spelling.variants(docs, modulus=7, most=most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(rows, modulus=7)
    assert sorted(map(tuple, got.collect()), key=str) == want and sum(w[1] is not None for w in want) > 5
    assert spelling.variants(docs.limit(0)).count() == 0


def test_variants_of_a_long_text(spark):
    text = " ".join(f"wörter{chr(97 + i % 7)}{chr(97 + i % 5)}" for i in range(400_000))
    rows = [(1, text), (2, "y" * 300_000)]
    got = sorted(map(tuple, spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == plain_variants(rows)


def plain_resample(docs, target, most=1, buckets=10_000, least=20, percent=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))

    def feats(t):
        w = words(t)
        return Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(w) - k + 1))

    f = [feats(t) for _, t in docs]
    s, t = sum(f, Counter()), sum((feats(x) for x in target), Counter())
    n, m = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in s}
    import hashlib

    out = []
    for (i, text), x in zip(docs, f):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in x.items())
        out.append([i, sum(x.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    place = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted((tuple(r[:4]) + (place.get(id(r)),) for r in out), key=str)


@pytest.mark.parametrize("most", [1, 3])
def test_resample_is_the_plain_draw(spark, most):
    rnd = random.Random(8)
    vocab = [f"W{i}" for i in range(300)] + ["é", "日本", "a.b"]
    docs = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 60)))) for i in range(200)] + [(None, "null id " * 20), (3, None), (4, ""), (5, " .. "), (6, "the " * 5000), (6, "the " * 5000)]
    target = [" ".join(rnd.choices(vocab[:40], k=50)) for _ in range(10)] + [None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"bucket": F.lit("x"), "rid": F.lit(1), "id": F.lit(0), "s": F.lit(0)}).repartition(4)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(frame, bench, most_words=most)
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(docs, target, most)
    assert resample.resample(frame.limit(0), bench).count() == 0
    assert sorted(map(tuple, resample.resample(frame, bench.limit(0), most_words=most).collect()), key=str) == plain_resample(docs, [], most)


def test_rows_are_told_apart_when_short_hashes_collide(spark, monkeypatch):
    """Line and substring dedup give the same with a 64-bit hash that always collides."""
    from gritstone.llm import line_dedup, mixing, substring_dedup

    run = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"menu\nown line {i}\n{run if i % 3 == 0 else ''} tail {i}", "a") for i in range(30)] + [(None, "menu", None), (None, None, "a"), (3, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)

    def results():
        lines = line_dedup.drop_boilerplate(docs, mark=True).select("doc_id", "source", "text", "n_lines", "n_dropped")
        spans = substring_dedup.remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept")
        return [sorted(map(str, x.collect())) for x in (lines, spans)]

    want = results()
    assert any("n_dropped=1" in r for r in want[0]) and any("n_removed=41" in r for r in want[1])
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    assert results() == want
    # rows of one id, and many sources of one size: no task gets all of them
    many = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one two").alias("text"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    got = mixing.mix(many)
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    # but the sums of ranges, a row each
    assert all("keys=[part" in plan[i + 1] for i, line in enumerate(plan) if "SinglePartition" in line) and got.agg(F.sum("taken")).first()[0] <= 8000
    monkeypatch.undo()
    got = mixing.mix(many.withColumn("source", F.lit("x")))
    assert got.count() == 4000 and got.where("taken <> 2").count() == 0
