"""Each registered query against a plain version over the same whole table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from gritstone.llm import queries as Q
from gritstone.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows(spark, sf, name):
    got = Q.queries()[name](spark, sf).collect()
    out = {r.doc_id: r for r in got}
    assert len(out) == len(got)
    return out


def held(i, k):
    return zlib.crc32(str(i).encode()) % k == 0


def test_op1(spark, sf, docs):
    got = rows(spark, sf, "op1_mix_sources")
    assert got.keys() == docs.keys()
    size = {i: len(WORD.findall(d.text or "")) for i, d in docs.items()}
    by = Counter()
    for i, d in docs.items():
        by[d.source] += size[i]
    order = sorted(by)
    left, open_, target = sum(by.values()), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}
    while open_:
        w = sum(open_.values())
        over = [s for s in open_ if left * open_[s] / w > 3 * by[s]]
        if not over:
            target |= {s: left * x / w for s, x in open_.items()}
            break
        for s in over:
            target[s] = 3.0 * by[s]
            del open_[s]
        left -= sum(target[s] for s in over)
    taken = Counter()
    for i, r in got.items():
        s = docs[i].source
        assert r.size == size[i] and r.source_size == by[s]
        assert r.target == pytest.approx(target[s])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    most = max(size.values())
    assert all(abs(taken[s] - target[s]) <= most for s in order)
    assert sum(taken.values()) <= sum(size.values())
    again = rows(spark, sf, "op1_mix_sources")
    assert {i: r.taken for i, r in again.items()} == {i: r.taken for i, r in got.items()}


def test_op4(spark, sf, docs):
    got = rows(spark, sf, "op4_simhash")

    def fp(text):
        w = WORD.findall((text or "").translate(LOW))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        c = [0] * 64
        for x in s:
            h = xxhash.xxh64_intdigest(x.encode(), 42)
            for b in range(64):
                c[b] += h >> b & 1
        return sum(1 << b for b in range(64) if 2 * c[b] > len(s))

    prints = {i: fp(d.text) for i, d in docs.items()}
    assert {i: f"{p:016x}" for i, p in prints.items()} == {i: r.fingerprint for i, r in got.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {i: find(i) for i in ids} == {i: r.component_id for i, r in got.items()}


def test_op5(spark, sf, docs):
    got = rows(spark, sf, "op5_secret_scan")
    assert got.keys() == docs.keys()
    pats = [
        (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6, "assign"),
        (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20, "access"),
        (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24, "hex"),
    ]
    some = 0
    for i, d in docs.items():
        f = sorted((m.start(), k, m.end()) for k, (p, ok, _) in enumerate(pats) for m in p.finditer(d.text or "") if ok(m))
        n = Counter(k for _, k, _ in f)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == (n[0], n[1], n[2])
        assert r.base_sha256 == sha(",".join(f"{pats[k][2]}:{a}:{b}" for a, k, b in f))
        spans = [x for x in r.spans.split(",") if x]
        assert {f"{pats[k][2]}:{a}:{b}" for a, k, b in f} <= set(spans)
        some += bool(f)
    assert some


def benchmark_hits(spark, sf, texts):
    """For each id: its number of words, the words hit and the items."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOW))
    pats = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = split(r.text)
        m = min(10, len(w))
        for j in range(len(w) - m + 1) if m else ():
            pats[tuple(w[j : j + m])].add(r.item_id)
    sizes = {len(p) for p in pats}
    for i, t in texts.items():
        w = split(t)
        hit, items = set(), set()
        for m in sizes:
            for j in range(len(w) - m + 1):
                if (x := tuple(w[j : j + m])) in pats:
                    hit |= set(range(j, j + m))
                    items |= pats[x]
        yield i, w, hit, items


def test_op6(spark, sf, docs):
    got = rows(spark, sf, "op6_decontaminate")
    some = 0
    for i, w, hit, items in benchmark_hits(spark, sf, {i: d.text for i, d in docs.items()}):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert r.items_sha256 == sha(",".join(sorted(map(str, items))))
        some += bool(hit)
    assert some


def test_op7(spark, sf, docs):
    got = rows(spark, sf, "op7_quality")
    assert got.keys() == docs.keys()
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == held(i, 5) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    test = [(got[i].score, q) for i, q in y.items() if held(i, 5)]
    pos, neg = [s for s, q in test if q], [s for s, q in test if not q]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    print("AUC", auc)
    assert auc > 0.93


def test_op8(spark, sf, docs):
    got = rows(spark, sf, "op8_substring_dedup")
    w = {i: WORD.findall(d.text or "") for i, d in docs.items()}
    n = Counter(tuple(x[j : j + 35]) for x in w.values() for j in range(len(x) - 34))
    for i, x in w.items():
        gone = {k for j in range(len(x) - 34) if n[tuple(x[j : j + 35])] > 1 for k in range(j, j + 35)}
        r = got[i]
        assert (r.n_words, r.n_removed) == (len(x), len(gone))
        assert r.kept_sha256 == sha(" ".join(v for k, v in enumerate(x) if k not in gone))


def test_op9(spark, sf, docs):
    got = rows(spark, sf, "op9_lm_score")
    tok = {i: WORD.findall((d.text or "").translate(LOW)) + [None] for i, d in docs.items()}
    c = Counter(t for i, x in tok.items() if not held(i, 10) for t in x)
    n, v = sum(c.values()), len(c)
    for i, x in tok.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i, 10), len(x), sum(c[t] > 0 for t in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in x), rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    test = [r for r in got.values() if r.held_out]
    print("held out, log10 a token:", sum(r.base_score for r in test) / sum(r.n_tokens for r in test), sum(r.score for r in test) / sum(r.n_tokens for r in test))


def test_op10(spark, sf, docs):
    got = rows(spark, sf, "op10_media_columns")
    assert got.keys() == docs.keys()
    same = {}
    for i, d in docs.items():
        b = (d.text or "").encode()
        p = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), sha(p), zlib.crc32(p[-16:]))
        assert (r.width, r.height, r.depth) == (192, len(p) // 192, 8)
        assert same.setdefault(d.text, r[1:]) == r[1:]


def test_op2(spark, sf, docs):
    got = Q.queries()["op2_language_id"](spark, sf).collect()
    assert len(got) == len(docs) + spark.read.parquet(f"{sf}/pages.parquet").count()
    test = [r for r in got if r.doc_id is not None and held(r.doc_id, 5) and len(docs[r.doc_id].text.split()) > 5]
    right = sum(r.lang == docs[r.doc_id].lang for r in test) / len(test)
    print("held-out accuracy", right)
    assert right > 0.97


def test_oracles(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name, sql in Q.oracle_sql().items():
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        cols = sorted(names)
        want = sorted((tuple(dict(zip(names, r))[c] for c in cols) for r in cur.fetchall()), key=str)
        have = Q.queries()[name](spark, sf)
        assert sorted(have.columns) == cols
        assert sorted((tuple(r[c] for c in cols) for r in have.collect()), key=str) == want, name


def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline as P

    now = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        now = stage(spark, now, sf).cache()
        seen[name] = {r.doc_id: r for r in now.collect()}
        if name != "mixing":
            assert now.columns == list(P.COLUMNS)
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i for i, q in y.items() if q == 1]
    kept = [i for i in good if i in seen["quality"]]
    print("kept of quality 1", len(kept) / len(good), "of quality 0", sum(i in seen["quality"] for i, q in y.items() if q == 0) / sum(q == 0 for q in y.values()))
    assert len(kept) / len(good) > 0.97
    # near duplicates against all pairs' exact similarity
    text = {i: r.text or "" for i, r in seen["line_dedup"].items()}

    def shingles(t):
        w = WORD.findall(t.translate(LOW))
        return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()

    s = {i: shingles(t) for i, t in text.items()}
    inv = defaultdict(set)
    for i, x in s.items():
        for g in x or [()]:
            inv[g].add(i)
    pairs = {(a, b) for v in inv.values() for a in v for b in v if a < b}
    link = {(a, b): len(s[a] & s[b]) / len(s[a] | s[b]) if s[a] | s[b] else 1.0 for a, b in pairs}
    stay = seen["near_duplicates"]
    root = {r["doc_id"]: r["component_id"] for r in simhash.edited_copies(spark.createDataFrame([(i, t) for i, t in text.items()], "doc_id long, text string")).collect()}
    near = [p for p, j in link.items() if j >= 0.8]
    found = sum(root[a] == root[b] for a, b in near)
    print("near pairs", len(near), "found", found)
    assert found >= 0.97 * len(near)
    gone = set(text) - set(stay)
    for i in gone:
        assert any(j >= 0.8 and i in p for p, j in link.items()), i
    assert set(stay) == {i for i in text if root[i] == i}
    clean = {i for i, _, hit, _ in benchmark_hits(spark, sf, {i: r.text for i, r in stay.items()}) if not hit}
    assert clean == set(seen["decontamination"]) and len(clean) < len(stay)
    mixed = seen["mixing"]
    size = {i: len(WORD.findall(r.text)) for i, r in seen["decontamination"].items()}
    taken, target = Counter(), {}
    for i, r in mixed.items():
        assert r["size"] == size[i] > 0 and 0 < r.taken <= 3 * r["size"] and r.text == seen["decontamination"][i].text
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[x] - target[x]) <= max(size.values()) for x in target) and sum(taken.values()) <= sum(size.values())


def test_pipeline_runs(spark, sf):
    import corpus_pipeline as P

    got = P.run(spark, sf)
    assert got.columns[:5] == list(P.COLUMNS) and 0 < got.count() < spark.read.parquet(f"{sf}/documents.parquet").count()
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "mixing"] and P.ORACLE_SQL is None


def test_op7_is_the_plain_additive_model(spark, sf, docs):
    """Features, lookups and sums by hand, from the model's tables."""
    from gritstone.llm import quality

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    m = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    got = rows(spark, sf, "op7_quality")
    marks = {i for i in range(33, 127) if not chr(i).isalnum()}
    odd = marks - set(b".,;:'\"-()?!/")

    log1p = lambda x: float(np.log1p(np.array([float(x)]))[0])  # noqa: E731  the last bit of math's differs

    def features(text):
        b = (text or "").encode()
        w = b.split()
        n, size = len(w), max(1, len(b))
        if not n:
            return [0.0] * 16
        lines = b.count(b"\n") + 1
        share = lambda ok: sum(map(ok, b)) / size
        up = lambda x: 65 <= x <= 90
        return [
            log1p(n), sum(map(len, w)) / n, share(up), share(lambda x: 48 <= x <= 57), share(lambda x: x in marks), share(lambda x: x in odd), share(lambda x: x == 124), share(lambda x: x == 44),
            sum(x[-1] in b".!?" for x in w) / n, share(lambda x: x >= 128), len({(x[:4], x[-1], len(x)) for x in w}) / n, log1p(size / lines), sum(p == q and p in marks for p, q in zip(b, b[1:])) / size,
            sum(any(c in odd for c in x) for x in w) / n, sum(up(x[0]) and sum(map(up, x)) >= 2 for x in w) / n, log1p(lines),
        ]

    for i in sorted(docs)[::3]:
        bins = [sum(c <= x for c in cuts.tolist()) for x, cuts in zip(features(docs[i].text), m.cuts)]
        z = m.bias + sum(t[b] for t, b in zip(m.main, bins)) + sum(t[bins[a] // 4, bins[b] // 4] for a, b, t in m.pairs)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9), i


def test_op2_is_the_plain_posterior(spark, sf, docs):
    """Trigram counts, grouped soft counts and the product of all evidence by hand, over every document and page."""
    from gritstone.llm import langid as L

    def bins(text):
        b = [c if c >= 65 else 32 for c in (text or "").encode().lower()]
        codes = (p << 16 | q << 8 | r for p, q, r in zip(b, b[1:], b[2:]))
        return [(c * 2654435761 & 0xFFFFFFFF) >> 18 for c in codes if c != 0x202020]

    grams = {i: Counter(bins(d.text)) for i, d in docs.items()}
    langs = sorted({d.lang for d in docs.values() if d.lang})
    count = {x: Counter() for x in langs}
    for i, d in docs.items():
        if d.lang:
            count[d.lang].update(grams[i])
    total = {x: sum(c.values()) + 0.5 * L.BINS for x, c in count.items()}
    pages = L.page_rows(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    every = [(("d", i), f"documents/{d.source or ''}", "", "", grams[i]) for i, d in docs.items()]
    every += [(("p", r.id), r.host or "", (r.markup or "")[:2].lower(), r.suffix or "", Counter(bins(r.text))) for r in pages]
    ll = {k: [sum(n * math.log((count[x][g] + 0.5) / total[x]) for g, n in c.items()) / L.TEMPER for x in langs] for k, *_, c in every}
    post = {}
    for k, v in ll.items():
        e = [math.exp(x - max(v)) for x in v]
        post[k] = [x / sum(e) for x in e]

    def soft(keys):
        out = defaultdict(lambda: [0.0] * len(langs))
        for (k, *_), key in zip(every, keys):
            out[key] = [a + b for a, b in zip(out[key], post[k])]
        return out

    def domain(host):
        m = re.search(r"([^.]+\.[^.]+)$", host)
        return m[1] if m else host

    smooth = lambda c, above, w: [(x + w * p) / (sum(c) + w) for x, p in zip(c, above)]
    hosts, domains, marks, ends = soft([e[1] for e in every]), soft([domain(e[1]) for e in every]), soft([e[2] for e in every]), soft([e[3] for e in every])
    everything = [sum(p[j] for p in post.values()) for j in range(len(langs))]
    prior = [(x + L.SMOOTH) / (sum(everything) + L.SMOOTH * len(langs)) for x in everything]
    seen = lambda table, v, j: math.log((table[v][j] + L.SMOOTH) / (everything[j] + L.SMOOTH * len(table)))
    got = {("d", r.doc_id) if r.page_id is None else ("p", r.page_id): r for r in Q.queries()["op2_language_id"](spark, sf).collect()}
    assert len(got) == len(every)
    for k, host, mark, end, _ in every:
        p = smooth(hosts[host], smooth(domains[domain(host)], prior, L.DOMAIN_WEIGHT), L.HOST_WEIGHT)
        fused = [ll[k][j] + math.log(p[j]) + seen(marks, mark, j) + seen(ends, end, j) for j in range(len(langs))]
        best = max(fused)
        assert got[k].confidence == pytest.approx(1 / sum(math.exp(x - best) for x in fused), abs=1e-4), k
        if sorted(fused)[-1] - sorted(fused)[-2] > 1e-6:
            assert got[k].lang == langs[fused.index(best)], k


def test_op10_media_are_plain_images(spark, sf, docs):
    """Every stored medium by a tar reader and a PNG reader of this test, and the features by plain sums."""
    import io
    import struct
    import tarfile

    from gritstone.llm import media

    found, index = media.store(spark.read.parquet(f"{sf}/documents.parquet"))
    digest = {r.digest: r.doc_id for r in found.collect()}
    got = {r.digest: r for r in media.read_back(index).collect()}
    assert set(got) == set(digest)
    members = {}
    for shard in {r["shard"] for r in index.collect()}:
        raw = open(shard.removeprefix("file://"), "rb").read()
        with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
            for m in tar:
                members[m.name.rpartition("/")[2].removesuffix(".png")] = tar.extractfile(m).read()
    assert set(members) == set(got)
    for k, i in digest.items():
        png, r = members[k], got[k]
        assert (r.media_bytes, r.media_sha256) == (len(png), sha(png)) and png[:8] == b"\x89PNG\r\n\x1a\n"
        at, data, size = 8, b"", None
        while at < len(png):
            n, kind = struct.unpack(">I4s", png[at : at + 8])
            body = png[at + 8 : at + 8 + n]
            assert zlib.crc32(kind + body) == struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]
            size = struct.unpack(">II", body[:8]) if kind == b"IHDR" else size
            data += body if kind == b"IDAT" else b""
            at += 12 + n
        rows_ = zlib.decompress(data)
        lines = [rows_[j : j + 193] for j in range(0, len(rows_), 193)]
        assert size == (192, len(lines)) and all(x[0] == 0 for x in lines) and sha(b"".join(x[1:] for x in lines)) == r.payload_sha256 == k
        if i % 5 == 0:
            x = [list(v[1:]) for v in lines]
            n = sum(map(len, x))
            mean = sum(map(sum, x)) / n
            spread = max(0.0, sum(v * v for a in x for v in a) / n - mean * mean) ** 0.5
            step = sum(abs(a - b) for v in x for a, b in zip(v, v[1:])) / n
            entropy = -sum(c / n * math.log2(c / n) for c in Counter(v for a in x for v in a).values())
            head, *stated = r.feature.split(";")
            assert head == f"192x{len(x)}"
            for text, want in zip(stated, (mean, spread, step, entropy)):
                assert float(text.partition("=")[2]) == pytest.approx(want, abs=1.1e-3)


def test_op5_added_kinds_are_plain_searches(spark, sf, docs):
    got = rows(spark, sf, "op5_secret_scan")
    plain = {
        "private_key": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", "forge_token": r"gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}", "web_token": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    }
    extra = {i: {f"{k}:{m.start()}:{m.end()}" for k, p in plain.items() for m in re.finditer(p, d.text or "")} for i, d in docs.items()}
    for i, want in extra.items():
        have = {x for x in got[i].spans.split(",") if x.split(":")[0] in plain}
        assert have == want, i
    # and on texts that hold all of them
    from gritstone.llm import secrets

    text = "é -----BEGIN RSA PRIVATE KEY-----\n ghp_" + "a" * 36 + " glpat-" + "b" * 20 + " xoxb-" + "1" * 10 + " eyJ" + "a" * 8 + ".eyJ" + "b" * 8 + "." + "c" * 8
    spans = secrets.scan_versions(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0].first().spans.split(",")
    want = {f"{k}:{m.start()}:{m.end()}" for k, p in plain.items() for m in re.finditer(p, text)}
    assert want <= set(spans) and len(want) == 5


def test_op2_on_long_texts_and_clashing_names(spark):
    from gritstone.llm import langid

    train = spark.createDataFrame([(1, "the cat and the dog " * 50, "en"), (2, "der Hund und die Katze " * 50, "de")], "doc_id long, text string, lang string")
    model = langid.train(train)
    long = "der Hund und die Katze " * 120_000
    rows_ = [("a", long, None, None, None), ("b", "the dog", "h.example", "en-GB", "example"), ("c", None, None, "de", None), ("d", "", "h.example", None, None), ("d", " \n", "h.example", None, None)]
    pages = spark.createDataFrame(rows_, "id string, text string, host string, markup string, suffix string").selectExpr("*", "1 as ll", "'x' as prior", "2 as domain", "3 as n0", "4 as lang", "5 as post")
    got = langid.identify(pages, model).collect()
    assert sorted(r.id for r in got) == ["a", "b", "c", "d", "d"] and {r.id: r.lang for r in got if r.id in "ab"} == {"a": "de", "b": "en"}
    assert langid.identify(pages.limit(0), model).count() == 0
