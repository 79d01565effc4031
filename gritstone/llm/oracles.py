"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from . import line_dedup

#: words of ASCII letters, digits and non-ASCII characters, A-Z lowered
ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, source, p, line, trim(line, ' ') AS k
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p
        FROM documents WHERE text IS NOT NULL)),
of AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
bad AS (
  SELECT l.source, l.k FROM lines l JOIN of ON l.source IS NOT DISTINCT FROM of.source WHERE l.k <> ''
  GROUP BY l.source, l.k, of.n
  HAVING count(DISTINCT l.doc_id) >= {line_dedup.LEAST_PAGES} AND count(DISTINCT l.doc_id) > {line_dedup.RATIO} * of.n),
marked AS (SELECT l.*, b.k IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.k = b.k)
SELECT doc_id, source, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, source
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT doc_id, i, count(*) OVER f AS n, md5(string_agg(word, ' ') OVER f) AS h FROM word WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM win WHERE n = 35) WHERE c > 1),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, max(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS s FROM (SELECT w.doc_id, w.i, CASE WHEN dup.i IS NOT NULL THEN 1 END AS s FROM word w LEFT JOIN dup ON w.doc_id = dup.doc_id AND w.i = dup.i)) WHERE s = 1),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS t, count(*) AS n FROM word w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i WHERE g.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def decontaminate(window: int = 10) -> str:
    """Windows of all lengths up to `window`, of documents and of items, met by their hashes."""
    words = ALNUM

    def frames(table: str, m: int) -> str:
        f = f"(PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING)"
        return f"SELECT id, i, {m} AS m, md5(string_agg(word, ' ') OVER {f}) AS h, count(*) OVER {f} AS n FROM {table}"

    lengths = range(1, window + 1)
    texts = " UNION ALL ".join(f"SELECT id, i, m, h FROM ({frames('dword', m)}) WHERE n = m AND EXISTS (SELECT 1 FROM pat WHERE pat.m = {m})" for m in lengths)
    pats = " UNION ALL ".join(f"SELECT r.id, r.m, r.h FROM ({frames('bword', m)}) r JOIN b ON r.id = b.id WHERE n = {m} AND least(len(w), {window}) = {m}" for m in lengths)
    return f"""
WITH d AS (SELECT doc_id AS id, {words} AS w FROM documents), dword AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
b AS (SELECT item_id AS id, {words} AS w FROM benchmark), bword AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM b),
pat AS ({pats}), run AS ({texts}),
occ AS (SELECT DISTINCT run.id, i, run.m, pat.id AS item FROM run JOIN pat ON run.m = pat.m AND run.h = pat.h),
hit AS (SELECT id, count(DISTINCT k) AS n FROM (SELECT id, unnest(range(i, i + m)) AS k FROM occ) GROUP BY id),
items AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM occ) GROUP BY id)
SELECT d.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.id = hit.id LEFT JOIN items ON d.id = items.id
"""


#: The checksum's table, and the checksum of the bytes of a text.
CRC_TABLE = "crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"


def crc32(of: str) -> str:
    each = f"list_transform(range(octet_length(encode({of}))), lambda i: ('0x' || substr(hex(encode({of})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {each}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


RESAMPLE = f"""
WITH {CRC_TABLE}, d AS (SELECT doc_id, {ALNUM} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM d), bw AS (SELECT unnest({ALNUM}) AS word FROM benchmark),
known AS (SELECT word, {crc32('word')} % 10000 AS b FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
s AS (SELECT b, count(*) AS s FROM dw JOIN known USING (word) GROUP BY b), t AS (SELECT b, count(*) AS t FROM bw JOIN known USING (word) GROUP BY b),
total AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s, (SELECT count(*) FROM bw)::DOUBLE AS t),
gain AS (SELECT b, floor(1000.0 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (total.s + 10000) / ((coalesce(s.s, 0) + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS g FROM s FULL JOIN t USING (b), total),
weight AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM dw JOIN known USING (word) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000.0 * ln(-ln((('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weight ON d.doc_id = weight.doc_id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, p.rank FROM scored s LEFT JOIN (SELECT * FROM placed WHERE rank <= 10 * (SELECT count(*) FROM placed) // 100) p ON s.doc_id = p.doc_id
"""

VARIANTS = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
each AS (SELECT r, n, {crc32("doc_id || ':' || r")} AS h FROM (SELECT doc_id, r, count(*) AS n FROM runs GROUP BY doc_id, r), crc),
word AS (SELECT CASE WHEN h % 199 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, sum(n)::BIGINT AS n FROM each GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
cut AS (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
pair AS (SELECT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN word w ON c.v = w.word UNION SELECT w.word, c.word, c.n FROM cut c JOIN word w ON c.v = w.word),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, encode(b)) AS b, max(n) AS n FROM pair GROUP BY a),
form AS (SELECT w.word, b.b AS form, b.n AS form_n FROM word w JOIN best b ON w.word = b.a WHERE b.n >= 5 * w.n),
up AS (SELECT word, form AS root FROM form UNION ALL SELECT up.word, form.form FROM up JOIN form ON up.root = form.word),
last AS (SELECT word, root FROM up WHERE root NOT IN (SELECT word FROM form))
SELECT w.word, f.form, coalesce(l.root, w.word) AS root, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n FROM word w LEFT JOIN best b ON w.word = b.a LEFT JOIN form f USING (word) LEFT JOIN last l USING (word)
"""
