"""Secrets in every version of every file, through a ledger of blobs.

A text is named by its SHA-256. A (blob, rule version) pair that the ledger has is never scanned again, and a blob that
stands under many paths or in many versions is scanned once. The findings are joined back to all paths by the name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import prepare, staged

RULES_VERSION = "1"

# fixed values: the base patterns, their least lengths and the order of kinds
KINDS = ("assign", "access", "hex", "private_key", "forge_token", "web_token")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
HEX = re.compile(rb"[0-9a-f]{24,}")
# further kinds of the method itself
PRIVATE_KEY = re.compile(rb"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")
FORGE_TOKEN = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}")
WEB_TOKEN = re.compile(rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")

_HEX_ONLY = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def scan(body: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each secret in a text, in bytes, sorted. Cheap tests for needed substrings come first."""
    found = []
    low = body.lower()
    if any(x in low for x in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(body) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if b"AKIA" in body:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(body) if m.end() - m.start() >= LEAST_ACCESS]
    if b"x" * LEAST_HEX in body.translate(_HEX_ONLY):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(body)]
    if b"PRIVATE KEY-----" in body:
        found += [(m.start(), 3, m.end()) for m in PRIVATE_KEY.finditer(body)]
    if b"gh" in body or b"glpat-" in body or b"xox" in body:
        found += [(m.start(), 4, m.end()) for m in FORGE_TOKEN.finditer(body)]
    if b"eyJ" in body:
        found += [(m.start(), 5, m.end()) for m in WEB_TOKEN.finditer(body)]
    return sorted(found)


def spell(body: bytes, found: list[tuple[int, int, int]]) -> str:
    """kind:start:end of each, in code points, comma-joined."""
    if not found:
        return ""
    if body.isascii():
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
    # from place to place, each byte is decoded once
    at, last, n = {}, 0, 0
    for i in sorted({i for a, _, b in found for i in (a, b)}):
        n += len(body[last:i].decode("utf-8", "replace"))
        at[i], last = n, i
    return ",".join(f"{KINDS[k]}:{at[a]}:{at[b]}" for a, k, b in found)


FINDINGS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
FIELDS = [f.split()[0] for f in FINDINGS.split(", ")]


def _scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for t in parts:
        out = []
        for body in t:
            found = scan(body)
            base = [x for x in found if x[1] < 3]
            kinds = [x[1] for x in base]
            out.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(spell(body, base).encode()).hexdigest(), spell(body, found)))
        yield pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_versions(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", rules: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """The findings of every row of `docs` (id_col and the columns of FINDINGS), and the ledger after the scan
    (blob, rules and FINDINGS). `ledger`: what earlier scans returned; pairs in it are not scanned.

    Null texts count as the empty blob, which has no findings, nor have blank ones. Rows with one id may hold different
    versions; repeated rows have the same findings each. Null ids are kept. Very long texts are scanned whole. Of spans that
    begin at one place all are listed, those of the kind that is listed first being the first. An empty table gives an
    empty one and adds nothing to the ledger. Extra columns are ignored. Texts are shuffled once, by id and blob, and those that stand for no unseen blob end there; where no blob
    is unseen no text is read but for its name.
    """
    prepare(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    blob = F.unhex(F.sha2(body, 256))
    paths = docs.select(F.col(id_col), blob.alias("blob"))
    unseen = paths.groupBy("blob").agg(F.min(id_col).alias("one"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    pick = staged(unseen.select(F.xxhash64("one", "blob").alias("rid"), F.col("blob").alias("want")), "unseen")
    if ledger is not None and pick.isEmpty():
        return paths.join(ledger.where(F.col("rules") == rules).select("blob", *FIELDS), "blob").drop("blob"), ledger
    texts = docs.select(body.cast("binary").alias("body"), blob.alias("blob"), F.xxhash64(F.col(id_col), blob).alias("rid"))
    chosen = texts.join(pick, "rid").where(F.col("blob") == F.col("want"))
    new = staged(chosen.select("blob", F.pandas_udf(_scan, FINDINGS)("body").alias("x")).select("blob", F.lit(rules).alias("rules"), "x.*").dropDuplicates(["blob"]), "ledger")
    after = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    findings = paths.join(after.where(F.col("rules") == rules).select("blob", *FIELDS), "blob").drop("blob")
    return findings, after
