"""Words of a whole Arrow batch as numpy arrays: byte positions and 64-bit content hashes.

A word's hash is a polynomial in its bytes over the ring of 64-bit integers, taken from prefix sums, then scrambled;
sequences of words are hashed in the same way over the words' hashes. Everything is computed for the batch at once,
with no loop over documents or words.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BYTE2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)

#: Odd multipliers; each is 3 modulo 4, so that exchanged neighbours differ in all but one bit.
P_BYTES, P_WORDS, P_WORDS2 = 0x9E3779B97F4A7C17 | 3, 0xC2B2AE3D27D4EB4F | 3, 0xD6E8FEB86659FD93 | 3
P_BYTES2 = 0xA0761D6478BD642F | 3

#: Separators of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, U)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = _powers[base] = (out[0], out[1])
    return have


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (nulls empty) and where each row starts in them, with the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


#: Bytes of text that are worked on at once; the arrays over bytes take some fifty times as much.
PIECE = 2 << 20


def pieces(column: pa.Array, limit: int = PIECE):
    """Ranges (a, b) of rows that hold `limit` bytes of text at most, or one row."""
    _, at = flat(column)
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def small(batches, column: int = 1, limit: int = PIECE):
    """The batches cut by pieces()."""
    for batch in batches:
        for a, b in pieces(batch.column(column), limit):
            yield batch.slice(a, b - a)


def in_pieces(texts, work, limit: int = PIECE):
    """work(array) for the pieces of a pandas Series of binary texts, in order."""
    whole = pa.array(texts, pa.binary())
    for a, b in pieces(whole, limit):
        yield work(whole.slice(a, b - a))


@dataclass
class Words:
    data: np.ndarray  # the bytes that were hashed
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    doc: np.ndarray  # row of each word
    first: np.ndarray  # of each row, its first word; one more for the end
    hash: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def bounds(data: np.ndarray, at: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each row."""
    inside = ~sep[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, at)


def _cut(data: np.ndarray, a: int, sep: np.ndarray, limit: int) -> int:
    """The end of a stretch of about `limit` bytes from `a` on: at a separator or the end of the data."""
    b = a + limit
    while b < len(data):
        found = np.flatnonzero(sep[data[b : b + 65536]])
        if len(found):
            return b + int(found[0])
        b += 65536
    return len(data)


def words(column: pa.Array, sep: np.ndarray = SPACE, lower: bool = False, limit: int = PIECE, other: bool = False) -> Words:
    """The words of all rows; with `other` under hashes that are independent of the usual ones. A long text is hashed in stretches of about `limit` bytes that end between words, so its
    arrays over bytes stay small; what is kept of it is 32 bytes a word."""
    data, at = flat(column)
    if lower:
        data = LOWER[data]
    starts, ends, hashes = [], [], []
    table, base = (_BYTE2, P_BYTES2) if other else (_BYTE, P_BYTES)
    a = 0
    while a < len(data) or not starts:
        b = _cut(data, a, sep, limit)
        part = data[a:b]
        start, end, _ = bounds(part, at[(at >= a) & (at <= b)] - a, sep)
        up, down = powers(base, len(part) + 1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum(table[part] * up[: len(part)], out=total[1:])
        hashes.append(scramble((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(P_WORDS)))
        starts.append(start + a)
        ends.append(end + a)
        a = b
        if not len(data):
            break
    start, end, h = (np.concatenate(x) if len(x) > 1 else x[0] for x in (starts, ends, hashes))
    first = np.searchsorted(start, at)
    return Words(data, start, end, np.repeat(np.arange(len(at) - 1), np.diff(first)), first, h)


class Runs:
    """Hashes of any runs of words by position and length, in constant time each."""

    def __init__(self, h: np.ndarray, base: int = P_WORDS):
        self.up, self.down = powers(base, len(h) + 1)
        self.total = np.zeros(len(h) + 1, U)
        np.cumsum(scramble(h ^ U(base)) * self.up[: len(h)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(U))


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (x & np.uint32(1)))
    return x


_CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None, latin: bool = False, most: int = 64) -> np.ndarray:
    """The CRC-32 of each stretch of `data`, going on from the checksums in `before`. With `latin` the bytes are Latin-1 of
    letters below 128 and from 192 on, and the checksum is that of their UTF-8. All stretches move in step, byte by byte;
    those of more than `most` bytes are taken one by one."""
    size = end - start
    out = np.zeros(len(size), np.uint32) if before is None else before.astype(np.uint32)
    order = np.argsort(np.minimum(size, most + 1).astype(np.uint16), kind="stable")[::-1]
    order = order[np.searchsorted(-size[order], -most, side="left") :] if len(order) else order
    at, left, state = start[order], -size[order], ~out[order]
    step = lambda s, b: _CRC[(s ^ b) & np.uint32(255)] ^ (s >> np.uint32(8))
    for j in range(-int(left[0]) if len(left) else 0):
        k = int(np.searchsorted(left, -j, side="left"))  # those of more than j bytes come first
        s, b = state[:k], data[at[:k] + j].astype(np.uint32)
        if latin:
            wide = b >= 192
            if wide.any():
                s = np.where(wide, step(s, np.uint32(0xC3)), s)
                b = np.where(wide, b - np.uint32(64), b)
        state[:k] = step(s, b)
    out[order] = ~state
    for i in np.flatnonzero(size > most).tolist():
        raw = data[start[i] : end[i]].tobytes()
        out[i] = zlib.crc32(raw.decode("latin-1").encode() if latin else raw, int(out[i]))
    return out
