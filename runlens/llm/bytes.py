"""Whole texts as byte arrays: words, shingles and rolling digests in NumPy.

Every function takes texts of one Arrow batch laid end to end. ``slices`` cuts a
batch into runs of documents whose bytes stay below a bound, so that the working
arrays stay small whatever the batch size; a single longer document is a run of
its own. Words are maximal runs of bytes other than space and ``\\t`` to ``\\r``,
which in UTF-8 is the same as runs of characters other than these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SOLID = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Random odd base and random values of the bytes, fixed by the seed.
_BYTE_VALUES = np.random.default_rng(20260801).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), U64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have:have + step] = out[:step] * U64(pow(base, have, 1 << 64))
        have += step
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_KEPT_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """``powers``, kept for the next run where they are no longer than those of a slice."""
    if n > SLICE_BYTES + 1:
        return powers(base, n)
    if base not in _KEPT_POWERS:
        _KEPT_POWERS[base] = powers(base, SLICE_BYTES + 1)
    return _KEPT_POWERS[base][:n]


@dataclass
class Run:
    """A run of consecutive documents: rows ``first`` to ``first + len(ends)`` of the batch."""

    first: int
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def n(self) -> int:
        return len(self.starts)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Run]:
    """Runs of documents with at most ``limit`` bytes, or one document."""
    buf, offsets = text_buffer(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        base = int(offsets[first])
        own = offsets[first:last + 1] - base
        yield Run(first, buf[base:int(offsets[last])], own[:-1], own[1:])
        first = last


def digest_table(buf: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of value * base**i, and the inverse powers that make a digest of any stretch position-free."""
    n = len(buf)
    base = (_BASE + 2 * seed * 0x51ED270B) % (1 << 64) | 1
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE_VALUES[buf] * _powers(base, n), out=sums[1:])
    return sums, _powers(pow(base, -1, 1 << 64), n + 1)


def digests(table: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digests of the stretches [start, end)."""
    sums, inverse = table
    return mix((sums[ends] - sums[starts]) * inverse[starts])


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray      # row of the run
    first: np.ndarray    # index of each document's first word, n + 1 entries
    ids: np.ndarray      # digest of each word


def words(run: Run, lower: bool = False, seed: int = 0) -> Words:
    """The words of every document of the run with a 64-bit digest of each."""
    buf = _LOWER[run.buf] if lower else run.buf
    solid = _SOLID[run.buf]
    # A word never crosses a document: a document's first byte starts a word, its last ends one.
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    filled = run.ends > run.starts
    firsts, lasts = run.starts[filled], run.ends[filled] - 1
    begins[firsts] = solid[firsts]
    stops[lasts] = solid[lasts]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, np.append(run.starts, len(buf)))
    doc = np.repeat(np.arange(run.n), np.diff(first))
    ids = digests(digest_table(buf, seed), starts, ends) if len(starts) else np.zeros(0, U64)
    return Words(starts, ends, doc, first, ids)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, digest) of each run of ``n`` words; a shorter document's words are one shingle."""
    count = np.diff(w.first)
    out_doc, out = [], []
    if len(w.ids) >= n:
        h = w.ids[:len(w.ids) - n + 1].copy()
        for j in range(1, n):
            h = mix(h + U64(0x9E3779B97F4A7C15)) ^ w.ids[j:len(w.ids) - n + 1 + j]
        h = mix(h)
        whole = w.doc[:len(h)] == w.doc[n - 1:]
        out_doc.append(w.doc[:len(h)][whole])
        out.append(h[whole])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        h = w.ids[w.first[short]].copy()
        for j in range(1, n - 1):
            more = count[short] > j
            nxt = mix(h + U64(0x9E3779B97F4A7C15)) ^ w.ids[np.minimum(w.first[short] + j, len(w.ids) - 1)]
            h = np.where(more, nxt, h)
        out_doc.append(short)
        out.append(mix(h ^ count[short].astype(U64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(out_doc), np.concatenate(out)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed integers, the way Spark's long has them."""
    return np.ascontiguousarray(x).view(np.int64)


_KIND = np.full(256, 2, np.uint8)
_KIND[_SPACE] = 0
_KIND[128:] = 1
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    _KIND[_low:_high] = 1


def tokens(run: Run, lower: bool = False) -> Words:
    """Like ``words``, but letters and digits part from other marks: ``end!!`` is ``end`` and ``!!``."""
    buf = _LOWER[run.buf] if lower else run.buf
    kind = _KIND[buf]
    edge = np.empty(len(buf), bool)
    if len(buf):
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge[run.starts[run.starts < len(buf)]] = True
    at = np.flatnonzero(edge)
    stop = np.append(at[1:], len(buf))
    solid = kind[at] > 0
    starts, ends = at[solid], stop[solid]
    first = np.searchsorted(starts, np.append(run.starts, len(buf)))
    doc = np.repeat(np.arange(run.n), np.diff(first))
    ids = digests(digest_table(buf), starts, ends) if len(starts) else np.zeros(0, U64)
    return Words(starts, ends, doc, first, ids)
