"""Vectorised byte kernels over Arrow text columns, shared by the operators.

Texts are handled as the UTF-8 bytes that Arrow already holds. Every word
class used by the operators is decided by single bytes, so words, lines and
their 64-bit hashes come from a few numpy passes, with no Python object per
word. A column is walked in slices of about ``SLICE_BYTES``; only a single
text longer than that makes a larger slice.
"""

from __future__ import annotations

import ctypes
import functools
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 17
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes of a word of ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in text whose A-Z are lower-cased.
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def give_back() -> None:
    """Returns freed memory to the system, as workers stay alive between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frees(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """Of a task's function over batches, one that gives freed memory back when it ends."""

    @functools.wraps(run)
    def whole(*given, **named) -> Iterator[pa.RecordBatch]:
        yield from run(*given, **named)
        give_back()

    return whole


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over 64 output bits."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random value for each byte, for sums modulo 2**64 that only choose places and never decide that texts are equal.
RAW = mix64(np.arange(1, 257, dtype=_U) * _U(_BASE))

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, _U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def slices(column: pa.Array, target: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi of a text column at a time: (lo, hi, bytes, offsets from 0). A null is an empty text."""
    n = len(column)
    if not n:
        return
    col = pc.fill_null(column.cast(pa.large_string()), "")
    _, where, what = col.buffers()
    off = np.frombuffer(where, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + target, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each text its first word; one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find_words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> Words:
    """Maximal runs of member bytes; no run crosses from one text to the next."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(offsets), np.int64))
    flags = member[data]
    edge = np.empty(n, bool)
    edge[0] = False
    edge[1:] = flags[:-1]
    at = offsets[:-1]
    edge[at[at < n]] = False
    starts = np.flatnonzero(flags & ~edge)
    edge[-1] = False
    edge[:-1] = flags[1:]
    at = offsets[1:]
    edge[at[at > 0] - 1] = False
    ends = np.flatnonzero(flags & ~edge) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


#: The prime 2**61 - 1 and a base drawn at random below it, of the hash of segments.
_PRIME = (1 << 61) - 1
_DRAWN = 0x0B5E3C91D47A268F % _PRIME
_P, _S31, _S30, _S61 = _U(_PRIME), _U(31), _U(30), _U(61)
_LOW31, _LOW30 = _U((1 << 31) - 1), _U((1 << 30) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1."""
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, both below it."""
    a1, a0, b1, b0 = a >> _S31, a & _LOW31, b >> _S31, b & _LOW31
    mid = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << _U(1)) + (mid >> _S30) + ((mid & _LOW30) << _S31) + a0 * b0)


_drawn: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the drawn base and of its inverse, modulo the prime."""
    for k, b in enumerate((_DRAWN, pow(_DRAWN, -1, _PRIME))):
        p = _drawn[k]
        while len(p) < n:
            p = np.append(p, mulmod(p, np.full(len(p), pow(b, len(p), _PRIME), _U)))
        _drawn[k] = p
    return _drawn[0][:n], _drawn[1][:n]


#: The value of each byte in the hash of segments; in FOLDED_BYTES, A-Z have the values of a-z.
RAW_BYTES = np.arange(1, 257, dtype=_U)
FOLDED_BYTES = RAW_BYTES.copy()
FOLDED_BYTES[65:91] = FOLDED_BYTES[97:123]
#: Bytes whose products with 30- and 31-bit numbers are summed before they are reduced, so that no sum overflows.
_RUN = 1 << 24


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each segment, the same wherever it stands.

    A polynomial modulo the prime 2**61 - 1 in a drawn base: two given segments of n bytes
    agree for at most n of the 2**61 bases. Where a contract says equal, bytes are compared besides.
    """
    if len(data) > 2 * SLICE_BYTES and len(starts) > 1 and (starts[1:] >= starts[:-1]).all():  # in stretches that a cache holds; a hash does not depend on where a segment stands
        out = np.empty(len(starts), _U)
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + SLICE_BYTES, "left")))
            a, b = int(starts[lo:hi].min()), int(ends[lo:hi].max())
            out[lo:hi] = _hashes(data[a:b], starts[lo:hi] - a, ends[lo:hi] - a, table)
            lo = hi
        return out
    return _hashes(data, starts, ends, table)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    n = len(data)
    power, inverse = _prime_powers(n + 1)
    low, high = np.zeros(n + 1, _U), np.zeros(n + 1, _U)
    for a in range(0, n, _RUN):
        b = min(n, a + _RUN)
        v = table[data[a:b]]
        np.cumsum(v * (power[a:b] & _LOW31), out=low[a + 1 : b + 1])
        np.cumsum(v * (power[a:b] >> _S31), out=high[a + 1 : b + 1])
        if a:
            low[a + 1 : b + 1] += _reduced(low[a])
            high[a + 1 : b + 1] += _reduced(high[a])
    if n > _RUN:  # totals of later runs are reduced where they start, so differences are taken modulo the prime
        low, high = _reduced(low), _reduced(high)
        d_low, d_high = _reduced(low[ends] + (_P - low[starts])), _reduced(high[ends] + (_P - high[starts]))
    else:
        d_low, d_high = _reduced(low[ends] - low[starts]), _reduced(high[ends] - high[starts])
    value = _reduced((d_high >> _S30) + ((d_high & _LOW30) << _S31) + d_low)
    return mix64(mulmod(value, inverse[starts]) + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def equal_segments(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Whether the ``size`` bytes from a and from b are equal, for each pair; a table makes some bytes alike."""
    out = np.ones(len(a), bool)
    lo = 0
    total = np.cumsum(size)
    while lo < len(a):  # about a million bytes at a time
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 20), "right")))
        n = size[lo:hi]
        which = np.repeat(np.arange(hi - lo), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        x, y = data[a[lo:hi][which] + at], data[b[lo:hi][which] + at]
        bad = x != y if table is None else table[x] != table[y]
        out[lo + which[bad]] = False
        lo = hi
    return out


def classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray | None = None) -> np.ndarray:
    """A number for each segment, equal for two of them if and only if their bytes (and salts) are.

    Segments are sorted by hash and each is compared, byte by byte, with the first of its hash;
    the few that differ from it, if any ever do, are told apart by their bytes.
    """
    key = segment_hashes(data, starts, ends, RAW_BYTES)
    if salt is not None:
        key = key ^ salt
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    if len(first) == len(key):
        return number
    rep = first[number]
    size = ends - starts
    same = size == size[rep]
    if salt is not None:
        same &= salt == salt[rep]
    check = np.flatnonzero(same & (rep != np.arange(len(rep))))
    same[check] = equal_segments(data, starts[check], starts[rep[check]], size[check])
    odd = np.flatnonzero(~same)
    if len(odd):
        own: dict[tuple, int] = {}
        for i in odd.tolist():
            k = (bytes(data[starts[i] : ends[i]]), None if salt is None else int(salt[i]))
            number[i] = own.setdefault(k, len(first) + len(own))
    return number


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct values, where each first stands, and the number of each element's value: by an unstable sort, which is the faster."""
    order = np.argsort(x)
    ranked = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.flatnonzero(new)
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[at], np.minimum.reduceat(order, at) if len(at) else at, number


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` neighbours; runs that cross texts are for the caller to leave out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for k in range(width):
        out *= _U(0xFF51AFD7ED558CCD)
        out += hashes[k : k + n]
    return mix64(out)


def gram_starts(words: Words, width: int) -> np.ndarray:
    """Indices of the words at which a run of ``width`` words of one text starts."""
    ok = np.ones(max(0, len(words.starts) - width + 1), bool)
    for k in range(1, width):  # the last words of each text start none
        at = words.first[1:] - k
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return np.flatnonzero(ok)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each stretch of values between neighbouring offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def crc_of_ids(ids: list) -> np.ndarray:
    """crc32 of each id as text; a null id counts as the empty text."""
    return np.fromiter((zlib.crc32(b"" if x is None else str(x).encode()) for x in ids), np.int64, len(ids))
