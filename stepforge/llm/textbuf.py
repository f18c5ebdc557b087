"""Vectorised text primitives over Arrow string buffers.

Every Python stage of this subpackage receives Arrow batches and works on the
UTF-8 bytes of a whole column at once: token boundaries come from byte-class
tables, token identities from hashes of eight bytes at a time.  Batches are
walked in slices of a megabyte so that temporaries stay in cache and the
worker's memory does not follow the batch size; a slice always holds whole
documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_LEN = np.uint64(0x9E3779B97F4A7C15)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls read as empty."""
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, target: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` bytes each, at least one row long."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + target, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars, np.uint8)] = True
    return t


#: ASCII white space separates tokens; everything else belongs to one.
NOT_SPACE = ~table(b" \t\r\n\x0b\x0c\x00")
#: Letters, digits and every byte of a multi-byte character.
WORD = table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)))
#: Maps A-Z to a-z and leaves the other bytes alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in class ``inside``; no run crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = inside[data]
    first = offsets[:-1][np.diff(offsets) > 0]
    s = c.copy()
    s[1:] &= ~c[:-1]
    s[first] = c[first]
    e = c.copy()
    e[:-1] &= ~c[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    e[last] = c[last]
    return np.flatnonzero(s), np.flatnonzero(e) + 1


_BLOCKS = np.random.default_rng(20240229).integers(0, 2**63, (2, 1 << 12), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_TAIL = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _S33)
    h = h * _M1
    h = h ^ (h >> _S33)
    h = h * _M2
    return h ^ (h >> _S33)


def _masks(k: np.ndarray, which: int) -> np.ndarray:
    """A number for each block of a span; beyond the table it is the mix of two."""
    low = _BLOCKS[which][k & 4095]
    far = k > 4095
    if far.any():
        low[far] = mix(low[far] + (k[far] >> 12).astype(np.uint64) * _LEN)
    return low


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, piece: int = 1 << 17) -> np.ndarray:
    """64-bit hash of each span; spans don't overlap and have a byte at least.

    Blocks of eight bytes are mixed, each with a number of its place in the
    span, and the mixed blocks are added up: no polynomial, so words of a
    regular build don't meet.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    h = mix((word[starts] & _TAIL[np.minimum(size, 8)]) ^ _BLOCKS[which][0])
    long = np.flatnonzero(size > 8)
    many = (size[long] - 1) >> 3  # blocks after the first
    total, i = np.cumsum(many), 0
    while i < len(long):  # temporaries stay small
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + piece, side="right")))
        n, x = many[i:j], long[i:j]
        k = ragged(n) + 1
        at = np.repeat(starts[x], n) + 8 * k
        block = word[at] & _TAIL[np.minimum(np.repeat(ends[x], n) - at, 8)]
        h[x] += np.add.reduceat(mix(block ^ _masks(k, which)), np.cumsum(n) - n)
        i = j
    return mix(h + size.astype(np.uint64) * _LEN)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(n, 2) words of a 128-bit BLAKE2b digest of each span: equal digests stand for equal bytes."""
    view = memoryview(np.ascontiguousarray(data))
    out = b"".join([blake2b(view[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def owner(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row that each span lies in."""
    return np.searchsorted(offsets, starts, side="right") - 1


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length, concatenated."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1], dtype=np.int64) - np.repeat(ends - lengths, lengths)


class IntTable:
    """Open-addressing map from 64-bit keys (not 2**64 - 1) to non-negative int32, built and probed with arrays."""

    _EMPTY = np.uint64(2**64 - 1)
    _MUL = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        self.keys = np.full(1 << self.bits, self._EMPTY, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        self.probes = 0
        keys, values = keys.astype(np.uint64), values.astype(np.int32)
        slot = self._slot(keys)
        while len(keys):
            self.probes += 1
            _, first = np.unique(slot, return_index=True)
            put = np.zeros(len(slot), bool)
            put[first] = True
            put &= self.keys[slot] == self._EMPTY
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self._MUL) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where absent."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        at = np.flatnonzero((there != keys) & (there != self._EMPTY))
        while len(at):
            slot[at] = (slot[at] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[at]]
            out[at] = np.where(there == keys[at], self.values[slot[at]], out[at])
            at = at[(there != keys[at]) & (there != self._EMPTY)]
        return out
