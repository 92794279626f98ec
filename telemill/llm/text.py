"""Vectorised text helpers shared by the operators: byte views of Arrow columns, word spans, word hashes.

Everything works on one flat ``uint8`` array per Arrow batch with document offsets, so no Python object is made per word.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``: digits, a-z and every non-ASCII byte (text is lower-cased first).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = np.uint64(_BASE)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK_BYTES = 1 << 21


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits of a product hash are usable."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            both = []
            for base in (_BASE, _INVERSE):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                both.append(np.cumprod(a))
            self.up, self.down = both
        return self.up, self.down


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the ``n + 1`` offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents holding about ``limit`` bytes each (one longer document is a range of its own)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def spans(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``member`` bytes inside each document, and word offsets per document."""
    inside = member[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begun = offsets[:-1][offsets[:-1] < offsets[1:]]
    ended = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    first[begun] = inside[begun]
    last[ended] = inside[ended]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def prefix_hash(buf: np.ndarray, powers: Powers) -> np.ndarray:
    """``n + 1`` prefix sums of byte values times powers of the base."""
    up, _ = powers.get(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of byte spans: equal bytes give equal hashes wherever they stand."""
    _, down = powers.get(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Spans longer than this are hashed one by one; there are few of them in any text.
_LONG = 256


def fresh_seed() -> int:
    """A seed that nobody who writes a text can know."""
    return int.from_bytes(os.urandom(15), "little")


class SpanHash:
    """64-bit hashes of byte spans of ``buf``, eight bytes at a time with a non-linear step after each.

    Equal bytes give equal hashes wherever they stand. Where identity decides a result, ``seed`` is drawn anew for every
    run (:func:`fresh_seed`), so that no text can be written in which two spans meet by construction.
    """

    def __init__(self, buf: np.ndarray, seed: int = 0):
        padded = np.zeros(len(buf) + 8, np.uint8)
        padded[:len(buf)] = buf
        self.buf = buf
        self.words = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))  # the eight bytes that start at each byte
        self.key = np.frombuffer(hashlib.blake2b(seed.to_bytes(16, "little"), digest_size=24).digest(), np.uint64)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        longest = int(size.max(initial=0))
        h = mix((self.words[starts] & _MASK[np.minimum(size, 8)]) ^ self.key[1]) + size.astype(np.uint64) * self.key[0]
        for k in range(8, min(_LONG, longest), 8):
            now = np.flatnonzero((size > k) & (size <= _LONG)) if longest > _LONG or k > 8 else np.flatnonzero(size > k)
            block = self.words[starts[now] + k] & _MASK[np.minimum(size[now] - k, 8)]
            h[now] = mix(h[now] * _ODD + mix(block ^ self.key[2]))
        if longest > _LONG:
            for k in np.flatnonzero(size > _LONG).tolist():
                digest = hashlib.blake2b(self.buf[starts[k]:ends[k]].tobytes(), digest_size=8, key=self.key.tobytes()).digest()
                h[k] = int.from_bytes(digest, "little")
        return mix(h)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i], starts[i] + 1, ...`` for every span, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def span_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow binary array."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    data = buf[ragged(starts, lengths)]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
