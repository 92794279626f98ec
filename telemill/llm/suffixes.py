"""Induced suffix sorting with disk-backed queues.

Suffixes at local minima (LMS) are named by their substrings and sorted through the shorter string of names, by the same
induction while its alphabet is small and by prefix doubling after that. All other suffixes are induced from them in two
sweeps over the characters: a queue holds tuples (position, rank of the next LMS suffix, distance to it) by first
character, first in first out, and moves to disk beyond its memory budget. The tuple carries what a common prefix needs:
two neighbours at equal distance from their LMS suffixes share that distance plus the common prefix of the LMS suffixes.
All steps work on whole buckets with NumPy.
"""

from __future__ import annotations

import os
from collections import defaultdict

import numpy as np

SMALL_ALPHABET = 512
MEMORY = 64 << 20


class DiskQueue:
    """Tuples by key, first in first out within a key; beyond ``memory`` bytes everything held moves to files."""

    def __init__(self, folder: str, name: str, memory: int = MEMORY):
        self.folder, self.name, self.memory, self.held = folder, name, memory, 0
        self.parts: dict[int, list[np.ndarray]] = defaultdict(list)
        self.on_disk: set[int] = set()

    def _path(self, key: int) -> str:
        return os.path.join(self.folder, f"{self.name}-{key}")

    def push(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Append the columns of ``rows`` (3 x n, int32) to their keys, in order."""
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        rows, keys = rows[:, order], keys[order]
        at = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if keys[0] else keys[0] + 1)) if len(keys) > 1 else np.zeros(1, np.int64)
        if at[0] != 0:
            at = np.concatenate(([0], at))
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(keys)]):
            self.parts[int(keys[i])].append(rows[:, i:j])
        self.held += rows.nbytes
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        for key, parts in self.parts.items():
            if parts:
                with open(self._path(key), "ab") as f:
                    for p in parts:
                        f.write(np.ascontiguousarray(p.T).tobytes())
                self.on_disk.add(key)
        self.parts.clear()
        self.held = 0

    def pop(self, key: int) -> np.ndarray | None:
        """All tuples of a key, oldest first, or None."""
        parts = self.parts.pop(key, [])
        self.held -= sum(p.nbytes for p in parts)
        if key in self.on_disk:
            with open(self._path(key), "rb") as f:
                old = np.frombuffer(f.read(), np.int32).reshape(-1, 3).T
            os.unlink(self._path(key))
            self.on_disk.discard(key)
            parts = [old, *parts]
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1)


def packed(t: np.ndarray) -> np.ndarray:
    """Four 16-bit characters from each position on, as one number (zero behind the end)."""
    x = np.concatenate([t, np.zeros(4, t.dtype)]).astype(np.uint64)
    n = len(t)
    return (x[:n] << np.uint64(48)) | (x[1:n + 1] << np.uint64(32)) | (x[2:n + 2] << np.uint64(16)) | x[3:n + 3]


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, have: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix lengths of the suffixes at ``a`` and ``b``, known to be ``have`` at least, up to about ``cap``."""
    out, n = have.astype(np.int64).copy(), len(words)
    going = np.flatnonzero(out < cap)
    while len(going):
        x, y = a[going] + out[going], b[going] + out[going]
        inside = (x < n) & (y < n)
        going, x, y = going[inside], x[inside], y[inside]
        differ = words[x] ^ words[y]
        same = ((differ >> np.uint64(48)) == 0).astype(np.int64)
        same += (differ >> np.uint64(32)) == 0
        same += (differ >> np.uint64(16)) == 0
        same += differ == 0
        out[going] += same
        going = going[(same == 4) & (out[going] < cap)]
    return out


def types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last character must be the unique smallest."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])
    out = np.ones(n, bool)
    if len(change):
        out[:change[-1] + 1] = np.repeat(t[change] < t[change + 1], np.diff(change, prepend=-1))
    return out


def named(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of LMS substrings in text order (equal substrings, equal names, in sorted order) and their number."""
    m = len(lms)
    ends = np.append(lms[1:], lms[-1]) + 1
    size = ends - lms
    bits = int(t.max()).bit_length() + 1
    per = 62 // bits
    symbols = np.concatenate([(t.astype(np.uint64) << np.uint64(1)) | small, np.zeros(per, np.uint64)])

    def keys(which: np.ndarray, at: int) -> np.ndarray:
        out = np.zeros(len(which), np.uint64)
        for k in range(per):
            pos = lms[which] + at + k
            s = symbols[np.minimum(pos, len(t))] + np.uint64(0)
            s[pos >= ends[which]] = 0
            out = (out << np.uint64(bits)) | s
        return out

    key = keys(np.arange(m), 0)
    order = np.argsort(key)
    new = np.ones(m, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    at = per
    while True:
        group = np.cumsum(new) - 1
        tied = np.bincount(group)[group] > 1
        slots = np.flatnonzero(tied & (size[order] > at))
        if not len(slots):
            break
        which = order[slots]
        key = keys(which, at)
        inner = np.lexsort((key, group[slots]))
        order[slots] = which[inner]
        key, g = key[inner], group[slots]
        cut = np.zeros(len(slots), bool)
        cut[1:] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        new[slots[cut]] = True
        at += per
    names = np.empty(m, np.int64)
    names[order] = np.cumsum(new) - 1
    return names, int(new.sum())


def doubled(names: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``names`` by their first ``reach`` names or more, and common names of neighbours."""
    m = len(names)
    order = np.argsort(names)
    new = np.ones(m, bool)
    new[1:] = names[order][1:] != names[order][:-1]
    rank = np.empty(m, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    ranks, step = [rank], 1
    while step < reach:
        # only suffixes that still share their rank are sorted on
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(slots):
            break
        r, which = ranks[-1], order[slots]
        behind = np.zeros(len(which), np.int64)
        inside = which + step < m
        behind[inside] = r[which[inside] + step] + 1
        key = r[which] * (m + 2) + behind
        inner = np.argsort(key)
        order[slots], key = which[inner], key[inner]
        new[slots[1:][key[1:] != key[:-1]]] = True
        rank = r.copy()
        rank[order[slots]] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        ranks.append(rank)
        step *= 2
    shared = np.zeros(m, np.int64)
    x, y = order[:-1], order[1:]
    for level in range(len(ranks) - 1, -1, -1):
        r, at = ranks[level], shared[1:]
        i, j = x + at, y + at
        inside = (i < m) & (j < m)
        same = np.zeros(m - 1, bool)
        same[inside] = r[i[inside]] == r[j[inside]]
        shared[1:][same] += 1 << level
    return order, shared


def lms_suffixes(t: np.ndarray, small: np.ndarray, words: np.ndarray, cap: int, folder: str, memory: int):
    """LMS positions in suffix order, and common prefixes of neighbours (capped)."""
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names, distinct = named(t, small, lms)
    if distinct < len(lms) and distinct <= SMALL_ALPHABET and len(lms) > 4 * SMALL_ALPHABET:
        order = suffix_order(names.astype(np.uint16), cap, folder, memory)
        w = packed(names.astype(np.uint16))
        shared = np.zeros(len(lms), np.int64)
        shared[1:] = np.minimum(common_prefix(w, order[:-1], order[1:], shared[1:], cap), len(lms) - 1 - np.maximum(order[:-1], order[1:]))
    else:
        order, shared = doubled(names, cap // 2 + 1)  # a name stands for two characters at least
    at = lms[order]
    lcp = np.zeros(len(lms), np.int64)
    far = np.minimum(order[1:] + shared[1:], len(lms) - 1)
    lcp[1:] = common_prefix(words, at[:-1], at[1:], np.minimum(lms[far] - at[1:], cap), cap)
    return at, lcp


def induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray, folder: str, memory: int):
    """Suffix tuples bucket by bucket in ascending order: (position, rank of the next LMS suffix, distance), 3 x n."""
    n, top = len(t), int(t.max())
    rank_at = np.full(n, -1, np.int32)
    rank_at[lms] = np.arange(len(lms), dtype=np.int32)
    lms_char = t[lms]
    edges = np.searchsorted(lms_char, np.arange(top + 2))
    large, done = DiskQueue(folder, f"l{id(t)}", memory), DiskQueue(folder, f"d{id(t)}", memory)

    def before(rows: np.ndarray) -> np.ndarray:
        rows = rows[:, rows[0] > 0]
        return rows + np.array([[-1], [0], [1]], np.int32)

    for c in range(top + 1):
        while (rows := large.pop(c)) is not None:
            done.push(np.full(rows.shape[1], c, t.dtype), rows)
            rows = before(rows)
            keys = t[rows[0]]
            large.push(keys[keys >= c], rows[:, keys >= c])
        i, j = int(edges[c]), int(edges[c + 1])
        if i < j:
            rows = before(np.stack([lms[i:j].astype(np.int32), np.arange(i, j, dtype=np.int32), np.zeros(j - i, np.int32)]))
            large.push(t[rows[0]], rows)
    smaller, out = DiskQueue(folder, f"s{id(t)}", memory), DiskQueue(folder, f"o{id(t)}", memory)
    # the last character is the smallest suffix and is not induced by any other
    for c in range(top, -1, -1):
        while (rows := smaller.pop(c)) is not None:
            own = rank_at[rows[0]]
            is_lms = own >= 0
            rows = np.stack([rows[0], np.where(is_lms, own, rows[1]), np.where(is_lms, 0, rows[2])]).astype(np.int32)
            out.push(np.full(rows.shape[1], c, t.dtype), rows)
            rows = before(rows)
            keys = t[rows[0]]
            smaller.push(keys[keys <= c], rows[:, keys <= c])
        rows = done.pop(c)
        if rows is not None:
            done.push(np.full(rows.shape[1], c, t.dtype), rows)
            rows = before(rows[:, ::-1])
            keys = t[rows[0]]
            smaller.push(keys[keys < c], rows[:, keys < c])
    yield np.array([[n - 1], [rank_at[n - 1]], [0]], np.int32)
    for c in range(top + 1):
        parts = [x for x in (done.pop(c), out.pop(c)) if x is not None]
        if len(parts) == 2:
            parts[1] = parts[1][:, ::-1]
        elif parts and small[parts[0][0, 0]]:
            parts[0] = parts[0][:, ::-1]
        if parts:
            yield np.concatenate(parts, axis=1)


def suffix_order(t: np.ndarray, cap: int, folder: str, memory: int = MEMORY) -> np.ndarray:
    """All suffixes in order of their first ``cap`` characters; the last character must be 0 and occur once."""
    small = types(t)
    at, _ = lms_suffixes(t, small, packed(t), cap, folder, memory)
    return np.concatenate([rows[0] for rows in induced(t, small, at, folder, memory)]).astype(np.int64)


def repeated(t: np.ndarray, length: int, folder: str, memory: int = MEMORY) -> np.ndarray:
    """Whether the ``length`` characters from each position on also start anywhere else (16-bit characters, last one 0)."""
    small, words = types(t), packed(t)
    at, lcp = lms_suffixes(t, small, words, length, folder, memory)
    below: dict[int, np.ndarray] = {}
    flags = np.zeros(len(t), bool)
    for pos, rank, dist in induced(t, small, at, folder, memory):
        if len(pos) < 2:
            continue
        a, b, ra, rb, da, db = pos[:-1], pos[1:], rank[:-1], rank[1:], dist[:-1], dist[1:]
        near = (da == db) & (da < min(64, length))
        # LMS suffixes that agree beyond the length sought may come in either order
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        pairs = np.flatnonzero(near)
        hit = np.zeros(len(a), bool)
        for d in np.unique(da[pairs]).tolist():
            own = pairs[da[pairs] == d]
            if d not in below:
                below[d] = np.cumsum(lcp < length - d, dtype=np.int32)
            own = own[below[d][high[own]] == below[d][low[own]]]
            if d and len(own):
                own = own[common_prefix(words, a[own], b[own], np.zeros(len(own), np.int64), d) >= d]
            hit[own] = True
        other = np.flatnonzero(~near)
        if len(other):
            hit[other[common_prefix(words, a[other], b[other], np.zeros(len(other), np.int64), length) >= length]] = True
        flags[a[hit]] = True
        flags[b[hit]] = True
    return flags
