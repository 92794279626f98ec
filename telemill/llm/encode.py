"""Token ids of whole texts, with each distinct piece of text encoded once per task.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so ids of the pieces, one after another, are the
ids of the text. Distinct pieces are found by a hash whose seed is new in every task, and new ones go to the tokenizers
library in long joined texts. Texts that hold a string of a special token go to the library as they are, whole.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from . import text

#: Distinct pieces remembered by one task before it starts over; bounds memory, results do not depend on it.
REMEMBERED = 600_000
_JOINED = 2000
#: Lead bytes of characters that may be white space; a blank before one of them is not taken as a cut.
_UNSURE = np.zeros(256, bool)
_UNSURE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Kinds of ASCII bytes: 1 letters, 2 digits, 3 signs but the apostrophe. Two-byte Latin letters count as letters too.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[0x27] = 0
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes flat columns. ``leading_space``: pieces start with their blank (byte-level BPE); else white space is dropped.

    Ids are those that the library gives for the whole text without further settings, so a special token's string in a
    text becomes that token.
    """

    def __init__(self, path: str, leading_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.separator = "<|endoftext|>"
        self.separator_id = self.tokenizer.token_to_id(self.separator)
        self.leading_space = leading_space
        self.seed = text.fresh_seed()
        self.reset()

    def reset(self) -> None:
        self.known: dict[int, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def cut(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece starts and ends, and piece offsets per document."""
        n = len(buf)
        kind = _CLASS[buf]
        lead = (buf[:-1] >= 0xC3) & (buf[:-1] <= 0xC5) & ~((buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)))
        kind[:-1][lead] = kind[1:][lead] = 1
        # a letter, a digit and a sign (but the apostrophe) next to each other are always cut apart
        first = np.zeros(n + 1, bool)
        first[1:n] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        begun = offsets[:-1][offsets[:-1] < offsets[1:]]
        if self.leading_space:
            if n > 1:
                following = buf[1:]
                blank = (buf[:-1] == 0x20) & ~text.SPACE[following] & (following > 0x20) & ~_UNSURE[following]
                first[:n - 1] |= blank
            first[begun] = True
            first[n] = False
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], n)[:len(starts)]
        else:
            first[1:n] |= (kind[1:] == 2) & (kind[:-1] == 2)
            inside = text.NOT_SPACE[buf]
            first[1:n] |= ~inside[:-1]
            first[begun] = True
            first[:n] &= inside
            first[n] = True
            last = inside.copy()
            last[:-1] &= first[1:n] | ~inside[1:]
            first[n] = False
            starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, offsets)

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces and append their ids to the pool."""
        plain = np.array([p.isascii() and (p[1:] if self.leading_space and p[0] == " " else p).isalpha() for p in pieces])
        starts, lengths = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        base = len(self.pool)
        pool = [self.pool]
        for encode, chosen in ((self._words, plain), (self._joined, ~plain)):
            at = np.flatnonzero(chosen)
            for i in range(0, len(at), _JOINED):
                part = at[i:i + _JOINED]
                ids, size = encode([pieces[k] for k in part.tolist()])
                starts[part], lengths[part] = base + np.cumsum(size) - size, size
                base += len(ids)
                pool.append(ids)
        self.pool = np.concatenate(pool)
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])

    def _words(self, pieces: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of pieces of ASCII letters and their numbers: one pre-token each, so the model alone splits them."""
        tokenize = self.tokenizer.model.tokenize
        if self.leading_space:
            pieces = ["\u0120" + p[1:] if p[0] == " " else p for p in pieces]
        ids = [[t.id for t in tokenize(p)] for p in pieces]
        return np.array([i for x in ids for i in x], np.uint32), [len(x) for x in ids]

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of any pieces and their numbers, with a special token between them."""
        if any("<|" in p for p in pieces):
            got = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.uint32), [len(x) for x in got]
        x = np.array(self.tokenizer.encode_batch_fast([self.separator.join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(x == self.separator_id)
        return x[x != self.separator_id], (np.diff(np.concatenate(([-1], at, [len(x)]))) - 1).tolist()

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the ``n + 1`` id offsets of the documents."""
        raw = buf.tobytes()
        if not any(s in raw for s in self.special):
            return self.encode_pieces(buf, offsets)
        values = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        whole = np.array([any(s in v for s in self.special) for v in values])
        # the others, one after another
        size = np.diff(offsets)
        ends = np.concatenate(([0], np.cumsum(size[~whole])))
        ids, at = self.encode_pieces(buf[np.repeat(~whole, size)], ends)
        got = iter(self.tokenizer.encode_batch_fast([values[k].decode() for k in np.flatnonzero(whole)], add_special_tokens=False))
        rest = iter(np.split(ids, at[1:-1]) if len(at) > 1 else [])
        every = [np.array(next(got).ids, np.uint32) if w else next(rest) for w in whole.tolist()]
        return np.concatenate(every), np.concatenate(([0], np.cumsum([len(x) for x in every])))

    def encode_pieces(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for texts without strings of special tokens."""
        starts, ends, per_doc = self.cut(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if not self.leading_space:
            # this tokenizer lower-cases; only all-ASCII pieces may be lower-cased before it composes characters
            low, wide = text.LOWER[buf], np.concatenate(([0], np.cumsum(buf >= 0x80, dtype=np.int32)))
            kept = wide[ends] > wide[starts]
            at = text.ragged(starts[kept], (ends - starts)[kept])
            low[at] = buf[at]
            buf = low
        codes, distinct = pd.factorize(text.SpanHash(buf, self.seed)(starts, ends))
        if len(self.known) > REMEMBERED:
            self.reset()
        keys = distinct.tolist()
        get = self.known.get
        slots = np.array([get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            where = np.zeros(len(keys), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            a, b = starts[where[new]].tolist(), ends[where[new]].tolist()
            raw = buf.tobytes()
            at = len(self.starts)
            self.learn([raw[i:j].decode() for i, j in zip(a, b)])
            slots[new] = at + np.arange(len(new))
            self.known.update(zip((keys[i] for i in new.tolist()), range(at, at + len(new))))
        slots = slots[codes]
        lengths = self.lengths[slots]
        ids = self.pool[text.ragged(self.starts[slots], lengths)]
        return ids, np.concatenate(([0], np.cumsum(lengths)))[per_doc]

    def documents(self, column):
        """Ids of each value of an Arrow string column, with the end id appended to each: pieces of (ids, offsets)."""
        buf, offsets = text.flat(column)
        for i, j in text.pieces(offsets):
            ids, ends = self.encode(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            yield i, j, ids, ends


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every document followed by ``end_id``."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, offsets + np.arange(n + 1)
