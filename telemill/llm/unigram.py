"""Token counts by dynamic programming over a trie of distinct pre-tokens.

Pre-tokens are runs of non-blank characters with a leading mark. A task gathers the distinct ones of a stretch of text by
hash and inserts those it has not met yet in a trie, level by level; the best unigram score of a prefix (its forward
score) is computed once for the trie node that all words with this prefix share. A word's terminal node stores its number
of tokens, which is added up for each document. Nothing is shuffled or written.

Pieces come from a vocabulary file in order of frequency; the piece at rank *r* has the score ``-log(r + RANK_SHIFT)``.
Characters outside the vocabulary cost a token for each byte. Of paths with equal scores the one with fewer tokens
counts. Scores are sums of integers, so they do not depend on the order of addition.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import staging, text

MARK = "▁"
RANK_SHIFT = 2.7
#: Scores are kept as integers of this many units; a token more costs one unit, which decides ties.
UNIT = 1 << 20
#: Cost of a byte outside the vocabulary.
BYTE_COST = -14.0
#: Words up to this many bytes go through the trie level by level; longer ones are few and are done one by one.
LEVELS = 192
#: Bytes of text whose words enter a trie together, and distinct words whose counts one task keeps.
STRETCH = 8 << 20
REMEMBERED = 2_000_000


@lru_cache(maxsize=4)
def pieces(path: str) -> dict[str, int]:
    """Integer scores of the pieces of a sentencepiece file, in its order of rank (control and byte pieces left out)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: score_of(r) for r, p in enumerate(own)}


def score_of(rank: int) -> int:
    return round(-math.log(rank + RANK_SHIFT) * 1024) * UNIT - 1


BYTE_SCORE = round(BYTE_COST * 1024) * UNIT - 1


class Vocabulary:
    """Piece scores by hash, for lookups of many spans at once."""

    def __init__(self, scores: dict[str, int], seed: int):
        raw = [p.encode() for p in scores]
        lengths = np.array([len(r) for r in raw], np.int64)
        buf = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lengths)
        h = text.SpanHash(buf, seed)(ends - lengths, ends)
        order = np.argsort(h)
        self.seed = seed
        self.hashes, self.scores = h[order], np.array(list(scores.values()), np.int64)[order]
        self.longest = int(lengths.max()) if len(raw) else 0
        self.sizes = sorted(set(lengths.tolist()))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a piece, and its score."""
        if not len(self.hashes):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return self.hashes[at] == h, self.scores[at]


_LOW = np.iinfo(np.int64).min // 2


def trie_counts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Tokens of each word (bytes ``buf[start:end]``, the mark included) from a trie of all of them."""
    size = ends - starts
    hashes = text.SpanHash(buf, vocabulary.seed)
    counts = np.zeros(len(starts), np.int64)
    boundary = np.append((buf & 0xC0) != 0x80, True)
    live = np.flatnonzero(size <= LEVELS)
    # words grow by one byte a level; words with one prefix point to the same node
    node = np.zeros(len(live), np.int64)
    scores, tokens = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    parents: list[np.ndarray] = []
    for depth in range(1, int(size[live].max()) + 1 if len(live) else 1):
        here = size[live] >= depth
        live, node = live[here], node[here]
        key = node * 256 + buf[starts[live] + depth - 1]
        distinct, first, node = np.unique(key, return_index=True, return_inverse=True)
        parents.append(distinct // 256)
        word = live[first]
        best, many = np.full(len(word), _LOW, np.int64), np.zeros(len(word), np.int64)
        end = starts[word] + depth
        complete = boundary[end] | (end == ends[word])
        back = np.arange(len(word))
        for length in range(1, max(vocabulary.longest, 4) + 1):
            if length > depth:
                break
            back = parents[depth - length][back]
            begin = end - length
            open_at = complete & boundary[begin] & (scores[depth - length][back] > _LOW)
            if not open_at.any():
                continue
            k = np.flatnonzero(open_at)
            if length in vocabulary.sizes:
                known, value = vocabulary.find(hashes(begin[k], end[k]))
            else:
                known, value = np.zeros(len(k), bool), np.zeros(len(k), np.int64)
            one = ~known & _one_character(boundary, begin[k], end[k], length)
            value = np.where(known, value, BYTE_SCORE * length)
            usable = known | one
            total = np.where(usable, scores[depth - length][back[k]] + value, _LOW)
            better = total > best[k]
            best[k[better]] = total[better]
            many[k[better]] = (tokens[depth - length][back[k]] + np.where(known, 1, length))[better]
        scores.append(best)
        tokens.append(many)
        full = size[live] == depth
        counts[live[full]] = many[node[full]]
    for w in np.flatnonzero(size > LEVELS).tolist():
        counts[w] = _one_word(hashes, boundary, int(starts[w]), int(ends[w]), vocabulary)
    return counts


def _one_character(boundary: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    out = np.ones(len(begin), bool)
    for k in range(1, length):
        out &= ~boundary[begin + k]
    return out


def _one_word(hashes: text.SpanHash, boundary: np.ndarray, a: int, b: int, vocabulary: Vocabulary) -> int:
    """The same forward scores for one long word, with all its possible pieces looked up at once."""
    n = b - a
    best, many = [0] + [_LOW] * n, [0] * (n + 1)
    sizes = np.array(vocabulary.sizes, np.int64)
    for low in range(0, n, 4096):
        ends = np.arange(low + 1, min(n, low + 4096) + 1)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for length in sizes.tolist():
            e = ends[(ends >= length)]
            e = e[boundary[a + e - length] & (boundary[a + e] | (e == n))]
            known, value = vocabulary.find(hashes(a + e - length, a + e))
            for x, v in zip(e[known].tolist(), value[known].tolist()):
                found.setdefault(x, []).append((length, v, 1))
        for x in ends.tolist():
            if not (boundary[a + x] or x == n):
                continue
            length = 1
            while length < x and not boundary[a + x - length]:
                length += 1
            options = found.get(x, [])
            if not any(o[0] == length for o in options):
                options = [*options, (length, BYTE_SCORE * length, length)]
            for length, value, count in sorted(options):
                if best[x - length] > _LOW and best[x - length] + value > best[x]:
                    best[x], many[x] = best[x - length] + value, many[x - length] + count
    return many[n]


_MARKED = np.frombuffer(MARK.encode(), np.uint8)


def marked(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words copied one after another, each behind the mark."""
    size = ends - starts
    at = np.cumsum(size + len(_MARKED)) - size
    out = np.empty(int((size + len(_MARKED)).sum()), np.uint8)
    for k, b in enumerate(_MARKED):
        out[at - len(_MARKED) + k] = b
    out[text.ragged(at, size)] = buf[text.ragged(starts, size)]
    return out, at - len(_MARKED), at + size


class Counter:
    """Token counts of words by hash, learned as words turn up; starts over beyond ``REMEMBERED`` words."""

    def __init__(self, scores: dict[str, int]):
        self.seed = text.fresh_seed()
        self.vocabulary = Vocabulary(scores, self.seed)
        self.reset()

    def reset(self) -> None:
        self.words, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def documents(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each document."""
        s, e, w = text.spans(buf, offsets, text.NOT_SPACE)
        codes, words = pd.factorize(text.SpanHash(buf, self.seed)(s, e))
        if len(self.words) > REMEMBERED:
            self.reset()
        at = np.searchsorted(self.words, words)
        known = np.zeros(len(words), bool)
        known[at < len(self.words)] = self.words[at[at < len(self.words)]] == words[at < len(self.words)]
        new = np.flatnonzero(~known)
        if len(new):
            first = np.zeros(len(words), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            raw, a, b = marked(buf, s[first[new]], e[first[new]])
            counts = trie_counts(raw, a, b, self.vocabulary)
            every = np.concatenate([self.words, words[new]])
            order = np.argsort(every, kind="stable")
            self.words, self.counts = every[order], np.concatenate([self.counts, counts])[order]
            at = np.searchsorted(self.words, words)
        total = np.concatenate(([0], np.cumsum(self.counts[at][codes] if len(codes) else np.zeros(0, np.int64))))
        return np.diff(w), total[w[1:]] - total[w[:-1]]


def token_counts(docs: DataFrame, vocabulary: dict[str, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, n_words, n_tokens`` under the unigram scores in ``vocabulary`` (piece: integer score).

    Null, empty and blank texts have no words and no tokens. Repeated rows each give a row; a null identifier stays
    null. An empty table gives an empty result. Other columns are not read. The vocabulary is sent to every task; its
    size is that of a tokenizer file.
    """
    staging.batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        counter = Counter(shared.value)
        for batch in gathered(batches):
            buf, offsets = text.flat(batch.column("_text"))
            for i, j in text.pieces(offsets, STRETCH):
                words, tokens = counter.documents(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(i, j - i), pa.array(words), pa.array(tokens)], names=["_id", "n_words", "n_tokens"])

    def gathered(batches):
        """Batches joined to about one stretch of text, as larger tries share more prefixes."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= STRETCH:
                yield joined(held)
                held, size = [], 0
        if held:
            yield joined(held)

    def joined(held):
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
        return whole[0] if whole else held[0]

    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(run, f"_id {kind}, n_words long, n_tokens long").withColumnRenamed("_id", id_col)
