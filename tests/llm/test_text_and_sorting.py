"""Helpers without Spark: word spans and hashes, suffix order, encoder, chunk format, packing plan, patterns."""

import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from telemill.llm import decontaminate, encode, packing, suffixes, text, token_files, unigram

SAMPLES = ["", " ", "a", "  a  b ", "é É x\ty\n", "A" * 300, "日本語 テスト", "a\x85b\x1cc", "x1 22 y-z"]


def test_spans_follow_the_word_pattern():
    buf, offsets = text.flat(pa.array([*SAMPLES, None]))
    s, e, w = text.spans(buf, offsets, text.NOT_SPACE)
    raw = buf.tobytes()
    for k, value in enumerate([*SAMPLES, ""]):
        got = [raw[a:b].decode() for a, b in zip(s[w[k]:w[k + 1]], e[w[k]:w[k + 1]])]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", value)
    sliced, off = text.flat(pa.array(SAMPLES).slice(3, 2))
    assert sliced.tobytes().decode() == SAMPLES[3] + SAMPLES[4] and len(off) == 3


def test_span_hash_depends_on_bytes_alone():
    powers = text.Powers()
    buf = np.frombuffer(b"abc xabc ab\x00\x00c", np.uint8)
    p = text.prefix_hash(buf, powers)
    h = text.span_hash(p, np.array([0, 5, 9, 4, 0]), np.array([3, 8, 11, 8, 2]), powers)
    assert h[0] == h[1] and h[2] == h[4] and len(set(h.tolist())) == 3


def brute_repeats(t, length):
    s = t.tolist()
    n = Counter(tuple(s[i:i + length]) for i in range(len(s) - length + 1))
    return [n[tuple(s[i:i + length])] > 1 for i in range(len(s) - length + 1)]


@pytest.mark.parametrize("memory", [64, 1 << 26])
def test_suffix_order_and_repeats(tmp_path, memory):
    rng = np.random.default_rng(1)
    for k in range(150):
        x = rng.integers(1, rng.integers(2, 6), rng.integers(1, 90))
        if k % 3 == 0:
            x = np.tile(x[:max(1, len(x) // 5)], 6)
        if k % 4 == 0:
            x = np.concatenate([x, np.ones(30, int), x])
        t = np.append(x, 0).astype(np.uint16)
        assert suffixes.suffix_order(t, 1000, str(tmp_path), memory).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        for length in (1, 2, 5, 20):
            want = brute_repeats(t, length)
            assert suffixes.repeated(t, length, str(tmp_path), memory)[:len(want)].tolist() == want
    assert not os.listdir(tmp_path)


def test_suffix_order_recurses_on_small_alphabets(tmp_path, monkeypatch):
    monkeypatch.setattr(suffixes, "SMALL_ALPHABET", 8)
    rng = np.random.default_rng(2)
    for _ in range(60):
        x = np.tile(rng.integers(1, 3, rng.integers(1, 20)), rng.integers(1, 30))
        x[rng.integers(0, len(x), 2)] = 3
        t = np.append(x, 0).astype(np.uint16)
        assert suffixes.suffix_order(t, 5000, str(tmp_path)).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize("name,leading", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_encode_like_whole_texts(name, leading):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    parts = [" ", "  ", "\n", "\r\n", "a", "B", "Ab", "'s", "'", "é", "É", "×", "÷", "ß", "\xa0", "　", "1", "23", "!", "?!", "<|", "<|endoftext|>", "日", "\t", "́", "̌", "\x85", "\x1f", "…", "é", "J̌"]
    texts = [*SAMPLES, *("".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(800))]
    t = Tokenizer.from_file(encode.tokenizer_path(name))
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    e = encode.PieceEncoder(encode.tokenizer_path(name), leading)
    got = [ids[ends[k]:ends[k + 1]].tolist() for i, j, ids, ends in e.documents(pa.array(texts)) for k in range(j - i)]
    assert got == want


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (5, 2), (40_000, 49_408), (16_384, 1 << 20), (7, 1 << 32)])
def test_chunks_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    assert (token_files.unpack_chunk(token_files.pack_chunk(ids)) == ids).all()
    assert (token_files.unpack_chunk(token_files.pack_chunk(ids, block=100)) == ids).all()


def test_least_squares_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.random((8, 15)), rng.random(8)
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and gain.max() < 1e-6 and np.abs(gain[x > 0]).max() < 1e-6


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(5)
    for full in (4, 16, 64):
        for _ in range(10):
            counts = np.append(0, rng.integers(0, 200, full) * (rng.random(full) < 0.5))
            made = packing.plan(counts, full)
            used = np.zeros(full + 1, np.int64)
            for bins, times in made:
                assert sum(bins) <= full and times > 0
                np.add.at(used, list(bins), times)
            assert (used == counts).all()
    smooth = np.append(0, np.full(64, 1000))
    assert sum(t for _, t in packing.plan(smooth, 64)) <= 1.02 * (smooth * np.arange(65)).sum() / 64


def test_long_words_and_the_trie_agree(monkeypatch):
    scores = {"▁": -5, "a": -3, "ab": -7, "ba": -6, "日本": -9, "aba": -8}
    words = ["abab" * k for k in range(1, 9)] + ["日本日", "x", "aあb"]
    raw = [unigram.MARK + w for w in words]
    data = np.frombuffer("".join(raw).encode(), np.uint8)
    ends = np.cumsum([len(r.encode()) for r in raw])
    starts = ends - [len(r.encode()) for r in raw]
    v = unigram.Vocabulary(scores, 7)
    together = unigram.trie_counts(data, starts, ends, v).tolist()
    monkeypatch.setattr(unigram, "LEVELS", 0)
    assert unigram.trie_counts(data, starts, ends, v).tolist() == together


def test_shift_tables_find_every_occurrence():
    rng = np.random.default_rng(6)
    words = ["w%d" % k for k in range(5)]
    items = [(str(k), " ".join(rng.choice(words, rng.integers(0, 18)))) for k in range(12)] + [("n", None)]
    docs = [" ".join(rng.choice(words, n)) for n in (0, 1, 5, 70, 400)] + [None]
    buf, offsets = text.flat(pa.array(docs))
    n_words, runs, found = decontaminate._search(buf, offsets, decontaminate.pattern_tables(items, 4), text.Powers())
    for d, value in enumerate(docs):
        own = (value or "").split()
        hit, names = set(), set()
        for item, body in items:
            b = (body or "").split()
            size = min(4, len(b))
            for i in range(len(b) - size + 1 if size else 0):
                for p in range(len(own) - size + 1):
                    if own[p:p + size] == b[i:i + size]:
                        hit |= set(range(p, p + size))
                        names.add(item)
        assert n_words[d] == len(own) and found[d] == sorted(names)
        assert {x for r in runs[d] for x in range(r["start"], r["end"])} == hit
