"""Registered queries without SQL against plain Python over the smallest shared tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from telemill.llm import encode
from telemill.llm.queries import QUERIES


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


def ids_of(texts, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.tokenizer_path(name))
    return {i: t.encode(x, add_special_tokens=False).ids + [1] for i, x in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op9_is_the_library_document_by_document(spark, data, texts):
    start, want = 0, set()
    for i, ids in sorted(ids_of(texts, "word_bpe_49k.json").items()):
        want.add((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert {tuple(r) for r in QUERIES["op9_token_files"](spark, data).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def test_op3_holds_every_id_once_in_gapless_sequences(spark, data, texts):
    ids, parts, full = ids_of(texts, "byte_bpe_50k.json"), defaultdict(list), defaultdict(list)
    rows = QUERIES["op3_packing"](spark, data).collect()
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == crc(own[r["start"]:r["start"] + r["length"]]) and r["length"] > 0
        parts[r["doc_id"]].append((r["start"], r["length"]))
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in ids.items():
        at = 0
        for start, length in sorted(parts[i]):
            assert start == at
            at += length
        assert at == len(own)
    for pieces in full.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(full) <= 1.1 * sum(map(len, ids.values())) / 2048 + 1


def test_op2_removes_what_occurs_twice_at_400_bytes(spark, data, texts):
    raw = {i: x.encode() for i, x in texts.items()}
    seen = Counter(b[k:k + 400] for b in raw.values() for k in range(len(b) - 399))
    want = set()
    for i, b in raw.items():
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - 399):
            if seen[b[k:k + 400]] > 1:
                gone[k + 1:k + 401] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        want.add((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    got = QUERIES["op2_substring_dedup"](spark, data).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {tuple(r) for r in got} == want and any(w[2] for w in want)


@pytest.mark.parametrize("name,threshold", [("op1_quality", 0.3), ("op13_toxicity", 0.5)])
def test_classifiers_return_every_document_with_its_fold(spark, data, texts, name, threshold):
    rows = QUERIES[name](spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
