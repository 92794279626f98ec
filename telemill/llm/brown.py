"""Brown class-based bigram scores: exchange clustering, class transitions and word emissions.

``P(word | previous) = T(class | previous class) * E(word | class)``. The work is cut twice. A *block* holds the tokens of
whole documents as numbers into its own dictionary; a *bucket* holds the part of every dictionary whose word hashes fall
together. A word is counted inside its block first and met once per block in its bucket, so a frequent word is never a
hot key. Words are 64-bit hashes.

Exchange clustering runs over the buckets: a word is described by how often its neighbours fall into each of
``CONTEXTS`` left and right context cells, and each sweep moves every word to the class that makes its neighbours most
likely, with the word itself taken out of the class that it is in. A sweep needs the class sums only, which have a fixed
size. Emissions are discounted counts; what is discounted is the chance of an unknown word, so probabilities over the
known words and the unknown one sum to 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import staging, text

CLASSES = 64
CONTEXTS = 64
SWEEPS = 4
BLOCK_TOKENS = 1_500_000
#: Text bytes for each bucket: a bucket's words from all blocks are merged in one task.
BUCKET_BYTES = 64 << 20
MIN_BUCKETS = 32
DISCOUNT = 0.5
PRIOR = 20.0
END = np.uint64(0x5EED0FE0D0C5EED1)
FOLDS, FOLD = 5, 1


def pack(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()) if len(a) else b""


def unpack(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.zeros(1, a.dtype)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def tokens_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each document, and tokens per document."""
    b = text.LOWER[buf]
    s, e, w = text.spans(b, offsets, text.NOT_SPACE)
    n = len(offsets) - 1
    out = np.full(len(s) + n, END, np.uint64)
    word = np.ones(len(out), bool)
    word[w[1:] + np.arange(n)] = False
    out[word] = text.SpanHash(b)(s, e)
    return out, np.diff(w) + 1


def block_rows(block: int, ids: list, held: list[bool], tokens: np.ndarray, lengths: np.ndarray, buckets: int):
    """The rows of one block: its tokens, and its dictionary with counts and contexts of training tokens by bucket."""
    codes, words = pd.factorize(tokens)
    home = bucket_of(words, buckets)
    order = np.lexsort((words, home))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes, words, home = rank[codes], words[order], home[order]
    trained = np.repeat(~np.array(held), lengths)
    counts = np.bincount(codes[trained], minlength=len(words))
    cell = (words % np.uint64(CONTEXTS)).astype(np.int64)[codes]
    first = np.zeros(len(codes), bool)
    first[np.cumsum(lengths) - lengths] = True
    last = np.zeros(len(codes), bool)
    last[np.cumsum(lengths) - 1] = True
    left = np.roll(cell, 1)
    left[first] = int(END % np.uint64(CONTEXTS))
    right = np.roll(cell, -1)
    inner = trained & ~last
    keys = np.concatenate([codes[trained] * (2 * CONTEXTS) + left[trained], codes[inner] * (2 * CONTEXTS) + CONTEXTS + right[inner]])
    keys = np.sort(keys)
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    edges = np.searchsorted(home, np.arange(buckets + 1))
    pairs = np.searchsorted(keys, edges * 2 * CONTEXTS)
    rows = [{"kind": 0, "block": block, "bucket": -1, "ids": ids, "held": held, "a": pack(codes.astype(np.uint32)), "b": pack(lengths.astype(np.int64)), "c": None, "d": None}]
    for k in range(buckets):
        i, j, p, q = edges[k], edges[k + 1], pairs[k], pairs[k + 1]
        if i < j:
            rows.append({"kind": 1, "block": block, "bucket": k, "ids": None, "held": None, "a": pack_sorted(words[i:j]), "b": pack(counts[i:j].astype(np.uint32)),
                         "c": pack(np.diff(keys[p:q] - i * 2 * CONTEXTS, prepend=0).astype(np.uint32)), "d": pack(times[p:q].astype(np.uint32))})
    return rows


BLOCKS = "block long, bucket int, ids array<bigint>, held array<boolean>, a binary, b binary, c binary, d binary, kind int"
_BLOCK_TYPES = (("block", "i8"), ("bucket", "i4"), ("ids", "ids"), ("held", "held"), ("a", "raw"), ("b", "raw"), ("c", "raw"), ("d", "raw"), ("kind", "i4"))


def blocks(docs: DataFrame, buckets: int, block_tokens: int) -> DataFrame:
    """Documents (``_id, _text, _held``) as blocks of about ``block_tokens`` tokens."""
    def run(batches):
        kinds = {"i8": pa.int64(), "i4": pa.int32(), "ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "raw": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in _BLOCK_TYPES])
        block = TaskContext.get().partitionId() << 24
        ids, held, tokens, lengths, size = [], [], [], [], 0
        for batch in batches:
            buf, offsets = text.flat(batch.column("_text"))
            names, out = batch.column("_id").to_pylist(), batch.column("_held").to_pylist()
            for i, j in text.pieces(offsets):
                t, n = tokens_of(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                ids, held, size = ids + names[i:j], held + out[i:j], size + len(t)
                tokens.append(t)
                lengths.append(n)
                if size >= block_tokens:
                    yield pa.RecordBatch.from_pylist(block_rows(block, ids, held, np.concatenate(tokens), np.concatenate(lengths), buckets), schema)
                    ids, held, tokens, lengths, size, block = [], [], [], [], 0, block + 1
        if ids:
            yield pa.RecordBatch.from_pylist(block_rows(block, ids, held, np.concatenate(tokens), np.concatenate(lengths), buckets), schema)

    return docs.mapInArrow(run, BLOCKS)


def merge_bucket(table: pa.Table) -> pa.Table:
    """The words of a bucket over all blocks: sorted hashes, counts, and context counts."""
    runs = [unpack_sorted(x.as_py()) for x in table.column("a")]
    words, at = np.unique(np.concatenate(runs), return_inverse=True)
    counts = np.zeros(len(words), np.int64)
    np.add.at(counts, at, np.concatenate([unpack(x.as_py(), np.uint32) for x in table.column("b")]))
    keys, times, base = [], [], 0
    for run, c, d in zip(runs, table.column("c"), table.column("d")):
        k = np.cumsum(unpack(c.as_py(), np.uint32).astype(np.int64))
        keys.append(at[base + k // (2 * CONTEXTS)] * (2 * CONTEXTS) + k % (2 * CONTEXTS))
        times.append(unpack(d.as_py(), np.uint32))
        base += len(run)
    keys, times = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.add.reduceat(times[order].astype(np.int64), first) if len(keys) else np.zeros(0, np.int64)
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "words": pa.array([pack_sorted(words)]),
                     "counts": pa.array([pack(counts)]), "keys": pa.array([pack(np.diff(keys[first], prepend=0).astype(np.uint32))]), "times": pa.array([pack(times.astype(np.uint32))])})


WORDS = "bucket int, words binary, counts binary, keys binary, times binary"


def exchange(keys: np.ndarray, times: np.ndarray, n: int, sums: list[np.ndarray], classes: int) -> np.ndarray:
    """Classes of a bucket's words after one sweep for each of the class sums given.

    At first a word is in the class of its commonest left context. A word without training tokens stays in class 0.
    """
    word, cell = keys // (2 * CONTEXTS), keys % (2 * CONTEXTS)
    left = np.flatnonzero(cell < CONTEXTS)
    order = left[np.lexsort((cell[left], -times[left], word[left]))]
    own = np.zeros(n, np.int64)
    lead = order[np.flatnonzero(np.diff(word[order], prepend=-1))]
    own[word[lead]] = cell[lead] % classes
    starts = np.searchsorted(word, np.arange(n + 1))
    total = np.bincount(word, times, n)
    for m in sums:
        whole = m.sum(1)
        gain = (np.log(m + 0.5) - np.log(whole + CONTEXTS)[:, None]).T.astype(np.float32)
        without = np.log(np.maximum(m[own[word], cell] - times, 0) + 0.5) - np.log(np.maximum(whole[own[word]] - total[word], 0) + CONTEXTS)
        stay = np.bincount(word, times * without, n)
        moved = own.copy()
        for i in range(0, n, 16_384):
            j = min(n, i + 16_384)
            p, q = starts[i], starts[j]
            dense = np.zeros((j - i, 2 * CONTEXTS), np.float32)
            dense[word[p:q] - i, cell[p:q]] = times[p:q]
            score = dense @ gain
            score[np.arange(j - i), own[i:j]] = stay[i:j]
            moved[i:j] = np.argmax(score, axis=1)
        moved[total == 0] = 0
        own = moved
    return own


def class_sums(spark: SparkSession, words: DataFrame, sums: list[np.ndarray], classes: int) -> np.ndarray:
    """Context counts of every class, after the sweeps so far; added up in each task before they are sent."""
    shared = spark.sparkContext.broadcast(sums)

    def run(batches):
        out = np.zeros((classes, 2 * CONTEXTS))
        for batch in batches:
            for w, k, t in zip(batch.column("words"), batch.column("keys"), batch.column("times")):
                n = len(unpack(w.as_py(), np.uint64))
                keys, times = np.cumsum(unpack(k.as_py(), np.uint32).astype(np.int64)), unpack(t.as_py(), np.uint32).astype(np.float64)
                own = exchange(keys, times, n, shared.value, classes)
                np.add.at(out, (own[keys // (2 * CONTEXTS)], keys % (2 * CONTEXTS)), times)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.ravel()[at])], names=["cell", "n"])

    total = np.zeros(classes * 2 * CONTEXTS)
    for r in words.select("words", "keys", "times").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[r["cell"]] = r["n"]  # at most classes * 2 * CONTEXTS rows
    return total.reshape(classes, -1)


def classified(spark: SparkSession, words: DataFrame, sums: list[np.ndarray], classes: int) -> DataFrame:
    """Per bucket: sorted words, counts and classes; the end token has a class of its own."""
    shared = spark.sparkContext.broadcast(sums)

    def run(batches):
        for batch in batches:
            for b, w, c, k, t in zip(*(batch.column(x) for x in ("bucket", "words", "counts", "keys", "times"))):
                h, counts = unpack_sorted(w.as_py()), unpack(c.as_py(), np.int64)
                keys, times = np.cumsum(unpack(k.as_py(), np.uint32).astype(np.int64)), unpack(t.as_py(), np.uint32).astype(np.float64)
                own = exchange(keys, times, len(h), shared.value, classes)
                own[h == END] = classes
                n = np.bincount(own, counts, classes + 1).astype(np.int64)
                v = np.bincount(own[counts > 0], minlength=classes + 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([b.as_py()], pa.int32()), pa.array([w.as_py()]), pa.array([c.as_py()]), pa.array([pack(own.astype(np.uint8))]),
                                                  pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([v.tolist()], pa.list_(pa.int64()))],
                                                 names=["bucket", "words", "counts", "own", "n", "v"])

    return words.mapInArrow(run, "bucket int, words binary, counts binary, own binary, n array<bigint>, v array<bigint>")


def answers(left: pa.Table, right: pa.Table) -> pa.Table:
    """For the dictionary part of every block in a bucket: counts and classes of its words, in its order."""
    words, counts, own = unpack_sorted(right.column("words")[0].as_py()), unpack(right.column("counts")[0].as_py(), np.int64), unpack(right.column("own")[0].as_py(), np.uint8)
    out = []
    for a in left.column("a"):
        at = np.searchsorted(words, unpack_sorted(a.as_py()))
        out.append((pack(counts[at]), pack(own[at])))
    return pa.table({"block": left.column("block"), "bucket": left.column("bucket"), "counts": pa.array([x for x, _ in out], pa.binary()), "own": pa.array([y for _, y in out], pa.binary())})


def documents_of(n_class: np.ndarray, n_all: int, v_all: int):
    """A function of a block's tokens and answers that gives its documents, with everything but class transitions."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("bucket").to_numpy(), kind="stable").tolist()
        counts = np.concatenate([unpack(right.column("counts")[i].as_py(), np.int64) for i in order])
        own = np.concatenate([unpack(right.column("own")[i].as_py(), np.uint8) for i in order]).astype(np.int64)
        codes, lengths = unpack(left.column("a")[0].as_py(), np.uint32), unpack(left.column("b")[0].as_py(), np.int64)
        ends = np.cumsum(lengths)
        base = np.log10((counts + 0.5) / (n_all + 0.5 * (v_all + 1)))
        last = len(n_class) - 1
        emit = np.zeros(len(counts))
        known = counts > 0
        emit[known] = np.log10((counts[known] - np.where(own[known] == last, 0, DISCOUNT)) / n_class[own[known]])
        kind = np.where(known, own, last + 1).astype(np.uint8)[codes]
        total = [np.add.reduceat(x, ends - lengths) for x in (known[codes].astype(np.int64), base[codes], emit[codes])]
        seq = [zstandard.ZstdCompressor(level=1).compress(kind[a:b].tobytes()) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
        return pa.table({"_id": pa.array(left.column("ids")[0].as_py(), pa.int64()), "held_out": pa.array(left.column("held")[0].as_py(), pa.bool_()), "n_tokens": pa.array(lengths),
                         "n_known": pa.array(total[0]), "base_score": pa.array(total[1]), "emission": pa.array(total[2]), "classes": pa.array(seq, pa.binary())})

    return run


DOCUMENTS = "_id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, classes binary"


def sequences(batch: pa.RecordBatch):
    """Class sequences of a batch one after another, the class before each token (a document starts after an end), and document ends."""
    unpress = zstandard.ZstdDecompressor()
    flat = np.frombuffer(b"".join(unpress.decompress(x.as_py()) for x in batch.column("classes")), np.uint8).astype(np.int64)
    lengths = batch.column("n_tokens").to_numpy()
    return flat, lengths, np.cumsum(lengths) - lengths


def transitions(rows: DataFrame, classes: int) -> np.ndarray:
    """How often a class follows another one in training documents (a fixed-size matrix, summed in each task first)."""
    size = classes + 2

    def run(batches):
        out = np.zeros(size * size, np.int64)
        for batch in batches:
            flat, lengths, starts = sequences(batch)
            before = np.roll(flat, 1)
            before[starts] = classes
            out += np.bincount(before * size + flat, minlength=size * size)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["cell", "n"])

    total = np.zeros(size * size)
    for r in rows.where("NOT held_out").select("n_tokens", "classes").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[r["cell"]] = r["n"]  # at most (classes + 2) ** 2 rows
    return total.reshape(size, size)


def transition_table(counts: np.ndarray, n_class: np.ndarray, v_class: np.ndarray) -> np.ndarray:
    """log10 of the chance of a class after a class; the last row and column stand for an unknown word."""
    c = len(n_class)
    n = n_class.sum()
    share = n_class / max(n, 1)
    free = np.where(n_class > 0, DISCOUNT * v_class / np.maximum(n_class, 1), 0)
    free[-1] = 0
    t = (counts[:c, :c] + PRIOR * share) / (counts[:c, :c].sum(1, keepdims=True) + PRIOR)
    weight = n_class * free
    after = (weight / weight.sum()) @ t if weight.sum() > 0 else share
    out = np.zeros((c + 1, c + 1))
    out[:c, :c], out[c, :c] = t, after
    out[:, c] = out[:, :c] @ free
    if n == 0:
        out[:, c] = 1
    return np.log10(np.maximum(out, 1e-300))


def score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, sweeps: int = SWEEPS,
          block_tokens: int = BLOCK_TOKENS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10).

    Learned from documents whose CRC-32 of the identifier as text is not 1 modulo 5. Null and empty texts are an end
    token alone; a null identifier is not held out; repeated rows each count and each give a row. Without a training
    document every token is unknown and certain, so scores are 0. An empty table gives an empty result. Other columns
    are not read. No word is left out: every count covers all training documents.
    """
    if not 1 <= classes <= CONTEXTS:
        raise ValueError("classes must lie between 1 and CONTEXTS")
    staging.batches(spark)
    value = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), value.alias("_text"), held.alias("_held"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = MIN_BUCKETS
    while buckets * bucket_bytes < size:
        buckets *= 2
    made = staging.stage(spark, blocks(rows, buckets, block_tokens), compression="none", partition_by=("kind",))
    parts = made.where("kind = 1").select("block", "bucket", "a", "b", "c", "d")
    words = staging.stage(spark, parts.select("bucket", "a", "b", "c", "d").groupBy("bucket").applyInArrow(merge_bucket, WORDS), compression="none")
    sums: list[np.ndarray] = []
    for _ in range(sweeps):
        sums.append(class_sums(spark, words, sums, classes))
    known = staging.stage(spark, classified(spark, words, sums, classes), compression="none")
    n_class, v_class = np.zeros(classes + 1), np.zeros(classes + 1)
    totals = known.select(F.posexplode(F.arrays_zip("n", "v"))).groupBy("pos").agg(F.sum("col.n").alias("n"), F.sum("col.v").alias("v"))
    for r in totals.collect():  # one row per class
        n_class[r["pos"]], v_class[r["pos"]] = r["n"], r["v"]
    n_all, v_all = int(n_class.sum()), int(v_class.sum())
    back = parts.select("block", "bucket", "a").groupBy("bucket").cogroup(known.select("bucket", "words", "counts", "own").groupBy("bucket")) \
        .applyInArrow(answers, "block long, bucket int, counts binary, own binary")
    own = made.where("kind = 0").select("block", "ids", "held", "a", "b")
    found = own.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(documents_of(n_class, n_all, v_all), DOCUMENTS)
    found = staging.stage(spark, found, compression="none")
    shared = spark.sparkContext.broadcast(transition_table(transitions(found, classes), n_class, v_class))

    def run(batches):
        t = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, lengths, starts = sequences(batch)
            before = np.roll(flat, 1)
            before[starts] = classes
            total = np.add.reduceat(t[before, flat], starts) + batch.column("emission").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("_id", "held_out", "n_tokens", "n_known", "base_score")] + [pa.array(total)],
                                             names=["_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = found.mapInArrow(run, "_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
