"""Removal of repeated byte strings by external induced suffix sorting.

Every window of ``LENGTH`` bytes has an anchor, the substring of ``LENGTH - SPAN + 1`` bytes in it with the smallest
hash, so equal windows have equal anchors at equal places. Neighbouring windows with one anchor form a run, and a run's
*context* is all bytes of its windows. An anchor that occurs once cannot lie in a repeated window. Contexts of the other
anchors are reduced to distinct ones with their number of copies. An anchor with a single context has nothing left to
compare: all its windows are as repeated as the context. All others are dealt out by anchor and suffix-sorted in shards;
a window that shares ``LENGTH`` bytes with a neighbour in suffix order is repeated, as is every window of a context that
has copies. Anchors with very many different contexts are spread over several shards, and classes of equal windows are
then matched between these by digest.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import staging, suffixes, text

LENGTH = 400
SPAN = 201
#: Different contexts of one anchor that are sorted together; more are spread over several shards.
SPREAD = 4096
#: Bytes of contexts sorted at once by one task, and of contexts dealt to one task.
SHARD_BYTES = 4 << 20
TASK_BYTES = 64 << 20
SLICE = 1 << 20


def window_anchors(buf: np.ndarray, prefix: np.ndarray, gram: int, span: int, powers: text.Powers) -> np.ndarray:
    """For each place where ``span`` substrings of ``gram`` bytes start: where the one with the smallest hash starts."""
    m = len(buf) - gram + 1
    if m < span:
        return np.zeros(0, np.int64)
    bits = np.uint64(int(m).bit_length())
    h = text.mix((prefix[gram:] - prefix[:m]) * powers.get(len(prefix))[1][:m])
    key = ((h >> bits) << bits) | np.arange(m, dtype=np.uint64)
    whole = -(-m // span) * span
    padded = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = key
    rows = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
    n = m - span + 1
    return (np.minimum(back[:n], ahead[span - 1:span - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def runs_of(buf: np.ndarray, offsets: np.ndarray, length: int, span: int, powers: text.Powers):
    """Runs of a flat column: document, first and behind-last window start (in the document), anchor and context hashes."""
    gram = length - span + 1
    prefix = text.prefix_hash(buf, powers)
    anchor = window_anchors(buf, prefix, gram, span, powers)
    n = len(anchor)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    edge = np.zeros(n + 1, np.int32)
    sizes = np.diff(offsets)
    big = sizes >= length
    np.add.at(edge, offsets[:-1][big], 1)
    np.add.at(edge, np.minimum(offsets[1:][big] - length + 1, n), -1)
    valid = np.cumsum(edge[:-1]) > 0
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first[offsets[:-1][big]] = True
    start = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    end = np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    at = anchor[start]
    a = text.span_hash(prefix, at, at + gram, powers)
    c = text.mix(text.span_hash(prefix, start, end + length - 1, powers) + (at - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return doc, start - offsets[doc], end - offsets[doc], a.view(np.int64), c.view(np.int64)


def slices(offsets: np.ndarray, length: int):
    """Pieces of whole documents; a document longer than a piece in overlapping parts: (first, last, from, to)."""
    for i, j in text.pieces(offsets, SLICE):
        a, b = int(offsets[i]), int(offsets[j])
        if j - i > 1 or b - a <= 2 * SLICE:
            yield i, j, a, b
            continue
        for p in range(a, b, SLICE):
            yield i, j, p, min(b, p + SLICE + length - 1)
            if p + SLICE + length - 1 >= b:
                break


def runs(rows: DataFrame, length: int, span: int) -> DataFrame:
    """All runs of all documents (``_key, _bytes``): ``key, firsts, size, anchor, context``.

    Equal contexts of one document, as periodic texts have them by the thousand, are one row with all their places.
    """
    def run(batches):
        powers = text.Powers()
        for batch in batches:
            buf, offsets = text.flat(batch.column("_bytes"))
            keys = batch.column("_key").to_numpy()
            for i, j, p, q in slices(offsets, length):
                own = np.clip(offsets[i:j + 1], p, q) - p
                doc, s, e, a, c = runs_of(buf[p:q], own, length, span, powers)
                shift = int(p - offsets[i]) if j - i == 1 else 0
                order = np.lexsort((s, c, doc))
                doc, s, e, a, c = (x[order] for x in (doc, s, e, a, c))
                at = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (c[1:] != c[:-1])))) if len(doc) else np.zeros(0, np.int64)
                places = pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)).astype(np.int32)), pa.array(s + shift))
                yield pa.RecordBatch.from_arrays([pa.array(keys[i + doc[at]]), places, pa.array((e - s)[at].astype(np.int32)), pa.array(a[at]), pa.array(c[at])],
                                                 names=["key", "firsts", "size", "anchor", "context"])

    return rows.mapInArrow(run, "key long, firsts array<bigint>, size int, anchor long, context long")


def contexts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the contexts listed for each document key."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("first", "size", "anchor", "context", "copies", "spread", "salt")).alias("runs"))
    joined = rows.join(lists, rows["_key"] == lists["key"]).select("_bytes", "runs")

    def run(batches):
        for batch in batches:
            buf, offsets = text.flat(batch.column("_bytes"))
            lists = batch.column("runs")
            r = lists.flatten()
            doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            first = r.field("first").to_numpy() + offsets[doc]
            end = first + r.field("size").to_numpy() + length - 1
            yield pa.RecordBatch.from_arrays([r.field(c) for c in ("anchor", "context", "copies", "spread", "salt")] + [text.span_bytes(buf, first, end)],
                                             names=["anchor", "context", "copies", "spread", "salt", "bytes"])

    return joined.mapInArrow(run, "anchor long, context long, copies long, spread int, salt int, bytes binary")


def _bounds(flag: np.ndarray) -> tuple[list[int], list[int]]:
    x = np.flatnonzero(np.diff(np.concatenate(([0], flag.astype(np.int8), [0]))))
    return x[::2].tolist(), x[1::2].tolist()


def sort_shard(rows: list[tuple], length: int, folder: str, powers: text.Powers):
    """Repeated windows of distinct contexts, as rows (kind, anchor, context, starts, ends, digests).

    Kind 0 gives stretches of repeated windows. Kind 1, for contexts of a spread anchor only, gives one digest for each
    window and whether it is repeated already.
    """
    sizes = np.array([len(r[5]) for r in rows], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    t = np.ones(offsets[-1] + 1, np.uint16)
    t[-1] = 0
    at = text.ragged(offsets[:-1], sizes)
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    t[at] = data.astype(np.uint16) + 2
    flags = suffixes.repeated(t, length, folder)
    ends = np.cumsum(sizes)
    for k, (anchor, context, copies, spread, _, raw) in enumerate(rows):
        n = len(raw) - length + 1
        flag = flags[offsets[k]:offsets[k] + n]
        if copies > 1:
            flag = np.ones(n, bool)
        if flag.any():
            s, e = _bounds(flag)
            yield 0, anchor, context, s, e, None, None
        if spread > 1:
            own = data[ends[k] - sizes[k]:ends[k]]
            prefix = text.prefix_hash(own, powers)
            h = text.span_hash(prefix, np.arange(n), np.arange(n) + length, powers)
            other = text.prefix_hash(text.LOWER[::-1][own], powers)
            h2 = text.span_hash(other, np.arange(n), np.arange(n) + length, powers)
            yield 1, anchor, context, np.arange(n).tolist(), flag.astype(np.int64).tolist(), h.view(np.int64).tolist(), h2.view(np.int64).tolist()


FOUND = "kind int, anchor long, context long, starts array<bigint>, ends array<bigint>, h1 array<bigint>, h2 array<bigint>"


def sorted_shards(dealt: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Suffix-sort the contexts of every task, in shards of whole (anchor, salt) groups."""
    def run(batches):
        powers = text.Powers()
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4]
        names = ["kind", "anchor", "context", "starts", "ends", "h1", "h2"]
        held: list[tuple] = []
        size = 0

        def flush():
            # working files of this task alone, gone when it ends
            with tempfile.TemporaryDirectory() as folder:
                out = list(sort_shard(held, length, folder, powers))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "copies", "spread", "salt", "bytes"))):
                if held and size >= shard_bytes and (held[-1][0], held[-1][4]) != (row[0], row[4]):
                    yield from flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield from flush()

    return dealt.mapInArrow(run, FOUND)


def finish(rows: DataFrame, removed: DataFrame, length: int) -> DataFrame:
    """Per document row: bytes, removed spans and the kept bytes' digest."""
    joined = rows.join(removed, "_key", "left").select("_id", "_bytes", "runs")

    def run(batches):
        for batch in batches:
            buf, offsets = text.flat(batch.column("_bytes"))
            raw = buf.tobytes()
            removed, spans, sha = [], [], []
            for k, found in enumerate(batch.column("runs").to_pylist()):
                a, b = int(offsets[k]), int(offsets[k + 1])
                own, digest, at = [], hashlib.sha256(), a
                for s, e in sorted((x["s"], x["e"]) for x in found or ()):
                    if own and s <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], e + length - 1)
                    else:
                        own.append([s, e + length - 1])
                for s, e in own:
                    digest.update(raw[at:a + s])
                    at = a + e
                digest.update(raw[at:b])
                removed.append(sum(e - s for s, e in own))
                spans.append([{"start": s, "end": e} for s, e in own])
                sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([
                batch.column("_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(sha, pa.string())],
                names=["_id", "n_bytes", "n_removed", "spans", "kept_sha256"])

    kind = dict(rows.dtypes)["_id"]
    return joined.mapInArrow(run, f"_id {kind}, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")


def repeated_spans(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   span: int = SPAN, spread: int = SPREAD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document row: ``id, n_bytes, n_removed, spans`` (byte ranges to remove), ``kept_sha256``.

    A byte is removed when it lies in a string of ``length`` bytes that also starts elsewhere, in this text or another
    one. Texts are UTF-8 bytes, null is empty, and matches end at the ends of texts. Repeated rows are repeated texts and
    lose everything from ``length`` bytes on, whether identifiers repeat, are null or not. An empty table gives an empty
    result. Other columns are not read. Rows are found again by a 64-bit hash of identifier and text.
    """
    if not 1 <= span <= length:
        raise ValueError("span must lie between 1 and length")
    staging.batches(spark)
    raw = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{id_col}`"), raw, F.octet_length(raw)).alias("_key"), raw.alias("_bytes"))
    every = runs(rows.select("_key", "_bytes"), length, span)
    # written out, so that the joins below read plain exchanges, whose large partitions can be split
    often = every.groupBy("anchor").agg(F.sum(F.size("firsts")).alias("n")).where("n > 1").select("anchor")
    often = staging.stage(spark, often)
    some = staging.stage(spark, every.join(often, "anchor", "left_semi").select("key", "firsts", "size", "anchor", "context"))
    distinct = staging.stage(spark, some.groupBy("anchor", "context").agg(
        F.sum(F.size("firsts")).alias("copies"), F.min("key").alias("key"),
        F.min_by(F.struct(F.get("firsts", F.lit(0)).alias("first"), "size"), "key").alias("at")))
    several = staging.stage(spark, distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    wanted = distinct.join(several, "anchor").withColumn("spread", F.ceil(F.col("kinds") / spread).cast("int"))
    wanted = wanted.withColumn("salt", F.pmod("context", F.col("spread")).cast("int"))
    wanted = staging.stage(spark, wanted.select("key", "at.first", "at.size", "anchor", "context", "copies", "spread", "salt"))
    # the only context of an anchor has nothing to be sorted against: its copies make all its windows repeated
    alone = distinct.where("copies > 1").join(several, "anchor", "left_anti").select("anchor", "context", F.lit(0).cast("long").alias("s"), F.col("at.size").cast("long").alias("e"))
    size = wanted.agg(F.sum(F.col("size") + length)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES + 1)
    dealt = contexts(rows.select("_key", "_bytes"), wanted, length).repartition(tasks, "anchor", "salt").sortWithinPartitions("anchor", "salt")
    found = staging.stage(spark, sorted_shards(dealt, length, shard_bytes))
    hits = found.where("kind = 0").select("anchor", "context", F.explode(F.arrays_zip("starts", "ends")).alias("x")).select("anchor", "context", F.col("x.starts").alias("s"), F.col("x.ends").alias("e"))
    windows = found.where("kind = 1").select("anchor", "context", F.explode(F.arrays_zip("starts", "ends", "h1", "h2")).alias("x"))
    windows = windows.select("anchor", "context", F.col("x.starts").alias("s"), F.col("x.ends").alias("known"), F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"))
    again = windows.groupBy("h1", "h2").agg(F.sum(F.lit(1) + F.col("known")).alias("n")).where("n > 1")
    late = windows.where("known = 0").join(again, ["h1", "h2"], "left_semi").select("anchor", "context", "s", (F.col("s") + 1).alias("e"))
    hits = hits.unionByName(late).unionByName(alone)
    placed = some.join(hits, ["anchor", "context"]).select("key", F.explode("firsts").alias("first"), "s", "e")
    placed = placed.select("key", (F.col("first") + F.col("s")).alias("s"), (F.col("first") + F.col("e")).alias("e")).distinct()
    removed = placed.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    return finish(rows, removed, length).withColumnRenamed("_id", id_col)
