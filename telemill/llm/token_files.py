"""Token ids on disk as compressed bit planes.

A chunk holds whole documents. Its ids are cut into blocks of fixed size; the bits of a block are transposed, so that
plane *k* has bit *k* of every id, and each plane is compressed with zstandard. A chunk starts with its index: block
size, width, number of ids and the length of every plane, so single blocks and planes can be read. Chunks are rows of a
Parquet table in the shared folder, in ascending document order by (part, chunk), each with the identifiers and lengths
of its documents and the number of ids before it in its part.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import encode, staging, text

BLOCK = 16_384
CHUNK_IDS = 1 << 18
END_ID = 1
_HEAD = "<4sIIQ"
_HEAD_BYTES = 20
_MAGIC = b"BPL1"


def planes(ids: np.ndarray, width: int) -> list[bytes]:
    """The bit planes of one block, least significant first."""
    n = len(ids)
    kind = np.uint8 if width <= 8 else np.uint16 if width <= 16 else np.uint32
    size = np.dtype(kind).itemsize
    bits = np.unpackbits(ids.astype(f"<u{size}").view(np.uint8).reshape(n, size), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits[:, :width].T), axis=1, bitorder="little")
    return [p.tobytes() for p in packed]


def pack_chunk(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A chunk's bytes: head, plane lengths, compressed planes."""
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    press = zstandard.ZstdCompressor(level=1)
    parts = [press.compress(p) for i in range(0, len(ids), block) for p in planes(ids[i:i + block], width)]
    return b"".join([struct.pack(_HEAD, _MAGIC, block, width, len(ids)), np.array([len(p) for p in parts], "<u4").tobytes(), *parts])


def unpack_chunk(data: bytes) -> np.ndarray:
    """The ids of a chunk as ``uint32``."""
    magic, block, width, n = struct.unpack_from(_HEAD, data)
    if magic != _MAGIC:
        raise ValueError("not a bit-plane chunk")
    blocks = -(-n // block)
    sizes = np.frombuffer(data, "<u4", blocks * width, _HEAD_BYTES)
    at = _HEAD_BYTES + sizes.nbytes
    unpress = zstandard.ZstdDecompressor()
    out = []
    for b in range(blocks):
        m = min(block, n - b * block)
        rows = np.empty((width, -(-m // 8)), np.uint8)
        for k in range(width):
            size = int(sizes[b * width + k])
            rows[k] = np.frombuffer(unpress.decompress(data[at:at + size]), np.uint8)
            at += size
        bits = np.unpackbits(rows, axis=1, count=m, bitorder="little")
        padded = np.zeros((m, 32), np.uint8)
        padded[:, :width] = bits.T
        out.append(np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel())
    return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, np.uint32)


CHUNKS = "part int, chunk long, first long, n_ids long, doc_ids array<bigint>, doc_tokens array<bigint>, payload binary"


def chunk_rows(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
               block: int = BLOCK, chunk_ids: int = CHUNK_IDS, leading_space: bool = False) -> DataFrame:
    """The rows of a token file, computed where they stand: documents must come range-partitioned and sorted."""
    def run(batches):
        encoder = encode.PieceEncoder(tokenizer, leading_space)
        part, chunk, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, tokens, ids, size = [], [], [], 0

        def row():
            nonlocal doc_ids, tokens, ids, size, chunk, first
            payload = pack_chunk(np.concatenate(ids), block)
            out = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([first], pa.int64()), pa.array([size], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())), pa.array([tokens], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["part", "chunk", "first", "n_ids", "doc_ids", "doc_tokens", "payload"])
            chunk, first = chunk + 1, first + size
            doc_ids, tokens, ids, size = [], [], [], 0
            return out

        for batch in batches:
            names = batch.column("_id").to_pylist()
            for i, j, got, ends in encoder.documents(batch.column("_text")):
                got, ends = encode.with_end(got, ends, end_id)
                while i < j:
                    base = len(ends) - 1 - (j - i)
                    k = max(1, int(np.searchsorted(ends, ends[base] + chunk_ids - size, "right")) - 1 - base)
                    k = min(k, j - i)
                    ids.append(got[ends[base]:ends[base + k]])
                    doc_ids += names[i:i + k]
                    tokens += np.diff(ends[base:base + k + 1]).tolist()
                    size += int(ends[base + k] - ends[base])
                    i += k
                    if size >= chunk_ids:
                        yield row()
        if doc_ids:
            yield row()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return rows.mapInArrow(run, CHUNKS)


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 partitions: int | None = None, **options) -> DataFrame:
    """Write all documents as a token file in ascending order of their identifier and return it as read back.

    Null texts are empty and consist of the end id. Rows without an identifier come first; rows that share one are
    ordered by a hash of their text. An empty table gives a file without chunks. Other columns are not read.
    """
    staging.batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_i"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_t"))
    rows = rows.repartitionByRange(n, "_i").sortWithinPartitions("_i", F.xxhash64("_t"), F.octet_length("_t"))
    return staging.stage(spark, chunk_rows(rows, tokenizer, "_i", "_t", **options), compression="none")


def read_tokens(spark: SparkSession, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of a token file: where its ids start, how many there are, and their CRC-32 as 32-bit integers."""
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per part of the file, so the window holds a few numbers
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))

    def run(batches):
        for batch in batches:
            cols = {k: batch.column(k).to_pylist() for k in ("base", "doc_ids", "doc_tokens")}
            payload = batch.column("payload")
            for r in range(batch.num_rows):
                ids = unpack_chunk(payload[r].as_py()).astype("<u4")
                ends = np.concatenate(([0], np.cumsum(np.array(cols["doc_tokens"][r], np.int64))))
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(cols["doc_ids"][r], pa.int64()), pa.array(ends[:-1] + cols["base"][r]), pa.array(np.diff(ends)),
                    pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    rows = chunks.join(F.broadcast(parts), chunks["part"] == parts["_part"])  # one row per part
    rows = rows.select((F.col("_before") + F.col("first")).alias("base"), "doc_ids", "doc_tokens", "payload")
    return rows.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
