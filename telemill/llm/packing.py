"""Packing documents into fixed windows by non-negative least squares.

Documents become token ids and an end id, cut into full windows and one remainder. Remainder lengths fall into bins of
``GRAIN`` tokens. All combinations of up to three bins that fill a window are enumerated; non-negative least squares
finds how often to repeat each so that together they use up the histogram. Repeat counts are rounded without using more
pieces than there are, and what is left is packed greedily, largest first. The plan depends on the histogram alone, so
its size is bounded by the number of bins. Each piece finds its place by its rank inside its bin.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import encode, staging

WINDOW = 2048
GRAIN = 8
DEPTH = 3
END_ID = 1
PIECES = "doc long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, bin int, part int, nth long"


def combinations(full: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All multisets of up to ``depth`` bins that sum to ``full``, each in descending order."""
    out: list[tuple[int, ...]] = []

    def grow(rest: int, most: int, have: tuple[int, ...]) -> None:
        if rest == 0:
            out.append(have)
            return
        slots = depth - len(have)
        for b in range(min(rest, most), 0, -1):
            if b * slots < rest:
                break
            grow(rest - b, b, (*have, b))

    grow(full, full, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """The non-negative ``x`` that minimises ``|a x - b|``, by an active set of columns.

    Products of columns are formed for the active ones only, so memory is that of ``a``.
    """
    x = np.zeros(a.shape[1])
    active = np.zeros(len(x), bool)
    for _ in range(3 * len(b) + 10):
        used = np.flatnonzero(x)
        gain = a.T @ (b - a[:, used] @ x[used])
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= tolerance:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            some = a[:, at]
            z = np.linalg.lstsq(some.T @ some, some.T @ b, rcond=None)[0]
            if (z > tolerance).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= tolerance
            old = x[at]
            step = float(np.min(old[bad] / np.maximum(old[bad] - z[bad], 1e-300)))
            x[at] = old + step * (z - old)
            gone = at[(x[at] <= tolerance)]
            if not len(gone):
                gone = at[bad][:1]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
        if not active.any():
            break
    return x


def plan(counts: np.ndarray, full: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a sequence, number of such sequences) for all pieces; ``counts[b]`` pieces are in bin ``b``."""
    left = counts.astype(np.int64).copy()
    made: list[tuple[tuple[int, ...], int]] = []

    def use(bins: tuple[int, ...], times: int) -> None:
        kinds, many = np.unique(bins, return_counts=True)
        times = min(times, int((left[kinds] // many).min()))
        if times > 0:
            left[kinds] -= times * many
            made.append((bins, times))

    use((full,), int(left[full]))
    total = int(left.sum())
    if total:
        combos = [c for c in combinations(full, depth) if len(c) > 1 and (left[list(c)] > 0).all()]
        if combos:
            a = np.zeros((full + 1, len(combos)))
            for k, c in enumerate(combos):
                np.add.at(a[:, k], list(c), 1)
            x = nnls(a, left / total) * total
            for k in np.argsort(-x, kind="stable"):
                if round(x[k]) < 1:
                    break
                use(combos[k], round(x[k]))
    while left.any():
        b = int(np.flatnonzero(left)[-1])
        bins, have, room = [b], left.copy(), full - b
        have[b] -= 1
        while room > 0:
            fit = np.flatnonzero(have[1:room + 1])
            if not len(fit):
                break
            b = int(fit[-1]) + 1
            bins.append(b)
            have[b] -= 1
            room -= b
        use(tuple(bins), int(left.max()))
    return made


def places(made: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, list[int], list[int], list[int]]]:
    """For each bin, in order of rank: first rank, first sequence and slot of every stretch of ranks."""
    by: dict[int, tuple[list[int], list[int], list[int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for bins, times in made:
        for slot, b in enumerate(bins):
            low, first, slots = by.setdefault(b, ([], [], []))
            low.append(used.get(b, 0))
            first.append(sequence)
            slots.append(slot)
            used[b] = used.get(b, 0) + times
        sequence += times
    return [(b, *v) for b, v in by.items()]


def cut_documents(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, window: int, grain: int, end_id: int,
                  leading_space: bool) -> DataFrame:
    """Pieces of all documents with their bin and their number inside (task, bin)."""
    def run(batches):
        encoder = encode.PieceEncoder(tokenizer, leading_space)
        part, seen = TaskContext.get().partitionId(), np.zeros(-(-window // grain) + 1, np.int64)
        for batch in batches:
            names = batch.column("_id")
            for i, j, ids, ends in encoder.documents(batch.column("_text")):
                ids, ends = encode.with_end(ids, ends, end_id)
                tokens = np.diff(ends)
                many = -(-tokens // window)
                doc = np.repeat(np.arange(j - i), many)
                start = window * (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many))
                length = np.minimum(window, tokens[doc] - start)
                bins = -(-length // grain)
                order = np.argsort(bins, kind="stable")
                kinds, sizes = np.unique(bins, return_counts=True)
                nth = np.empty(len(bins), np.int64)
                nth[order] = np.arange(len(bins)) - np.repeat(np.cumsum(sizes) - sizes - seen[kinds], sizes)
                seen[kinds] += sizes
                raw = memoryview(ids.astype("<u4").tobytes())
                at = (ends[doc] + start).tolist()
                cut = [raw[4 * a:4 * (a + n)] for a, n in zip(at, length.tolist())]
                yield pa.RecordBatch.from_arrays([
                    names.slice(i, j - i).take(pa.array(doc)), pa.array(start), pa.array(length),
                    pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(tokens[doc]),
                    pa.array([c.tobytes() for c in cut], pa.binary()), pa.array(bins, pa.int32()),
                    pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth)],
                    names=["doc", "start", "length", "ids_crc32", "doc_tokens", "ids", "bin", "part", "nth"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return rows.mapInArrow(run, PIECES)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, grain: int = GRAIN, end_id: int = END_ID, leading_space: bool = True) -> DataFrame:
    """One row per piece: identifier, ``start, length, ids_crc32, doc_tokens, sequence_id, offset`` and its ``ids``.

    ``ids`` are little-endian unsigned 32-bit integers. A null or empty text is a document of the end id alone. Rows that
    share an identifier are documents of their own. An empty table gives no pieces. Other columns are not read.
    """
    if window % grain:
        raise ValueError("grain must divide window")
    staging.batches(spark)
    pieces = staging.stage(spark, cut_documents(docs, tokenizer, id_col, text_col, window, grain, end_id, leading_space))
    per_part = pieces.groupBy("bin", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(window // grain + 1, np.int64)
    for r in per_part.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # one row per bin
        counts[r["bin"]] = r["n"]
    table = spark.createDataFrame(places(plan(counts, window // grain)) or [],
                                  "bin int, low array<bigint>, first array<bigint>, slot array<int>")
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("bin", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = pieces.join(offsets, ["bin", "part"]).join(F.broadcast(table), "bin")  # one row per bin
    rank = F.col("before") + F.col("nth")
    stretch = F.size(F.filter("low", lambda x: x <= rank))
    rows = rows.withColumn("_k", stretch).select(
        F.col("doc").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "ids",
        (F.element_at("first", F.col("_k")) + rank - F.element_at("low", F.col("_k"))).alias("sequence_id"),
        F.element_at("slot", F.col("_k")).alias("_slot"))
    earlier = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("_slot")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, length, ids`` (pieces one after another, without padding)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select(
        "sequence_id", "length", F.aggregate(F.transform("p", lambda x: x["ids"]), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
