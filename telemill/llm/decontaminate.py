"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of 13 consecutive item words (an item of fewer words is one window). Texts are searched as
sequences of 64-bit word hashes, and a block is two words. For each pattern length a shift table tells, for the block
that ends at the present position, how far the search may move without missing a pattern; where it may not move, the
suffix hash selects the patterns that end in this block, and comparing the words themselves decides. Many places are
searched in step, so one NumPy call moves all of them.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import staging, text

WINDOW = 13
#: Positions of a document that one search lane covers.
LANE = 64
TABLE_BITS = 20
#: Item bytes per pattern table (a table takes some thirty times as much); larger benchmarks are searched table by table, so a broadcast stays bounded.
TABLE_BYTES = 2 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)


def words_of(value: str | None) -> list[bytes]:
    """Words of one text: A-Z lower-cased, runs of ASCII digits, a-z and non-ASCII characters."""
    buf = text.LOWER[np.frombuffer((value or "").encode(), np.uint8)]
    s, e, _ = text.spans(buf, np.array([0, len(buf)]), text.ALNUM)
    raw = buf.tobytes()
    return [raw[i:j] for i, j in zip(s.tolist(), e.tolist())]


def _hashes(words: list[bytes], powers: text.Powers) -> np.ndarray:
    buf = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    return text.span_hash(text.prefix_hash(buf, powers), ends - lengths, ends, powers)


def _block(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the block of ``width`` words that ends at each position."""
    return h[at] if width == 1 else text.mix(h[at - 1] * _STEP + h[at])


class Patterns:
    """Shift table, suffix buckets and texts of the patterns of one length."""

    def __init__(self, length: int, windows: dict[bytes, list[str]], powers: text.Powers):
        self.length, self.width = length, min(2, length)
        self.texts = list(windows)
        self.items = [sorted(set(windows[t])) for t in self.texts]
        h = _hashes([w for t in self.texts for w in t.split(b" ")], powers).reshape(-1, length)
        self.shift = np.full(1 << TABLE_BITS, length - self.width + 1, np.int8)
        flat, rows = h.ravel(), np.arange(len(h)) * length
        for end in range(self.width - 1, length):
            block = _block(flat, rows + end, self.width) & np.uint64((1 << TABLE_BITS) - 1)
            np.minimum.at(self.shift, block, np.int8(length - 1 - end))
        suffix = _block(flat, rows + length - 1, self.width)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def state(self) -> dict:
        """The tables as plain arrays and lists, which executors can read without this package."""
        return dict(self.__dict__)

    @classmethod
    def of(cls, state: dict) -> Patterns:
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def search(self, h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (end position, pattern) whose suffix block agrees, for the caller to compare."""
        first, limit = offsets[:-1] + self.length - 1, offsets[1:]
        lanes = np.maximum(0, -(-(limit - first) // LANE))
        at = np.repeat(first, lanes) + LANE * (text.ragged(np.zeros(len(lanes), np.int64), lanes))
        limit = np.minimum(at + LANE, np.repeat(limit, lanes))
        found = []
        mask = np.uint64((1 << TABLE_BITS) - 1)
        while len(at):
            block = _block(h, at, self.width)
            shift = self.shift[block & mask]
            stop = shift == 0
            if stop.any():
                found.append((at[stop], block[stop]))
            at = at + np.maximum(shift, 1)
            going = at < limit
            at, limit = at[going], limit[going]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, blocks = (np.concatenate(x) for x in zip(*found))
        low = np.searchsorted(self.suffix, blocks, "left")
        many = np.searchsorted(self.suffix, blocks, "right") - low
        return np.repeat(ends, many), self.order[text.ragged(low, many)]


def pattern_tables(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[Patterns]:
    """Patterns by length, for items as (identifier, text)."""
    by_length: dict[int, dict[bytes, list[str]]] = defaultdict(lambda: defaultdict(list))
    for item, value in items:
        words = words_of(value)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            by_length[size][b" ".join(words[i:i + size])].append(item)
    powers = text.Powers()
    return [Patterns(n, w, powers) for n, w in sorted(by_length.items())]


def _search(buf: np.ndarray, offsets: np.ndarray, tables: list[Patterns], powers: text.Powers):
    """For each document of a flat column: number of words, hit word runs and matching items."""
    n_words, runs, items = [], [], []
    for i, j in text.pieces(offsets):
        b, o = text.LOWER[buf[offsets[i]:offsets[j]]], offsets[i:j + 1] - offsets[i]
        s, e, w = text.spans(b, o, text.ALNUM)
        h = text.span_hash(text.prefix_hash(b, powers), s, e, powers)
        raw = b.tobytes()
        edge = np.zeros(len(s) + 1, np.int32)
        own: dict[int, set[str]] = defaultdict(set)
        for t in tables:
            ends, which = t.search(h, w)
            for end, k, doc in zip(ends.tolist(), which.tolist(), (np.searchsorted(w, ends, "right") - 1).tolist()):
                a = end - t.length + 1
                if b" ".join(raw[s[x]:e[x]] for x in range(a, end + 1)) == t.texts[k]:
                    edge[a] += 1
                    edge[end + 1] -= 1
                    own[doc].update(t.items[k])
        hit = np.cumsum(edge[:-1]) > 0
        n_words += np.diff(w).tolist()
        for d in range(j - i):
            if d not in own:
                runs.append([])
                items.append([])
                continue
            m = np.concatenate(([False], hit[w[d]:w[d + 1]], [False]))
            x = np.flatnonzero(m[1:] != m[:-1])
            runs.append([{"start": int(p), "end": int(q)} for p, q in zip(x[::2], x[1::2])])
            items.append(sorted(own[d]))
    return n_words, runs, items


RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ITEMS = T.ArrayType(T.StringType())


def _free(names: list[str]) -> str:
    """A prefix that no column name begins with."""
    out = "_"
    while any(n.lower().startswith(out) for n in names):
        out += "_"
    return out


def _scan(docs: DataFrame, text_col: str, tables: list[Patterns], own: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast([t.state() for t in tables])
    kinds = (T.LongType(), RUNS, ITEMS)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, kind) for n, kind in zip(own, kinds)]])
    arrow_runs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        powers, tables = text.Powers(), [Patterns.of(s) for s in shared.value]
        for batch in batches:
            buf, offsets = text.flat(batch.column(text_col))
            n_words, runs, items = _search(buf, offsets, tables, powers)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()), pa.array(runs, arrow_runs), pa.array(items, pa.list_(pa.string()))],
                names=[*batch.schema.names, *own])

    return docs.mapInArrow(run, schema)


def benchmark_tables(benchmark: DataFrame, item_col: str, text_col: str, table_bytes: int):
    """Pattern tables over slices of the benchmark, each of about ``table_bytes`` of text."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"),
                            F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, math.ceil(total / table_bytes))
    for k in range(slices):
        part = rows if slices == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k)
        yield pattern_tables([(r["item"], r["text"]) for r in part.collect()])


def _scans(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, table_bytes: int) -> tuple[DataFrame, list[list[str]]]:
    """``docs`` passed through every pattern table, and the names of the columns that each adds (words, runs, items)."""
    prefix, added = _free(docs.columns), []
    for k, tables in enumerate(benchmark_tables(benchmark, item_col, item_text, table_bytes)):
        added.append([f"{prefix}{what}{k}" for what in ("words", "runs", "items")])
        docs = _scan(docs, text_col, tables, added[-1])
    return docs, added


def _merged_runs(names: list[str]) -> Column:
    if len(names) == 1:
        return F.col(names[0])
    every = F.array_sort(F.flatten(F.array(*names)))

    def add(acc: Column, x: Column) -> Column:
        # runs come in order of their start: one that begins inside the last one extends it
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return (F.when((F.size(acc) > 0) & (last["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer)))
                .otherwise(F.concat(acc, F.array(x))))

    return F.aggregate(every, F.array().cast(RUNS), add)


def _hits(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: ``n_words``, hit word ``runs`` (start, end), ``items`` sorted as strings, ``contaminated``.

    A word inside any occurrence of a window is hit; a document is contaminated when a twentieth of its words or more
    are hit. Null and empty texts have no words and are clean, as is everything when the benchmark is empty. An item
    without words has no window; items that share a window are all named; an item whose identifier is null is named "".
    Repeated rows each give a row, and other columns are not read. The benchmark is read in slices of ``table_bytes``:
    each gives one broadcast table, and the documents pass through the tables one after another.
    """
    staging.batches(docs.sparkSession)
    found = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    found, added = _scans(found, benchmark, "_text", item_col, item_text, table_bytes)
    words, runs, items = zip(*added)
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*items))))
    out = found.select(F.col("_id").alias(id_col), F.col(words[0]).alias("n_words"), _merged_runs(list(runs)).alias("runs"), items.alias("items"))
    return out.withColumn("n_hit", _hits(F.col("runs"))).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, without a shuffle."""
    staging.batches(docs.sparkSession)
    found, added = _scans(docs, benchmark, text_col, item_col, item_text, table_bytes)
    words, runs, _ = zip(*added)
    hit = _hits(_merged_runs(list(runs)))
    return found.where(~((hit > 0) & (20 * hit >= F.col(words[0])))).select(*[f"`{c}`" for c in docs.columns])
