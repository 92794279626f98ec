"""Keyed processing in event-time order.

Rows of a key may arrive in any order within the watermark, while alert and feature state depends on
the order. Rows therefore wait in state until the watermark has passed them and are then handed on in
``(time, seq)`` order, so a stream yields what a batch over the same rows yields.

Keys share a fixed number of buckets by their hash, and a bucket is the unit that Spark groups by: calls to Python
and to the state store are then as many as buckets, however many keys there are, and ``step`` sees the rows of many keys
at once. A bucket holds three pieces of state in the state store: the rows that wait (a list of Arrow chunks, so a
batch adds one entry), what ``step`` carries on for each of its keys, and a clock. One event-time timer per bucket is
set, for the first row that waits or else for the end of a key's idle time. When that passes without new rows the key's
state is removed, and rows that come later start afresh.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..session import configure

#: ``step(rows, starts, carries) -> (extra columns, carries)``: rows of one key after another, key ``i`` from ``starts[i]``
#: to ``starts[i + 1]``, with what it carried on. A long key may come in several calls.
Step = Callable[[Mapping[str, np.ndarray], np.ndarray, list[tuple]], tuple[Mapping[str, object], list[tuple]]]
_NEVER = 2**63 - 1
#: Buckets of keys; rows that ``step`` sees at most at once; rows or keys in one entry of a list in the state store.
BUCKETS, BLOCK, ENTRY = 1024, 16_384, 16_384


def _packed(columns: Mapping[str, object]) -> bytes:
    batch = pa.record_batch([pa.array(c) for c in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(entry: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(entry).read_next_batch()


class InOrder(StatefulProcessor):
    """Hands the rows of a bucket to ``step``, key by key and in order, once the watermark has passed them."""

    def __init__(self, keys: list[str], values: list[str], step: Step, fresh: Callable[[], tuple], state_fields: list[T.StructField],
                 out_fields: list[T.StructField], time: str, seq: str, idle_ms: int | None):
        self.keys, self.values, self.step, self.fresh = keys, values, step, fresh
        self.state_fields, self.out_fields, self.time, self.seq, self.idle_ms = [f.name for f in state_fields], out_fields, time, seq, idle_ms
        self.k, self.v = [f"k{i}" for i in range(len(keys))], [f"v{i}" for i in range(len(values))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        entry = T.StructType([T.StructField("entry", T.BinaryType())])
        self.handle = handle
        self.waiting = handle.getListState("waiting", entry)
        self.carry = handle.getListState("carry", entry)
        self.clock = handle.getValueState("clock", T.StructType([T.StructField("first", T.LongType()), T.StructField("timer", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [{**{k: pdf[c].to_numpy() for k, c in zip(self.k, self.keys)},
                "time": pdf[self.time].to_numpy(dtype="datetime64[us]").astype("int64"), "seq": pdf[self.seq].to_numpy(dtype="int64"),
                **{v: pdf[c].to_numpy(dtype=float) for v, c in zip(self.v, self.values)}} for pdf in rows]
        yield from self.advance(key[0], new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance(key[0], [], timerValues.getCurrentWatermarkInMs())

    def advance(self, bucket: int, new: list[dict[str, np.ndarray]], mark: int) -> Iterator[pd.DataFrame]:
        first, timer = self.clock.get() if self.clock.exists() else (_NEVER, _NEVER)
        first = min([first, *(int(chunk["time"].min()) // 1000 for chunk in new)])
        if first > mark and self.idle_ms is None:  # nothing is due, and nothing leaves
            for chunk in new:
                self.waiting.appendValue((_packed(chunk),))
            self.set_clock(first, max(first, mark) + 1 if first != _NEVER else _NEVER, timer, mark)
            return
        held = [_unpacked(entry) for entry, in self.waiting.get()]
        chunks = [*({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names} for batch in held), *new]
        carry = {}
        for entry, in self.carry.get():
            columns = [c.to_pylist() for c in _unpacked(entry).columns]
            n = len(self.k)
            carry |= {key: state for key, state in zip(zip(*columns[:n]), zip(*columns[n:]))}
        rest, waiting = {}, set()
        if chunks:
            rows = {c: np.concatenate([chunk[c] for chunk in chunks]) for c in chunks[0]}
            codes, names = self.codes(rows)
            order = np.lexsort((rows["seq"], rows["time"], codes))
            is_due = rows["time"][order] <= mark * 1000
            due, late = order[is_due], order[~is_due]
            for i in range(0, len(due), BLOCK):
                yield self.stepped(bucket, {c: x[due[i:i + BLOCK]] for c, x in rows.items()}, codes[due[i:i + BLOCK]], names, carry)
            rest, waiting = {c: x[late] for c, x in rows.items()}, {names[c] for c in np.unique(codes[late]).tolist()}
            if len(due):
                self.keep(self.waiting, rest, len(late))
            else:
                for chunk in new:
                    self.waiting.appendValue((_packed(chunk),))
        known = len(carry)
        wanted = _NEVER
        if self.idle_ms is not None:
            carry = {key: state for key, state in carry.items() if key in waiting or mark < state[-1] + self.idle_ms}
            wanted = min([_NEVER, *(max(state[-1] + self.idle_ms, mark) + 1 for key, state in carry.items() if key not in waiting)])
        if (chunks and len(due)) or len(carry) < known:
            columns = [*zip(*carry), *zip(*carry.values())]
            self.keep(self.carry, dict(zip([*self.k, *self.state_fields, "_last"], columns)), len(carry))
        first = int(rest["time"].min()) // 1000 if waiting else _NEVER
        if waiting:
            wanted = min(wanted, max(first, mark) + 1)
        self.set_clock(first, wanted, timer, mark, gone=not carry and not waiting)

    def codes(self, rows: Mapping[str, np.ndarray]) -> tuple[np.ndarray, list[tuple]]:
        """A number per row for its key, and the keys by number; values that are no value are None there."""
        frame = pd.DataFrame({k: rows[k] for k in self.k})
        if not self.k:
            return np.zeros(len(rows["time"]), np.int64), [()]
        codes = frame.groupby(self.k, sort=False, dropna=False).ngroup().to_numpy()
        _, at = np.unique(codes, return_index=True)
        columns = [[None if v is None or v != v else v for v in rows[k][at].tolist()] for k in self.k]
        return codes, list(zip(*columns))

    def stepped(self, bucket: int, rows: dict[str, np.ndarray], codes: np.ndarray, names: list[tuple], carry: dict) -> pd.DataFrame:
        n = len(codes)
        starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [n]])
        here = [names[c] for c in codes[starts[:-1]].tolist()]
        extra, states = self.step({"_seq": rows["seq"], **{c: rows[v] for v, c in zip(self.v, self.values)}}, starts,
                                  [carry[key][:-1] if key in carry else self.fresh() for key in here])
        last = (rows["time"][starts[1:] - 1] // 1000).tolist()
        carry |= {key: (*state, t) for key, state, t in zip(here, states, last)}
        made = {c: [None] * n if bucket >> i & 1 else rows[k] for i, (k, c) in enumerate(zip(self.k, self.keys))}
        made[self.time] = rows["time"].astype("datetime64[us]")
        made[self.seq] = rows["seq"]
        made |= {c: rows[v] for v, c in zip(self.v, self.values)} | {f.name: extra[f.name] for f in self.out_fields}
        return pd.DataFrame(made)

    @staticmethod
    def keep(state, columns: Mapping[str, object], n: int) -> None:
        """The columns as the whole of a list in the state store."""
        if n:
            state.put([(_packed({c: x[i:i + ENTRY] for c, x in columns.items()}),) for i in range(0, n, ENTRY)])
        else:
            state.clear()

    def set_clock(self, first: int, wanted: int, timer: int, mark: int, gone: bool = False) -> None:
        if wanted != timer:
            if mark < timer < _NEVER:
                self.handle.deleteTimer(timer)
            if wanted != _NEVER:
                self.handle.registerTimer(wanted)
        if gone:
            self.clock.clear()
        else:
            self.clock.update((first, wanted))


def bucketed(rows: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Add ``_bucket``: the hash of the key and, in the lowest bits, which of its columns are NULL.

    A column is then NULL in all rows of a bucket or in none, and whole numbers are filled in, as a pandas column would
    turn them into floats beside a NULL.
    """
    bits = [F.col(k).isNull().cast("long") * F.lit(1 << i) for i, k in enumerate(keys)]
    number = (F.pmod(F.xxhash64(*keys), F.lit(buckets)) if keys else F.lit(0).cast("long")) * F.lit(1 << len(bits))
    out = rows.withColumn("_bucket", sum(bits, number))
    whole = [k for k in keys if isinstance(rows.schema[k].dataType, T.IntegralType)]
    return out.withColumns({k: F.coalesce(k, F.lit(0).cast(rows.schema[k].dataType)) for k in whole})


def process_in_order(
    rows: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    step: Step,
    fresh: Callable[[], tuple],
    state_fields: Sequence[T.StructField],
    out_fields: Sequence[T.StructField],
    time: str = "timestamp",
    seq: str = "seq",
    idle: float | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Apply ``step`` to each key's rows in order.

    ``values`` are numeric columns carried along, ``_seq`` is the sequence number; ``out_fields`` are the columns that ``step`` adds. Of a key without rows for
    ``idle`` seconds of event time nothing is kept; ``None`` keeps every key. A task holds one of the ``buckets`` at a
    time, so their number follows from how many keys fit it; it is part of the checkpoint and must not change with it.
    """
    configure(rows.sparkSession)  # several pieces of state per bucket need the state store that can hold them
    names = list(values)
    out_schema = T.StructType([
        *[T.StructField(k, rows.schema[k].dataType) for k in keys], T.StructField(time, T.TimestampType()), T.StructField(seq, T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in names], *out_fields])
    processor = InOrder(list(keys), names, step, fresh, list(state_fields), list(out_fields), time, seq, None if idle is None else int(idle * 1000))
    needed = bucketed(rows, keys, buckets).select("_bucket", *dict.fromkeys([*keys, time, seq, *names]))
    return needed.groupBy("_bucket").transformWithStateInPandas(processor, out_schema, "append", "EventTime")
