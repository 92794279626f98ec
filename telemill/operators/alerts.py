"""Alert policy: scores become alerts through a small finite state machine.

The policy's memory is finite, so its states are enumerated once on the driver into a
transition table (a few hundred rows for the default settings). A stretch of a series is then
nothing but a mapping from the state it is entered in to the state it is left in, and mappings
compose in any grouping. A task therefore raises the mapping of every run of equal flags to the
run's length by repeated squaring, composes all runs of a batch by a prefix scan in which the
distance doubles, and reads the alerts of all rows from the orbits of their run's first state;
it never steps through rows. A key too long for one task is cut into slots whose mappings are
worked out side by side and then chained in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import join_keys
from .series import SLOT, Series


@dataclass(frozen=True)
class AlertPolicy:
    """Settings; ``mode`` is ``persistence`` (n in a row) or ``confirmation`` (k of the last n)."""

    threshold: float = 0.5
    persistence: int = 3
    cooldown: int = 10
    rearm: int = 10
    confirm: int = 3
    confirm_window: int = 5
    mode: str = "persistence"


QUIET = (0, 0, False, 0, ())  # streak, cooldown left, waiting to re-arm, rows below, recent flags


def _step(policy: AlertPolicy, state: tuple, above: bool) -> tuple[tuple, bool]:
    streak, cooling, waiting, below, recent = state
    if policy.mode == "confirmation":
        recent = (*recent, above)[-policy.confirm_window:]
        while recent and not recent[0]:
            recent = recent[1:]  # leading blanks never count
    if cooling:
        return (streak, cooling - 1, waiting, below, recent), False
    if waiting:
        below = 0 if above else below + 1
        if below >= policy.rearm:
            return (0, 0, False, 0, recent), False
        return (streak, 0, True, below, recent), False
    if policy.mode == "persistence":
        streak = streak + 1 if above else 0
        fires = streak >= policy.persistence
    else:
        fires = sum(recent) >= policy.confirm
    if fires:
        return (0, policy.cooldown, True, 0, ()), True
    return (streak, 0, False, 0, recent), False


@lru_cache(maxsize=32)
def transitions(policy: AlertPolicy) -> list[tuple[int, bool, int, bool]]:
    """Per state: next state and alert when below, next state and alert when above. State 0 is fresh."""
    index, table, queue = {QUIET: 0}, [], [QUIET]
    while queue:
        state, row = queue.pop(0), []
        for above in (False, True):
            after, fires = _step(policy, state, above)
            if after not in index:
                index[after] = len(index)
                queue.append(after)
            row += [index[after], fires]
        table.append(tuple(row))
    return table


def walk(table: list, state: int, flags) -> tuple[list[bool], int]:
    """Alerts along ``flags`` from ``state``, and the state afterwards."""
    fired = []
    for above in flags:
        row = table[state]
        state, fires = (row[2], row[3]) if above else (row[0], row[1])
        fired.append(fires)
    return fired, state


#: Entries of the mappings composed at once: bounds a task's memory whatever the batch.
_ENTRIES = 1 << 22


class Machine:
    """A transition table as arrays: mappings of whole stretches in place of single steps."""

    def __init__(self, table: list[tuple[int, bool, int, bool]]):
        rows = np.array([[a, b, c, d] for a, b, c, d in table], np.int64)
        self.states = n = len(rows)
        self.fires = rows[:, [1, 3]].T.astype(bool)
        self.powers = [[rows[:, 0]], [rows[:, 2]]]  # by flag: the mapping of 2**k equal flags
        # orbits: where a state is after 0, 1, ... equal flags, up to a round of the cycle that every orbit ends in
        self.orbit = np.empty((2, n, 2 * n), np.int16 if n < 1 << 15 else np.int64)
        self.period = np.ones((2, n), np.int64)
        for flag in (0, 1):
            now = np.arange(n)
            for t in range(2 * n):
                self.orbit[flag, :, t] = now
                now = self.powers[flag][0][now]
            on_cycle = self.orbit[flag, :, n - 1]  # after that many steps every orbit is on its cycle
            again, unknown, t = self.powers[flag][0][on_cycle], np.ones(n, bool), 1
            while unknown.any():
                met = unknown & (again == on_cycle)
                self.period[flag, met] = t
                unknown &= ~met
                again, t = self.powers[flag][0][again], t + 1

    def power(self, flag: int, times: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Each of ``start`` (one or more columns of states) after its number of equal flags, by repeated squaring."""
        out, bit = start, 0
        times = times.reshape(-1, *[1] * (start.ndim - 1))
        while (times >> bit).any():
            known = self.powers[flag]
            if len(known) <= bit:
                known.append(known[-1][known[-1]])
            out = np.where((times >> bit) & 1, known[bit][out], out)
            bit += 1
        return out

    def after(self, flag: np.ndarray, entry: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """State after ``offset`` equal flags from ``entry``."""
        n = self.states
        return self.orbit[flag, entry, np.where(offset < n, offset, n + (offset - n) % self.period[flag, entry])]

    def mappings(self, flag: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For every run the state it is left in, by the state it is entered in."""
        out = np.empty((len(flag), self.states), np.int64)
        for f in (0, 1):
            of = np.flatnonzero(flag == f)
            out[of] = self.power(f, length[of], np.broadcast_to(np.arange(self.states), (len(of), self.states)))
        return out

    @staticmethod
    def composed(maps: np.ndarray) -> np.ndarray:
        """Prefix compositions of mappings in order: distances double, so ``log2`` rounds do."""
        maps, step = maps.copy(), 1
        while step < len(maps):
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step], 1)
            step *= 2
        return maps

    def mapping(self, above: np.ndarray) -> np.ndarray:
        """The mapping of a whole stretch of flags."""
        whole = np.arange(self.states)
        start, length, flag = runs_of(above, np.zeros(len(above), bool))
        many = max(1, _ENTRIES // self.states)
        for i in range(0, len(start), many):
            whole = self.composed(self.mappings(flag[i:i + many], length[i:i + many]))[-1][whole]
        return whole

    def walk(self, above: np.ndarray, state: int, fresh: np.ndarray | None = None, enter: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """Alerts along flags from ``state``, and the state afterwards. At ``fresh`` rows another series begins in ``enter`` (0)."""
        fired, last = np.zeros(len(above), bool), state
        for rows, flag, entry, offset in self._runs(above, state, fresh, enter):
            fired[rows] = self.fires[flag, self.after(flag, entry, offset)]
            last = int(self.after(flag[-1:], entry[-1:], offset[-1:] + 1)[0])
        return fired, last

    def walk_each(self, above: np.ndarray, starts: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Alerts along many series that follow one another, and the state each is left in; series ``i`` enters in ``enter[i]``."""
        fired, left = np.zeros(len(above), bool), np.zeros(len(above), np.int64)
        fresh, entering = np.zeros(len(above), bool), np.zeros(len(above), np.int64)
        fresh[starts[:-1]], entering[starts[:-1]] = True, enter
        for rows, flag, entry, offset in self._runs(above, 0, fresh, entering):
            fired[rows] = self.fires[flag, self.after(flag, entry, offset)]
            left[rows] = self.after(flag, entry, offset + 1)
        return fired, left[starts[1:] - 1]

    def _runs(self, above: np.ndarray, state: int, fresh: np.ndarray | None, enter: np.ndarray | None) -> Iterator[tuple]:
        """Rows piece by piece, with each row's flag, the state its run is entered in, and its place in the run."""
        fresh = np.zeros(len(above), bool) if fresh is None else fresh
        start, length, flag = runs_of(above, fresh)
        many = max(1, _ENTRIES // self.states)
        for i in range(0, len(start), many):
            s, n, f = start[i:i + many], length[i:i + many], flag[i:i + many]
            new = fresh[s]
            first = enter[s].astype(np.int64) if enter is not None else np.zeros(len(s), np.int64)
            maps = self.mappings(f, n)
            maps[new] = np.take_along_axis(maps[new], first[new][:, None], 1)  # whatever came before is forgotten
            maps = self.composed(maps)
            entry = np.where(new, first, np.concatenate(([state], maps[:-1, state])))
            state = int(maps[-1, state])
            rows = slice(s[0], s[-1] + n[-1])
            yield rows, np.repeat(f, n), np.repeat(entry, n), np.arange(rows.start, rows.stop) - np.repeat(s, n)


def runs_of(above: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and flag of the maximal runs of equal flags; a run ends where another series begins."""
    if not len(above):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = fresh.copy()
    first[0] = True
    first[1:] |= above[1:] != above[:-1]
    start = np.flatnonzero(first)
    return start, np.diff(np.append(start, len(above))), above[start].astype(np.int64)


def apply_policy(
    df: DataFrame, series: Series, policy: AlertPolicy = AlertPolicy(), score: str = "leak_score",
    threshold: str | None = None, out: str = "model_alert",
) -> DataFrame:
    """Add the alert flag per row. ``threshold`` may name a column that overrides the policy's value.

    Rows of a partition pass by as Arrow batches; only keys and flags are looked at. NULL is a key like any other.
    """
    table = transitions(policy)
    cut = F.col(threshold) if threshold else F.lit(policy.threshold)
    df = series.slotted(df).withColumn("_above", F.coalesce(F.col(score) >= cut, F.lit(False)))
    order, parts = list(series.order), series.parts

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, last, state = Machine(table), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = np.zeros(n, bool)
            for k in parts:
                codes = batch.column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                fresh[1:] |= codes[1:] != codes[:-1]
            ends = [[batch.column(k)[i].as_py() for k in parts] for i in (0, n - 1)]
            fresh[0] = last is None or ends[0] != last
            enter = batch.column("_enter").to_numpy(zero_copy_only=False) if "_enter" in batch.schema.names else None
            fired, state = machine.walk(batch.column("_above").to_numpy(zero_copy_only=False), state, fresh, enter)
            last = ends[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fired)], names=[*batch.schema.names, out])

    def run(rows: DataFrame) -> DataFrame:
        schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BooleanType())])
        placed = rows.repartition(*parts).sortWithinPartitions(*parts, *order) if parts else rows.coalesce(1).sortWithinPartitions(*order)
        return placed.mapInArrow(fire, schema)

    if series.slot is None:
        return run(df).drop("_above")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(table)
        for batch in batches:
            flags = batch.column("_flags")
            maps = [machine.mapping(flags[i].values.to_numpy(zero_copy_only=False)).tolist() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in parts], pa.array(maps, pa.list_(pa.int32()))], names=[*parts, "_exits"])

    # a slot holds no more rows than one task may have, so its flags are an array of that many bits
    in_order = F.transform(F.sort_array(F.collect_list(F.struct(*order, "_above"))), lambda x: x["_above"])
    flags = df.groupBy(*parts).agg(in_order.alias("_flags"))
    part_fields = [df.schema[k] for k in parts]
    slots = flags.mapInArrow(summarise, T.StructType([*part_fields, T.StructField("_exits", T.ArrayType(T.IntegerType()))]))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(SLOT)
        before = Machine.composed(np.array(pdf["_exits"].tolist(), np.int64))[:-1, 0]
        pdf["_enter"] = np.concatenate(([0], before))
        return pdf[[*parts, "_enter"]]

    entered = slots.groupBy(*series.keys).applyInPandas(
        chain, T.StructType([*part_fields, T.StructField("_enter", T.IntegerType())]))
    return run(join_keys(df, entered, parts)).drop("_above", "_enter", SLOT)


def sticky_alerts(df: DataFrame, keys: Sequence[str], order: Sequence[str], ticks: int = 30) -> DataFrame:
    """Keys with an alert among their last ``ticks`` rows, and the score of the latest one."""
    from .runs import last_rows

    recent = last_rows(df, keys, order, ticks).where(F.col("model_alert"))
    return recent.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("alerts"), F.max_by("leak_score", F.struct(*order)).alias("leak_score"))
