import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.operators import alerts
from telemill.operators.alerts import AlertPolicy, Machine, apply_policy, transitions, walk
from telemill.operators.series import Series

H, L = 0.9, 0.1


def fired(scores, **kw):
    policy = AlertPolicy(**kw)
    found, _ = walk(transitions(policy), 0, [s >= policy.threshold for s in scores])
    return [i for i, a in enumerate(found) if a]


@pytest.mark.parametrize("scores, want", [
    ([H] * 3, [2]),
    ([H, H, L] * 10, []),
    ([H] * 40, [2]),
    ([H] * 3 + [L] * 20 + [H] * 3, [2, 25]),
    ([H] * 3 + [L] * 15 + [H] + [L] * 10 + [H] * 3, [2, 31]),
])
def test_persistence(scores, want):
    assert fired(scores) == want


def test_confirmation_three_of_five():
    assert fired([H, L, H, L, H], mode="confirmation") == [4]
    assert fired([H, L, L, H, L, L, H], mode="confirmation") == []


def flags_of(rng, n):
    """Stretches of equal flags, from single rows to very long ones."""
    out = []
    while len(out) < n:
        out += [bool(rng.integers(2))] * int(rng.choice([1, 1, 2, 3, 5, 12, 40, 3000]))
    return np.array(out[:n])


POLICIES = [AlertPolicy(), AlertPolicy(mode="confirmation"), AlertPolicy(persistence=1, cooldown=0, rearm=1),
            AlertPolicy(mode="confirmation", confirm=2, confirm_window=7, cooldown=3, rearm=4)]


@pytest.mark.parametrize("policy", POLICIES)
def test_composed_mappings_agree_with_walking_row_by_row(policy, monkeypatch):
    table, rng = transitions(policy), np.random.default_rng(1)
    machine = Machine(table)
    for n in (0, 1, 2, 50, 5000):
        flags = flags_of(rng, n)
        assert machine.mapping(flags).tolist() == [walk(table, s, flags)[1] for s in range(len(table))]
        for state in (0, len(table) - 1):
            fired, end = machine.walk(flags, state)
            assert (fired.tolist(), end) == walk(table, state, flags)
    monkeypatch.setattr(alerts, "_ENTRIES", 7 * len(table))  # runs are composed in several pieces
    fired, end = machine.walk(flags, 0)
    assert (fired.tolist(), end) == walk(table, 0, flags)
    assert machine.mapping(flags)[0] == end


def test_several_series_in_one_batch_start_afresh():
    policy = AlertPolicy(cooldown=3, rearm=2)
    table, rng = transitions(policy), np.random.default_rng(2)
    machine, flags = Machine(table), flags_of(rng, 400)
    fresh = rng.random(400) < 0.1
    fresh[0] = False
    enter = rng.integers(0, len(table), 400)
    want, state = [], 3
    for above, new, first in zip(flags, fresh, enter):
        got, state = walk(table, int(first) if new else state, [above])
        want += got
    fired, end = machine.walk(flags, 3, fresh, enter)
    assert (fired.tolist(), end) == (want, state) and sum(want) > 5


def test_python_takes_no_step_per_row(monkeypatch):
    """A million rows cost a handful of array operations."""
    machine, calls = Machine(transitions(AlertPolicy())), []
    real = np.take_along_axis
    monkeypatch.setattr(alerts.np, "take_along_axis", lambda *a: calls.append(1) or real(*a))
    flags = np.arange(1_000_000) % 1000 < 30
    fired, _ = machine.walk(flags, 0)
    assert fired.sum() == 1000 and len(calls) < 20


def test_null_keys_and_other_columns_pass_by(spark):
    scores = [0.9, 0.9, 0.9, 0.1, 0.9]
    data = [(k, i, x, [i], None if i % 2 else "é") for k in (None, 1, 2) for i, x in enumerate(scores)]
    df = spark.createDataFrame(data, "k int, seq long, leak_score double, extra array<int>, word string")
    plain = Series(("k",), ("seq",))
    for series in (plain, Series(("k",), ("seq",), slot=F.floor(F.col("seq") / 2))):
        got = apply_policy(df, series)
        assert got.columns == [*df.columns, "model_alert"]
        assert sorted(((r["k"] or 0), r["seq"], r["extra"], r["word"], r["model_alert"]) for r in got.collect()) == sorted(
            ((k or 0), i, e, w, i == 2) for k, i, _, e, w in data)
    assert apply_policy(df.where("false"), plain).count() == 0


def test_table_stays_small():
    assert len(transitions(AlertPolicy())) < 50
    assert len(transitions(AlertPolicy(mode="confirmation"))) < 1000
