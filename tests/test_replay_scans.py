"""Replay by scans, moves of the cursor and loading of states."""

import random

import pytest
from sheaf.operators import history as H
from sheaf.operators.history import loaded_history, move_cursors, replay, replay_by_scans, step


def simulate(events):
    stack, cursor = [], -1
    for op, state in events:
        cursor = step(stack, cursor, op, state)
    return stack, cursor


def table(spark, runs):
    rows = [(k, 3 * i, op, st) for k, events in runs.items() for i, (op, st) in enumerate(events)]
    return spark.createDataFrame(rows, "session_id string, seq long, op string, st string")


def some(n, seed, weights, states="abc"):
    rng = random.Random(seed)
    return [(rng.choices(["new", "back", "forward", "other"], weights)[0], rng.choice([*states, None])) for _ in range(n)]


CASES = {
    "even": some(60, 1, (4, 4, 1, 0)),
    "down": some(60, 2, (2, 6, 2, 1)),
    "redo": some(60, 3, (2, 3, 4, 0)),
    "same": some(60, 4, (3, 3, 2, 0), "a"),
    "empty": [("back", None), ("forward", None)],
    "late": [("back", None), ("forward", None), ("new", "a"), ("back", None), ("back", None), ("new", "a"), ("forward", None)],
    "bounce": [("new", x) for x in "abcd"] + [("back", None)] * 9 + [("forward", None)] * 9 + [("back", None), ("new", "c"), ("new", "x")],
}


@pytest.mark.parametrize("slice_rows", [7, 1000])
def test_scans_equal_the_fold(spark, slice_rows):
    got = replay_by_scans(table(spark, CASES), ["session_id"], slice_rows)
    found = {}
    for r in got.collect():
        found.setdefault(r.session_id, {})[r.pos] = (r.st, r.cursor)
    for key, events in CASES.items():
        stack, cursor = simulate(events)
        assert found.get(key, {}) == {i: (st, cursor) for i, st in enumerate(stack)}, key


def test_wrong_guesses_do_not_take_a_round_each(spark):
    """Bit by bit this run takes 17 rounds of guesses."""
    events = some(600, 2, (4, 4, 3, 0), "abcd")
    got = replay_by_scans(table(spark, {"hot": events}), ["session_id"], 100, rounds=6)
    assert got is not None
    stack, cursor = simulate(events)
    assert sorted((r.pos, r.st, r.cursor) for r in got.collect()) == [(i, st, cursor) for i, st in enumerate(stack)]


def test_unsettled_runs_use_scans(spark, monkeypatch):
    used = []
    real = H.replay_by_scans
    monkeypatch.setattr(H, "replay_by_scans", lambda *a: used.append(a) or real(*a))
    events = some(80, 9, (4, 4, 1, 0))
    got = replay(table(spark, {"hot": events, "b": events[:5]}), rows_per_slice=20).collect()
    stack, cursor = simulate(events)
    assert used
    assert sorted((r.pos, r.st) for r in got if r.session_id == "hot") == list(enumerate(stack))
    assert [r.pos for r in got if r.session_id == "hot" and r.is_cursor] == [cursor]


def test_unsettled_bits_fall_back_to_one_pass(spark, monkeypatch):
    monkeypatch.setattr(H, "replay_by_scans", lambda *a: None)
    events = some(50, 5, (4, 4, 1, 0))
    got = replay(table(spark, {"hot": events}), rows_per_slice=10).collect()
    assert sorted((r.pos, r.st) for r in got) == list(enumerate(simulate(events)[0]))


def test_moves_are_clamped_and_broken_states_go(spark):
    rows = [(s, i, f"{s}{i}", i == 1) for s in "abcdef" for i in range(3)]
    history = spark.createDataFrame(rows, "session_id string, pos long, st string, is_cursor boolean")
    moves = spark.createDataFrame([("a", -1), ("b", -7), ("c", 1), ("d", 0), ("e", -1)], "session_id string, by int")
    moved = move_cursors(history, moves)
    assert {r.session_id: r.target for r in moved.collect()} == {"a": 0, "b": 0, "c": 2, "d": 1, "e": 0}
    broken = spark.createDataFrame([("e", "e0"), ("c", "c2"), ("d", "d1"), ("a", "a2")], "session_id string, st string")
    after = {}
    for r in loaded_history(history, moved, broken).collect():
        after.setdefault(r.session_id, []).append((r.pos, r.st, r.is_cursor))
    whole = lambda s, at: [(i, f"{s}{i}", i == at) for i in range(3)]
    assert {s: sorted(x) for s, x in after.items()} == {
        "a": whole("a", 0), "b": whole("b", 0), "d": whole("d", 1), "f": whole("f", 1),
        "c": [(0, "c0", False), (1, "c1", True)], "e": [(0, "e1", False), (1, "e2", True)],
    }
