"""Ordered work and replay against plain Python, with and without slices."""

import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sheaf.operators.history import (
    drop_repeats,
    fingerprint,
    independent_runs,
    latest_selection,
    remove_broken,
    replay,
    step,
)
from sheaf.operators.ordered import Ordered
from sheaf.operators.packing import number_shards
from sheaf.streaming.replay import HistoryProcessor, current_history, replay_stream


@pytest.mark.parametrize("slice_rows", [3, 1000])
def test_ordered_operations(spark, slice_rows):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 7 % 101, rng.randint(-9, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    ordered = Ordered(df, ["k"], ["o"], slice_rows)
    assert ordered.sliced == (slice_rows == 3)
    out = (
        ordered.position("pos")
        .prefix_sums(before=F.col("v"))
        .suffix_min("low", F.col("v"))
        .neighbour("prev", ["v"], -1)
        .neighbour("next", ["v"], 1)
        .to_df()
    )
    got = {(r.k, r.o): (r.pos, r.before, r.low, r.prev and r.prev.v, r.next and r.next.v) for r in out.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        mine = sorted((o, v) for k, o, v in rows if k == key)
        vs = [v for _, v in mine]
        for i, (o, _) in enumerate(mine):
            want[(key, o)] = (
                i,
                sum(vs[:i]),
                min(vs[i + 1 :], default=None),
                vs[i - 1] if i else None,
                vs[i + 1] if i + 1 < len(vs) else None,
            )
    assert got == want


def simulate(events):
    stack, cursor = [], -1
    for op, state in events:
        cursor = step(stack, cursor, op, state)
    return stack, cursor


def replayed(df):
    rows = sorted(df.collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(len(rows)))
    return [r.st for r in rows], next((r.pos for r in rows if r.is_cursor), -1)


def history(spark, events):
    rows = [("s", i, op, state) for i, (op, state) in enumerate(events)]
    return spark.createDataFrame(rows, "session_id string, seq int, op string, st string")


N, B, W, R = "new", "back", "forward", "reset"


@pytest.mark.parametrize(
    ("events", "stack", "cursor"),
    [
        ([(N, "a"), (N, "b"), (B, None), (N, "a")], ["a", "b"], 0),
        ([(N, "a"), (N, "b"), (N, "c"), (B, None), (B, None), (N, "x")], ["a", "x"], 1),
        ([(B, None), (W, None), (N, "a"), (B, None), (W, None)], ["a"], 0),
        ([(N, "a"), (N, "b"), (R, None), (N, "c")], ["c"], 0),
        ([(N, "a"), (R, None)], [], -1),
        ([(N, None), (N, None), (N, "a")], [None, "a"], 1),
    ],
)
def test_replay_cases(spark, events, stack, cursor):
    assert simulate(events) == (stack, cursor)
    for slice_rows in (2, 1000):
        assert replayed(replay(history(spark, events), slice_rows)) == (stack, cursor)


ops = st.tuples(st.sampled_from([N, N, N, B, W, R]), st.sampled_from(["a", "b", "c", None]))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ops, min_size=4, max_size=60))
def test_split_replay_equals_simulation(spark, events):
    assert replayed(replay(history(spark, events), 3)) == simulate(events)


def test_long_growing_history_is_split(spark):
    rng = random.Random(1)
    events = [(rng.choice([N, N, N, N, B, W]), str(rng.randint(0, 50))) for _ in range(400)]
    df = history(spark, events)
    assert independent_runs(df, 50).select("run").distinct().count() > 20
    assert replayed(replay(df, 50)) == simulate(events)


def test_drop_repeats_and_broken(spark):
    df = spark.createDataFrame(
        [("s", i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])], "session_id string, seq int, st string"
    )
    for slice_rows in (2, 100):
        kept = drop_repeats(df, "st", rows_per_slice=slice_rows).orderBy("seq").collect()
        assert [r.st for r in kept] == ["a", None, "b", "a"]
    stack = spark.createDataFrame(
        [("s", i, v, i == 3) for i, v in enumerate("abcd")], "session_id string, pos bigint, st string, is_cursor boolean"
    )
    broken = spark.createDataFrame([("s", "b"), ("s", "d")], "session_id string, st string")
    assert replayed(remove_broken(stack, broken)) == (["a", "c"], 1)


def test_fingerprint_ignores_map_order(spark):
    df = spark.sql(
        "SELECT map('a', '1', 'b', '2') AS file_hashes, 'x' AS mode UNION ALL SELECT map('b', '2', 'a', '1'), 'x' "
        "UNION ALL SELECT map('b', '2', 'a', '1'), null"
    )
    prints = [r[0] for r in df.select(fingerprint("file_hashes", "mode")).collect()]
    assert prints[0] == prints[1] != prints[2]


def test_latest_selection(spark):
    df = spark.createDataFrame([("s", 1, "/a"), ("s", 3, "/c"), ("s", 2, "/b")], "session_id string, seq int, path string")
    assert latest_selection(df).first().path == "/c"


def test_shards_keep_everything(spark):
    df = spark.range(500).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) AS k", "cast(id AS string) AS v")
    shards = number_shards(df, ["k"], "v", 20)
    assert shards.count() == 500
    assert shards.where("k = 'hot'").select("shard").distinct().count() > 5


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    source, out = tmp_path / "in", tmp_path / "out"
    rows = [(f"s{i % 4}", i, rng.choice([N, N, B, W]), rng.choice("abc")) for i in range(120)]
    schema = "session_id string, seq bigint, op string, st string"
    everything = spark.createDataFrame(rows, schema)
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    for start in range(0, 120, 40):
        # events that were applied before come again, and late ones: neither counts
        late = [(s, i, "new", "late") for s, i, *_ in rows[:start:7]]
        spark.createDataFrame(rows[start : start + 40] + rows[:start:5] + late, schema).coalesce(1).write.mode("append").parquet(str(source))
        query = (
            replay_stream(stream)
            .writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"))
            .outputMode("update")
            .option("checkpointLocation", str(tmp_path / "marks"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    streamed = {tuple(r) for r in current_history(spark.read.parquet(str(out))).collect()}
    batch = {tuple(r) for r in replay(everything).select("session_id", "pos", "st", "is_cursor").collect()}
    assert streamed == batch


class _Calls:
    """State in a dictionary; counts what is sent to the store."""

    def __init__(self):
        self.kept, self.place, self.sent = {}, None, 0

    def getMapState(self, name, key, value):
        return self

    def getValueState(self, name, schema):
        state = _Calls()
        state.exists, state.get = lambda: state.place is not None, lambda: state.place
        state.update = lambda value: setattr(state, "place", value)
        return state

    def getValue(self, key):
        self.sent += 1
        return self.kept[key]

    def updateValue(self, key, value):
        self.sent += 1
        self.kept[key] = value


def test_a_batch_touches_few_entries_of_a_long_history():
    rng, store, processor = random.Random(4), _Calls(), HistoryProcessor()
    processor.init(store)
    stack, cursor, logged, seq = [], -1, {}, 0
    for weights in ((9, 1, 1), (1, 9, 3), (5, 4, 3), (9, 1, 0), (1, 9, 1), (6, 5, 4)) * 3:
        ops = rng.choices([N, B, W], weights, k=150) + (["reset"] + [N] * 5 if rng.random() < 0.2 else [])
        events = [(seq + i, op, rng.choice(["a", "b", "c", None])) for i, op in enumerate(ops)]
        seq += len(ops)
        for _, op, st in events:
            cursor = step(stack, cursor, op, st)
        store.sent = 0
        rows = rng.sample(events, len(events))
        out = next(processor.handleInputRows(("s",), iter([pd.DataFrame(rows, columns=["seq", "op", "st"])]), None))
        logged.update(zip(out["pos"], out["st"]))
        assert [logged[i] for i in range(len(stack))] == stack
        assert (out["cursor"].iloc[0], out["size"].iloc[0], out["version"].iloc[0]) == (cursor, len(stack), seq - 1)
        assert store.sent <= 12
