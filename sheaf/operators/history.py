"""Session history: fingerprints, duplicates, positions, replay of undo and redo."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.constants import ROWS_PER_SLICE
from sheaf.operators.ordered import Ordered, key_sizes
from sheaf.operators.sizes import small_side
from sheaf.session import freeze, remove_folder, scratch_path

SIX_KEYS = ("files", "selected_items", "selection_mode", "selected_file", "file_hashes", "tree")


def fingerprint(*columns: str) -> Column:
    """SHA-256 over the compared fields of a state; maps enter as sorted entries."""
    names = columns or SIX_KEYS
    fields = [
        F.array_sort(F.map_entries(n)).alias(n) if n == "file_hashes" else F.col(n).alias(n) for n in names
    ]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def file_list_digest(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys…, digest: one value for a set of rows, independent of their order and number.

    The 256-bit hashes of the rows are added limb by limb, so a key with any number of rows
    is reduced by partial aggregation.  Put a position among ``columns`` where order counts.
    """
    row_hash = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    limbs = [F.conv(F.substring(row_hash, 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)") for i in range(5)]
    return rows.groupBy(*keys).agg(
        F.sha2(F.concat_ws(":", F.count(F.lit(1)), *[F.sum(limb) for limb in limbs]), 256).alias("digest")
    )


def drop_repeats(
    states: DataFrame, value: str, key: str = "session_id", order: str = "seq", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Drop states equal to the one before them (histories without undo)."""
    ordered = Ordered(states, [key], [order], rows_per_slice).neighbour("__prev", [value], -1).to_df()
    same = F.col("__prev").isNotNull() & F.col(f"__prev.{value}").eqNullSafe(F.col(value))
    return ordered.where(~same).drop("__prev")


def positions(
    states: DataFrame, key: str = "session_id", order: str = "seq", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Add pos (1-based), total, label, can_go_back and can_go_forward."""
    totals = states.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    placed = Ordered(states, [key], [order], rows_per_slice).position("pos").to_df()
    pos = (F.col("pos") + 1).cast("bigint")
    return (
        placed.withColumn("pos", pos)
        .join(totals, key)
        .withColumns({
            "label": position_label("pos", "total"),
            "can_go_back": F.col("pos") > 1,
            "can_go_forward": F.col("pos") < F.col("total"),
        })
    )


def position_label(pos, total) -> Column:
    return F.concat(F.lit("History: "), F.col(pos).cast("string"), F.lit(" of "), F.col(total).cast("string"))


def neighbours(
    states: DataFrame,
    columns: list[str],
    key: str = "session_id",
    order: str = "seq",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add ``previous`` and ``next`` structs; the ends have none."""
    ordered = Ordered(states, [key], [order], rows_per_slice)
    return ordered.neighbour("previous", columns, -1).neighbour("next", columns, 1).to_df()


# ---- replay ----


def step(stack: list, cursor: int, op: str, state) -> int:
    """One history operation on ``stack`` (changed in place); returns the new cursor."""
    if op == "new":
        if cursor >= 0 and stack[cursor] == state:
            return cursor
        del stack[cursor + 1 :]
        stack.append(state)
        return cursor + 1
    if op == "back":
        return max(cursor - 1, 0) if stack else -1
    if op == "forward":
        return min(cursor + 1, len(stack) - 1)
    if op == "reset":
        stack.clear()
        return -1
    return cursor


_BATCH = 10_000


def _fold_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replay rows sorted by (session, run, seq); holds one stack, whatever the run's length."""
    names = ["session_id", "run", "pos", "st", "cursor"]
    current, stack, cursor, key_type = None, [], -1, None
    out = [[] for _ in names]

    def flush():
        types = [key_type, pa.int64(), pa.int64(), pa.string(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
        for column in out:
            column.clear()
        return batch

    def drain():
        for start in range(0, len(stack), _BATCH):
            part = stack[start : start + _BATCH]
            n = len(part)
            for column, values in zip(out, ([current[0]] * n, [current[1]] * n, range(start, start + n), part, [cursor] * n)):
                column.extend(values)
            if len(out[0]) >= _BATCH:
                yield flush()

    for batch in batches:
        key_type = batch.schema.field("session_id").type
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for session, run, op, state in zip(*columns):
            if (session, run) != current:
                if current is not None:
                    yield from drain()
                current, stack, cursor = (session, run), [], -1
            cursor = step(stack, cursor, op, state)
    if current is not None:
        yield from drain()
    if out[0]:
        yield flush()


def independent_runs(events: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add ``run``: stretches of a session's events that can be replayed apart from each other.

    A run starts at a "new" that surely pushes (it follows a different "new") and below which
    the cursor never falls later.  That is decided from a lower bound of the cursor: a sure
    push counts +1, "back" −1, anything else 0.  Every later event then sees only states of
    its own run, so the final history is the runs' histories end to end.
    """
    ordered = Ordered(events, ["session_id"], ["seq"], rows_per_slice).neighbour("__prev", ["op", "st"], -1)
    is_new = F.col("op") == "new"
    first = F.col("__prev").isNull()
    differs = (F.col("__prev.op") == "new") & ~F.col("__prev.st").eqNullSafe(F.col("st"))
    sure = is_new & (first | F.coalesce(differs, F.lit(False)))
    delta = F.when(sure, 1).when(F.col("op") == "back", -1).otherwise(0)
    walked = ordered.with_columns(__sure=sure, __delta=delta).prefix_sums(__walk=F.col("__delta"))
    walked = walked.with_columns(__walk=F.col("__walk") + F.col("__delta")).suffix_min("__low", F.col("__walk"))
    starts = F.col("__sure") & F.coalesce(F.col("__low") >= F.col("__walk"), F.lit(True))
    marked = walked.with_columns(__start=starts.cast("int")).prefix_sums(run=F.col("__start"))
    run = (F.col("run") + F.col("__start")).cast("bigint")
    return marked.with_columns(run=run).to_df().select("session_id", "seq", "op", "st", "run")


# Rounds of replaying slices before a run that still changes is replayed in one pass.
ROUNDS = 24


def replay_by_scans(events: DataFrame, keys: list[str], rows_per_slice: int = ROWS_PER_SLICE, rounds: int = ROUNDS) -> DataFrame | None:
    """Final history of each run, replayed by all its slices at once: keys…, pos, st, cursor.

    ``events``: keys…, seq, op ('new', 'back', 'forward'), st.  A run is cut into slices of rows, and each slice is replayed on what it is given:
    the cursor, the top and the states that it can reach, which are no more than it has rows.  First nothing is given: unknown states count as
    different, the top as reached.  A slice answers with its walk of ±1 steps (sum and lowest point, so the cursors of all slices follow from
    prefix sums and prefix minima, reflected at 0) and with the last push to each position, so the state that a later slice finds at a
    position is that of the latest push to it, an as-of lookup by (keys, position).  Slices that are now given something else are replayed anew.  What the slices
    before the first wrong one give is right, so once nothing changes the histories are right.  Most slices settle at once; a table that has not settled after
    ``rounds`` rounds gives None.  No task holds more than a slice and the states it can reach.
    """
    spark = events.sparkSession
    first = events.where("op = 'new'").groupBy(*keys).agg(F.min("seq").alias("__first"))
    # nothing happens to an empty history
    live = events.where(F.col("op").isin("new", "back", "forward")).join(first, keys).where(F.col("seq") >= F.col("__first"))
    n = 2 * max(1, -(-events.count() // rows_per_slice))
    sliced = live.select(*keys, "seq", "op", "st").repartitionByRange(n, *keys, "seq").withColumn("slice", F.spark_partition_id())
    sliced = freeze(sliced)
    names = [*keys, "slice"]
    replayed, given, used = _replay_slices(sliced, None, keys), None, []
    for _ in range(rounds):
        replayed = _kept(replayed, used)
        now = _kept(_given(replayed, keys), used)
        if given is None:
            changed = now.select(*names).distinct()
        else:
            both = given.unionByName(now).groupBy(*given.columns).agg(F.count(F.lit(1)).alias("__n"))
            changed = both.where("__n != 2").select(*names).distinct()
        changed = _kept(changed, used)
        if changed.isEmpty():
            final = freeze(_final(replayed, keys))
            for folder in used:
                remove_folder(spark, folder)
            return final
        changed = small_side(changed)
        again = _replay_slices(sliced.join(changed, names, "left_semi"), now.join(changed, names, "left_semi"), keys)
        replayed, given = replayed.join(changed, names, "left_anti").unionByName(again), now
    for folder in used:
        remove_folder(spark, folder)
    return None


def _kept(rows: DataFrame, used: list[str]) -> DataFrame:
    """The same rows, computed once, in a folder that is added to ``used``."""
    folder = scratch_path(rows.sparkSession, "replay")
    used.append(folder)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


# What a slice is given, and its events, in the order in which they are read.
_CURSOR, _TOP, _STATE, _EVENT = range(4)


def _replay_slices(sliced: DataFrame, given: DataFrame | None, keys: list[str]) -> DataFrame:
    """Replay each slice on what it is given (keys…, slice, kind, at, st; if None nothing is known).

    Per position the last push: keys…, slice, i (its event's number), st, walk (the steps up to it) and low (their lowest sum).  Per slice a row without i: the
    steps and their lowest sum, push and push_low (the same up to the last push), and backs and forwards (how many it has).
    """
    names = [*keys, "slice"]
    rows = sliced.select(*names, F.lit(_EVENT).alias("kind"), F.col("seq").alias("at"), "op", "st")
    if given is not None:
        rows = given.select(*names, "kind", "at", F.lit(None).cast("string").alias("op"), "st").unionByName(rows)
    placed = rows.repartition(*names).sortWithinPartitions(*names, "kind", "at").select(*names, "kind", "at", "op", "st")
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in sliced.select(*names).schema]
    return placed.mapInArrow(
        _fold_slices, ", ".join([*types, "i bigint, st string, walk bigint, low bigint, push bigint, push_low bigint, backs bigint, forwards bigint"]))


def _fold_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The work of ``_replay_slices``; holds the states that one slice wrote or was given."""
    current, fields, out = None, None, []

    def begin():
        nonlocal cursor, top, floor, stack, walk, low, pushed, i, backs, forwards
        cursor, top, floor, stack = 0, 0, None, {}
        walk, low, pushed, i, backs, forwards = 0, None, (None, None), 0, 0, 0

    cursor = top = floor = stack = walk = low = pushed = i = backs = forwards = None

    def flush():
        arrays = [pa.array(column, f.type) for column, f in zip(zip(*out), fields)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    def drain():
        for state, *push in stack.values():
            if push:
                out.append((*current, push[0], state, push[1], push[2], None, None, None, None))
                if len(out) >= _BATCH:
                    yield flush()
        out.append((*current, None, None, walk, low or 0, *pushed, backs, forwards))

    for batch in batches:
        if fields is None:
            wide = batch.schema.names.index("kind")
            more = [("i", pa.int64()), ("st", pa.string()), *((n, pa.int64()) for n in ("walk", "low", "push", "push_low", "backs", "forwards"))]
            fields = [*(batch.schema.field(j) for j in range(wide)), *(pa.field(*f) for f in more)]
        columns = [batch.column(j).to_pylist() for j in range(batch.num_columns)]
        for place, kind, at, op, state in zip(zip(*columns[:wide]), *columns[wide:]):
            if place != current:
                if current is not None:
                    yield from drain()
                current = place
                begin()
            if kind == _EVENT:
                i += 1
                if op == "new":
                    if cursor in stack and stack[cursor][0] == state:
                        continue
                    cursor += 1
                    walk += 1
                    low = walk if low is None else min(low, walk)
                    top, pushed = cursor, (walk, low)
                    stack[cursor] = (state, i, walk, low)
                elif op == "back":
                    backs += 1
                    walk -= 1
                    low = walk if low is None else min(low, walk)
                    if cursor != floor:
                        cursor -= 1
                else:
                    forwards += 1
                    if cursor < top:
                        cursor += 1
                        walk += 1
                        low = walk if low is None else min(low, walk)
            elif kind == _CURSOR:
                cursor, floor = at, 0
            elif kind == _TOP:
                top = at
            else:
                stack[at] = (state,)
    if current is not None:
        yield from drain()
    if out:
        yield flush()


def _raised(start: str, walk: str, low: str) -> Column:
    """Where a walk that begins at ``start`` comes to: it is reflected at 0."""
    return (F.col(start) + F.col(walk) + F.greatest(F.lit(0), -(F.col(start) + F.col(low)))).cast("bigint")


def _starts(replayed: DataFrame, keys: list[str]) -> DataFrame:
    """Per slice: keys…, slice, backs, forwards, start and top (before it), end and end_top (after it)."""
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    walked = replayed.where(F.col("i").isNull()).withColumn("__sum", F.coalesce(F.sum("walk").over(before), F.lit(0)))
    walked = walked.withColumn("__low", F.min(F.col("__sum") + F.col("low")).over(before))
    # a history begins empty, with the cursor at -1; its first event pushes, and from then on 0 is the floor
    start = F.col("__sum") - 1 + F.greatest(F.lit(0), 1 - F.coalesce("__low", F.lit(1)))
    walked = walked.withColumn("start", start.cast("bigint")).withColumn("__top", _raised("start", "push", "push_low"))
    walked = walked.withColumn("top", F.coalesce(F.last("__top", ignorenulls=True).over(before), F.lit(-1).cast("bigint")))
    return walked.select(
        *keys, "slice", "backs", "forwards", "start", "top", _raised("start", "walk", "low").alias("end"), F.coalesce("__top", "top").alias("end_top"))


def _entries(replayed: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """The last pushes of each slice to a position: keys…, slice, i, pos, st."""
    entries = replayed.where(F.col("i").isNotNull()).join(starts.select(*keys, "slice", "start"), [*keys, "slice"])
    return entries.select(*keys, "slice", "i", _raised("start", "walk", "low").alias("pos"), "st")


def _given(replayed: DataFrame, keys: list[str]) -> DataFrame:
    """What each slice finds, as the slices before it were replayed: keys…, slice, kind, at, st."""
    starts = _starts(replayed, keys)
    none = F.lit(None).cast("string")
    places = starts.select(*keys, "slice", F.explode(F.array(
        F.struct(F.lit(_CURSOR).alias("kind"), F.col("start").alias("at")), F.struct(F.lit(_TOP).alias("kind"), F.col("top").alias("at")))).alias("p"))
    # the positions that a slice can come to
    lowest = F.greatest(F.lit(0).cast("bigint"), F.col("start") - F.col("backs"))
    highest = F.least(F.col("top"), F.col("start") + F.col("forwards"))
    asked = starts.where(lowest <= highest).select(
        *keys, "slice", F.lit(-1).cast("bigint").alias("i"), F.explode(F.sequence(lowest, highest)).alias("pos"), none.alias("st"))
    before = Window.partitionBy(*keys, "pos").orderBy("slice", "i").rowsBetween(Window.unboundedPreceding, -1)
    push = F.when(F.col("i") > 0, F.struct("st"))
    found = _entries(replayed, starts, keys).unionByName(asked).withColumn("__push", F.last(push, ignorenulls=True).over(before))
    found = found.where((F.col("i") < 0) & F.col("__push").isNotNull())
    return places.select(*keys, "slice", "p.kind", "p.at", none.alias("st")).unionByName(
        found.select(*keys, "slice", F.lit(_STATE).alias("kind"), F.col("pos").alias("at"), F.col("__push.st").alias("st")))


def _final(replayed: DataFrame, keys: list[str]) -> DataFrame:
    starts = _starts(replayed, keys)
    states = _entries(replayed, starts, keys).groupBy(*keys, "pos").agg(F.max_by("st", F.struct("slice", "i")).alias("st"))
    ends = starts.groupBy(*keys).agg(F.max_by("end", "slice").alias("cursor"), F.max_by("end_top", "slice").alias("__end"))
    return states.join(ends, keys).where(F.col("pos") <= F.col("__end")).select(*keys, "pos", "st", "cursor")


def replay(events: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Final history of each session: session_id, pos (0-based), st, is_cursor.

    ``events``: session_id, seq, op ('new', 'back', 'forward', 'reset'), st.  Events before a
    session's last reset are dropped first.  Sessions are sorted and folded in one pass with
    one stack in memory.  If a session is bigger than ``rows_per_slice``, its history is first
    cut into independent runs, which are replayed in parallel and put end to end; a run that is still
    bigger (as many undos as pushes) is replayed by scans.
    """
    last_reset = events.groupBy("session_id").agg(
        F.max(F.when(F.col("op") == "reset", F.col("seq"))).alias("__reset")
    )
    live = (
        events.select("session_id", "seq", "op", "st")
        .join(last_reset, "session_id")
        .where(F.col("__reset").isNull() | (F.col("seq") > F.col("__reset")))
        .drop("__reset")
    )
    biggest, _ = key_sizes(events, ["session_id"])
    if biggest <= rows_per_slice:
        folded = _fold(live.withColumn("run", F.lit(0).cast("bigint")))
        return folded.select("session_id", "pos", "st", (F.col("pos") == F.col("cursor")).alias("is_cursor"))

    folded = freeze(_fold_all(freeze(independent_runs(live, rows_per_slice)), rows_per_slice))
    # the state at a run's cursor is its last one unless the run is the session's last
    runs = folded.groupBy("session_id", "run").agg((F.max("cursor") + 1).alias("kept"))
    offsets = Ordered(runs, ["session_id"], ["run"], rows_per_slice).prefix_sums(base=F.col("kept")).to_df()
    last = runs.groupBy("session_id").agg(F.max("run").alias("last_run"))
    joined = folded.join(offsets.drop("kept"), ["session_id", "run"]).join(last, "session_id")
    is_last = F.col("run") == F.col("last_run")
    return joined.where(is_last | (F.col("pos") <= F.col("cursor"))).select(
        "session_id",
        (F.col("base") + F.col("pos")).cast("bigint").alias("pos"),
        "st",
        (is_last & (F.col("pos") == F.col("cursor"))).alias("is_cursor"),
    )


def _fold_all(runs: DataFrame, rows_per_slice: int) -> DataFrame:
    """Small runs in one pass each, big ones by scans."""
    keys = ["session_id", "run"]
    big = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_per_slice).select(*keys)
    big = freeze(big)
    if big.isEmpty():
        return _fold(runs)
    scanned = replay_by_scans(runs.join(small_side(big), keys, "left_semi"), keys, rows_per_slice)
    if scanned is None:
        return _fold(runs)
    return _fold(runs.join(small_side(big), keys, "left_anti")).unionByName(scanned)


def _fold(events: DataFrame) -> DataFrame:
    key_type = events.schema["session_id"].dataType.simpleString()
    placed = events.repartition("session_id", "run").sortWithinPartitions("session_id", "run", "seq")
    return placed.select("session_id", "run", "op", "st").mapInArrow(
        _fold_runs, f"session_id {key_type}, run bigint, pos bigint, st string, cursor bigint"
    )


def remove_broken(history: DataFrame, broken: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Remove states that cannot be loaded and close the gaps; the cursor index is clamped.

    ``history``: session_id, pos, st, is_cursor; ``broken``: session_id, st.
    """
    cursors = history.groupBy("session_id").agg(F.max(F.when(F.col("is_cursor"), F.col("pos"))).alias("__cursor"))
    kept = history.join(broken.select("session_id", "st").distinct(), ["session_id", "st"], "left_anti")
    counts = kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("__n"))
    placed = Ordered(kept, ["session_id"], ["pos"], rows_per_slice).position("__pos").to_df()
    return (
        placed.join(counts.join(cursors, "session_id"), "session_id")
        .withColumn("is_cursor", F.col("__pos") == F.least(F.col("__cursor"), F.col("__n") - 1))
        .select("session_id", F.col("__pos").cast("bigint").alias("pos"), "st", "is_cursor")
    )


def move_cursors(history: DataFrame, moves: DataFrame) -> DataFrame:
    """Where each session's cursor goes: session_id, cursor, target, count.

    ``history``: session_id, pos, st, is_cursor; ``moves``: session_id, by (positions; negative is back).  The target is clamped to the history.
    """
    places = history.groupBy("session_id").agg(F.max(F.when(F.col("is_cursor"), F.col("pos"))).alias("cursor"), F.count(F.lit(1)).alias("count"))
    target = F.least(F.greatest(F.col("cursor") + F.col("by"), F.lit(0)), F.col("count") - 1).cast("bigint")
    return places.join(moves.select("session_id", "by"), "session_id").select("session_id", "cursor", target.alias("target"), "count")


def loaded_history(history: DataFrame, moved: DataFrame, broken: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The histories after the moves: session_id, pos, st, is_cursor.

    ``moved``: as ``move_cursors`` gives; ``broken``: session_id, st of states that cannot be loaded.  A cursor that reaches a state stands there.  A state that
    proves broken when it is reached leaves the history, and the cursor stays where it was, or at the new end.
    """
    placed = history.join(moved, "session_id", "left").join(
        small_side(broken.select("session_id", "st", F.lit(True).alias("__broken")).distinct()), ["session_id", "st"], "left")
    reached = F.coalesce((F.col("pos") == F.col("target")) & (F.col("target") != F.col("cursor")), F.lit(False))
    marked = placed.withColumn("__gone", reached & F.coalesce("__broken", F.lit(False)))
    gone = marked.where("__gone").select("session_id", F.col("pos").alias("__gap"))
    kept = marked.where(~F.col("__gone")).join(small_side(gone), "session_id", "left")
    pos = F.col("pos") - F.when(F.col("pos") > F.col("__gap"), 1).otherwise(0)
    cursor = F.when(F.col("__gap").isNotNull(), F.least(F.col("cursor"), F.col("count") - 2)).otherwise(F.col("target"))
    now = F.when(F.col("cursor").isNull(), F.col("is_cursor")).otherwise(pos == cursor)
    return kept.select("session_id", pos.cast("bigint").alias("pos"), "st", now.alias("is_cursor"))


def open_events(opened: DataFrame) -> DataFrame:
    """A file-open event replaces the selection: it is a "new" whose state is the one path."""
    return opened.select("session_id", "seq", F.lit("new").alias("op"), F.col("path").alias("st"))


def latest_selection(opened: DataFrame) -> DataFrame:
    """The selection after all file-open events of a session: the last path."""
    return opened.groupBy("session_id").agg(F.max_by("path", "seq").alias("path"))
