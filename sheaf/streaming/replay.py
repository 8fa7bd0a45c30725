"""History replay as a stateful stream.

State per session is one map entry per BLOCK history positions plus a cursor, so an event touches a
few entries, a micro-batch reads and writes each of them once, and a long history is never loaded whole.  Inside a micro-batch a session's events are sorted; across
them an event whose number is not above the last one applied comes too late, or comes again, and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


# Positions in one entry of the state: every read or write of an entry is a message to the state store.
BLOCK = 64


class HistoryProcessor(StatefulProcessor):
    """Applies new/back/forward/reset events to a session's stored history."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._blocks = handle.getMapState("blocks", "block bigint", "states array<string>")
        self._place = handle.getValueState("place", "cursor bigint, size bigint, last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cursor, size, last = self._place.get() if self._place.exists() else (-1, 0, None)
        events = {}
        for part in rows:
            for seq, op, state in zip(part["seq"], part["op"], part["st"]):
                if (last is None or seq > last) and seq not in events:
                    events[seq] = (op, state)
        if not events:
            return
        order = sorted(events, key=lambda seq: (seq != seq, seq))
        version = int(order[-1])
        stored, blocks, written = size, {}, {}

        def block(pos):
            number = pos // BLOCK
            if number not in blocks:
                # an entry of which no position is in use has nothing to be read
                found = list(self._blocks.getValue((number,))[0]) if number * BLOCK < stored else []
                blocks[number] = found + [None] * (BLOCK - len(found))
            return blocks[number]

        for op, state in map(events.__getitem__, order):
            if op == "new":
                if cursor >= 0 and block(cursor)[cursor % BLOCK] == state:
                    continue
                cursor += 1
                block(cursor)[cursor % BLOCK] = state
                written[cursor] = state
                size = cursor + 1
            elif op == "back" and size:
                cursor = max(cursor - 1, 0)
            elif op == "forward":
                cursor = min(cursor + 1, size - 1)
            elif op == "reset":
                cursor, size, stored = -1, 0, 0
                blocks.clear()
                written.clear()

        changed = {pos: st for pos, st in written.items() if pos < size}
        for number in sorted({pos // BLOCK for pos in changed}):
            self._blocks.updateValue((number,), (blocks[number][: size - number * BLOCK],))
        self._place.update((cursor, size, version))
        positions = sorted(changed) or [None]
        yield pd.DataFrame({
            "session_id": [key[0]] * len(positions),
            "version": [version] * len(positions),
            "pos": pd.array(positions, dtype="Int64"),
            "st": [changed.get(p) for p in positions],
            "cursor": [cursor] * len(positions),
            "size": [size] * len(positions),
        })

    def close(self) -> None:
        pass


def replay_stream(events: DataFrame) -> DataFrame:
    """Change log of the histories: session_id, version, pos, st, cursor, size.

    ``events``: streaming session_id, seq, op, st.  Each micro-batch gives the positions it
    wrote (or one row without a position) and the cursor and size after it; one with late events only gives nothing.
    """
    events.sparkSession.conf.set(_PROVIDER, ROCKSDB)
    key_type = events.schema["session_id"].dataType.simpleString()
    return (
        events.select("session_id", "seq", "op", "st")
        .groupBy("session_id")
        .transformWithStateInPandas(
            HistoryProcessor(),
            outputStructType=f"session_id {key_type}, version bigint, pos bigint, st string, cursor bigint, size bigint",
            outputMode="Update",
            timeMode="None",
        )
    )


def current_history(log: DataFrame) -> DataFrame:
    """The histories a change log amounts to: session_id, pos, st, is_cursor (as batch replay gives)."""
    place = log.groupBy("session_id").agg(F.max_by(F.struct("cursor", "size"), "version").alias("place"))
    entries = log.where(F.col("pos").isNotNull()).groupBy("session_id", "pos").agg(
        F.max_by("st", "version").alias("st")
    )
    return (
        entries.join(place, "session_id")
        .where(F.col("pos") < F.col("place.size"))
        .select("session_id", "pos", "st", (F.col("pos") == F.col("place.cursor")).alias("is_cursor"))
    )
