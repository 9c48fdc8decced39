"""The live lists of viewers as a stream.

State is one row a spot: the last change taken in and what the spot showed then. It
does not grow with the viewers, who are looked up by cell for each micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from curbspark.operators.viewers import SEEN, viewer_messages
from curbspark.sources.tables import write_batch

_VALUES = "latitude double, longitude double, status string"
#: What a change gives, and what the state of a spot holds, for the feed's type of time; `there` tells a deleted spot
#: from a shown one.
OUTPUT = "id long, ts {time}, seq long, was_there boolean, is_there boolean, " + ", ".join(
    f"{side}_{c}" for side in ("was", "is") for c in _VALUES.split(", ")
)
STATE = "ts {time}, seq long, there boolean, " + _VALUES


class SpotChanges(StatefulProcessor):
    """Changes of a spot in order, each with what it replaced.

    A change that is not later than the last one taken in is passed over: it was
    replayed, or came too late to be shown.
    """

    def __init__(self, time: str):
        self.time = time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE.format(time=self.time))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.last.get() if self.last.exists() else None
        nothing = (None,) * len(SEEN)
        ts, seq, there, *shown = state or (None, None, False, *nothing)
        out = []
        for row in pd.concat(rows).sort_values(["ts", "seq"]).itertuples(index=False):
            if ts is not None and (row.ts, row.seq) <= (pd.Timestamp(ts), seq):
                continue
            was_there, was = there, tuple(shown)
            there = row.op == "INSERT" or there and row.op != "DELETE"
            ts, seq = row.ts.to_pydatetime(), int(row.seq)
            shown = [None if pd.isna(v) else v for v in (row.latitude, row.longitude, row.status)] if there else list(nothing)
            if was_there or there:
                out.append((key[0], ts, seq, was_there, there, *was, *shown))
        if ts is not None:
            self.last.update((ts, seq, there, *shown))
        if out:
            names = [c.split()[0] for c in OUTPUT.split(", ")]
            yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def changes_of_spots(feed: DataFrame) -> DataFrame:
    """Stream of (id, ts, seq, before, after) for a feed of (id, ts, seq, op, latitude, longitude, status)."""
    time = feed.schema["ts"].dataType.simpleString()
    found = (
        feed.where("id IS NOT NULL AND ts IS NOT NULL AND seq IS NOT NULL")
        .select("id", "ts", "seq", "op", *SEEN)
        .groupBy("id")
        .transformWithStateInPandas(SpotChanges(time), OUTPUT.format(time=time), "Append", "none")
    )
    side = lambda name: F.when(F.col(f"{name}_there"), F.struct(*(F.col(f"{name}_{c}").alias(c) for c in SEEN)))
    return found.select("id", "ts", "seq", side("was").alias("before"), side("is").alias("after"))


def viewer_writer(feed: DataFrame, viewers: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Stream of messages to viewers, one folder a micro-batch; start it with the wanted trigger.

    The session must use a state store that keeps columns apart, such as RocksDB.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, out, batch_id)

    messages = viewer_messages(changes_of_spots(feed), viewers)
    return messages.writeStream.queryName("viewers").option("checkpointLocation", checkpoint).foreachBatch(sink)
