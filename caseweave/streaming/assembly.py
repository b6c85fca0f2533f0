"""Collecting the events of running cases until their trace is complete.

State is keyed by (case, shard): the events of one case are spread over ``shards`` keys, so
a giant case is not one task's burden, and the end event is sent to all of them. A trace is
released when the watermark has passed its end event -- events that arrive late but within
the delay are still part of it -- or, with ``wait="arrival"``, with the batch that brings the
end event. All shards of a case are released in the same micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WATERMARK_DELAY = "20 minutes"
#: A case without an end event is released after so much silence (event time), and its state with it.
RELEASE_OPEN_MS = 24 * 3600 * 1000

# Keyed state of this kind lives in RocksDB: on disk, so a key may outgrow memory.
_PROVIDER = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)

_STATE = "activity string, ts_us long, seq long, attrs string, is_end boolean"
_OUT = "case_id string, shard int, activity string, ts_us long, seq long, attrs string, is_end boolean, late boolean"
_FIELDS = ["activity", "ts_us", "seq", "attrs", "is_end"]
_CHUNK = 10_000


class TraceAssembler(StatefulProcessor):
    """Buffers events per (case, shard); see the module text."""

    def __init__(self, wait: str, keep_closed_ms: int, release_open_ms: int | None):
        self.wait, self.keep_closed_ms, self.release_open_ms = wait, keep_closed_ms, release_open_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", _STATE)
        # phase: 0 open, 1 end seen, 2 released; at: time of the timer that matters
        self.status = handle.getValueState("status", "phase int, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Each state call is a round trip to the JVM, so there are as few as possible per key.
        status = self.status.get()
        phase, at = status or (0, 0)
        waiting, last = [], 0
        for batch in rows:
            marked = batch["marker"].to_numpy()
            events = batch[~marked]
            if len(events):
                if phase == 2:
                    yield self._out(key, events, late=True)
                    continue
                waiting.append(events)
                last = max(last, int(events["ts_us"].max()) // 1000)
            if phase < 2 and marked.any():
                phase, at = 1, max(at, int(batch.loc[marked, "ts_us"].max()) // 1000)
            if phase < 2 and sum(map(len, waiting)) >= _CHUNK:
                self._keep(waiting)
                status, waiting = status or (0, 0), []
        if phase == 2:
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        if phase == 1 and self.wait == "arrival":
            if status is not None:
                yield from self._release(key)
            for events in waiting:
                yield self._out(key, events, late=False)
            phase, at = 2, at + self.keep_closed_ms
        elif waiting:
            self._keep(waiting)
        if phase == 0 and self.release_open_ms is not None:
            at = max(at, last + self.release_open_ms)
        if phase or self.release_open_ms is not None:
            self.handle.registerTimer(max(at, watermark + 1))
        if (phase, at) != status:
            self.status.update((phase, at))

    def _keep(self, waiting: list[pd.DataFrame]) -> None:
        rows = [row for events in waiting for row in events[_FIELDS].itertuples(index=False, name=None)]
        self.events.appendList(rows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        phase, at = self.status.get() or (2, 0)
        if at > timerValues.getCurrentWatermarkInMs():
            return  # superseded by a later timer
        if phase == 2:
            self.status.clear()
            return
        yield from self._release(key)
        at = timerValues.getCurrentWatermarkInMs() + self.keep_closed_ms
        self.status.update((2, at))
        self.handle.registerTimer(at)

    def _release(self, key) -> Iterator[pd.DataFrame]:
        chunk = []
        for row in self.events.get():
            chunk.append(tuple(row))
            if len(chunk) == _CHUNK:
                yield self._out(key, pd.DataFrame(chunk, columns=_FIELDS), late=False)
                chunk = []
        if chunk:
            yield self._out(key, pd.DataFrame(chunk, columns=_FIELDS), late=False)
        self.events.clear()

    @staticmethod
    def _out(key, events: pd.DataFrame, late: bool) -> pd.DataFrame:
        out = events[_FIELDS].copy()
        out.insert(0, "case_id", key[0])
        out.insert(1, "shard", int(key[1]))
        out["late"] = late
        return out


def assembled_traces(
    log: DataFrame,
    *,
    shards: int = 4,
    wait: str = "watermark",
    delay: str = WATERMARK_DELAY,
    keep_closed_ms: int = 24 * 3600 * 1000,
    release_open_ms: int | None = RELEASE_OPEN_MS,
) -> DataFrame:
    """Streaming log in, events of finished traces out, with a ``late`` column.

    Rows with ``late`` came after their trace was released; they are to be counted, not used.
    ``shards`` trades overhead per case against the largest case one task can take.
    A released case is remembered for ``keep_closed_ms`` of event time. ``release_open_ms``
    releases cases without an end event after that much silence (one day; None keeps them for
    good). So every case's timer ends in the removal of its state: once the watermark has passed
    the last event by both spans, no state is left.
    """
    log.sparkSession.conf.set(*_PROVIDER)
    packed = log.withWatermark("ts", delay).select(
        "case_id",
        "activity",
        "ts",
        F.unix_micros("ts").alias("ts_us"),
        "seq",
        F.to_json("attrs").alias("attrs"),
        F.coalesce("is_end", F.lit(False)).alias("is_end"),
        F.pmod(F.xxhash64("case_id", "seq", "ts"), F.lit(shards)).cast("int").alias("_own"),
    )
    copies = F.array(F.struct(F.col("_own").alias("shard"), F.lit(False).alias("marker")))
    markers = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(s.alias("shard"), F.lit(True).alias("marker"))
    )
    routed = packed.select(
        "case_id", "activity", "ts", "ts_us", "seq", "attrs", "is_end",
        F.inline(F.when(F.col("is_end"), F.concat(copies, markers)).otherwise(copies)),
    )
    released = routed.groupBy("case_id", "shard").transformWithStateInPandas(
        statefulProcessor=TraceAssembler(wait, keep_closed_ms, release_open_ms),
        outputStructType=_OUT,
        outputMode="Append",
        timeMode="EventTime",
    )
    return released.select(
        "case_id",
        "activity",
        F.timestamp_micros("ts_us").alias("ts"),
        "seq",
        F.from_json("attrs", "map<string,string>").alias("attrs"),
        "is_end",
        "late",
    )
