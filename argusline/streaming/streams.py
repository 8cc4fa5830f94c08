"""Streams of messages: routing, the in-flight gate, heartbeats, matching and feedback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from argusline.functions.text import route_message
from argusline.operators.knn import knn_vote
from argusline.sources.files import GrowingMemory, append_once

MESSAGES = "msg_id long, ts timestamp, key long, header string"


def message_stream(spark: SparkSession, path: str, schema: str = MESSAGES) -> DataFrame:
    """Messages that arrive as Parquet files below ``path``."""
    return spark.readStream.schema(schema).parquet(path)


def route_stream(messages: DataFrame) -> DataFrame:
    """``messages`` with kind, command and size; bad headers are error rows."""
    return messages.withColumn("_m", route_message(F.col("header"))).select(*messages.columns, "_m.kind", "_m.command", "_m.size")


#: What the gate says: a frame ``passed``; its lock ``expired`` without a decision.
GATED = "key long, msg_id long, ts timestamp, event string"


class _Gate(StatefulProcessor):
    """Keeps, for a key, which frame is in flight and until when."""

    def __init__(self, timeout_s: float | None, clock: str):
        self.timeout_ms, self.clock = None if timeout_s is None else round(timeout_s * 1000), clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.busy = handle.getValueState("busy", "msg_id long, since timestamp, until long")

    def _rows(self, key, said: list) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], *r) for r in said], columns=["key", "msg_id", "ts", "event"])
        return out.astype({"key": "int64", "msg_id": "int64", "ts": "datetime64[us]"})

    def _lock(self, before, held) -> None:
        """The state and its timer as they are to be after these rows."""
        if before == held:
            return
        if before is not None and before[2] is not None:
            self.handle.deleteTimer(before[2])
        if held is None:
            self.busy.clear()
            return
        self.busy.update(held)
        if held[2] is not None:
            self.handle.registerTimer(held[2])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "msg_id"])
        before = tuple(self.busy.get()) if self.busy.exists() else None
        held, said = before, []
        now = timerValues.getCurrentProcessingTimeInMs()
        for r in batch.itertuples(index=False):
            at = now if self.clock == "processingTime" else r.ts.value // 1_000_000
            # A message that comes after the end of the lock finds the gate open.
            if held is not None and held[2] is not None and at >= held[2]:
                said.append((held[0], held[1], "expired"))
                held = None
            if r.kind == "command":
                held = None
            elif r.kind == "frame" and held is None:
                held = (int(r.msg_id), r.ts.to_pydatetime(), None if self.timeout_ms is None else int(at + self.timeout_ms))
                said.append((r.msg_id, r.ts, "passed"))
        self._lock(before, held)
        yield self._rows(key, said)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = tuple(self.busy.get()) if self.busy.exists() else None
        said = []
        if held is not None and held[2] == expiredTimerInfo.getExpiryTimeInMs():
            said.append((held[0], held[1], "expired"))
            self.busy.clear()
        yield self._rows(key, said)

    def close(self) -> None:
        pass


def gate_events(messages: DataFrame, timeout_s: float | None = None, clock: str = "processingTime") -> DataFrame:
    """key, msg_id, ts, event: frames that ``passed`` and locks that ``expired``.

    A frame blocks the next ones of its key until a command or for
    ``timeout_s``.  The end of a lock is a timer, so its row comes without a
    further message of the key: with the clock ``processingTime`` by the
    cluster's clock, counted from when the frame was handled; with
    ``eventTime`` when the watermark, which ``messages`` must have on ts,
    passes ts + ``timeout_s``.  Needs the RocksDB state store.
    """
    mode = "none" if timeout_s is None else clock
    return messages.groupBy("key").transformWithStateInPandas(_Gate(timeout_s, clock), GATED, "append", mode)


def inflight_gate(messages: DataFrame, timeout_s: float | None = None, clock: str = "processingTime") -> DataFrame:
    """Frames (key, msg_id, ts) that pass while none of their key is in flight."""
    return gate_events(messages, timeout_s, clock).where("event = 'passed'").drop("event")


class _Beat(StatefulProcessor):
    """Counts the polls of a key."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "msg_id"])
        before = self.seen.get()[0] if self.seen.exists() else 0
        n = before + 1 + pd.RangeIndex(len(batch)).to_numpy()
        self.seen.update((int(before + len(batch)),))
        yield batch.assign(n=n).loc[n % self.every == 0, ["key", "msg_id", "ts", "n"]]

    def close(self) -> None:
        pass


def heartbeat(polls: DataFrame, every: int = 15) -> DataFrame:
    """Every ``every``-th poll (key, msg_id, ts, n) of a key, counted over batches."""
    slim = polls.select("key", "msg_id", "ts")
    return slim.groupBy("key").transformWithStateInPandas(_Beat(every), "key long, msg_id long, ts timestamp, n long", "append", "none")


def observed(messages: DataFrame, name: str = "status") -> DataFrame:
    """``messages`` whose batches tell a ``LiveStatus`` of that name what went by."""
    kind = F.col("kind")
    return messages.observe(name, F.count("*").alias("messages"), F.count_if(kind == "frame").alias("frames"), F.count_if(kind == "command").alias("commands"), F.count_if(kind == "blank").alias("polls"), F.max("ts").alias("last"))


class LiveStatus(StreamingQueryListener):
    """Totals of an ``observed`` stream, and a beat at each ``every``-th poll.

    Add it to a session with ``spark.streams.addListener``.  ``totals`` are the
    counts so far, ``last`` the newest message's time, ``beats`` the polls at
    which a beat was due, with the batch that brought them; the driver gets one
    row of metrics a batch, whatever its size.  Several batches of one listener
    add up; a restarted query is counted anew by a new listener.
    """

    def __init__(self, name: str = "status", every: int = 15, tell: Callable[[int, int], None] | None = None):
        self.name, self.every, self.tell = name, every, tell
        self.totals = dict.fromkeys(("messages", "frames", "commands", "polls"), 0)
        self.last, self.beats, self.running, self.error = None, [], False, None

    def onQueryStarted(self, event) -> None:
        self.running = True

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        before = self.totals["polls"]
        for k in self.totals:
            self.totals[k] += row[k] or 0
        if row["last"] is not None:
            self.last = row["last"] if self.last is None else max(self.last, row["last"])
        for n in range(before // self.every + 1, self.totals["polls"] // self.every + 1):
            self.beats.append((n * self.every, event.progress.batchId))
            if self.tell:
                self.tell(n * self.every, event.progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.running, self.error = False, event.exception


def decision_stream_join(frames: DataFrame, decisions: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Frames with the decisions of their key within ``delay`` after them."""
    f = frames.select("key", "msg_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    d = decisions.select(F.col("key").alias("d_key"), "command", F.col("ts").cast("timestamp").alias("d_ts")).withWatermark("d_ts", delay)
    return f.join(d, F.expr(f"key = d_key AND d_ts > ts AND d_ts <= ts + INTERVAL {delay}")).drop("d_key")


def feedback_loop(decided: DataFrame, memory_path: str, checkpoint: str, name: str = "feedback") -> StreamingQuery:
    """Appends decided inspections to the memory, each batch exactly once.

    A batch goes through ``append_once`` under the name and its id, so one that
    is run again after a failure adds nothing.  ``name`` belongs to the
    checkpoint: streams that share a memory take different ones.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        append_once(batch, memory_path, name, batch_id)

    return decided.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def knn_stream(queries: DataFrame, memory_path: str, checkpoint: str, sink: Callable[[DataFrame], None]) -> StreamingQuery:
    """Votes for arriving queries over the memory as it is at each batch.

    The memory is what ``feedback_loop`` appends below ``memory_path``, so a
    decision takes part in the votes of the next batch.  A batch reads the
    files that came since the one before; the rest is held by the executors.
    """
    memory = GrowingMemory(queries.sparkSession, memory_path)

    def vote(batch: DataFrame, _: int) -> None:
        sink(knn_vote(batch, memory.refresh()))

    return queries.writeStream.foreachBatch(vote).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
