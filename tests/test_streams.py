"""Streams over batches: timers, exactly-once feedback, beats and a memory that grows."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from argusline.operators import sequences
from argusline.sources import files
from argusline.streaming import streams

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MSG = "msg_id long, s long, key long, kind string"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def put(spark, path, rows):
    df = spark.createDataFrame(rows, MSG).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def events(df, path):
    out = []
    q = df.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return sorted((r.key, r.ts.replace(tzinfo=dt.timezone.utc).timestamp(), r.event, r.msg_id) for r in out)


def test_a_lock_ends_without_a_later_message(rocks, tmp_path):
    """Processing time: the timer fires though the stream is silent after one frame."""
    stream = put(rocks, tmp_path, [(1, 10, 7, "frame"), (2, 11, 7, "frame"), (3, 10, 8, "frame"), (4, 11, 8, "command")])
    out = []
    q = streams.gate_events(stream, timeout_s=1).writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 90
        while time.time() < end and not any(r.event == "expired" for r in out):
            assert q.isActive, q.exception()
            time.sleep(0.2)
    finally:
        q.stop()
    assert sorted((r.key, r.msg_id, r.event) for r in out) == [(7, 1, "expired"), (7, 1, "passed"), (8, 3, "passed")]


def test_event_time_locks_equal_a_plain_run(rocks, tmp_path):
    """Locks end by the watermark; a frame at the very end of a lock passes."""
    rows = [(1, 100, 1, "frame"), (2, 104, 1, "frame"), (3, 110, 1, "frame"), (4, 112, 1, "command"), (5, 113, 1, "frame"), (6, 100, 2, "frame"), (7, 105, 2, "blank"), (8, 101, 3, "command")]
    put(rocks, tmp_path, rows)
    stream = put(rocks, tmp_path, [(9, 200, 9, "blank")])  # moves the watermark, of another key
    got = events(streams.gate_events(stream.withWatermark("ts", "0 seconds"), timeout_s=10, clock="eventTime"), tmp_path)
    assert got == [(1, 100, "expired", 1), (1, 100, "passed", 1), (1, 110, "passed", 3), (1, 113, "expired", 5), (1, 113, "passed", 5), (2, 100, "expired", 6), (2, 100, "passed", 6)]


def test_beats_of_a_stream(rocks, tmp_path):
    """Every 15th poll of a key over batches, and the status of the whole stream."""
    rows = [(i, 1000 + i, i % 2, "blank" if i % 5 else ("frame" if i % 10 else "command")) for i in range(1, 121)]
    for at in (0, 50, 110):
        stream = put(rocks, tmp_path, rows[at : {0: 50, 50: 110, 110: 120}[at]])
    status = streams.LiveStatus(every=15)
    rocks.streams.addListener(status)
    try:
        out = []
        beats = streams.heartbeat(streams.observed(stream).where("kind = 'blank'"))
        q = beats.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        end = time.time() + 30
        while time.time() < end and status.running:
            time.sleep(0.1)
    finally:
        rocks.streams.removeListener(status)
    table = rocks.createDataFrame(rows, MSG).withColumn("ts", F.timestamp_seconds("s")).where("kind = 'blank'")
    assert {(r.key, r.msg_id, r.n) for r in out} == {(r.key, r.msg_id, r.n) for r in sequences.heartbeat(table).collect()}
    polls = sum(r[3] == "blank" for r in rows)
    assert status.totals == {"messages": 120, "frames": 12, "commands": 12, "polls": polls} and not status.running
    assert [n for n, _ in status.beats] == list(range(15, polls + 1, 15)) and len({b for _, b in status.beats}) == 3


def decisions(spark, *values):
    return spark.createDataFrame([("NG" if v % 2 else "OK", f"cat {v % 3}", v) for v in values], "label string, category string, v int").select(
        "label", "category", F.timestamp_seconds("v").alias("ts"), F.array(F.col("v").cast("float")).alias("embedding"))


def held(spark, path):
    return sorted(r.sig[0] for r in files.memory_now(spark, path).collect())


def test_a_batch_is_appended_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "memory")
    assert files.append_once(decisions(spark, 1, 2, 3), path, "a/b", 0)
    assert not files.append_once(decisions(spark, 1, 2, 3), path, "a/b", 0)
    assert held(spark, path) == [1, 2, 3]
    # Another writer's batch of that id, and an empty one, are batches of their own.
    assert files.append_once(decisions(spark, 4), path, "a_b", 0) and files.append_once(decisions(spark, 5).where("false"), path, "a/b", 1)
    assert held(spark, path) == [1, 2, 3, 4]
    # A run that ends before its entry leaves nothing that counts.
    files.samples(decisions(spark, 6, 7), False).write.partitionBy("label", "category").parquet(f"{path}/_arriving/a_2f_b/{2:020d}")
    assert held(spark, path) == [1, 2, 3, 4]
    assert files.append_once(decisions(spark, 6, 7), path, "a/b", 2) and held(spark, path) == [1, 2, 3, 4, 6, 7]


def test_a_run_that_ends_amid_its_moves_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "memory"), files._files

    class Failing:
        """A file system whose third rename (the entry is the first) fails."""

        def __init__(self, fs):
            self.fs, self.n = fs, 0

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, a, b):
            self.n += 1
            if self.n == 3:
                raise OSError("lost")
            return self.fs.rename(a, b)

    fs, at = real(spark, path)
    monkeypatch.setattr(files, "_files", lambda *_: (Failing(fs), at))
    with pytest.raises(OSError):
        files.append_once(decisions(spark, 1, 2, 3, 4), path, "w", 5)
    monkeypatch.setattr(files, "_files", real)
    assert 0 < len(held(spark, path)) < 4
    assert not files.append_once(decisions(spark, 1, 2, 3, 4), path, "w", 5)
    assert held(spark, path) == [1, 2, 3, 4]


def test_feedback_replayed_without_its_checkpoint_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "memory")
    decisions(spark, 1, 2).write.parquet(str(tmp_path / "in"))
    for c in ("c1", "c2"):  # the second run knows no offsets, so batch 0 is the same batch again
        stream = spark.readStream.schema("label string, category string, ts timestamp, embedding array<float>").parquet(str(tmp_path / "in"))
        assert streams.feedback_loop(stream, path, str(tmp_path / c)).awaitTermination(120)
    assert held(spark, path) == [1, 2]


def test_a_growing_memory_reads_new_files_only(spark, tmp_path):
    path = str(tmp_path / "memory")
    memory = files.GrowingMemory(spark, path)
    assert memory.refresh().count() == 0
    want, names = [], []
    for i in range(12):
        files.append_once(decisions(spark, *range(i * 10, i * 10 + 3 + i)), path, "w", i)
        want += range(i * 10, i * 10 + 3 + i)
        assert sorted(r.sig[0] for r in memory.refresh().collect()) == sorted(want)
        names += memory.reads[-1]
    assert len(names) == len(set(names)) == len(files._listed(*[f(path) if i else f for i, f in enumerate(files._files(spark, path))]))
    assert memory.refresh().count() == len(want) and memory.reads[-1] == [] and len(memory.parts) <= 5
    # What executors hold may be lost: the rows come from the files again.
    for _, rows in memory.parts:
        rows.unpersist(blocking=True)
    assert sorted(r.sig[0] for r in memory.refresh().collect()) == sorted(want)
    memory.close()
