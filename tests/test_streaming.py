"""Streams against the batch queries: late, reordered and last rows, and hourly counts."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import sessions
from strandline.streaming import focus, ingest

H = 1_704_067_200_000
MINUTE = 60_000
SCHEMA = "session_id string, id string, ts_utc long, monitor string, subject_id string"


@pytest.fixture
def rocks(spark):
    pytest.importorskip("google.protobuf")
    was = spark.conf.get(focus.STATE_STORE[0])
    spark.conf.set(*focus.STATE_STORE)
    yield spark
    spark.conf.set(focus.STATE_STORE[0], was)


def write(folder, n, rows):
    """The n-th file of a stream; files are read in the order of their times."""
    folder.mkdir(exist_ok=True)
    path = folder / f"{n:04}.json"
    path.write_text("".join(json.dumps(dict(zip(("session_id", "id", "ts_utc", "monitor", "subject_id"), r))) + "\n" for r in rows))
    os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))


def dims(spark):
    return spark.createDataFrame([(f"w{i}", f"app{i % 2}") for i in range(4)], "id string, app_id string")


def stream(spark, folder, tmp_path, **options):
    """All files of ``folder``, one a batch, through the sessions of the stream; a new call goes on where the last stopped."""
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    found = focus.focus_stream(events, dims(spark), **options)
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("session_id", "start_ms", "end_ms", "window_id", "app_id").collect())


def batch(spark, rows, since, until, idle_ms):
    out = []
    for device in sorted({r[0] for r in rows}):
        own = spark.createDataFrame([r for r in rows if r[0] == device], SCHEMA)
        found = sessions.focus_sessions(own, dims(spark), since, until, idle_ms).collect()
        out += [(device, r.start_ms, r.end_ms, r.window_id, r.app_id) for r in found]
    return sorted(out)


def shuffled(rng, rows, late=4 * MINUTE):
    """Rows up to ``late`` out of order."""
    return [r for _, r in sorted((r[2] + rng.randrange(late), r) for r in rows)]


def test_stream_gives_the_sessions_of_the_batch(rocks, tmp_path):
    rng, rows, at = random.Random(11), [], H + 90 * MINUTE
    for i in range(240):
        at += rng.choice([0, 900, 20_000, 60_000, 60_001, 200_000])
        monitor = rng.choice(["active_window"] * 4 + ["keyboard"])
        rows.append((f"d{rng.randrange(3)}", f"{i:05}", at, monitor, f"w{rng.randrange(5)}"))
    since, until = H + 91 * MINUTE, at + 30_000
    dealt, files = shuffled(rng, rows), tmp_path / "in"
    for n in range(0, len(dealt), 40):
        write(files, n, dealt[n : n + 40])
    first = stream(rocks, files, tmp_path, since=since, until=until)
    want = batch(rocks, rows, since, until, 60_000)
    assert first and set(first) <= set(want) and len(first) < len(want)  # the last sessions are still open
    write(files, 900, [("d0", "beat", until + 6 * MINUTE, "heartbeat", None)])
    write(files, 901, [("d1", "late", H + 92 * MINUTE, "active_window", "w0"), ("d0", "beat2", until + 20 * MINUTE, "heartbeat", None)])
    assert stream(rocks, files, tmp_path, since=since, until=until) == want


def test_last_session_is_closed_by_a_timer(rocks, tmp_path):
    files = tmp_path / "in"
    write(files, 0, [("s", "a", H, "active_window", "w1"), ("s", "b", H + 10_000, "active_window", "w2"), ("t", "c", H, "active_window", "w9")])
    assert stream(rocks, files, tmp_path) == []
    write(files, 1, [("u", "d", H + 7 * MINUTE, "mouse", None)])
    want = [("s", H, H + 10_000, "w1", "app1"), ("s", H + 10_000, H + 11_000, "w2", "app0"), ("t", H, H + 1000, "w9", None)]
    assert stream(rocks, files, tmp_path) == want
    write(files, 2, [("s", "e", H + 8 * MINUTE, "active_window", "w3"), ("u", "f", H + 30 * MINUTE, "mouse", None)])
    assert stream(rocks, files, tmp_path) == sorted([*want, ("s", H + 8 * MINUTE, H + 8 * MINUTE + 1000, "w3", "app1")])


def test_hourly_counts_close_after_the_late_time(spark, tmp_path):
    files = tmp_path / "in"
    write(files, 0, [("s", "a", H + MINUTE, "mouse", None), ("s", "b", H + 2 * MINUTE, "mouse", None), ("s", "c", H + 3 * MINUTE, "keyboard", None)])
    write(files, 1, [("s", "d", H + 62 * MINUTE, "mouse", None)])
    write(files, 2, [("s", "e", H + 59 * MINUTE, "mouse", None), ("s", "f", H + 66 * MINUTE, "mouse", None)])  # late, but in time
    write(files, 3, [("s", "h", H + 67 * MINUTE, "mouse", None)])
    write(files, 4, [("s", "g", H + 58 * MINUTE, "mouse", None), ("s", "i", H + 68 * MINUTE, "mouse", None)])  # too late
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(files))
    ingest.hourly_counts(events).writeStream.format("memory").queryName("hourly_counts_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(300)
    got = sorted((r.hour_ms - H, r.monitor, r.events) for r in spark.table("hourly_counts_out").collect())
    assert got == [(0, "keyboard", 1), (0, "mouse", 3)]
    batch_rows = spark.read.schema(SCHEMA).json(str(files)).where(F.col("id") != "g")
    assert {(m, n) for _, m, n in got} == {(r.monitor, r.n) for r in batch_rows.where(F.col("ts_utc") < H + 60 * MINUTE).groupBy("monitor").agg(F.count("*").alias("n")).collect()}
