"""Late files change exactly their hours and days, whatever stops a run."""

import gzip
import json

import pytest

from strandline.functions.scalars import DAY, HOUR
from strandline.plans import reconcile
from strandline.plans.store import Store
from strandline.sources.eventstore import EventStore
from strandline.streaming import ingest

T0 = 1_704_067_200_000
EVENT = "id string, ts_utc long, monitor string, subject_id string"


class Stop(Exception):
    pass


def events(spark, spots, name="e"):
    return spark.createDataFrame([(f"{name}{k:03}", t, m, w) for k, (t, m, w) in enumerate(spots)], EVENT)


def dims(spark):
    return spark.createDataFrame([("w1", "a"), ("w2", "b")], "id string, app_id string")


def hours_of(results):
    table = results.read("hourly")
    return {} if table is None else {(r.hour_ms, r.metric_key): (r.value_num, r.updated_utc_ms) for r in table.collect()}


def days_of(results):
    table = results.read("daily")
    return {} if table is None else {(r.day_ms, r.metric_key): (r.value_num, r.updated_utc_ms) for r in table.collect()}


FIRST = [(T0 + h * HOUR + m * 60_000, k, w) for h in (0, 1, 5, 30, 31) for m, k, w in ((1, "active_window", "w1"), (20, "active_window", "w2"), (30, "keyboard", None))]


def test_late_events_change_their_hours_and_day_only(spark, tmp_path):
    kept, results = EventStore(spark, f"file://{tmp_path}/e"), Store(spark, f"file://{tmp_path}/r")
    assert reconcile.reconcile_commits(kept, results, dims(spark), T0, "r0")["commits"] == 0
    kept.insert(events(spark, FIRST))
    now = T0 + 10 * DAY
    first = reconcile.reconcile_commits(kept, results, dims(spark), now, "r1")
    assert first == {"commits": 1, "hours_examined": 5, "hour_inserts": 30, "hour_updates": 0, "days_examined": 2, "day_inserts": 12, "day_updates": 0}
    hours, days = hours_of(results), days_of(results)
    kept.insert(events(spark, [(T0 + 5 * HOUR + 40 * 60_000, "keyboard", None), (T0 + 5 * HOUR + 50 * 60_000, "active_window", "w1")], "late"))
    again = reconcile.reconcile_commits(kept, results, dims(spark), now + 1, "r2")
    assert (again["commits"], again["hours_examined"], again["hour_inserts"], again["days_examined"]) == (1, 1, 0, 1) and again["hour_updates"] == 6
    changed = {h for (h, _), v in hours_of(results).items() if v != hours[(h, _)]}
    assert changed == {T0 + 5 * HOUR}
    assert {d for (d, _), v in days_of(results).items() if v != days[(d, _)]} == {T0}
    assert hours_of(results)[(T0 + 5 * HOUR, "keyboard_events")] == (2.0, now + 1)
    assert reconcile.reconcile_commits(kept, results, dims(spark), now + 2, "r3")["hours_examined"] == 0


def test_open_hours_wait(spark, tmp_path):
    kept, results = EventStore(spark, f"file://{tmp_path}/e"), Store(spark, f"file://{tmp_path}/r")
    kept.insert(events(spark, FIRST[:6]))
    soon = reconcile.reconcile_commits(kept, results, dims(spark), T0 + HOUR + 6 * 60_000, "r1")
    assert (soon["commits"], soon["hours_examined"]) == (0, 1) and {h for h, _ in hours_of(results)} == {T0}
    later = reconcile.reconcile_commits(kept, results, dims(spark), T0 + 3 * HOUR, "r2")
    assert (later["commits"], later["hours_examined"], later["hour_inserts"]) == (1, 2, 6)
    assert hours_of(results)[(T0, "focus_minutes")][1] == T0 + HOUR + 6 * 60_000  # equal rows stay as they were


@pytest.mark.parametrize("step", ["hours", "days", "marks"])
def test_a_stopped_run_is_made_good(spark, tmp_path, step):
    kept, results = EventStore(spark, f"file://{tmp_path}/e"), Store(spark, f"file://{tmp_path}/r")
    kept.insert(events(spark, FIRST))

    def at(name):
        if name == step:
            raise Stop

    with pytest.raises(Stop):
        reconcile.reconcile_commits(kept, results, dims(spark), T0 + 10 * DAY, "r1", at=at)
    assert reconcile.reconcile_commits(kept, results, dims(spark), T0 + 10 * DAY, "r2")["commits"] == 1
    assert len(hours_of(results)) == 30 and len(days_of(results)) == 12


def test_a_stream_of_files(spark, tmp_path):
    spool = tmp_path / "in" / "keyboard"
    spool.mkdir(parents=True)

    def write(name, times):
        rows = [{"id": f"{name}{k}", "ts_utc": t, "monitor": "keyboard", "action": "a", "subject_type": "none", "session_id": "s"} for k, t in enumerate(times)]
        (spool / f"{name}.ndjson.gz").write_bytes(gzip.compress("\n".join(map(json.dumps, rows)).encode()))

    kept, results = EventStore(spark, f"file://{tmp_path}/e"), Store(spark, f"file://{tmp_path}/r")
    clock = iter(range(T0 + 5 * DAY, T0 + 6 * DAY)).__next__

    def run():
        reconcile.reconcile_stream(ingest.journal_stream(spark, str(tmp_path / "in"), 1), kept, results, dims(spark), clock, str(tmp_path / "cp")).awaitTermination(300)

    write("a", [T0 + 60_000, T0 + 26 * HOUR])
    run()
    before = hours_of(results)
    write("b", [T0 + 120_000])
    run()
    after = hours_of(results)
    assert {h for (h, _), v in after.items() if before.get((h, _)) != v} == {T0}
    assert after[(T0, "keyboard_events")][0] == 2.0 and days_of(results)[(T0, "keyboard_events")][0] == 2.0
    assert kept.unmarked(reconcile.MARK) == []
