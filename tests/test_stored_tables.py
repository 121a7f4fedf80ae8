"""Stored tables: parts, versions, writers that meet, and hours computed anew."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.functions.scalars import DAY, HOUR
from strandline.operators import metrics, sessions
from strandline.plans import store as stored
from strandline.plans.store import Store

T0 = 1_704_067_200_000
EVIDENCE = "hour_ms long, evidence_json string"


class Stop(Exception):
    pass


def rows(spark, *pairs):
    return spark.createDataFrame([(h, v) for h, v in pairs], EVIDENCE)


def values(kept, name="evidence", **where):
    table = kept.read(name, **where)
    return [] if table is None else sorted((r.hour_ms, r.evidence_json, r.run_id, r.created_utc_ms, r.updated_utc_ms) for r in table.collect())


def parts(kept, name="evidence"):
    return kept._manifest(name)[1]


def files(tmp_path):
    return sorted(str(p) for p in tmp_path.rglob("*.parquet"))


def test_an_upsert_writes_only_the_parts_it_changes(spark, tmp_path):
    kept = Store(spark, f"file://{tmp_path}/s")
    assert kept.read("evidence") is None
    years = spark.range(0, 365).select((F.col("id") * 10 * DAY + T0).alias("hour_ms"), F.lit("a").alias("evidence_json"))
    assert kept.upsert("evidence", years, "r1", 1) == {"inserts": 365, "updates": 0, "unchanged": 0}
    before, was = parts(kept), files(tmp_path)
    assert len(before) == 365
    day = T0 + 1000 * DAY
    six = rows(spark, (day, "b"), *[(day + k * HOUR, "c") for k in range(1, 6)])
    assert kept.upsert("evidence", six, "r2", 2) == {"inserts": 5, "updates": 1, "unchanged": 0}
    after = parts(kept)
    assert {p for p in after if after[p] != before.get(p)} == {"2026-09-27"}
    assert len(set(files(tmp_path)) - set(was)) == 1
    assert values(kept, since=day, until=day + DAY) == [(day, "b", "r2", 1, 2), *[(day + k * HOUR, "c", "r2", 2, 2) for k in range(1, 6)]]
    assert len(kept.read("evidence", day, day + DAY).inputFiles()) == 1
    assert kept.upsert("evidence", six, "r3", 3) == {"inserts": 0, "updates": 0, "unchanged": 6}
    assert parts(kept) == after and kept.read("evidence").count() == 370
    assert kept.upsert("evidence", six.limit(0), "r4", 4) == {"inserts": 0, "updates": 0, "unchanged": 0}


def test_nulls_and_untouched_rows_of_a_part(spark, tmp_path):
    kept = Store(spark, f"file://{tmp_path}/s")
    kept.upsert("evidence", rows(spark, (T0, None), (T0 + HOUR, "x"), (T0 + 2 * HOUR, "y")), "a", 1)
    assert kept.upsert("evidence", rows(spark, (T0, None), (T0 + HOUR, None)), "b", 2) == {"inserts": 0, "updates": 1, "unchanged": 1}
    assert values(kept) == [(T0, None, "a", 1, 1), (T0 + HOUR, None, "b", 1, 2), (T0 + 2 * HOUR, "y", "a", 1, 1)]


@pytest.mark.parametrize("step", ["computed", "merged", "publish"])
def test_a_stopped_upsert_changes_nothing(spark, tmp_path, step):
    kept = Store(spark, f"file://{tmp_path}/s")
    kept.upsert("evidence", rows(spark, (T0, "x")), "a", 1)
    want = values(kept)

    def at(name):
        if name == step:
            raise Stop

    with pytest.raises(Stop):
        kept.upsert("evidence", rows(spark, (T0, "y"), (T0 + DAY, "z")), "b", 2, at=at)
    assert values(kept) == want
    kept.vacuum()
    assert values(kept) == want
    assert kept.upsert("evidence", rows(spark, (T0, "y"), (T0 + DAY, "z")), "b", 2) == {"inserts": 1, "updates": 1, "unchanged": 0}


@pytest.mark.parametrize("theirs", [T0 + 5 * HOUR, T0, T0 + 9 * DAY])
def test_two_writers_lose_no_row(spark, tmp_path, theirs):
    mine, other = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    mine.upsert("evidence", rows(spark, (T0, "x"), (T0 + HOUR, "x")), "a", 1)
    done = []

    def at(name):
        if name == "publish" and not done:
            done.append(1)
            other.upsert("evidence", rows(spark, (theirs, "theirs")), "o", 2)

    assert mine.upsert("evidence", rows(spark, (T0, "mine"), (T0 + 2 * HOUR, "mine")), "m", 3, at=at) == {"inserts": 1, "updates": 1, "unchanged": 0}
    want = {T0: "mine", T0 + HOUR: "x", T0 + 2 * HOUR: "mine"}
    want.setdefault(theirs, "theirs")
    assert {h: v for h, v, *_ in values(mine)} == want
    assert mine._manifest("evidence")[0] == 3


def test_old_versions_go_and_their_readers_keep_some(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "KEPT", 3)
    kept = Store(spark, f"file://{tmp_path}/s")
    kept.upsert("evidence", rows(spark, (T0, "0"), (T0 + DAY, "stays")), "a", 1)
    old = kept.read("evidence")
    for k in range(1, 3):
        kept.upsert("evidence", rows(spark, (T0, str(k))), "a", 1 + k)
    assert sorted(r.evidence_json for r in old.collect()) == ["0", "stays"]
    for k in range(3, 8):
        kept.upsert("evidence", rows(spark, (T0, str(k))), "a", 1 + k)
    assert [h[1] for h in values(kept)] == ["7", "stays"]
    versions = sorted((tmp_path / "s" / "evidence" / "versions").glob("*.json"))
    named = {f for v in versions for f in json.loads(v.read_text()).values()}
    assert len(versions) == 3
    assert {str(p.parent).split("/evidence/")[1] for p in (tmp_path / "s" / "evidence" / "data").rglob("*.parquet")} == named


def events(spark, spots):
    return spark.createDataFrame([(f"e{k:03}", t, m, w) for k, (t, m, w) in enumerate(spots)], "id string, ts_utc long, monitor string, subject_id string")


def test_hours_computed_anew_are_each_alone(spark, tmp_path):
    spots = [(T0 + 50 * 60_000, "active_window", "w1"), (T0 + HOUR + 10 * 60_000, "active_window", "w2"), (T0 + 2 * HOUR + 5 * 60_000, "active_window", "w1"), (T0 + 2 * HOUR + 6 * 60_000, "keyboard", None)]
    e, dims = events(spark, spots), spark.createDataFrame([("w1", "a"), ("w2", "b")], "id string, app_id string")
    kept = Store(spark, f"file://{tmp_path}/s")
    got = stored.recompute_hours(kept, e, dims, spark.createDataFrame([(T0,), (T0 + HOUR,), (T0 + 2 * HOUR,)], "hour_ms long"), 3_600_000, "r", 1)
    assert got == {"hours_examined": 3, "inserts": 18, "updates": 0, "unchanged": 0}
    focus = {(r.hour_ms - T0) // HOUR: r.value_num for r in kept.read("hourly").where("metric_key = 'focus_minutes'").collect()}
    assert focus == {0: 10.0, 1: 50.0, 2: 55.0}  # nothing is carried over the turn of an hour
    for hour in range(3):
        start = T0 + hour * HOUR
        own = metrics.hourly_summary(e, dims, start, start + HOUR, 3_600_000)
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, kept.read("hourly", start, start + HOUR).select(*own.columns).collect()))
    whole = sessions.focus_sessions(e, dims, T0, T0 + 3 * HOUR, 3_600_000).count()
    assert whole == 3 and stored.recompute_hours(kept, e, dims, spark.createDataFrame([], "hour_ms long"), 1, "r", 2)["hours_examined"] == 0


def test_artifacts_are_written_once(spark, tmp_path):
    from hashlib import sha256

    from strandline.operators import advice, render
    from strandline.plans import artifacts

    e = events(spark, [(T0 + k * 7 * 60_000, ("active_window", "keyboard", "mouse")[k % 3], f"w{k % 2 + 1}") for k in range(30)])
    dims = spark.createDataFrame([("w1", "a"), ("w2", 'b"q')], "id string, app_id string")
    kept = Store(spark, f"file://{tmp_path}/s")
    assert artifacts.plan(kept) is None
    hourly = metrics.hourly_summary(e, dims, T0, T0 + 4 * HOUR, 600_000)
    proof = sessions.evidence(sessions.top_apps(sessions.by_hour(sessions.focus_sessions(e, dims, T0, T0 + 4 * HOUR, 600_000))))
    daily = metrics.daily_summary(hourly)
    kept.upsert("hourly_report", render.hourly_report(hourly, proof), "r", 1)
    kept.upsert("daily_report", render.daily_report(daily), "r", 1)
    kept.upsert("hourly_digest", render.hourly_digest(hourly, proof, advice.hourly_advice(hourly, proof)), "r", 1)
    files = artifacts.plan(kept)
    out = tmp_path / "out"
    assert artifacts.carry_out(kept, files, f"file://{out}", dry_run=True) == {"written": 4 * 3 + 3 + 4 * 2, "unchanged": 0} and not out.exists()
    assert artifacts.carry_out(kept, files, f"file://{out}")["written"] == 23
    for r in files.collect():
        raw = (out / r.path).read_bytes()
        assert sha256(raw).hexdigest() == r.sha256 and r.path.startswith("2024/01/01/")
        if r.form == "json":
            assert raw.decode() == json.dumps(json.loads(raw), indent=2, sort_keys=True) + "\n"
    assert artifacts.carry_out(kept, files, f"file://{out}") == {"written": 0, "unchanged": 23}
    spoilt = next(out.rglob("*.csv"))
    spoilt.write_text("other")
    assert artifacts.carry_out(kept, artifacts.plan(kept, T0, T0 + DAY), f"file://{out}") == {"written": 1, "unchanged": 22}
    first = json.loads(next(out.rglob("daily-*.json")).read_text())
    assert set(first) == {"day_hash", "day_start_ms", "metrics"} and set(first["metrics"]["focus_minutes"]) == {"hours_counted", "low_conf_hours", "value_num"}


def test_retention_plans_are_carried_out_once(spark, tmp_path):
    import os

    from strandline.operators import retention

    for k in range(6):
        path = tmp_path / "_done" / "mouse" / f"2024010{k}-00-x.ndjson.gz"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * 100)
        os.utime(path, (1_700_000_000 + k * 90_000,) * 2)
    (tmp_path / "mouse").mkdir()
    (tmp_path / "mouse" / "20240109-00-y.ndjson.gz").write_bytes(b"y" * 100)
    files = retention.list_files(spark, f"file://{tmp_path}")
    assert retention.trim_plan(files, "20240101-00", 1000).count() == 0
    plan = retention.trim_plan(files, "20240101-00", 600)  # 700 bytes are used, 540 allowed; the current hour's file stays
    want = {"20240100-00-x.ndjson.gz", "20240102-00-x.ndjson.gz"}
    assert {r.path.split("/")[-1] for r in plan.collect()} == want
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    assert retention.carry_out(spark, plan, dry_run=True) == {"files": 2, "bytes": 200, "missing": 0}
    assert retention.carry_out(spark, plan) == {"files": 2, "bytes": 200, "missing": 0}
    assert retention.carry_out(spark, plan) == {"files": 0, "bytes": 0, "missing": 2}
    assert {p.name for p in (tmp_path / "_done" / "mouse").glob("*.gz")} == {f"2024010{k}-00-x.ndjson.gz" for k in (1, 3, 4, 5)} and retention.list_files(spark, f"file://{tmp_path}").count() == 5
