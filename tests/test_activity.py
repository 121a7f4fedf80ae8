"""Small fixtures with results worked out by hand."""

import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.functions.scalars import HOUR
from strandline.operators import advice, dynamics, metrics, render, retention, sessions, upsert
from strandline.plans import runs, store, views
from strandline.sources import events as source
from strandline.sources import importer, sinks

H = 1_640_944_800_000


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, ts_utc long, monitor string, subject_id string")


def windows(spark):
    return spark.createDataFrame([("w1", "app1"), ("w2", "app2"), ("w3", "app1")], "id string, app_id string")


def changes(spark, spots):
    return frame(spark, [(f"{i:03}", H + t, "active_window", w) for i, (t, w) in enumerate(spots)])


def test_sessions_of_an_hour(spark):
    e = changes(spark, [(60_000, "w1"), (90_000, "w2"), (150_000, "w3"), (2_700_000, "w1")])
    s = sessions.focus_sessions(e, windows(spark), H, H + HOUR)
    got = sorted((r.start_ms - H, r.end_ms - H, r.app_id) for r in s.collect())
    assert got == [(60_000, 90_000, "app1"), (90_000, 150_000, "app2"), (150_000, 151_000, "app1"), (2_700_000, 3_600_000, "app1")]
    wide = metrics.hourly_wide(e, windows(spark), H, H + HOUR, 60_000).first()
    assert (wide.sessions, wide.switches, wide.focus_minutes, wide.deep_focus_minutes, wide.idle_minutes, wide.coverage) == (4, 3, 16.52, 15.0, 43.48, 0.2753)
    assert sessions.evidence(sessions.top_apps(sessions.by_hour(s))).first().evidence_json == '[{"app_id":"app1","minutes":15.52},{"app_id":"app2","minutes":1.0}]'


def test_metrics_with_typing(spark):
    rows = [("a", H + 60_000, "active_window", "w1"), ("b", H + 1_800_000, "active_window", "w2")]
    rows += [(f"k{i}", H + i * 60_000, "keyboard", None) for i in range(15)] + [(f"m{i}", H + i * 60_000, "mouse", None) for i in range(25)]
    long = metrics.hourly_summary(frame(spark, rows), windows(spark), H, H + HOUR, 60_000)
    got = {r.metric_key: (r.value_num, r.input_row_count) for r in long.collect()}
    assert got == {"focus_minutes": (30.02, 2), "idle_minutes": (29.98, 2), "context_switches": (1.0, 2), "deep_focus_minutes": (30.0, 2), "keyboard_events": (15.0, 15), "mouse_events": (25.0, 25)}


def test_edges_of_sessions(spark):
    e = changes(spark, [(0, "w1"), (60_000, "x"), (60_000, "y"), (100_000, "z")])
    got = sorted((r.start_ms - H, r.end_ms - H, r.window_id, r.app_id) for r in sessions.focus_sessions(e, windows(spark), H, H + 3 * HOUR).collect())
    assert got == [(0, 60_000, "w1", "app1"), (60_000, 100_000, "y", None), (100_000, 3 * HOUR, "z", None)]
    parts = sessions.by_hour(sessions.focus_sessions(e, windows(spark), H, H + 3 * HOUR))
    deep = {(r.hour_ms - H) // HOUR: r.deep_ms for r in sessions.hourly_sessions(parts).collect()}
    assert deep == {0: HOUR - 60_000, 1: HOUR, 2: HOUR}


def test_empty_range_and_hours_without_events(spark):
    none = frame(spark, [])
    wide = metrics.hourly_long(metrics.hourly_wide(none, windows(spark), H, H + 2 * HOUR, 60_000))
    assert wide.count() == 12 and {r.value_num for r in wide.where("metric_key = 'idle_minutes'").collect()} == {60.0}
    assert sessions.hour_grid(spark, H + HOUR, H).count() == 0
    got = metrics.input_hashes(none, sessions.hour_grid(spark, H, H + HOUR), "abc123").first()
    assert got.input_hash == hashlib.sha256(b"events|0|0|0|||git:abc123").hexdigest()


def test_random_sessions_match_a_loop(spark):
    rng = random.Random(4)
    t, rows = 0, []
    for i in range(400):
        t += rng.choice([0, 1_000, 59_999, 60_000, 60_001, 600_000])
        rows.append((t, rng.choice(["w1", "w2", "w3", "q"])))
    e = changes(spark, rows)
    end = H + t + 5_000
    want = []
    for (a, w), nxt in zip(rows, [*rows[1:], None]):
        stop = end if nxt is None else H + a + 1000 if nxt[0] - a > 60_000 else H + nxt[0]
        if stop > H + a:
            want.append((H + a, stop, w))
    assert sorted((r.start_ms, r.end_ms, r.window_id) for r in sessions.focus_sessions(e, windows(spark), H, end).collect()) == sorted(want)


def test_hour_rounding(spark):
    b = 1_640_995_200_000
    df = spark.createDataFrame([(b,), (b + 1_800_000,), (b + 500,), (-1,)], "t long")
    got = [(r.f, r.c) for r in df.select(scalars.floor_to(F.col("t"), HOUR).alias("f"), scalars.ceil_hour(F.col("t")).alias("c")).collect()]
    assert got == [(b, b), (b, b + HOUR), (b, b), (-HOUR, 0)]


def test_daily_and_mismatch(spark):
    e = frame(spark, [("k1", H + 300_000, "keyboard", None)])
    day = H // 86_400_000 * 86_400_000
    hourly = metrics.hourly_summary(e, windows(spark), day, day + 24 * HOUR, 60_000)
    daily = {r.metric_key: r for r in metrics.daily_summary(hourly).collect()}
    assert daily["keyboard_events"].value_num == 1.0 and daily["keyboard_events"].hours_counted == 24 and daily["focus_minutes"].low_conf_hours == 24
    late = e.union(frame(spark, [("k2", H + 600_000, "keyboard", None)]))
    hours = sessions.hour_grid(spark, H, H + HOUR)
    stored = hourly.where(F.col("hour_ms") == H)
    assert metrics.hour_mismatches(metrics.input_hashes(e, hours), stored).count() == 0
    assert [r.hour_ms for r in metrics.hour_mismatches(metrics.input_hashes(late, hours), stored).collect()] == [H]
    assert metrics.day_mismatches(hourly, metrics.daily_summary(hourly)).count() == 0


def test_advice(spark):
    row = lambda **m: spark.createDataFrame([(H, k, float(v), 0.75, "h") for k, v in m.items()], "hour_ms long, metric_key string, value_num double, coverage_ratio double, input_hash string")
    got = {r.rule_key: r for r in advice.hourly_advice(row(focus_minutes=15, idle_minutes=45, keyboard_minutes=12, mouse_minutes=8, switches=15, deep_focus_minutes=35)).collect()}
    assert {k: (r.severity, r.score) for k, r in got.items()} == {"low_focus": ("warn", 0.4), "high_switches": ("warn", 0.3), "deep_focus_positive": ("good", 0.4), "long_idle": ("info", 0.3)}
    assert got["low_focus"].advice_text == "Low focused time this hour (15.0m; target ≥ 25m). Try reducing interruptions."
    assert json.loads(got["low_focus"].reason_json) == {"coverage_ratio_actual": 0.75, "coverage_ratio_threshold": 0.6, "focus_minutes_actual": 15.0, "focus_minutes_threshold": 25.0}
    low = row(focus_minutes=10).withColumn("coverage_ratio", F.lit(0.5))
    assert advice.hourly_advice(low).count() == 0
    day = spark.createDataFrame([(H, k, float(v), 8, 2, "h") for k, v in {"focus_minutes": 120, "deep_focus_minutes": 90, "switches": 180}.items()], "day_ms long, metric_key string, value_num double, hours_counted int, low_conf_hours int, input_hash string")
    assert {r.rule_key: r.score for r in advice.daily_advice(day).collect()} == {"low_daily_focus": 0.3333, "high_switch_day": 0.3}


def test_digest_order_and_labels(spark):
    m = spark.createDataFrame([(H, "b", 1.0, 0.0008, "h2"), (H, "a", 2.0, 1.0, "h1")], "hour_ms long, metric_key string, value_num double, coverage_ratio double, input_hash string")
    ev = spark.createDataFrame([(H, '[{"app_id":"x","minutes":1.0}]')], "hour_ms long, evidence_json string")
    ad = spark.createDataFrame([(H, "deep_focus_positive", "good", 0.4, "t1"), (H, "high_switches", "warn", 0.3, "t2")], "hour_ms long, rule_key string, severity string, score double, advice_text string")
    r = render.hourly_digest(m, ev, ad).first()
    assert r.txt.split("\n") == [
        "metric_key=a,value_num=2.0,coverage_ratio=1.0", "metric_key=b,value_num=1.0,coverage_ratio=0.0008", 'evidence[top_app_minutes]=[{"app_id":"x","minutes":1.0}]',
        'advice rule=high_switches,severity=warn,score=0.3,text="t2"', 'advice rule=deep_focus_positive,severity=good,score=0.4,text="t1"',
    ]
    assert r.hour_hash == "h2" and render.hourly_report(m, ev).first().hour_hash == "h1"
    assert render.hourly_report(m, ev).first().csv == "coverage_ratio,metric_key,value_num\r\n1.0,a,2.0\r\n0.0008,b,1.0\r\n"


def test_upsert_twice_changes_nothing(spark):
    new = spark.createDataFrame([(1, 2.0, 10), (2, None, 10)], "k int, v double, created_utc_ms int")
    old = spark.createDataFrame([(1, 1.0, 5), (3, 3.0, 5)], "k int, v double, created_utc_ms int")
    assert {r.k: r.change for r in upsert.diff(new, old, ["k"], ["v"]).collect()} == {1: "update", 2: "insert"}
    done = upsert.apply(new, old, ["k"], ["v"])
    assert sorted((r.k, r.v, r.created_utc_ms) for r in done.collect() if r.v) == [(1, 2.0, 5), (3, 3.0, 5)]
    assert {r.change for r in upsert.diff(new, done, ["k"], ["v"]).collect()} == {"unchanged"}


def test_dynamics(spark):
    keys = frame(spark, [(f"{i}", t, "keyboard", None) for i, t in enumerate([0, 100, 200, 300, 400, 410, 420, 430, 440])])
    assert dynamics.bursts(keys, "monitor").first().bursts == 1
    x = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 4.0, 10.0, float("nan"), float("inf"), None)], "monitor string, gap double")
    r = dynamics.interval_stats(x, "monitor").first()
    assert r.n == 4 and r.p95_ms == pytest.approx(9.1)
    points = spark.createDataFrame([("a", str(i), i, float(3 * i), float(4 * i)) for i in range(3)], "d string, id string, ts_utc long, x double, y double")
    assert dynamics.distance(points, "d").first().distance_px == 10
    assert [r.gap for r in dynamics.idle_gaps(frame(spark, [("a", 0, "k", None), ("b", 6999, "k", None), ("c", 13999, "k", None)])).collect()] == [7000]
    kept = dynamics.dedupe_within(frame(spark, [(str(t), t, "k", "s") for t in (0, 4999, 5000, 9999, 10_000)]), "subject_id")
    assert sorted(r.ts_utc for r in kept.collect()) == [0, 5000, 10_000]


def test_scalars(spark):
    df = spark.createDataFrame([("https://u:p@Example.com:8080/a?b", "Read.ME.TXT"), ("//h/p", ".bashrc"), ("mailto:x", "a")], "u string, f string")
    got = [tuple(r) for r in df.select(scalars.url_authority(F.col("u")), scalars.extension(F.col("f"))).collect()]
    assert got == [("u:p@Example.com:8080", "txt"), ("h", ""), ("", "")]
    salt = "00ff"
    assert df.select(scalars.salted_hash(F.lit("é"), "url", salt)).first()[0] == hashlib.sha256(bytes.fromhex(salt) + b"url\0" + "é".encode()).hexdigest()
    ages = spark.createDataFrame([(5_000,), (180_000,), (7_200_000,), (4 * 86_400_000,)], "a long")
    assert [r[0] for r in ages.select(scalars.age_text(F.col("a"))).collect()] == ["5s ago", "3m ago", "2h ago", "4d ago"]
    assert df.select(scalars.seconds_of(F.lit("128 or 1.5s"), 9.0), scalars.seconds_of(F.lit("x"), 9.0)).first()[:] == (1.5, 9.0)


def line(**k):
    return json.dumps({"id": "a", "ts_utc": 1, "monitor": "mouse", "action": "x", "subject_type": "none", "session_id": "s", **k})


def test_journal(spark, tmp_path):
    d = tmp_path / "mouse"
    d.mkdir()
    lines = [line(), line(id=3), line(ts_utc="7"), line(ts_utc=1.5), line(monitor="zzz"), line(subject_type="q"), line(id=None), "no json", "", line(id="b", extra=1, pid=4)]
    with gzip.open(d / "20240101-00.ndjson.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    (d / "20240101-01.ndjson.gz.part").write_bytes(b"junk")
    (tmp_path / "other").mkdir()
    with gzip.open(tmp_path / "other" / "x.ndjson.gz", "wt") as f:
        f.write(line(id="zz"))
    good, bad = source.split_valid(source.parse_lines(source.read_journal(spark, str(tmp_path))))
    assert sorted((r.id, r.pid) for r in good.collect()) == [("a", None), ("b", 4)] and bad.count() == 6


def test_salvage(spark, tmp_path):
    raw = gzip.compress(("\n".join([line(id=str(i)) for i in range(2000)]) + "\nbad\n").encode())
    (tmp_path / "cut.part").write_bytes(raw[: len(raw) * 2 // 3])
    (tmp_path / "whole.part").write_bytes(raw)
    got = source.salvage(spark, str(tmp_path))
    by = {r.file.rsplit("/", 1)[1]: (r.n, r.c) for r in got.groupBy("file").agg(F.count("*").alias("n"), F.count_if("corrupt").alias("c")).collect()}
    assert by["whole.part"] == (2001, 1) and 0 < by["cut.part"][0] < 2000 and by["cut.part"][1] == 0
    plain = spark.createDataFrame([("f", 1, line()), ("f", 2, "x"), ("f", 3, line())], "file string, line_no int, value string")
    assert source.salvage_plain(plain).count() == 1


def test_files_and_artifacts(spark, tmp_path):
    sinks.write_journal(source.generate(spark, 200), str(tmp_path / "j"))
    files = retention.list_files(spark, str(tmp_path / "j"))
    assert retention.quota_state(files).first().state == "NORMAL"
    dated = spark.createDataFrame([("a", 1, 10), ("b", 2, 10), ("c", 3, 10)], "path string, d int, size long").withColumn("modified", F.timestamp_seconds(F.col("d") * 90_000))
    assert sorted(r.path for r in retention.victims(dated, 15).collect()) == ["a", "b"] and retention.victims(dated, 0).count() == 0
    assert sinks.csv_bytes([])[0] == b"" and sinks.csv_bytes([{"b": 1, "a": 2}])[0] == b"a,b\r\n2,1\r\n"
    assert sinks.json_bytes({"b": 1, "a": 2}, compact=True)[0] == b'{"a":2,"b":1}'


def test_runs_locks_and_tick(spark, tmp_path):
    r = runs.Run({"since": 1})
    assert r.status == "partial" and '"since":1' in r.row()[3] and r.finish("ok").status == "ok"
    with pytest.raises(ValueError):
        runs.Run({}).finish("done")
    a, b = runs.Lock(str(tmp_path), "tick"), runs.Lock(str(tmp_path), "tick")
    assert a.acquire() and not b.acquire() and a.renew() and not b.release() and a.release() and b.acquire()
    short = runs.Lock(str(tmp_path), "short", ttl=-1)
    assert short.acquire() and runs.Lock(str(tmp_path), "short").acquire()
    lost, taken = runs.Lock(str(tmp_path), "lost", ttl=-1), runs.Lock(str(tmp_path), "lost")
    assert lost.acquire() and taken.acquire() and not lost.renew() and not lost.release() and taken.owner() == taken.token and taken.renew() and taken.release()


def test_tick_rolls_up_the_day_before_in_its_window(spark, tmp_path):
    day = H // 86_400_000 * 86_400_000
    e = frame(spark, [(f"e{i:03}", day + i * 600_000, ("active_window", "keyboard")[i % 2], "w1") for i in range(150)])
    kept = store.Store(spark, f"file://{tmp_path}/s")
    at = day + 86_400_000
    assert not any(v for k, v in runs.run_tick(kept, e, windows(spark), at + 299_999, str(tmp_path), backfill_hours=2).items() if k.startswith("day_"))
    inside = runs.run_tick(kept, e, windows(spark), at + 300_000, str(tmp_path), backfill_hours=2)
    assert (inside["day_inserts"], inside["day_report_inserts"], inside["day_digest_inserts"]) == (6, 1, 1) and inside["day_advice_inserts"] >= 1
    assert {r.day_ms for r in kept.read("daily").collect()} == {day}
    assert not any(v for k, v in runs.run_tick(kept, e, windows(spark), at + 3_600_000, str(tmp_path), backfill_hours=2).items() if k.startswith("day_"))
    assert not any(v for k, v in runs.run_tick(kept, e, windows(spark), at + 400_000, str(tmp_path), backfill_hours=2, do_daily=False).items() if k.startswith("day_"))


def test_entry_without_the_corpus_package(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "strandline", tmp_path / "strandline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)}).returncode == 0


def lines_of(n, monitor="keyboard", start=H, first=0):
    return [{"id": f"{monitor}{i:05}", "ts_utc": start + i * 60_000, "monitor": monitor, "action": "a", "subject_type": "none", "session_id": "s"} for i in range(first, first + n)]


def pack(path, rows, cut=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    raw = gzip.compress("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows).encode())
    path.write_bytes(raw[:cut])


def test_journal_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i:03}", H + i * 60_000, ("keyboard", "mouse")[i % 2], "a", "none", "s") for i in range(150)], "id string, ts_utc long, monitor string, action string, subject_type string, session_id string")
    spool = str(tmp_path / "spool")
    n = sinks.write_journal(rows, spool, per_file=20)
    assert n == retention.list_files(spark, spool).count() >= 6
    assert all(p.parent.name in ("keyboard", "mouse") and p.name[:8].isdigit() for p in (tmp_path / "spool").rglob("*.gz"))
    good, bad = source.split_valid(source.parse_lines(source.read_journal(spark, spool)))
    assert sorted(r.id for r in good.collect()) == sorted(r.id for r in rows.collect()) and bad.count() == 0
    sinks.write_journal(rows.limit(0), spool)
    assert retention.list_files(spark, spool).count() == n


def test_recovery_sweep(spark, tmp_path):
    long = [json.dumps({"id": i, "pad": hashlib.sha256(str(i).encode()).hexdigest() * 20}) for i in range(200)]
    pack(tmp_path / "keyboard" / "x.ndjson.gz.part", long, cut=-500)
    two = gzip.compress(b'{"a":1}\n{"a":2}\n') + gzip.compress(b'{"a":3}\nno json\n{"a":4}\n{"a":5}')
    (tmp_path / "keyboard" / "two.ndjson.gz.part").write_bytes(two)
    (tmp_path / "keyboard" / "none.ndjson.gz.part").write_bytes(b"no gzip")
    (tmp_path / "mouse").mkdir()
    (tmp_path / "mouse" / "y.part").write_text('{"a":1}\n{"a":2}\nbad\n{"a":3}\n')
    spool = f"file://{tmp_path}"
    assert importer.recover(spark, spool, only=("browser",))["temp_files_found"] == 0

    class Stop(Exception):
        pass

    def at(step):
        if step == "noted":
            raise Stop

    with pytest.raises(Stop):
        importer.recover(spark, spool, at=at)
    totals = importer.recover(spark, spool)
    lines = {p.name: gzip.decompress(p.read_bytes()).decode().splitlines() for p in tmp_path.rglob("*_recovered.ndjson.gz")}
    whole = len(lines["x_recovered.ndjson.gz"])
    assert 0 < whole < 200 and lines["x_recovered.ndjson.gz"] == long[:whole]
    assert lines["two_recovered.ndjson.gz"] == [f'{{"a":{k}}}' for k in (1, 2, 3, 4)] and lines["y_recovered.ndjson.gz"] == ['{"a":1}', '{"a":2}']
    assert totals == {"monitors_processed": 2, "temp_files_found": 4, "temp_files_recovered": 3, "temp_files_failed": 1, "total_lines_salvaged": whole + 6, "corrupted_lines": 1}
    note = (tmp_path / "keyboard" / "two.ndjson.gz.part.error").read_text()
    assert note == f'bytes_read={len(two)}, lines_salvaged=4, reason="complete file", invalid_json_lines=1'
    assert "truncated" in (tmp_path / "keyboard" / "x.ndjson.gz.part.error").read_text()
    assert sorted(p.name for p in tmp_path.rglob("*.part")) == ["none.ndjson.gz.part"]
    assert (tmp_path / "keyboard" / "none.ndjson.gz.part.error").read_text().startswith("No valid lines salvaged from 7 bytes; ")
    again = importer.recover(spark, spool)
    assert (again["temp_files_found"], again["temp_files_recovered"], again["total_lines_salvaged"]) == (1, 0, 0)


def test_whole_gzip_loses_its_unfinished_line(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b'{"a":1}\n{"a":2}'))
    assert [r.value for r in source.salvage(spark, str(tmp_path)).collect()] == ['{"a":1}']


def test_tick_twice_changes_nothing(spark, tmp_path):
    day = H // 86_400_000 * 86_400_000
    e = frame(spark, [(f"e{i:03}", day + i * 120_000, ("active_window", "keyboard", "mouse")[i % 3], f"w{i % 3 + 1}") for i in range(150)])
    kept = store.Store(spark, str(tmp_path / "store"))
    now = day + 5 * HOUR + 60_000
    first = runs.run_tick(kept, e, windows(spark), now, str(tmp_path), backfill_hours=5, do_daily=True)
    assert (first["hours_examined"], first["skipped_open_hours"]) == (6, 2) and first["hour_inserts"] == 24 and first["day_inserts"] == 6 and first["hour_report_inserts"] == 4
    again = runs.run_tick(kept, e, windows(spark), now, str(tmp_path), backfill_hours=5, do_daily=True)
    assert not any(v for k, v in again.items() if k.endswith(("inserts", "updates")))
    late = e.union(frame(spark, [("late", day + 90 * 60_000, "keyboard", None)]))
    third = runs.run_tick(kept, late, windows(spark), now, str(tmp_path), backfill_hours=5)
    assert third["hour_inserts"] == 0 and third["hour_updates"] == 6
    row = kept.read("hourly").where(f"hour_ms = {day + HOUR} AND metric_key = 'keyboard_events'").first()
    assert row.created_utc_ms == row.updated_utc_ms == now and kept.read("runs").where("status = 'ok'").count() == 3
    assert kept.counts().where("name = 'hourly'").first().rows == 24
    held = runs.Lock(str(tmp_path), "tick")
    assert held.acquire() and [x[0] for x in runs.locks(str(tmp_path))] == ["tick"]
    with pytest.raises(RuntimeError):
        runs.run_tick(kept, e, windows(spark), now, str(tmp_path))
    old = runs.Lock(str(tmp_path), "old", ttl=-1)
    assert old.acquire() and runs.purge(str(tmp_path)) == 1 and held.release()
    assert sum(runs.Lock(str(tmp_path), "x").acquire() for _ in range(3)) == 1


def test_buckets_give_what_one_window_gives(spark):
    rng = random.Random(7)
    rows = [(f"{i:04}", H + rng.choice([0, 400, 3_600_000, 90_000_000]) * rng.randrange(9) + rng.randrange(3), rng.choice("abc")) for i in range(400)]
    e = spark.createDataFrame([(i, t, k, "keyboard", "w") for i, t, k in rows], "id string, ts_utc long, k string, monitor string, subject_id string")
    was, gaps, starts = {}, {}, {}
    for i, t, k in sorted(rows, key=lambda r: (r[1], r[0])):
        gaps[i] = t - was[k][0] if k in was else None
        starts[i] = was[k][1] if k in was and gaps[i] <= 500 else t
        was[k] = (t, starts[i])
    assert {r.id: r.gap for r in dynamics.gaps(e, "k").collect()} == gaps
    assert {r.id: r.island for r in dynamics.islands(e, "k", 500).collect()} == starts
    for span in (2, 401):
        want = []
        for k in "abc":
            last = None
            for t in sorted(r[1] for r in rows if r[2] == k):
                if last is None or t - last >= span:
                    want.append((k, last := t))
        assert sorted((r.k, r.ts_utc) for r in dynamics.dedupe_within(e, "k", span=span).collect()) == sorted(want)


def test_small_helpers(spark):
    e = spark.createDataFrame([("1", '{"a":"secret"}'), ("2", "{}"), ("3", None)], "id string, attrs_json string")
    assert sorted(r.id for r in source.reject_plaintext(e, ["secret"]).collect()) == ["2", "3"]
    got = spark.createDataFrame([("01ARZ3NDEKTSV4RRFFQ69G5FAV", "AB", "ab"), ("81ARZ3NDEKTSV4RRFFQ69G5FAV", "a", "b")], "u string, a string, b string").select(scalars.valid_ulid(F.col("u")).alias("u"), scalars.same_digest(F.col("a"), F.col("b")).alias("s")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False)]
    dim = lambda *rows: spark.createDataFrame(list(rows), "k string, first_seen_utc long, last_seen_utc long")
    assert sorted(tuple(r) for r in upsert.merge_dimension(dim(("a", 5, 9)), dim(("a", 7, 12), ("b", 1, 1)), "k").collect()) == [("a", 5, 12), ("b", 1, 1)]
    files = spark.sql("SELECT 'x' AS path, timestamp'2024-01-01' AS modified, 1L AS size UNION ALL SELECT 'y', timestamp'2024-01-09', 1L")
    import datetime

    assert [r.path for r in retention.expired(files, datetime.datetime(2024, 1, 10), 5).collect()] == ["x"]


def test_dimension_keeps_ids_and_fills(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id string, ts_utc long, k string, exe_name string, ext string")
    first = upsert.get_or_create(rows(("1", 5, "a", "x", ""), ("2", 6, "a", None, "txt"), ("3", 7, None, "y", "z")), None, ["k"], ("exe_name",), ("ext",))
    known = first.withColumn("id", F.lit("own"))
    got = {r.k: tuple(r) for r in upsert.get_or_create(rows(("4", 9, "a", "new", "md"), ("5", 9, "b", None, None), ("6", 8, "b", "q", "")), known, ["k"], ("exe_name",), ("ext",)).collect()}
    assert got["a"] == ("own", "a", "new", "txt", 5, 9)
    assert got["b"] == (hashlib.sha256(b"b").hexdigest()[:32], "b", "q", None, 8, 9) and len(got) == 2
    assert upsert.get_or_create(rows().limit(0), known, ["k"], ("exe_name",), ("ext",)).count() == 1
    ids = upsert.with_ids(rows(("7", 1, "a", None, None), ("8", 1, None, None, None)), known, ["k"], "app_id")
    assert sorted((r.id, r.app_id) for r in ids.collect()) == [("7", "own"), ("8", None)]


def test_idle_snapshots_by_hand(spark):
    e = frame(spark, [("a", H, "active_window", "w"), ("b", H + 1000, "keyboard", None), ("c", H + 5000, "heartbeat", None), ("d", H + 9000, "mouse", None), ("e", H + 9500, "active_window", "w")])
    got = sorted((r.ts_utc - H, r.trigger, r.id, r.since_ms) for r in dynamics.idle_snapshots(e, 7000).collect())
    assert got == [(0, "foreground", "a", None), (8000, "idle_gap", "b", 8000), (9500, "foreground", "e", 1500)]


def test_views_of_a_store(spark, tmp_path):
    kept = store.Store(spark, f"file://{tmp_path}/s")
    assert views.last_run(kept) == "null" and views.missing(kept).count() == len(store.TABLES)
    assert views.seed(kept, "r", 1) == {"inserts": 14, "updates": 0, "unchanged": 0}
    assert views.seed(kept, "q", 2) == {"inserts": 0, "updates": 0, "unchanged": 14}
    assert [r.name for r in views.tables(kept, "%catalog").collect()] == ["metric_catalog", "rule_catalog"]
    (tmp_path / "locks").mkdir()
    e = changes(spark, [(60_000, "w1"), (90_000, "w2")])
    runs.run_tick(kept, e, windows(spark), H + HOUR + 600_000, str(tmp_path / "locks"), 2, code="abc")
    last = json.loads(views.last_run(kept))
    assert list(last) == sorted(last) and (last["status"], last["code_git_sha"]) == ("ok", "abc")
    assert "focus_minutes" in views.show(kept, "hourly_report", H) and views.show(kept, "hourly_report", 1) is None and views.show(kept, "daily_report", H) is None


def test_iso_times(spark):
    got = spark.createDataFrame([(0,), (1_704_067_200_123,), (1_704_153_599_000,)], "t long").select(scalars.iso_utc(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == ["1970-01-01T00:00:00+00:00", "2024-01-01T00:00:00.123000+00:00", "2024-01-01T23:59:59+00:00"]
