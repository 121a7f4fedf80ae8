"""Greedy segmentation against plain loops, with runs that no task holds."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from strandline.operators import dynamics, segments

T0 = 1_704_067_200_000
ROWS = "k string, id string, ts_utc long, kind string, note string"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS).repartition(4)


def random_rows(seed, n, keys="abc"):
    rng, at, out = random.Random(seed), T0, []
    for i in range(n):
        at += rng.choice([0, 0, 3, 20, 40, 60, 90, 120, 501, 2500 if rng.random() < 0.3 else 1, 70_000 if rng.random() < 0.1 else 1])
        key = rng.choice(keys)
        out.append((None if key == "_" else key, f"{i:05}", at, rng.choice(["keydown", "keydown", "keyup"]), f"n{i}"))
    return out


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        groups.setdefault(r[0], []).append(r)
    return groups


def plain_dedupe(rows, span):
    out = []
    for own in by_key(rows).values():
        last = None
        for r in own:
            if last is None or r[2] - last >= span:
                out.append(r)
                last = r[2]
    return sorted(out, key=lambda r: r[1])


def plain_burst_ends(rows, span, keys):
    out = []
    for own in by_key(rows).values():
        held = []
        for r in own:
            held = [t for t in held if t >= r[2] - span] + [r[2]]
            if len(held) >= keys:
                out.append(r)
                held = []
    return sorted(out, key=lambda r: r[1])


def plain_batches(rows, n, span):
    out = {}
    for own in by_key(rows).values():
        opened = None
        for i, r in enumerate(own):
            if opened is None or i - opened >= n or (span is not None and r[2] - own[opened][2] >= span):
                opened = i
            out[r[1]] = opened
    return out


def plain_p95(x):
    x = sorted(x)
    k = (len(x) - 1) * 0.95
    return x[int(k)] + (x[min(int(k) + 1, len(x) - 1)] - x[int(k)]) * (k - int(k)) if x else 0.0


def plain_keyboard(rows, n, span):
    batch = plain_batches(rows, n, span)
    out = {}
    for key, own in by_key(rows).items():
        last, held = None, []
        for r in own:
            s = out.setdefault((key, batch[r[1]]), [0, 0, 0, []])
            if r[3] == "keyup":
                s[1] += 1
                continue
            s[0] += 1
            if last is not None:
                s[3].append(r[2] - last)
            last = r[2]
            held = [t for t in held if t >= r[2] - 500] + [r[2]]
            if len(held) >= 5:
                s[2] += 1
                held = []
    return {k: (d, u, b, round(statistics.mean(x), 6) if x else 0.0, round(plain_p95(x), 6), round(statistics.stdev(x), 6) if len(x) > 1 else 0.0) for k, (d, u, b, x) in out.items()}


def tuples(df):
    return sorted((tuple(r) for r in df.select("k", "id", "ts_utc", "kind", "note").collect()), key=lambda r: r[1])


@pytest.fixture(params=[(60_000, 10_000), (300, 7)], ids=["wide", "narrow"])
def sizes(request, monkeypatch):
    """Buckets as they are, and so narrow that every run crosses many."""
    monkeypatch.setattr(segments, "BUCKET_MS", request.param[0])
    monkeypatch.setattr(segments, "PLACES", request.param[1])
    monkeypatch.setattr(segments.places, "__defaults__", ("ts_utc", "id", request.param[0]))
    monkeypatch.setattr(segments.spaced, "__defaults__", (None, request.param[0]))


def test_rows_of_all_kinds(spark, sizes):
    rows = random_rows(3, 500, "abc_")
    e = frame(spark, rows)
    assert tuples(dynamics.dedupe_within(e, "k", span=5000)) == plain_dedupe(rows, 5000)
    assert tuples(dynamics.burst_ends(e, "k")) == plain_burst_ends(rows, 500, 5)
    want = {}
    for r in plain_burst_ends(rows, 500, 5):
        want[r[0]] = want.get(r[0], 0) + 1
    assert {r.k: r.bursts for r in dynamics.bursts(e, "k").collect()} == {k: want.get(k, 0) for k in {r[0] for r in rows}}
    assert {r.id: r.batch for r in dynamics.batches(e, "k", 6, 1500).collect()} == plain_batches(rows, 6, 1500)
    rows = random_rows(5, 400, "a_")
    got = {(r.k, r.batch): (r.keydown, r.keyup, r.bursts, round(r.mean_ms, 6), round(r.p95_ms, 6), round(r.stdev_ms, 6)) for r in dynamics.keyboard_batches(frame(spark, rows), "k", 16, 1500).collect()}
    want = plain_keyboard(rows, 16, 1500)
    assert got == want and sum(v[2] for v in got.values()) > 10


def test_intervals_and_bursts_go_over_the_turn_of_a_batch(spark):
    rows = [("a", f"{i}", T0 + 100 * i, "keydown", "") for i in range(8)] + [("a", "9", T0 + 750, "keyup", "")]
    got = sorted(tuple(r)[1:] for r in dynamics.keyboard_batches(frame(spark, rows), "k", 3, None).collect())
    assert got == [(0, 3, 0, 100.0, 100.0, 0.0, 0), (3, 3, 0, 100.0, 100.0, 0.0, 1), (6, 2, 1, 100.0, 100.0, 0.0, 0)]


def test_few_rows(spark):
    none = frame(spark, [])
    assert dynamics.dedupe_within(none, "k").collect() == [] and dynamics.bursts(none, "k").collect() == [] and dynamics.batches(none, "k", 3, 10).collect() == []
    one = [("a", "1", T0, "keydown", "n")]
    assert tuples(dynamics.dedupe_within(frame(spark, one), "k")) == one
    assert [tuple(r)[1:] for r in dynamics.keyboard_batches(frame(spark, one), "k").collect()] == [(0, 1, 0, 0.0, 0.0, 0.0, 0)]


def test_a_long_run_meets_in_no_task(spark, monkeypatch):
    """One run of 60,000 rows without a gap: no window holds more than a bucket of it."""
    n = 60_000
    rows = spark.range(n).select(F.lit("a").alias("k"), F.format_string("%06d", "id").alias("id"), (F.col("id") * 3 + T0).alias("ts_utc"))
    monkeypatch.setattr(segments.places, "__defaults__", ("ts_utc", "id", 6000))
    monkeypatch.setattr(segments.spaced, "__defaults__", (None, 6000))
    monkeypatch.setattr(segments, "PLACES", 3000)
    kept = sorted(r.ts_utc - T0 for r in dynamics.dedupe_within(rows, "k", span=5000).collect())
    want, last = [], None
    for t in range(0, 3 * n, 3):
        if last is None or t - last >= 5000:
            want.append(last := t)
    assert kept == want
    placed = segments.places(rows, "k")
    assert placed.agg(F.count_distinct("_pos"), F.max("_pos")).first()[:] == (n, n - 1)
    asked = segments.first_from(placed.select("k", "_pos", F.col("ts_utc").alias("_at")), "k", "_at", 5000, 6000)
    assert asked.where(F.col("_next") != F.least(F.col("_pos") + 1667, F.lit(n))).count() == 0
    assert dynamics.bursts(rows, "k").first().bursts == n // 5


def plain_mouse(rows, n, span):
    rows = [r for r in rows if r[3] in dynamics.MOUSE]
    batch, out = plain_batches([r[:5] for r in rows], n, span), {}
    for key, own in by_key(rows).items():
        last = {}
        for r in own:
            s = out.setdefault((key, batch[r[1]]), dict.fromkeys([*dynamics.MOUSE.values(), "distance_px"], 0))
            s[dynamics.MOUSE[r[3]]] += 1
            if r[3] == "move":
                x, y = int(r[4]), int(r[4]) * 2
                if batch[r[1]] in last:
                    a, b = last[batch[r[1]]]
                    s["distance_px"] += int(((x - a) ** 2 + (y - b) ** 2) ** 0.5)
                last[batch[r[1]]] = (x, y)
    return {k: tuple(v.values()) for k, v in out.items()}


def test_mouse_batches_by_button(spark):
    rng = random.Random(8)
    rows = [(r[0], r[1], r[2], rng.choice(["move", "move", "left", "right", "middle", "scroll", "release"]), str(rng.randrange(500))) for r in random_rows(9, 400, "a_")]
    e = frame(spark, rows).withColumn("x", F.col("note").cast("double")).withColumn("y", F.col("x") * 2)
    got = {(r.k, r.batch): tuple(r)[2:] for r in dynamics.mouse_batches(e, "k", 16, 1500).collect()}
    assert got == plain_mouse(rows, 16, 1500)


def test_counters_by_action(spark):
    rng = random.Random(6)
    kinds = [(m, a) for m, actions in dynamics.COUNTERS.values() for a in actions] + [("mouse", "other"), ("browser", "click"), ("keyboard", None)]
    rows = [(k, f"{i:04}", T0 + rng.randrange(9_000_000), *rng.choice(kinds)) for i in range(500) for k in rng.choice("ab")]
    triggers = [(k, T0 + t) for k in "ab" for t in sorted(rng.sample(range(9_000_000), 12))]
    e = spark.createDataFrame(rows, "k string, id string, ts_utc long, monitor string, action string")
    got = {(r.k, r.ts_utc): tuple(r)[2:] for r in dynamics.counters_since(e, spark.createDataFrame(triggers, "k string, ts_utc long"), "k").collect()}
    want = {}
    for k, t in triggers:
        since = max((u for j, u in triggers if j == k and u < t), default=-1)
        own = [r for r in rows if r[0] == k and since < r[2] <= t]
        want[(k, t)] = tuple(sum(r[3] == m and r[4] in actions for r in own) for m, actions in dynamics.COUNTERS.values())
    assert got == want


def test_journal_rolls_over_by_bytes(spark, tmp_path):
    import gzip
    import json

    from strandline.sources import sinks

    rng = random.Random(2)
    rows = [(f"{i:05}", T0 + i * 40_000, ("keyboard", "mouse")[i % 2], "p" * rng.randrange(200)) for i in range(600)]
    e = spark.createDataFrame(rows, "id string, ts_utc long, monitor string, pad string").repartition(5)
    got = sinks.spool_journal(e, f"file://{tmp_path}/spool", 2000)
    want, sizes = [], {}
    for i, t, m, pad in rows:
        line = json.dumps({"id": i, "ts_utc": t, "monitor": m, "pad": pad}, separators=(",", ":"))
        key = (m, t // 3_600_000)
        if key not in sizes or sizes[key] >= 2000:
            sizes[key] = 0
            want.append((key, []))
        sizes[key] += len(line) + 1
        next(f for k, f in reversed(want) if k == key).append(line)
    files = [p for p in (tmp_path / "spool").rglob("*.ndjson.gz")]
    read = sorted(gzip.decompress(p.read_bytes()).decode().splitlines() for p in files)
    assert read == sorted(f for _, f in want)
    assert got == {"files": len(want), "rows": 600, "bytes": sum(len(x) + 1 for f in read for x in f)} and len(want) > 30
    assert sinks.spool_journal(e.limit(0), f"file://{tmp_path}/none", 2000) == {"files": 0, "rows": 0, "bytes": 0}
