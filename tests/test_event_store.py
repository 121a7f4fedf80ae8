"""The event store and the import: every id once, whatever stops a run and wherever."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import retention
from strandline.sources import events as source
from strandline.sources import eventstore, importer
from strandline.sources.eventstore import ConflictError, EventStore, insert_again
from strandline.streaming import ingest

DAY = 86_400_000
T0 = 1_704_067_200_000
SCHEMA = "id string, ts_utc long, monitor string, note string"


class Stop(Exception):
    pass


def stop_at(name, nth=1):
    """A step that fails when ``name`` comes for the nth time."""
    seen = []

    def at(step):
        if step == name:
            seen.append(step)
            if len(seen) == nth:
                raise Stop(name)

    return at


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def stored(store, *columns):
    rows = store.read()
    return [] if rows is None else sorted(tuple(r) for r in rows.select(*(columns or ("id", "ts_utc", "monitor", "note"))).collect())


def line(monitor, **k):
    return json.dumps({"id": "x", "ts_utc": T0, "monitor": monitor, "action": "a", "subject_type": "none", "session_id": "s", **k})


def lines(n, monitor="keyboard", first=0):
    return [line(monitor, id=f"{monitor}{i}", ts_utc=T0 + i * 1000) for i in range(first, first + n)]


def pack(path, *members, cut=0):
    """A journal file of gzip members, each of some lines."""
    path.parent.mkdir(parents=True, exist_ok=True)
    raw = b"".join(gzip.compress(("\n".join(m) + "\n").encode()) for m in members)
    path.write_bytes(raw[: len(raw) - cut])


def counts(stats):
    return {r.monitor: tuple(r)[1:] for r in stats.collect()}


def test_an_id_is_stored_once_over_days_and_commits(spark, tmp_path):
    store = EventStore(spark, f"file://{tmp_path}/s", buckets=3, segments=2)
    assert store.read() is None
    first = [(f"i{k}", T0 + k * DAY, "mouse", "a") for k in range(40)]
    entry = store.insert(batch(spark, [*first, *first, ("i3", T0 + 2 * DAY, "mouse", "earlier"), ("i4", T0 + 4 * DAY, "mouse", "Z"), (None, T0, "mouse", "no id")]))
    assert (entry["events"], entry["first_ts"], entry["last_ts"]) == (40, T0, T0 + 39 * DAY)
    want = {r[0]: r for r in first} | {"i3": ("i3", T0 + 2 * DAY, "mouse", "earlier"), "i4": ("i4", T0 + 4 * DAY, "mouse", "Z")}
    assert stored(store) == sorted(want.values())
    later = [(f"i{k}", T0 + 99 * DAY, "mouse", "again") for k in range(30, 50)]
    assert store.insert(batch(spark, later), by="note")["added"] == {"again": 10}
    assert stored(store) == sorted([*want.values(), *later[10:]])
    assert store.insert(batch(spark, later))["events"] == 0
    assert store.insert(batch(spark, []))["events"] == 0
    assert sorted(r.id for r in store.read(T0 + 38 * DAY, T0 + 99 * DAY).collect()) == ["i38", "i39"]
    assert store.read(T0 + 200 * DAY) is None
    assert len(EventStore(spark, f"file://{tmp_path}/s", buckets=99).log()) == 4 and EventStore(spark, f"file://{tmp_path}/s").buckets == 3


def test_filters_hold_every_id_and_few_others(spark, tmp_path):
    store = EventStore(spark, f"file://{tmp_path}/s", buckets=2, segments=1)
    ids = spark.range(5000).select(F.concat(F.lit("id"), "id").alias("id"), (F.col("id") + T0).alias("ts_utc"))
    entry = store.insert(ids)
    asked = spark.range(10_000).select(F.concat(F.lit("id"), "id").alias("id"), (F.col("id") < 5000).alias("known"))
    marked = store._maybe(store._placed(asked, entry["segments"]), store._commits(store.log()))
    got = {(r.known, r._maybe): r["count"] for r in marked.groupBy("known", "_maybe").count().collect()}
    assert got.get((True, False), 0) == 0 and got[(True, True)] == 5000
    assert got.get((False, True), 0) < 100


def test_the_filter_grows_and_is_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(eventstore, "SEGMENT_IDS", 20)
    monkeypatch.setattr(eventstore, "MOST_FILTERS", 2)
    store = EventStore(spark, f"file://{tmp_path}/s", buckets=1, segments=1)
    rng, seen = random.Random(4), {}
    for turn in range(7):
        rows = [(f"i{rng.randrange(120)}", T0 + rng.randrange(9) * DAY, "m", str(turn)) for _ in range(25)]
        fresh = {}
        for r in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
            fresh.setdefault(r[0], r)
        entry = store.insert(batch(spark, rows))
        assert entry["events"] == len(set(fresh) - set(seen))
        seen = {**fresh, **seen}
    log = store.log()
    assert log[-1]["segments"] > 1 and sum(e["whole_filter"] for e in log) >= 3
    assert stored(store) == sorted(seen.values())


@pytest.mark.parametrize("step", ["begin", "stage", "events", "filter", "commit", "done"])
def test_a_stopped_insert_is_whole_or_nothing(spark, tmp_path, step):
    store = EventStore(spark, f"file://{tmp_path}/s")
    rows = [(f"i{k}", T0 + k * DAY, "m", "a") for k in range(20)]
    store.insert(batch(spark, rows[:5]))
    with pytest.raises(Stop):
        store.insert(batch(spark, rows), at=stop_at(step))
    assert stored(store) == sorted(rows if step == "done" else rows[:5])
    store.insert(batch(spark, rows))
    assert stored(store) == sorted(rows)
    store.vacuum()
    assert stored(store) == sorted(rows) and store.insert(batch(spark, rows))["events"] == 0
    assert store.vacuum() >= 0


def test_two_writers_lose_and_double_nothing(spark, tmp_path):
    a, b = EventStore(spark, f"file://{tmp_path}/s"), EventStore(spark, f"file://{tmp_path}/s")
    mine, theirs = [(f"i{k}", T0, "m", "a") for k in range(10)], [(f"i{k}", T0 + DAY, "m", "b") for k in range(5, 15)]

    def meanwhile(step):
        if step == "commit" and not b.log():
            b.insert(batch(spark, theirs))

    with pytest.raises(ConflictError):
        a.insert(batch(spark, mine), at=meanwhile)
    assert insert_again(a, batch(spark, mine))["events"] == 5
    assert sorted(r[0] for r in stored(a, "id")) == sorted({r[0] for r in mine + theirs})


def test_import_counts_archives_and_marks(spark, tmp_path):
    spool, store = tmp_path / "spool", EventStore(spark, f"file://{tmp_path}/s")
    pack(spool / "keyboard" / "a.ndjson.gz", lines(40), [*lines(5), "no json", "", '{"id": 1}'])
    pack(spool / "keyboard" / "b.ndjson.gz", lines(300), cut=30)
    pack(spool / "keyboard" / "c.ndjson.gz", lines(9, first=900), lines(9, first=950), cut=12)  # its second member is cut
    pack(spool / "keyboard" / "d.ndjson.gz", ["only", "words"])
    (spool / "keyboard" / "e.ndjson.gz").write_bytes(gzip.compress(b"\xff\xfe{}\n"))
    (spool / "keyboard" / "f.ndjson.gz").write_bytes(b"")
    (spool / "keyboard" / "g.ndjson.gz").write_bytes(gzip.compress(lines(1, first=70)[0].encode()) + b"\0" * 9)
    pack(spool / "mouse" / "a.ndjson.gz", lines(10, "mouse"))
    pack(spool / "other" / "a.ndjson.gz", lines(10, "mouse"))
    pack(spool / "_done" / "mouse" / "a.ndjson.gz", lines(1, "mouse"))
    stats = importer.import_journal(spark, f"file://{spool}", store)
    assert counts(stats) == {"keyboard": (2, 41, 5, 1, 4), "mouse": (1, 10, 0, 0, 0)}
    assert tuple(importer.overall(stats, 30.0).first()) == (2, 3, 51, 5, 1, 4, 102.0)
    left = sorted(p.name for p in (spool / "keyboard").iterdir() if not p.name.startswith("."))
    assert left == sorted([*(f"{x}.ndjson.gz{y}" for x in "bcde" for y in ("", ".error")), "f.ndjson.gz"])
    assert (spool / "_done" / "keyboard" / "a.ndjson.gz").exists() and (spool / "_done" / "mouse" / "a-1.ndjson.gz").exists()
    note = json.loads((spool / "keyboard" / "c.ndjson.gz.error").read_text())
    assert set(note) == {"error_message", "timestamp", "file_path"} and note["error_message"] == "truncated gzip"
    pack(spool / "keyboard" / "h.ndjson.gz", lines(45))
    assert counts(importer.import_journal(spark, f"file://{spool}", store))["keyboard"] == (1, 5, 40, 0, 4)
    assert json.loads((spool / "keyboard" / "c.ndjson.gz.error").read_text()) == note
    assert store.read().count() == 56 and store.files(archived=False) == []
    files = retention.list_files(spark, str(spool))
    assert files.where("path LIKE '%/_done/%'").count() == 5
    assert counts(importer.import_journal(spark, f"file://{spool}", store)) == {"keyboard": (0, 0, 0, 0, 4)}


def test_an_import_parses_each_line_once(spark, tmp_path, monkeypatch):
    spool, store, plans = tmp_path / "spool", EventStore(spark, f"file://{tmp_path}/s"), []
    pack(spool / "keyboard" / "a.ndjson.gz", lines(5))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(importer, "insert_again", lambda store, batch, **options: plans.append(plan(batch)) or insert_again(store, batch, **options))
    assert counts(importer.import_journal(spark, f"file://{spool}", store)) == {"keyboard": (1, 5, 0, 0, 0)}
    assert len(plans) == 1 and "parseJson" not in plans[0] and "parse_json" not in plans[0]
    once = plan(source.checked(source.unpacked(spark, f"file://{spool}/_done", done="")))
    assert once.count("parseJson") + once.count("parse_json") == 1


@pytest.mark.parametrize("step,nth", [("read", 1), ("sidecars", 1), ("stage", 1), ("events", 1), ("files", 1), ("commit", 1), ("done", 1), ("archive", 1), ("moved", 1), ("moved", 2)])
def test_an_import_that_stops_anywhere_can_be_run_again(spark, tmp_path, step, nth):
    spool, store = tmp_path / "spool", EventStore(spark, f"file://{tmp_path}/s")
    for k in range(3):
        pack(spool / "keyboard" / f"{k}.ndjson.gz", lines(20, first=15 * k))
    with pytest.raises(Stop):
        importer.import_journal(spark, f"file://{spool}", store, at=stop_at(step, nth))
    pack(spool / "keyboard" / "later.ndjson.gz", lines(20, first=40))
    importer.import_journal(spark, f"file://{spool}", store)
    assert sorted(r.id for r in store.read().collect()) == sorted(f"keyboard{i}" for i in range(60))
    assert sorted(p.name for p in (spool / "_done" / "keyboard").iterdir() if p.name.endswith("gz")) == ["0.ndjson.gz", "1.ndjson.gz", "2.ndjson.gz", "later.ndjson.gz"]
    assert not [p for p in (spool / "keyboard").iterdir() if p.name.endswith("gz")]


def test_ingest_again_adds_nothing(spark, tmp_path):
    pack(tmp_path / "in" / "keyboard" / "a.ndjson.gz", [*lines(30), '{"id":1}'])
    pack(tmp_path / "in" / "keyboard" / "b.ndjson.gz", [line("keyboard", id=f"keyboard{i}", ts_utc=T0 + 3 * DAY) for i in range(20, 40)])
    store, bad = EventStore(spark, f"file://{tmp_path}/s"), str(tmp_path / "bad")
    for turn in ("c1", "c2"):  # another checkpoint: the batches are run again
        ingest.ingest(ingest.journal_stream(spark, str(tmp_path / "in"), 1), store, bad, str(tmp_path / turn)).awaitTermination(300)
        assert sorted(r.id for r in store.read().collect()) == sorted(f"keyboard{i}" for i in range(40))
        assert spark.read.parquet(bad).count() == 1


def test_long_files_are_handed_on_in_pieces(spark, tmp_path):
    pad = "p" * 300
    pack(tmp_path / "mouse" / "a.ndjson.gz", [line("mouse", id=f"m{i}", pad=pad) for i in range(7000)], [line("mouse", id="last")])
    got = source.unpacked(spark, f"file://{tmp_path}")
    assert {(r.kind, r.n, r.last) for r in got.groupBy("kind").agg(F.count("*").alias("n"), F.max("line_no").alias("last")).collect()} == {("line", 7001, 7001), ("file", 1, 7001)}
