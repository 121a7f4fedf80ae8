"""Runs, locks and the tick that brings summaries, advice and digests up to date."""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import DAY, HOUR
from strandline.operators import advice, metrics, render, sessions
from strandline.plans.store import Store, recompute_days, recompute_hours
from strandline.sources import sinks

#: Times of the day between which a tick rolls up the day before.
DAILY_FROM, DAILY_UNTIL = 300_000, 3_600_000
PARAMETERS = ("since", "until", "grace_minutes", "idle_mode", "recompute", "code_version")


@dataclass
class Run:
    """One run: partial until it is finished as ok, partial or failed."""

    parameters: dict
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    started: int = field(default_factory=lambda: int(time.time() * 1000))
    finished: int | None = None
    status: str = "partial"

    def finish(self, status: str) -> "Run":
        if status not in ("ok", "partial", "failed"):
            raise ValueError(f"no status of a run: {status}")
        self.status, self.finished = status, int(time.time() * 1000)
        return self

    def row(self) -> tuple:
        """Id, times, parameters as sorted compact JSON with all known names, status."""
        named = {k: self.parameters.get(k) for k in PARAMETERS}
        return self.run_id, self.started, self.finished, json.dumps(named, sort_keys=True, separators=(",", ":")), self.status


class Lock:
    """A named lock in a folder of the driver, free again after ``ttl`` seconds."""

    def __init__(self, folder: str, name: str, ttl: float = 300.0):
        self.path, self.ttl, self.token = os.path.join(folder, f"{name}.lock"), ttl, uuid.uuid4().hex

    def owner(self) -> str | None:
        try:
            with open(self.path) as f:
                token, until = f.read().split()
        except (FileNotFoundError, ValueError):
            return None
        return token if float(until) > time.time() else None

    def acquire(self) -> bool:
        if self.owner() is None and os.path.exists(self.path):
            # of several drivers that see it expired, one can rename it away
            aside = f"{self.path}.{self.token}"
            try:
                os.rename(self.path, aside)
            except FileNotFoundError:
                return False
            with open(aside) as f:
                fresh = f.read().split()
            if len(fresh) == 2 and float(fresh[1]) > time.time():  # another one was faster
                try:
                    os.link(aside, self.path)
                except FileExistsError:
                    pass
                os.remove(aside)
                return False
            os.remove(aside)
        try:
            fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(fd, "w") as f:
            f.write(f"{self.token} {time.time() + self.ttl}")
        return True

    def renew(self) -> bool:
        """Hold it for another ``ttl`` seconds, if it is still this one's."""
        return self._swap(f"{self.token} {time.time() + self.ttl}")

    def release(self) -> bool:
        """Give it up, if it is still this one's."""
        return self._swap(None)

    def _swap(self, content: str | None) -> bool:
        """Take the file away, look whose it is, and put a new or the same one back.

        A rename is one step, so the file that is looked at is the one that
        was there, and another's lock comes back as it was."""
        if self.owner() != self.token:
            return False
        aside = f"{self.path}.{self.token}"
        try:
            os.rename(self.path, aside)
        except FileNotFoundError:
            return False
        with open(aside) as f:
            found = f.read()
        mine = found.split()[:1] == [self.token] and float(found.split()[1]) > time.time()
        if mine and content is not None:
            with open(aside, "w") as f:
                f.write(content)
        if content is not None or not mine:
            try:
                os.link(aside, self.path)
            except FileExistsError:  # taken meanwhile
                mine = False
        os.remove(aside)
        return mine


def locks(folder: str) -> list[tuple[str, str, float]]:
    """(name, owner, seconds left) of the locks of a folder that are held."""
    found = []
    for name in sorted(os.listdir(folder)):
        if name.endswith(".lock"):
            with open(os.path.join(folder, name)) as f:
                token, until = f.read().split()
            if float(until) > time.time():
                found.append((name[:-5], token, float(until) - time.time()))
    return found


def purge(folder: str) -> int:
    """Remove the expired locks of a folder; how many."""
    held, n = {f"{k}.lock" for k, _, _ in locks(folder)}, 0
    for name in os.listdir(folder):
        if name.endswith(".lock") and name not in held:
            os.remove(os.path.join(folder, name))
            n += 1
    return n


def run_tick(store: Store, events: DataFrame, windows: DataFrame, now: int, folder: str, backfill_hours: int = 6, grace_minutes: int = 5, idle_ms: int = sessions.IDLE_MS, do_daily: bool | None = None, code: str | None = None) -> dict[str, int]:
    """Bring the stored tables up to date for the closed hours of the last
    ``backfill_hours``, and for days; counters.

    ``do_daily`` rolls up the days of these hours, and False none.  Without it
    the day before is rolled up by the ticks from 5 minutes to an hour after
    midnight UTC, when its last hour is closed.

    One driver at a time: the lock ``tick`` in ``folder`` is held meanwhile.
    Hours are summarised and stored, those whose hashes still differ are
    computed anew, and advice, reports and digests follow from what is
    stored.  The run is logged as ok or failed.  A second tick with the same
    input changes nothing."""
    start, end = (now - backfill_hours * HOUR) // HOUR * HOUR, (now - grace_minutes * 60_000) // HOUR * HOUR
    examined = -(-now // HOUR) - start // HOUR
    out = {"hours_examined": examined, "skipped_open_hours": examined - max(0, end - start) // HOUR}
    out["hours_recomputed"] = 0
    out |= {f"{x}_{y}": 0 for x in ("hour", "hour_advice", "hour_report", "hour_digest", "day", "day_advice", "day_report", "day_digest") for y in ("inserts", "updates")}
    if end <= start:
        return out
    lock = Lock(folder, "tick", (backfill_hours * 60 + grace_minutes + 5) * 60)
    if not lock.acquire():
        raise RuntimeError("another tick holds the lock")
    run = Run({"since": start, "until": end, "grace_minutes": grace_minutes, "code_version": code})
    try:
        def put(kind: str, table: str, rows: DataFrame) -> None:
            made = store.upsert(table, rows, run.run_id, now)
            for k in ("inserts", "updates"):
                out[f"{kind}_{k}"] += made[k]

        inside = lambda name, period: store.read(name, start, end)
        parts = sinks.scratch_table(sessions.by_hour(sessions.focus_sessions(events, windows, start, end, idle_ms)), "tick-parts")
        put("hour", "hourly", metrics.hourly_of_parts(events, parts, start, end, code))
        store.upsert("evidence", sessions.evidence(sessions.top_apps(parts)), run.run_id, now)
        sinks.release(store.spark, parts)
        hashes = metrics.input_hashes(events, sessions.hour_grid(store.spark, start, end), code)
        out["hours_recomputed"] = recompute_hours(store, events, windows, metrics.hour_mismatches(hashes, inside("hourly", "hour_ms")), idle_ms, run.run_id, now, code)["hours_examined"]
        hourly, proof = inside("hourly", "hour_ms"), inside("evidence", "hour_ms")
        proof = store.spark.createDataFrame([], "hour_ms long, evidence_json string") if proof is None else proof.select("hour_ms", "evidence_json")
        put("hour_advice", "hourly_advice", advice.hourly_advice(hourly, proof))
        put("hour_report", "hourly_report", render.hourly_report(hourly, proof))
        told = inside("hourly_advice", "hour_ms")
        put("hour_digest", "hourly_digest", render.hourly_digest(hourly, proof, advice.hourly_advice(hourly, proof) if told is None else told))
        days = None
        if do_daily:
            days = hourly.select((F.floor(F.col("hour_ms") / F.lit(float(DAY))) * DAY).cast("long").alias("day_ms")).distinct()
        elif do_daily is None and DAILY_FROM <= now % DAY < DAILY_UNTIL:
            days = store.spark.createDataFrame([(now // DAY * DAY - DAY,)], "day_ms long")
        if days is not None:
            made = recompute_days(store, days, run.run_id, now, code)
            out["day_inserts"], out["day_updates"] = made["inserts"], made["updates"]
            daily = store.read("daily")
            if daily is not None:
                daily = daily.join(days, "day_ms", "left_semi")
                put("day_advice", "daily_advice", advice.daily_advice(daily))
                put("day_report", "daily_report", render.daily_report(daily))
                told = store.read("daily_advice")
                told = advice.daily_advice(daily) if told is None else told.join(days, "day_ms", "left_semi")
                put("day_digest", "daily_digest", render.daily_digest(daily, told))
        run.finish("ok")
    except Exception:
        run.finish("failed")
        raise
    finally:
        lock.release()
        store.upsert("runs", store.spark.createDataFrame([run.row()], "run string, started long, finished long, parameters string, status string"), run.run_id, now)
    return out
