"""Late data: the hours and days that new events touch, and nothing else, are computed anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.functions.scalars import DAY, HOUR
from strandline.operators.sessions import IDLE_MS, closed_hours
from strandline.plans.store import Store, recompute_days, recompute_hours
from strandline.sources import events as source
from strandline.sources.eventstore import EventStore, insert_again

MARK = "reconciled"


def touched_hours(rows: DataFrame) -> DataFrame:
    """(hour_ms) of the hours that hold a row."""
    return rows.select((F.floor(F.col("ts_utc") / F.lit(float(HOUR))).cast("long") * HOUR).alias("hour_ms")).distinct()


def reconcile_commits(events: EventStore, results: Store, windows: DataFrame, now: int, run_id: str, idle_ms: int = IDLE_MS, grace_minutes: int = 5, code: str | None = None, at: Callable[[str], None] = lambda step: None) -> dict[str, int]:
    """Bring the stored hours and days up to date with the commits of the event store that aren't
    reconciled yet; how many of each were looked at and changed.

    The commits' own rows name the hours, so nothing else is read but the parts
    of the store that hold these hours.  A commit is marked when all of its hours are closed
    and stored; one with an open hour waits for a later call, which looks at
    its hours again.  A call that stops before the marks is made good by the
    next one, as equal rows are stored unchanged."""
    out = {"commits": 0, "hours_examined": 0, "hour_inserts": 0, "hour_updates": 0, "days_examined": 0, "day_inserts": 0, "day_updates": 0}
    entries = events.unmarked(MARK)
    if not entries:
        return out
    hours = closed_hours(touched_hours(events.rows_of(entries)), now, grace_minutes)
    first, last = hours.agg(F.min("hour_ms"), F.max("hour_ms")).first()
    at("hours")
    if first is not None:
        made = recompute_hours(results, events.read(first, last + HOUR), windows, hours, idle_ms, run_id, now, code)
        out |= {"hours_examined": made["hours_examined"], "hour_inserts": made["inserts"], "hour_updates": made["updates"]}
        at("days")
        days = hours.select((F.floor(F.col("hour_ms") / F.lit(float(DAY))).cast("long") * DAY).alias("day_ms")).distinct()
        made = recompute_days(results, days, run_id, now, code)
        out |= {"days_examined": made["days_examined"], "day_inserts": made["inserts"], "day_updates": made["updates"]}
    at("marks")
    done = [e["commit"] for e in entries if (e["last_ts"] // HOUR + 1) * HOUR + grace_minutes * 60_000 <= now]
    events.mark(MARK, done)
    return out | {"commits": len(done)}


def reconcile_stream(lines: DataFrame, events: EventStore, results: Store, windows: DataFrame, clock: Callable[[], int], checkpoint: str, idle_ms: int = IDLE_MS, grace_minutes: int = 5, code: str | None = None) -> StreamingQuery:
    """Journal lines as they come: each batch's new events are stored, and the hours and days that they touch follow.

    A batch that is run again adds no event, and finishes what the stopped one left."""

    def batch(df: DataFrame, number: int) -> None:
        valid, _ = source.split_valid(source.parse_lines(df))
        insert_again(events, valid, facts={"batch": number})
        reconcile_commits(events, results, windows, clock(), f"batch-{number}", idle_ms, grace_minutes, code)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
