"""Stored results: tables that are brought up to date by key, and what was out of date."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.scalars import DAY, HOUR
from strandline.operators import metrics
from strandline.sources import sinks

#: Keys and compared values of each table.
TABLES = {
    "hourly": (["hour_ms", "metric_key"], ["value_num", "input_row_count", "coverage_ratio", "input_hash"]),
    "evidence": (["hour_ms"], ["evidence_json"]),
    "daily": (["day_ms", "metric_key"], ["value_num", "hours_counted", "low_conf_hours", "input_hash"]),
    "hourly_advice": (["hour_ms", "rule_key", "rule_version"], ["severity", "score", "advice_text", "evidence_json", "reason_json", "input_hash"]),
    "daily_advice": (["day_ms", "rule_key", "rule_version"], ["severity", "score", "advice_text", "evidence_json", "reason_json", "input_hash"]),
    "hourly_report": (["hour_ms"], ["txt", "json", "csv", "hour_hash", "sha256"]),
    "daily_report": (["day_ms"], ["txt", "json", "csv", "day_hash", "sha256"]),
    "hourly_digest": (["hour_ms"], ["txt", "json", "hour_hash", "sha256"]),
    "daily_digest": (["day_ms"], ["txt", "json", "day_hash", "sha256"]),
    "metric_catalog": (["metric_key"], ["unit", "version", "description"]),
    "rule_catalog": (["rule_key", "version"], ["title", "description"]),
    "runs": (["run"], ["started", "finished", "parameters", "status"]),
}
#: Manifests that are kept, so that a reader of an older version isn't cut off.
KEPT = 10
#: Writers that commit meanwhile, before an upsert gives up.
TRIES = 20
WHOLE = "all"


def scratch(spark: SparkSession) -> str:
    """A new folder for a store: in the shared folder of the session, or a local
    one of a session on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"{(base or 'file:///tmp/checkpoints/strandline').rstrip('/')}/store-{uuid.uuid4().hex}"
    sinks.remove_at_exit(spark, folder)
    return folder


def part_of(name: str) -> Column:
    """The part that a row of a table belongs to: hours by their day, days by their month."""
    period = TABLES[name][0][0]
    if period == "hour_ms":
        return F.date_format(F.timestamp_millis(period), "yyyy-MM-dd")
    return F.date_format(F.timestamp_millis(period), "yyyy-MM") if period == "day_ms" else F.lit(WHOLE)


class Store:
    """Tables in a folder, each a list of parts in a manifest.

    A change writes the parts it touches anew, beside the old ones, and counts
    from the moment the next manifest is there; a job that stops before leaves
    files that no manifest names.  Of two writers one publishes a version and
    the other compares with it again, so no row is lost."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _manifest(self, name: str) -> tuple[int, dict[str, str]]:
        """The latest version of a table, and the folder of each of its parts."""
        found = [c for c in sinks.children(self.spark, f"{self.folder}/{name}/versions") if c.endswith(".json")]
        if not found:
            return 0, {}
        return int(found[-1][:-5]), json.loads(sinks.read_small(self.spark, f"{self.folder}/{name}/versions/{found[-1]}"))

    def _rows(self, name: str, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{name}/{f}" for f in sorted(folders)]).drop("change")

    def read(self, name: str, since: int | None = None, until: int | None = None) -> DataFrame | None:
        """A table, or its rows of periods in [since, until), of which other parts aren't opened; None if it has none."""
        _, parts = self._manifest(name)
        period = TABLES[name][0][0] if name in TABLES else None
        if period in ("hour_ms", "day_ms"):
            text = lambda ms: None if ms is None else _day(ms)[: 10 if period == "hour_ms" else 7]
            low, high = text(since), text(None if until is None else until - 1)
            parts = {p: f for p, f in parts.items() if (low is None or p >= low) and (high is None or p <= high)}
        if not parts:
            return None
        rows = self._rows(name, list(parts.values()))
        if since is not None:
            rows = rows.where(F.col(period) >= since)
        return rows if until is None else rows.where(F.col(period) < until)

    def upsert(self, name: str, computed: DataFrame, run_id: str, now: int, at: Callable[[str], None] = lambda step: None) -> dict[str, int]:
        """Insert new keys and update rows whose values differ; how many of each.

        An updated row keeps ``created_utc_ms``; one that is as stored stays
        whole, with its run and times, and rows of other keys stay too.  ``computed``
        is worked out once.  Only the parts of its keys are read, and only those
        with a change are written anew.  ``at`` is called before each step."""
        keys, values = TABLES[name]
        stamped = computed.select(*keys, *values, F.lit(run_id).alias("run_id"), F.lit(now).cast("long").alias("created_utc_ms"), F.lit(now).cast("long").alias("updated_utc_ms"))
        token = uuid.uuid4().hex
        at("computed")
        work = f"{self.folder}/{name}/work-{token}"
        stamped.withColumn("part", part_of(name)).write.partitionBy("part").parquet(work)
        touched = [c[5:] for c in sinks.children(self.spark, work) if c.startswith("part=")]
        try:
            if not touched:
                return {"inserts": 0, "updates": 0, "unchanged": 0}
            fresh = self.spark.read.schema(stamped.schema).parquet(*[f"{work}/part={p}" for p in touched])
            for attempt in range(TRIES):
                made = self._merge(name, fresh, touched, f"data/{token}-{attempt}", at)
                if made is not None:
                    return made
            raise RuntimeError(f"{TRIES} other writers changed {name} meanwhile")
        finally:
            sinks.remove(self.spark, work)

    def _merge(self, name: str, fresh: DataFrame, touched: list[str], target: str, at: Callable[[str], None]) -> dict[str, int] | None:
        """One try; None if another writer published the version first."""
        keys, values = TABLES[name]
        version, parts = self._manifest(name)
        old_folders = [parts[p] for p in touched if p in parts]
        before = self._rows(name, old_folders) if old_folders else fresh.limit(0)
        met = [F.col(f"n.{k}") == F.col(f"o.{k}") for k in keys]
        both = fresh.withColumn("_new", F.lit(True)).alias("n").join(before.withColumn("_old", F.lit(True)).alias("o"), met, "full_outer")
        same = F.lit(True)
        for v in values:
            same = same & F.col(f"n.{v}").eqNullSafe(F.col(f"o.{v}"))
        change = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "insert").when(same, "unchanged").otherwise("update")
        taken = change.isin("insert", "update")
        picked = [(F.coalesce(f"o.{c}", f"n.{c}") if c == "created_utc_ms" else F.when(taken, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c) for c in fresh.columns]
        at("merged")
        merged = both.select(*picked, change.alias("change")).withColumn("part", part_of(name))
        merged.repartition("part").write.partitionBy("part").parquet(f"{self.folder}/{name}/{target}")
        found = self.spark.read.schema(merged.schema).parquet(f"{self.folder}/{name}/{target}").groupBy("part", "change").count().collect()  # four rows a part
        counts: dict[str, int] = {}
        changed = set()
        for r in found:
            counts[r["change"]] = counts.get(r["change"], 0) + r["count"]
            if r["change"] in ("insert", "update"):
                changed.add(r["part"])
        made = {"inserts": counts.get("insert", 0), "updates": counts.get("update", 0), "unchanged": counts.get("unchanged", 0)}
        if changed:
            for p in {r["part"] for r in found} - changed:
                sinks.remove(self.spark, f"{self.folder}/{name}/{target}/part={p}")
            at("publish")
            following = parts | {p: f"{target}/part={p}" for p in changed}
            if not sinks.publish(self.spark, f"{self.folder}/{name}/versions/{version + 1:012}.json", json.dumps(following, sort_keys=True).encode()):
                sinks.remove(self.spark, f"{self.folder}/{name}/{target}")
                return None
            self._forget(name, version + 1 - KEPT)
        else:
            sinks.remove(self.spark, f"{self.folder}/{name}/{target}")
        return made

    def _forget(self, name: str, version: int) -> None:
        """Delete a version and the parts that only it and older ones name."""
        if version < 1:
            return
        path = lambda v: f"{self.folder}/{name}/versions/{v:012}.json"
        gone, after = sinks.read_small(self.spark, path(version)), sinks.read_small(self.spark, path(version + 1))
        if gone is None or after is None:
            return
        for folder in set(json.loads(gone).values()) - set(json.loads(after).values()):
            sinks.remove(self.spark, f"{self.folder}/{name}/{folder}")
        sinks.remove(self.spark, path(version))

    def vacuum(self) -> int:
        """Delete what upserts left behind that didn't publish; how many folders.  No writer may be at work."""
        n = 0
        for name in sinks.children(self.spark, self.folder):
            named = set()
            for c in sinks.children(self.spark, f"{self.folder}/{name}/versions"):
                named |= set(json.loads(sinks.read_small(self.spark, f"{self.folder}/{name}/versions/{c}") or b"{}").values())
            for c in sinks.children(self.spark, f"{self.folder}/{name}"):
                if c.startswith("work-"):
                    sinks.remove(self.spark, f"{self.folder}/{name}/{c}")
                    n += 1
            for c in sinks.children(self.spark, f"{self.folder}/{name}/data"):
                if not any(f.startswith(f"data/{c}/") for f in named):
                    sinks.remove(self.spark, f"{self.folder}/{name}/data/{c}")
                    n += 1
        return n

    def counts(self) -> DataFrame:
        """(name, rows) of all tables."""
        out = self.spark.createDataFrame([], "name string, rows long")
        for name in TABLES:
            table = self.read(name)
            if table is not None:
                out = out.union(table.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows")).select("name", "rows"))
        return out


def _day(ms: int) -> str:
    import datetime

    return (datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=ms)).strftime("%Y-%m-%d")


def recompute_hours(store: Store, events: DataFrame, windows: DataFrame, hours: DataFrame, idle_ms: int, run_id: str, now: int, code: str | None = None) -> dict[str, int]:
    """Compute the hours (hour_ms) anew, each from its own events alone, and store them;
    how many were looked at and changed.

    An hour's sessions neither begin before it nor end behind it, so its values
    don't depend on which other hours are computed with it."""
    first, last, n = hours.agg(F.min("hour_ms"), F.max("hour_ms"), F.count(F.lit(1))).first()
    if not n:
        return {"hours_examined": 0, "inserts": 0, "updates": 0, "unchanged": 0}
    fresh = metrics.hourly_summary(events, windows, first, last + HOUR, idle_ms, code, alone=True)
    return {"hours_examined": n, **store.upsert("hourly", fresh.join(hours, "hour_ms", "left_semi"), run_id, now)}


def recompute_days(store: Store, days: DataFrame, run_id: str, now: int, code: str | None = None) -> dict[str, int]:
    """Roll the stored hours of the days (day_ms) up anew and store them; only their parts are read."""
    n, first, last = days.agg(F.count(F.lit(1)), F.min("day_ms"), F.max("day_ms")).first()
    hourly = store.read("hourly", first, last + DAY) if n else None
    if hourly is None:
        return {"days_examined": n, "inserts": 0, "updates": 0, "unchanged": 0}
    day = (F.floor(F.col("hour_ms") / F.lit(float(DAY))) * DAY).cast("long")
    some = hourly.withColumn("day_ms", day).join(days, "day_ms", "left_semi").drop("day_ms")
    return {"days_examined": n, **store.upsert("daily", metrics.daily_summary(some, code), run_id, now)}
