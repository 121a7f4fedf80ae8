"""Focus sessions and what is counted from them, hour by hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import HOUR, round2

IDLE_MS = 60_000
#: Events are ordered inside buckets of this span; only the buckets' first times meet.
BUCKET_MS = 60_000


def next_times(events: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Add ``next_ts``, the time of the next event over all in the order of ts, id.

    The last event of a bucket takes the first time of the next bucket that has
    any: a table with a row a bucket, so no task holds all events."""
    dealt = events.withColumn("bucket", F.expr(f"floor(ts_utc / {bucket_ms}D)"))
    heads = dealt.groupBy("bucket").agg(F.min("ts_utc").alias("head")).withColumn("after", F.lead("head").over(Window.orderBy("bucket"))).drop("head")
    inside = F.lead("ts_utc").over(Window.partitionBy("bucket").orderBy("ts_utc", "id"))
    return dealt.withColumn("inside", inside).join(heads, "bucket").withColumn("next_ts", F.coalesce("inside", "after")).drop("bucket", "inside", "after")


def focus_sessions(events: DataFrame, windows: DataFrame, start: int, end: int, idle_ms: int = IDLE_MS, alone: bool = False) -> DataFrame:
    """(start_ms, end_ms, window_id, app_id) of the window changes in [start, end).

    A session lasts to the next change; where that is more than ``idle_ms``
    away it lasts a second, and the last one lasts to the end of the range.
    Changes at the same time give no session but for the last of them.  With
    ``alone`` each UTC hour is a range of its own."""
    changes = events.where((F.col("monitor") == "active_window") & (F.col("ts_utc") >= start) & (F.col("ts_utc") < end)).select("id", "ts_utc", F.col("subject_id").alias("window_id"))
    stop = F.least(F.expr(f"(floor(ts_utc / {HOUR}D) + 1) * {HOUR}"), F.lit(end)) if alone else F.lit(end)
    until = F.when(F.col("next_ts").isNull() | (F.col("next_ts") >= stop), stop).when(F.col("next_ts") - F.col("ts_utc") > idle_ms, F.col("ts_utc") + 1000).otherwise(F.col("next_ts"))
    ended = next_times(changes).withColumn("end_ms", F.least(until, stop)).where("end_ms > ts_utc")
    named = ended.join(windows.select(F.col("id").alias("window_id"), "app_id"), "window_id", "left")
    return named.select(F.col("ts_utc").alias("start_ms"), "end_ms", "window_id", "app_id")


def by_hour(sessions: DataFrame) -> DataFrame:
    """The parts of sessions within each UTC hour (hour_ms, start_ms, end_ms, ...)."""
    hours = F.sequence(F.expr(f"start_ms div {HOUR}"), F.expr(f"(end_ms - 1) div {HOUR}"))
    cut = sessions.withColumn("hour_ms", F.explode(hours)).withColumn("hour_ms", F.col("hour_ms") * HOUR)
    return cut.select("hour_ms", F.greatest("start_ms", "hour_ms").alias("start_ms"), F.least("end_ms", F.col("hour_ms") + HOUR).alias("end_ms"), *[c for c in sessions.columns if c not in ("start_ms", "end_ms")])


def hour_grid(spark: SparkSession, start: int, end: int) -> DataFrame:
    """(hour_ms) of the hours from the one that holds ``start`` to before ``end``;
    milliseconds within the last second are dropped."""
    first, last = start // HOUR * HOUR, -(-(end // 1000) // 3600) * HOUR
    return spark.range(first, max(first, last) if start < end else first, HOUR).withColumnRenamed("id", "hour_ms")


def spanned(events: DataFrame, period: int, name: str) -> DataFrame:
    """(name) of all periods of so many ms from that of the first event to that of the last, also those without events; none for no events."""
    ends = events.agg(*[(F.floor(f("ts_utc") / F.lit(float(period))).cast("long") * period).alias(n) for n, f in (("first", F.min), ("last", F.max))])
    return ends.where("first IS NOT NULL").select(F.explode(F.sequence("first", "last", F.lit(period).cast("long"))).alias(name))


def closed_hours(hours: DataFrame, now: int, grace_minutes: int = 5) -> DataFrame:
    """The hours that ended ``grace_minutes`` ago or longer."""
    return hours.where(F.col("hour_ms") + HOUR + grace_minutes * 60_000 <= now)


def hourly_sessions(parts: DataFrame) -> DataFrame:
    """(hour_ms, sessions, focus_ms, switches, deep_ms): deep_ms is the longest run of
    parts of one app, each beginning where the one before ends; no app equals
    no app."""
    order = Window.partitionBy("hour_ms").orderBy("start_ms")
    joined = F.lag("app_id").over(order).eqNullSafe(F.col("app_id")) & (F.lag("end_ms").over(order) == F.col("start_ms"))
    runs = parts.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = runs.groupBy("hour_ms", "run").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    return blocks.groupBy("hour_ms").agg(F.sum("n").alias("sessions"), F.sum("ms").alias("focus_ms"), (F.sum("n") - 1).alias("switches"), F.max("ms").alias("deep_ms"))


def top_apps(parts: DataFrame, k: int = 3) -> DataFrame:
    """(hour_ms, rank, app_id, minutes) of the apps longest in front; ties to the first seen."""
    sums = parts.groupBy("hour_ms", "app_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), F.min("start_ms").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("hour_ms").orderBy(F.desc("ms"), "seen"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k).select("hour_ms", "rank", "app_id", round2(F.col("ms") / F.lit(60000.0)).alias("minutes"))


def evidence(tops: DataFrame) -> DataFrame:
    """(hour_ms, evidence_json) of ranked apps."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", "app_id", "minutes"))), lambda x: F.struct(x["app_id"].alias("app_id"), x["minutes"].alias("minutes")))
    return tops.groupBy("hour_ms").agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("evidence_json"))
