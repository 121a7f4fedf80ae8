"""Hourly and daily metrics and the hashes that tell whether they are out of date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import DAY, HOUR, round2, round4
from strandline.operators.sessions import by_hour, focus_sessions, hour_grid, hourly_sessions

LOW_COVERAGE = 0.6
#: The catalog of metrics.
CATALOG = (
    ("focus_minutes", "minutes", 1, "Total minutes of focused foreground activity within the period."),
    ("idle_minutes", "minutes", 1, "Minutes without meaningful activity (derived from focus gaps)."),
    ("keyboard_events", "count", 1, "Number of keyboard input events observed."),
    ("mouse_events", "count", 1, "Number of mouse input events observed."),
    ("context_switches", "count", 1, "Foreground app/window switches in the period."),
    ("deep_focus_minutes", "minutes", 1, "Longest continuous single-app focus block within the period."),
)


def input_hashes(events: DataFrame, hours: DataFrame, code: str | None = None) -> DataFrame:
    """(hour_ms, events, input_hash): SHA-256 of count, times and ids of an hour's
    events and the code version; hours without events have a hash too."""
    seen = events.groupBy((F.expr(f"floor(ts_utc / {HOUR}D)") * HOUR).alias("hour_ms")).agg(F.count(F.lit(1)).alias("n"), F.min("ts_utc").alias("t0"), F.max("ts_utc").alias("t1"), F.min("id").alias("i0"), F.max("id").alias("i1"))
    joined = hours.join(seen, "hour_ms", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    text = F.concat_ws("|", F.lit("events"), zero("n"), zero("t0"), zero("t1"), F.coalesce("i0", F.lit("")), F.coalesce("i1", F.lit("")), F.lit(f"git:{code or '-'}"))
    return joined.select("hour_ms", F.coalesce("n", F.lit(0)).alias("events"), F.sha2(text, 256).alias("input_hash"))


def hourly_wide(events: DataFrame, windows: DataFrame, start: int, end: int, idle_ms: int, alone: bool = False) -> DataFrame:
    """A row for each hour of the range, with or without sessions; ``alone`` as for ``focus_sessions``."""
    return wide_of_parts(events, by_hour(focus_sessions(events, windows, start, end, idle_ms, alone)), start, end)


def wide_of_parts(events: DataFrame, parts: DataFrame, start: int, end: int) -> DataFrame:
    """The same from the hours' parts of sessions, where they are at hand."""
    hours = hour_grid(events.sparkSession, start, end)
    focus = hourly_sessions(parts)
    inside = events.where((F.col("ts_utc") >= start) & (F.col("ts_utc") < end) & F.col("monitor").isin("keyboard", "mouse"))
    typed = inside.groupBy((F.expr(f"floor(ts_utc / {HOUR}D)") * HOUR).alias("hour_ms")).agg(F.count_if(F.col("monitor") == "keyboard").alias("keys"), F.count_if(F.col("monitor") == "mouse").alias("clicks"))
    wide = hours.join(focus, "hour_ms", "left").join(typed, "hour_ms", "left").na.fill(0)
    minutes = round2(F.least(F.lit(60.0), F.col("focus_ms") / F.lit(60000.0)))
    wide = wide.withColumn("focus_minutes", minutes).withColumn("deep_focus_minutes", round2(F.col("deep_ms") / F.lit(60000.0)))
    return wide.withColumn("idle_minutes", round2(F.greatest(F.lit(0.0), F.lit(60.0) - F.col("focus_minutes")))).withColumn("coverage", round4(F.least(F.lit(1.0), F.col("focus_minutes") / F.lit(60.0))))


def hourly_long(wide: DataFrame) -> DataFrame:
    """(hour_ms, metric_key, value_num, input_row_count, coverage_ratio): six rows an hour."""
    return wide.select("hour_ms", F.expr("""stack(6,
        'context_switches', cast(switches AS double), sessions, coverage,
        'deep_focus_minutes', deep_focus_minutes, sessions, coverage,
        'focus_minutes', focus_minutes, sessions, coverage,
        'idle_minutes', idle_minutes, sessions, coverage,
        'keyboard_events', cast(keys AS double), keys, 1.0D,
        'mouse_events', cast(clicks AS double), clicks, 1.0D
    ) AS (metric_key, value_num, input_row_count, coverage_ratio)"""))


def hourly_summary(events: DataFrame, windows: DataFrame, start: int, end: int, idle_ms: int, code: str | None = None, alone: bool = False) -> DataFrame:
    """The long metrics with the hash of their hour."""
    return hourly_of_parts(events, by_hour(focus_sessions(events, windows, start, end, idle_ms, alone)), start, end, code)


def hourly_of_parts(events: DataFrame, parts: DataFrame, start: int, end: int, code: str | None = None) -> DataFrame:
    """The same from the hours' parts of sessions, where they are at hand."""
    long = hourly_long(wide_of_parts(events, parts, start, end))
    return long.join(input_hashes(events, hour_grid(events.sparkSession, start, end), code).select("hour_ms", "input_hash"), "hour_ms")


def daily_summary(hourly: DataFrame, code: str | None = None) -> DataFrame:
    """(day_ms, metric_key, value_num, hours_counted, low_conf_hours, input_hash) of
    hourly rows: sums in the order of hours, and a hash over the hours' hashes."""
    rows = F.array_sort(F.collect_list(F.struct("hour_ms", "value_num", "input_hash")))
    day = (F.floor(F.col("hour_ms") / F.lit(float(DAY))) * DAY).cast("long")
    grouped = hourly.groupBy(day.alias("day_ms"), "metric_key").agg(rows.alias("rows"), F.count(F.lit(1)).alias("hours_counted"), F.count_if(F.col("coverage_ratio") < LOW_COVERAGE).alias("low_conf_hours"))
    total = F.aggregate(F.col("rows.value_num"), F.lit(0.0), lambda a, x: a + x)
    return grouped.select("day_ms", "metric_key", round2(total).alias("value_num"), "hours_counted", "low_conf_hours", day_hash(F.col("rows.input_hash"), code).alias("input_hash"))


def day_hash(hashes, code: str | None = None):
    return F.sha2(F.concat_ws("|", F.array_join(hashes, "|"), F.lit(f"git:{code or '-'}")), 256)


def hour_mismatches(hashes: DataFrame, stored: DataFrame) -> DataFrame:
    """(hour_ms) of hours whose stored hash (any one of its rows) is missing, left over or other
    than the events' hash; hours with neither events nor rows agree."""
    one = stored.groupBy("hour_ms").agg(F.min("input_hash").alias("stored_hash"))
    both = hashes.join(one, "hour_ms", "full_outer")
    some = F.coalesce("events", F.lit(0)) > 0
    return both.where((some & F.col("stored_hash").isNull()) | (~some & F.col("stored_hash").isNotNull()) | (F.col("stored_hash") != F.col("input_hash"))).select("hour_ms").orderBy("hour_ms")


def day_mismatches(hourly: DataFrame, daily: DataFrame, code: str | None = None) -> DataFrame:
    """(day_ms) of days whose stored hash isn't that of one hash an hour."""
    one = hourly.groupBy("hour_ms").agg(F.min("input_hash").alias("h"))
    day = (F.floor(F.col("hour_ms") / F.lit(float(DAY))) * DAY).cast("long")
    now = one.groupBy(day.alias("day_ms")).agg(F.array_sort(F.collect_list(F.struct("hour_ms", "h"))).alias("r")).select("day_ms", day_hash(F.col("r.h"), code).alias("now"))
    kept = daily.groupBy("day_ms").agg(F.min("input_hash").alias("kept"))
    return now.join(kept, "day_ms", "full_outer").where(~F.col("now").eqNullSafe(F.col("kept"))).select("day_ms").orderBy("day_ms")
