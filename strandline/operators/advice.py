"""Rules that turn the metrics of a period into advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import clamp, float_text, round2, round4

#: The catalog of rules.
CATALOG = (
    ("low_focus", 1, "Low Focus Time", "Warns when focused time drops below 25 minutes per hour"),
    ("high_switches", 1, "High Context Switching", "Warns when context switches exceed 12 per hour"),
    ("deep_focus_positive", 1, "Strong Deep Focus", "Celebrates extended deep focus blocks"),
    ("passive_input", 1, "Passive Input Pattern", "Notes periods of low input with active window time"),
    ("long_idle", 1, "Extended Idle Time", "Notes extended idle periods over 40 minutes"),
    ("low_daily_focus", 1, "Low Daily Focus", "Warns when daily focused time drops below 3 hours"),
    ("positive_deep_focus_day", 1, "Strong Daily Deep Focus", "Celebrates days with significant deep focus"),
    ("high_switch_day", 1, "High Daily Switching", "Warns when daily context switches exceed 150"),
)
HOUR_KEYS = ("focus_minutes", "switches", "deep_focus_minutes", "keyboard_minutes", "mouse_minutes", "idle_minutes")
DAY_KEYS = ("focus_minutes", "deep_focus_minutes", "switches")
#: Names that the pipeline gives to metrics which the rules read under others.
ALIASES = {"switches": "context_switches", "keyboard_minutes": "keyboard_events", "mouse_minutes": "mouse_events"}


def _wide(metrics: DataFrame, period: str, keys: tuple[str, ...], carry: tuple[str, ...], aliases: bool) -> DataFrame:
    """A row a period: metrics rounded, missing ones 0, and ``carry`` of the row last by key."""
    value = lambda k: F.max(F.when(F.col("metric_key") == (ALIASES.get(k, k) if aliases else k), round2(F.col("value_num"))))
    last = [F.max_by(c, "metric_key").alias(c) for c in carry]
    return metrics.groupBy(period).agg(*[F.coalesce(value(k), F.lit(0.0)).alias(k) for k in keys], *last)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def _whole(x: Column) -> Column:
    return x.cast("long").cast("string")


def _advice(df: DataFrame, period: str, rules: list[tuple]) -> DataFrame:
    rows = [
        F.when(when, F.struct(F.lit(key).alias("rule_key"), F.lit(1).alias("rule_version"), F.lit(severity).alias("severity"), round4(score).alias("score"), text.alias("advice_text"), proof.alias("evidence_json"), reason.alias("reason_json")))
        for key, severity, when, score, text, proof, reason in rules
    ]
    return df.withColumn("_a", F.explode(F.array_compact(F.array(*rows)))).select(period, "_a.*", "input_hash")


def hourly_advice(metrics: DataFrame, evidence: DataFrame | None = None, period: str = "hour_ms", aliases: bool = False) -> DataFrame:
    """Advice of every hour of ``metrics`` (period, metric_key, value_num,
    coverage_ratio, input_hash), with the top apps of ``evidence`` in its proof."""
    df = _wide(metrics, period, HOUR_KEYS, ("coverage_ratio", "input_hash"), aliases).withColumn("coverage", round4(F.col("coverage_ratio")))
    if evidence is not None:
        df = df.join(evidence, period, "left")
    apps = F.from_json("evidence_json", "array<struct<app_id string, minutes double>>") if evidence is not None else F.lit(None).cast("array<struct<app_id string, minutes double>>")
    top = F.coalesce(F.slice(apps, 1, 3), F.array().cast("array<struct<app_id string, minutes double>>"))
    focus, switches, deep, keys, mouse, idle = (F.col(k) for k in HOUR_KEYS)
    cover = F.col("coverage")
    sure = cover >= 0.6
    proof = lambda **x: _json(coverage_ratio=cover, top_app_minutes=top, **x)
    reason = lambda **x: _json(coverage_ratio_threshold=F.lit(0.6), coverage_ratio_actual=cover, **x)
    return _advice(df, period, [
        ("low_focus", "warn", sure & (focus < 25), clamp((25 - focus) / 25, 0.3, 0.9), F.concat(F.lit("Low focused time this hour ("), float_text(focus), F.lit("m; target ≥ 25m). Try reducing interruptions.")), proof(focus_minutes=focus), reason(focus_minutes_threshold=F.lit(25.0), focus_minutes_actual=focus)),
        ("high_switches", "warn", sure & (switches >= 12), clamp((switches - 12) / 12, 0.3, 0.8), F.concat(F.lit("High context switching ("), _whole(switches), F.lit("s). Batch tasks or pause notifications.")), proof(switches=switches), reason(switches_threshold=F.lit(12.0), switches_actual=switches)),
        ("deep_focus_positive", "good", sure & (deep >= 30), clamp((deep - 30) / 30, 0.4, 0.9), F.concat(F.lit("Strong deep-focus block ("), float_text(deep), F.lit("m). Protect similar blocks.")), proof(deep_focus_minutes=deep), reason(deep_focus_minutes_threshold=F.lit(30.0), deep_focus_minutes_actual=deep)),
        ("passive_input", "info", sure & (keys + mouse < 5) & (focus >= 15), F.lit(0.5), F.lit("Low input but active window time; likely reading or meeting. Capture notes to retain context."), proof(keyboard_minutes=keys, mouse_minutes=mouse, focus_minutes=focus), reason(input_minutes_threshold=F.lit(5.0), input_minutes_actual=keys + mouse, focus_minutes_threshold=F.lit(15.0), focus_minutes_actual=focus)),
        ("long_idle", "info", sure & (idle >= 40), clamp((idle - 40) / 20, 0.3, 0.7), F.concat(F.lit("Extended idle ("), float_text(idle), F.lit("m). If this was a break, great; otherwise consider shorter pauses.")), proof(idle_minutes=idle), reason(idle_minutes_threshold=F.lit(40.0), idle_minutes_actual=idle)),
    ])


def daily_advice(metrics: DataFrame, period: str = "day_ms", aliases: bool = False) -> DataFrame:
    """Advice of every day of ``metrics`` (period, metric_key, value_num, hours_counted, low_conf_hours, input_hash)."""
    df = _wide(metrics, period, DAY_KEYS, ("hours_counted", "low_conf_hours", "input_hash"), aliases)
    focus, deep, switches = (F.col(k) for k in DAY_KEYS)
    hours, low = F.col("hours_counted"), F.col("low_conf_hours")
    sure = low <= 4
    proof = lambda **x: _json(hours_counted=hours, low_conf_hours=low, **x)
    reason = lambda **x: _json(low_conf_hours_threshold=F.lit(4), low_conf_hours_actual=low, **x)
    return _advice(df, period, [
        ("low_daily_focus", "warn", sure & (focus < 180), clamp((180 - focus) / 180, 0.3, 0.8), F.concat(F.lit("Low daily focused time ("), float_text(focus), F.lit("m; target ≥ 180m). Plan deeper focus blocks.")), proof(focus_minutes=focus), reason(focus_minutes_threshold=F.lit(180.0), focus_minutes_actual=focus)),
        ("positive_deep_focus_day", "good", sure & (deep >= 120), clamp((deep - 120) / 120, 0.4, 0.9), F.concat(F.lit("Excellent daily deep focus ("), float_text(deep), F.lit("m). Maintain this momentum.")), proof(deep_focus_minutes=deep), reason(deep_focus_minutes_threshold=F.lit(120.0), deep_focus_minutes_actual=deep)),
        ("high_switch_day", "warn", sure & (switches >= 150), clamp((switches - 150) / 150, 0.3, 0.8), F.concat(F.lit("High daily context switching ("), _whole(switches), F.lit("s). Consider time-blocking similar tasks.")), proof(switches=switches), reason(switches_threshold=F.lit(150.0), switches_actual=switches)),
    ])


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "warn", 1).when(severity == "info", 2).when(severity == "good", 3).otherwise(4)
