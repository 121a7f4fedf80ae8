"""What the stored tables hold, as the rows and lines that a user asks for."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.functions.scalars import HOUR
from strandline.operators import advice, metrics
from strandline.plans.store import TABLES, Store


def seed(store: Store, run_id: str, now: int) -> dict[str, int]:
    """Store the catalogs of metrics and rules; a second time changes nothing."""
    spark, out = store.spark, {"inserts": 0, "updates": 0, "unchanged": 0}
    known = spark.createDataFrame(list(metrics.CATALOG), "metric_key string, unit string, version int, description string")
    rules = spark.createDataFrame(list(advice.CATALOG), "rule_key string, version int, title string, description string")
    for name, rows in (("metric_catalog", known), ("rule_catalog", rules)):
        for k, n in store.upsert(name, rows, run_id, now).items():
            out[k] += n
    return out


def fields(**named: Column) -> Column:
    """``key=value`` pairs joined by commas, in the order given."""
    return F.concat_ws(",", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in named.items()])


def metric_lines(catalog: DataFrame) -> DataFrame:
    """(line) of each metric, by its key."""
    return catalog.orderBy("metric_key").select(fields(metric_key=F.col("metric_key"), unit=F.col("unit"), version=F.col("version")).alias("line"))


def rule_lines(catalog: DataFrame) -> DataFrame:
    """(line) of each rule, by key and version."""
    return catalog.orderBy("rule_key", "version").select(F.concat_ws(",", "rule_key", F.col("version").cast("string"), "title").alias("line"))


def advice_lines(found: DataFrame, period: str = "hour_ms") -> DataFrame:
    """(period, rule_key, line) of the advice of each period."""
    quoted = F.concat(F.lit('"'), "advice_text", F.lit('"'))
    line = fields(rule=F.col("rule_key"), version=F.col("rule_version"), severity=F.col("severity"), score=scalars.float_text(F.col("score")), text=quoted, hash=F.col("input_hash"))
    return found.select(period, "rule_key", F.concat(F.lit("advice "), line).alias("line")).orderBy(period, "rule_key")


def status(events: DataFrame, now: int) -> DataFrame:
    """(monitor, event_count, last_event_utc, age_seconds, age_str), the latest first."""
    last = events.groupBy("monitor").agg(F.count(F.lit(1)).alias("event_count"), F.max("ts_utc").alias("last"))
    age = F.lit(now) - F.col("last")
    shown = last.select("monitor", "event_count", "last", scalars.iso_utc(F.col("last")).alias("last_event_utc"), F.floor(age / F.lit(1000.0)).cast("long").alias("age_seconds"), scalars.age_text(age).alias("age_str"))
    return shown.orderBy(F.desc("last"), "monitor").drop("last")


def hour_preview(spark: SparkSession, start: int, end: int, shown: int = 3) -> DataFrame:
    """(place, line) of the first and the last ``shown`` hours of a grid."""
    n = max(0, (end - start) // HOUR)
    late = (F.col("id") >= shown) & (F.lit(n) > 2 * shown)
    at = F.lit(start) + F.col("id") * HOUR
    line = fields(win=F.col("id"), hstart_ms=at, hend_ms=at + HOUR)
    kept = spark.range(n).where((F.col("id") < shown) | (F.col("id") >= n - shown))
    return kept.select(F.col("id").alias("place"), F.concat(F.when(late, "...").otherwise(""), line).alias("line"))


def last_run(store: Store) -> str:
    """The latest run as compact JSON with sorted keys; ``null`` without any."""
    runs = store.read("runs")
    found = runs.orderBy(F.desc("started"), F.desc("run")).limit(1).collect() if runs is not None else []
    if not found:
        return "null"
    r = found[0]
    code = json.loads(r["parameters"]).get("code_version")
    named = {"run_id": r["run"], "started_utc_ms": r["started"], "finished_utc_ms": r["finished"], "code_git_sha": code, "params_json": r["parameters"], "status": r["status"]}
    return json.dumps(named, sort_keys=True, separators=(",", ":"))


def show(store: Store, table: str, period_ms: int, column: str = "txt") -> str | None:
    """The text of a stored report or digest as it stands."""
    rows = store.read(table)
    found = rows.where(F.col(TABLES[table][0][0]) == period_ms).select(column).collect() if rows is not None else []
    return found[0][0] if found else None


def tables(store: Store, pattern: str = "%") -> DataFrame:
    """(name) of the stored tables whose names are LIKE ``pattern``."""
    names = [(n,) for n in TABLES if store.read(n) is not None]
    return store.spark.createDataFrame(names, "name string").where(F.col("name").like(pattern)).orderBy("name")


def missing(store: Store) -> DataFrame:
    """(name) of the expected tables that aren't stored."""
    return store.spark.createDataFrame([(n,) for n in TABLES], "name string").exceptAll(tables(store)).orderBy("name")
