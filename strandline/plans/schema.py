"""Versions of the stored tables: what each has, how an older store becomes a newer one, and whether a store is sound."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.operators import advice, metrics
from strandline.plans.store import Store
from strandline.sources import sinks

_STAMPS = "run_id string, created_utc_ms long, updated_utc_ms long"
#: Columns of the newest version.
COLUMNS = {
    "hourly": f"hour_ms long, metric_key string, value_num double, input_row_count long, coverage_ratio double, input_hash string, {_STAMPS}",
    "evidence": f"hour_ms long, evidence_json string, {_STAMPS}",
    "daily": f"day_ms long, metric_key string, value_num double, hours_counted long, low_conf_hours long, input_hash string, {_STAMPS}",
    "hourly_advice": f"hour_ms long, rule_key string, rule_version int, severity string, score double, advice_text string, evidence_json string, reason_json string, input_hash string, {_STAMPS}",
    "daily_advice": f"day_ms long, rule_key string, rule_version int, severity string, score double, advice_text string, evidence_json string, reason_json string, input_hash string, {_STAMPS}",
    "hourly_report": f"hour_ms long, txt string, json string, csv string, hour_hash string, sha256 string, {_STAMPS}",
    "daily_report": f"day_ms long, txt string, json string, csv string, day_hash string, sha256 string, {_STAMPS}",
    "hourly_digest": f"hour_ms long, txt string, json string, hour_hash string, sha256 string, {_STAMPS}",
    "daily_digest": f"day_ms long, txt string, json string, day_hash string, sha256 string, {_STAMPS}",
    "metric_catalog": f"metric_key string, unit string, version int, description string, {_STAMPS}",
    "rule_catalog": f"rule_key string, version int, title string, description string, {_STAMPS}",
    "runs": f"run string, started long, finished long, parameters string, status string, {_STAMPS}",
}


@dataclass
class Step:
    """What a version brings: tables that are new, changes of the rows of older ones, and rows that it stores."""

    version: int
    name: str
    tables: tuple[str, ...] = ()
    changes: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    seed: Callable[[Store, int], None] = lambda store, now: None


def _added(**columns: str) -> Callable[[DataFrame], DataFrame]:
    """Columns with a SQL expression for old rows; those that are there already stay."""
    return lambda rows: rows.withColumns({c: F.expr(e) for c, e in columns.items() if c not in rows.columns})


def _metrics(store: Store, now: int) -> None:
    store.upsert("metric_catalog", store.spark.createDataFrame(list(metrics.CATALOG), "metric_key string, unit string, version int, description string"), "schema", now)


def _rules(store: Store, now: int) -> None:
    store.upsert("rule_catalog", store.spark.createDataFrame(list(advice.CATALOG), "rule_key string, version int, title string, description string"), "schema", now)


#: Versions and names of the changes, in order.  Version 1 has events and nothing that is stored here.
STEPS = (
    Step(2, "ai_summaries_v1", ("metric_catalog", "runs", "hourly", "daily", "evidence"), seed=_metrics),
    Step(3, "advisory_locks_v1"),
    Step(4, "reporting_audit_v1", ("hourly_report", "daily_report")),
    Step(5, "advice_v1", ("hourly_advice", "daily_advice", "rule_catalog"), seed=_rules),
    Step(6, "digest_v1", ("hourly_digest", "daily_digest"), {"daily_report": _added(json="cast(NULL AS string)", csv="cast(NULL AS string)")}),
)
LATEST = STEPS[-1].version


def version(store: Store) -> int:
    """The version of a store; one that names none is of version 1."""
    found = [int(c[:-5]) for c in sinks.children(store.spark, f"{store.folder}/schema") if c.endswith(".json")]
    return max(found, default=1)


def expected(at: int = LATEST) -> list[str]:
    """The tables that a store of a version has."""
    return [t for s in STEPS if s.version <= at for t in s.tables]


def migrate(store: Store, now: int, target: int = LATEST, steps: tuple[Step, ...] = STEPS) -> list[str]:
    """Bring a store to ``target``, step by step; the names of the steps that were taken.

    A step's changed rows are written beside the old ones first; only when all
    are there do the tables' next manifests name them, and then the store
    its version.  A step that fails leaves the store at the version before,
    and may be taken again; a store that is new enough isn't touched."""
    taken = []
    for step in steps:
        if not version(store) < step.version <= target:
            continue
        written = []
        try:
            for name, change in step.changes.items():
                written.append((name, *_rewritten(store, name, change)))
            for name, number, parts in written:
                if parts and not sinks.publish(store.spark, f"{store.folder}/{name}/versions/{number + 1:012}.json", json.dumps(parts, sort_keys=True).encode()):
                    raise RuntimeError(f"{name} was changed while step {step.name} was on its way")
            step.seed(store, now)
        except Exception:
            for name, number, parts in written:
                if store._manifest(name)[0] == number:  # not published
                    for folder in {f.rsplit("/", 1)[0] for f in parts.values()}:
                        sinks.remove(store.spark, f"{store.folder}/{name}/{folder}")
            raise
        sinks.publish(store.spark, f"{store.folder}/schema/{step.version:04}.json", json.dumps({"name": step.name, "at": now}).encode())
        taken.append(step.name)
    return taken


def _rewritten(store: Store, name: str, change: Callable[[DataFrame], DataFrame]) -> tuple[int, dict[str, str]]:
    """A table's version, and the folders of its parts with the change made, part by part as they are."""
    number, parts = store._manifest(name)
    if not parts:
        return number, {}
    target = f"data/schema-{uuid.uuid4().hex}"
    for part, folder in parts.items():
        change(store.spark.read.parquet(f"{store.folder}/{name}/{folder}")).write.parquet(f"{store.folder}/{name}/{target}/part={part}")
    return number, {p: f"{target}/part={p}" for p in parts}


def health(store: Store) -> DataFrame:
    """(name, problem) of what a store lacks: tables of its version that have no rows yet
    (``empty``), columns that are missing, of another type, or not known; no rows for a sound one."""
    found = []
    for name in expected(version(store)):
        table = store.read(name)
        if table is None:
            found.append((name, "empty"))
            continue
        want, have = ({f.name: f.dataType.simpleString() for f in s} for s in (StructType.fromDDL(COLUMNS[name]), table.schema))
        found += [(name, f"no column {c}") for c in want if c not in have]
        found += [(name, f"column {c} is {have[c]}, not {want[c]}") for c in want if have.get(c, want[c]) != want[c]]
        found += [(name, f"unknown column {c}") for c in have if c not in want]
    return store.spark.createDataFrame(sorted(found), "name string, problem string")
