"""Versions of a store: an old one becomes a new one whole or not at all."""

import pytest
from pyspark.sql import functions as F

from strandline.plans import schema
from strandline.plans import store as stored
from strandline.plans.store import TABLES, Store

T0 = 1_704_067_200_000
OLD_REPORT = (["day_ms"], ["txt", "day_hash", "sha256"])


def old_store(spark, tmp_path, monkeypatch):
    """A store of version 4, whose daily reports had no JSON and CSV."""
    kept = Store(spark, f"file://{tmp_path}/s")
    assert schema.migrate(kept, 1, target=4) == ["ai_summaries_v1", "advisory_locks_v1", "reporting_audit_v1"]
    monkeypatch.setitem(stored.TABLES, "daily_report", OLD_REPORT)
    rows = spark.createDataFrame([(T0 + k * 86_400_000 * 20, "t", "h", "s") for k in range(4)], "day_ms long, txt string, day_hash string, sha256 string")
    kept.upsert("daily_report", rows, "old", 2)
    monkeypatch.undo()
    return kept


def test_a_new_store_gets_all_versions(spark, tmp_path):
    kept = Store(spark, f"file://{tmp_path}/s")
    assert schema.version(kept) == 1 and schema.expected(1) == []
    assert len(schema.migrate(kept, 1)) == 5 and schema.version(kept) == schema.LATEST == 6
    assert sorted(schema.expected()) == sorted(TABLES) == sorted(schema.COLUMNS)
    assert kept.read("metric_catalog").count() == 6 and kept.read("rule_catalog").count() == 8
    assert schema.migrate(kept, 9) == [] and kept.read("rule_catalog").where("created_utc_ms = 1").count() == 8
    assert {(r.name, r.problem) for r in schema.health(kept).collect()} == {(t, "empty") for t in TABLES if t not in ("metric_catalog", "rule_catalog")}


def test_an_old_store_reads_as_a_new_one(spark, tmp_path, monkeypatch):
    kept = old_store(spark, tmp_path, monkeypatch)
    before = sorted(tuple(r) for r in kept.read("daily_report").select("day_ms", "txt", "run_id", "created_utc_ms").collect())
    assert "json" not in kept.read("daily_report").columns
    assert schema.migrate(kept, 5) == ["advice_v1", "digest_v1"]
    table = kept.read("daily_report")
    assert sorted(tuple(r) for r in table.select("day_ms", "txt", "run_id", "created_utc_ms").collect()) == before
    assert table.where("json IS NULL AND csv IS NULL").count() == 4
    assert schema.health(kept).where("problem <> 'empty'").count() == 0
    fresh = spark.createDataFrame([(T0, "t", "{}", "c", "h", "s")], "day_ms long, txt string, json string, csv string, day_hash string, sha256 string")
    assert kept.upsert("daily_report", fresh, "new", 6) == {"inserts": 0, "updates": 1, "unchanged": 0}


def test_a_step_that_fails_leaves_the_version_before(spark, tmp_path, monkeypatch):
    kept = old_store(spark, tmp_path, monkeypatch)

    def broken(rows):
        return rows.withColumn("json", F.raise_error(F.lit("broken")).cast("string"))

    steps = (*schema.STEPS[:-1], schema.Step(6, "digest_v1", (), {"daily_report": schema._added(csv="'x'"), "metric_catalog": broken}))
    files = sorted(str(p) for p in (tmp_path / "s" / "daily_report").rglob("*.parquet"))
    with pytest.raises(Exception, match="broken"):
        schema.migrate(kept, 5, steps=steps)
    assert schema.version(kept) == 5 and "csv" not in kept.read("daily_report").columns
    assert sorted(str(p) for p in (tmp_path / "s" / "daily_report").rglob("*.parquet")) == files
    assert schema.migrate(kept, 6) == ["digest_v1"] and schema.version(kept) == 6


def test_health_names_columns_and_types(spark, tmp_path, monkeypatch):
    kept = old_store(spark, tmp_path, monkeypatch)
    monkeypatch.setitem(stored.TABLES, "evidence", (["hour_ms"], ["evidence_json", "odd"]))
    kept.upsert("evidence", spark.createDataFrame([(T0, 5, "x")], "hour_ms long, evidence_json int, odd string"), "r", 1)
    got = {(r.name, r.problem) for r in schema.health(kept).where("problem <> 'empty'").collect()}
    assert got == {("daily_report", "no column csv"), ("daily_report", "no column json"), ("evidence", "column evidence_json is int, not string"), ("evidence", "unknown column odd")}
