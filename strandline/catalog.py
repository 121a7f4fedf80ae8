"""The activity queries over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.functions.scalars import DAY, HOUR
from strandline.operators import advice, dynamics, metrics, render, retention, sessions, upsert
from strandline.plans import artifacts
from strandline.plans import store as stored
from strandline.plans import views
from strandline.sources import events as source
from strandline.sources import eventstore, importer, sinks

#: The month that the test table covers, and a gap that suits its density.
START, END, IDLE = 1_704_067_200_000, 1_704_067_200_000 + 30 * DAY, 600_000
SALT = "00ff10a1"


class Inputs:
    """The tables of a query as the operators take them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.events = source.from_test_table(spark.read.parquet(f"{sf_dir}/events.parquet"))
        self.windows = source.test_windows(self.events)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sessions(self) -> DataFrame:
        return sessions.focus_sessions(self.events, self.windows, START, END, IDLE)

    def parts(self) -> DataFrame:
        return sessions.by_hour(self.sessions())

    def hours(self) -> DataFrame:
        return sessions.hour_grid(self.spark, START, END)

    def hourly(self) -> DataFrame:
        return metrics.hourly_summary(self.events, self.windows, START, END, IDLE)

    def evidence(self) -> DataFrame:
        return sessions.evidence(sessions.top_apps(self.parts()))

    def changed(self) -> DataFrame:
        """Hourly rows as an older run left them: every 50th hour is missing, every 60th has an old hash."""
        h = F.col("hour_ms") / HOUR
        old = F.when(h % 60 == 0, F.lit("old")).otherwise(F.col("input_hash"))
        return self.hourly().where(h % 50 != 0).withColumn("input_hash", old)


class Written(Inputs):
    """Inputs whose parts of sessions and hourly rows are worked out once, written, and read by all that a query derives from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = sinks.scratch_table(make(), name)
        return self._made[name]

    def parts(self) -> DataFrame:
        return self._once("parts", super().parts)

    def hourly(self) -> DataFrame:
        return self._once("hourly", lambda: metrics.hourly_of_parts(self.events, self.parts(), START, END))

    def evidence(self) -> DataFrame:
        return self._once("evidence", super().evidence)


def _q(f, inputs=Inputs):
    return lambda spark, sf_dir: f(inputs(spark, sf_dir))


def _w(f):
    return _q(f, Written)


def _bad_lines(x: Inputs) -> DataFrame:
    """Journal lines of all kinds made from events, and whether they are valid."""
    e = x.events.where("monitor = 'mouse'")
    k = F.col("id").cast("long") % 6
    line = (
        F.when(k == 0, F.concat(F.lit('{"id":"'), "id", F.lit('","ts_utc":'), "ts_utc", F.lit(',"monitor":"mouse","action":"a","subject_type":"none","session_id":"s"}')))
        .when(k == 1, F.concat(F.lit('{"id":'), F.col("id").cast("long").cast("string"), F.lit(',"ts_utc":1,"monitor":"mouse","action":"a","subject_type":"none","session_id":"s"}')))
        .when(k == 2, F.concat(F.lit('{"id":"'), "id", F.lit('","ts_utc":"1","monitor":"mouse","action":"a","subject_type":"none","session_id":"s"}')))
        .when(k == 3, F.concat(F.lit('{"id":"'), "id", F.lit('","ts_utc":1,"monitor":"other","action":"a","subject_type":"none","session_id":"s"}')))
        .when(k == 4, F.concat(F.lit('{"id":"'), "id", F.lit('","ts_utc":1,"monitor":"mouse","subject_type":"none","session_id":"s"}')))
        .otherwise(F.lit("no json"))
    )
    return source.parse_lines(e.select("id", line.alias("value"))).select("id", source.is_valid(F.col("event")).alias("valid"))


def _upserts(x: Inputs) -> DataFrame:
    """What a first and a second upsert of each table change."""
    kept = stored.Store(x.spark, stored.scratch(x.spark))
    kept.upsert("hourly", x.hourly(), "a", 1)
    kept.upsert("evidence", x.evidence(), "a", 1)
    hourly, proof = kept.read("hourly"), kept.read("evidence").select("hour_ms", "evidence_json")
    kept.upsert("daily", metrics.daily_summary(hourly), "a", 1)
    daily = kept.read("daily")
    tables = {"hourly": hourly, "evidence": proof, "daily": daily, "hourly_advice": advice.hourly_advice(hourly, proof, aliases=True), "daily_advice": advice.daily_advice(daily, aliases=True), "hourly_report": render.hourly_report(hourly, proof), "daily_report": render.daily_report(daily)}
    rows = []
    for name, computed in tables.items():
        if name not in ("hourly", "evidence", "daily"):
            kept.upsert(name, computed, "a", 1)
        again = kept.upsert(name, computed, "b", 2)
        rows.append((name, again["inserts"], again["updates"], again["unchanged"]))
    return x.spark.createDataFrame(rows, "name string, inserts long, updates long, unchanged long")


def _recomputed(x: Inputs) -> stored.Store:
    """A store as an older run left it, after its mismatched hours and days were computed anew."""
    kept = stored.Store(x.spark, stored.scratch(x.spark))
    kept.upsert("hourly", x.changed(), "old", 1)
    kept.upsert("daily", metrics.daily_summary(kept.read("hourly")), "old", 1)
    hashes = metrics.input_hashes(x.events, x.hours())
    stored.recompute_hours(kept, x.events, x.windows, metrics.hour_mismatches(hashes, kept.read("hourly")), IDLE, "new", 2)
    stored.recompute_days(kept, metrics.day_mismatches(kept.read("hourly"), kept.read("daily")), "new", 2)
    return kept


def _event_store(x: Inputs) -> DataFrame:
    """The event store after a part of the events and then all of them, the known ids on other days."""
    kept = eventstore.EventStore(x.spark, stored.scratch(x.spark))
    known = F.col("user_id") % 3 != 0
    kept.insert(x.events.where(known).select("id", "ts_utc", "monitor"))
    kept.insert(x.events.select("id", F.when(known, F.col("ts_utc") + 40 * DAY).otherwise(F.col("ts_utc")).alias("ts_utc"), "monitor"))
    return kept.read()


def _imports(x: Inputs) -> DataFrame:
    """What a first import of journal files counts, and a second one of files that hold known, repeated and invalid events too."""
    folder = stored.scratch(x.spark)
    kept = eventstore.EventStore(x.spark, f"{folder}/store")
    rows = x.events.select("id", "ts_utc", "monitor", "action", F.lit("none").alias("subject_type"), F.lit("s").alias("session_id"), "user_id")
    known, out = rows.where("user_id % 3 <> 0"), None
    again = rows.unionByName(rows.where("user_id % 3 = 0")).unionByName(rows.where("user_id % 5 = 0").withColumn("subject_type", F.lit("other")))
    for n, part in enumerate((known, again)):
        sinks.write_journal(part.drop("user_id"), f"{folder}/spool", daily=True)
        found = importer.import_journal(x.spark, f"{folder}/spool", kept).select(F.lit(n).alias("run"), "monitor", "events_imported", "duplicates_skipped", "invalid_events", "files_with_errors")
        out = found if out is None else out.union(found)
    return out


def _keys(x: Inputs) -> DataFrame:
    """Key presses and releases, with times that come close to each other now and then."""
    near = F.when(F.col("user_id") % 2 == 0, F.col("ts_utc")).otherwise(F.floor(F.col("ts_utc") / F.lit(float(DAY))).cast("long") * DAY + F.col("ts_utc") % 2000)
    return x.events.where("monitor = 'keyboard'").select("user_id", "id", near.alias("ts_utc"), F.when(F.col("action") == "signup", "keyup").otherwise("keydown").alias("kind"))


def _mouse(x: Inputs) -> DataFrame:
    """Mouse rows of all kinds."""
    pressed = F.get(F.array(*[F.lit(k) for k in ("left", "right", "middle")]), (F.col("id").cast("long") % 3).cast("int"))
    kind = F.when(F.col("action") == "error", pressed).when(F.col("action") == "click", "scroll").when(F.col("action") == "signup", "release").otherwise("move")
    return x.events.withColumn("x", F.col("value")).withColumn("y", F.col("value") * 2).withColumn("kind", kind)


def _acts(x: Inputs) -> DataFrame:
    """Events with the actions that snapshots count."""
    n = F.col("id").cast("long") % 3
    moves = F.when(n == 0, "move").when(n == 1, "left_click").otherwise("wheel")
    return x.events.withColumn("action", F.when(F.col("monitor") == "mouse", moves).when(F.col("action") == "signup", "keyup").otherwise("keydown"))


def _seen(x: Inputs) -> DataFrame:
    """Programs as the events show them: names that may be null, suffixes that may be empty."""
    n = F.col("id").cast("long")
    return x.events.select("id", "ts_utc", F.col("subject_id").alias("key_hash"), F.when(F.col("action") != "error", F.col("action")).alias("exe_name"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("e"), (n % 5).cast("string"))).alias("ext"))


def _dimension(x: Inputs) -> DataFrame:
    """A dimension after two batches."""
    first, then = _seen(x).where(F.col("ts_utc") < START + 15 * DAY), _seen(x).where(F.col("ts_utc") >= START + 15 * DAY)
    return upsert.get_or_create(then, upsert.get_or_create(first, None, ["key_hash"], ("exe_name",), ("ext",)), ["key_hash"], ("exe_name",), ("ext",))


def _window_ids(x: Inputs) -> DataFrame:
    rows = x.events.join(x.windows.select(F.col("id").alias("subject_id"), F.col("app_id").alias("exe_path_hash")), "subject_id", "left").select("id", "ts_utc", "exe_path_hash", F.col("action").alias("title_hash"))
    rows = upsert.with_ids(rows, upsert.get_or_create(rows, None, ["exe_path_hash"]), ["exe_path_hash"], "app_id")
    return upsert.with_ids(rows, upsert.get_or_create(rows, None, ["app_id", "title_hash"]), ["app_id", "title_hash"], "window_id").select("id", "app_id", "window_id")


def _urls(x: Inputs) -> DataFrame:
    pages = x.table("pages").where(scalars.trackable_url(F.col("url")))
    rows = pages.select(F.col("page_id").alias("id"), F.col("page_id").alias("ts_utc"), scalars.salted_hash(F.col("url"), "url", SALT).alias("url_hash"), scalars.domain_hash(F.col("url"), SALT).alias("domain_hash"))
    return upsert.get_or_create(rows, None, ["url_hash"], filled=("domain_hash",)).withColumn("domain_hash", F.coalesce("domain_hash", F.lit("")))


def _emitted(x: Inputs) -> DataFrame:
    """Rows of monitors that lack something here and there."""
    n = F.col("id").cast("long")
    rows = x.events.select(
        F.when(n % 4 != 0, F.col("id")).alias("id"), F.when(n % 7 != 0, F.col("ts_utc")).alias("ts_utc"), F.when(n % 5 != 0, F.col("monitor")).alias("monitor"), "action",
        F.when(n % 11 != 0, "none").alias("subject_type"), "subject_id", F.when(n % 2 == 0, "s1").alias("session_id"), F.when(n % 3 == 0, F.concat(F.lit("{"), "id", F.lit("}"))).alias("attrs_json"),
    )
    return source.enrich(rows, "mouse", "s0", END)


def _some_idle(x: Inputs) -> DataFrame:
    return x.events.withColumn("monitor", F.when(F.col("user_id") % 4 == 0, "heartbeat").otherwise(F.col("monitor")))


def _exe(x: Inputs) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("Chrome.exe", "notepad.exe", "FIREFOX.EXE", "opera.exe.bak", "iexplore.exe")])
    return x.events.select("id", F.get(names, (F.col("user_id") % 6).cast("int")).alias("exe_name"))


def _seeded(x: Inputs) -> stored.Store:
    kept = stored.Store(x.spark, stored.scratch(x.spark))
    views.seed(kept, "a", 1)
    return kept


def _with_hours(x: Inputs) -> stored.Store:
    """A store that holds the catalogs and the events' hours and days."""
    kept = _seeded(x)
    kept.upsert("hourly", x.hourly(), "a", 1)
    kept.upsert("daily", metrics.daily_summary(x.hourly()), "a", 1)
    return kept


def _preview(x: Inputs) -> DataFrame:
    first, last = x.events.agg(F.min("ts_utc"), F.max("ts_utc")).first()
    return views.hour_preview(x.spark, first // HOUR * HOUR, (last // HOUR + 1) * HOUR)


def _rules_met(x: Inputs) -> DataFrame:
    """The hourly and daily rules, and how often each was met."""
    rules = x.spark.createDataFrame(list(advice.CATALOG), "rule_key string, version int, title string, description string")
    met = advice.hourly_advice(x.hourly(), x.evidence(), aliases=True).select("rule_key").union(advice.daily_advice(metrics.daily_summary(x.hourly()), aliases=True).select("rule_key")).groupBy("rule_key").agg(F.count(F.lit(1)).alias("met"))
    return rules.join(met, "rule_key", "left").na.fill(0, ["met"])


QUERIES = {
    "dimension_upsert": _q(_dimension),
    "dimension_ids": _q(_window_ids),
    "url_records": _q(_urls),
    "enriched_events": _q(_emitted),
    "browser_rows": _q(lambda x: source.browser_rows(_exe(x))),
    "activity_rows": _q(lambda x: source.activity_rows(_some_idle(x)).select("id", "monitor")),
    "idle_snapshots": _q(lambda x: dynamics.idle_snapshots(_some_idle(x), 300_000)),
    "status": _q(lambda x: views.status(x.events, END)),
    "metric_lines": _w(lambda x: views.metric_lines(_seeded(x).read("metric_catalog").join(x.hourly().select("metric_key").distinct(), "metric_key", "left_semi"))),
    "rule_lines": _w(lambda x: views.rule_lines(_seeded(x).read("rule_catalog").join(advice.hourly_advice(x.hourly(), x.evidence(), aliases=True).select("rule_key").distinct(), "rule_key", "left_semi"))),
    "advice_lines": _w(lambda x: views.advice_lines(advice.hourly_advice(x.hourly(), x.evidence(), aliases=True))),
    "hour_preview": _q(_preview),
    "missing_tables": _w(lambda x: views.missing(_with_hours(x))),
    "tables_like": _w(lambda x: views.tables(_with_hours(x), "%ly")),
    "largest_files": _q(lambda x: retention.largest(x.table("pages").select(F.col("page_id").alias("path"), F.octet_length("html").cast("long").alias("size")))),
    "event_store": _q(_event_store),
    "journal_imports": _q(_imports),
    "stored_upserts": _w(_upserts),
    "recomputed_hours": _q(lambda x: _recomputed(x).read("hourly").select("hour_ms", "metric_key", "value_num", "input_hash", "run_id", "created_utc_ms", "updated_utc_ms")),
    "recomputed_days": _q(lambda x: _recomputed(x).read("daily").select("day_ms", "metric_key", "value_num", "input_hash")),
    "keyboard_batches": _q(lambda x: dynamics.keyboard_batches(_keys(x), "user_id", 16, DAY).select("user_id", "batch", "keydown", "keyup", "bursts", *[scalars.round2(F.col(c)).alias(c) for c in ("mean_ms", "p95_ms", "stdev_ms")])),
    "timed_batches": _q(lambda x: dynamics.batches(x.events.select("user_id", "ts_utc", "id"), "user_id", 8, 2 * DAY)),
    "mouse_batches": _q(lambda x: dynamics.mouse_batches(_mouse(x), "user_id", 16, 4 * DAY)),
    "counters_since_trigger": _q(lambda x: dynamics.counters_since(_acts(x), x.events.where("monitor = 'active_window'").select("user_id", "ts_utc"), "user_id")),
    "hourly_report_json": _w(lambda x: render.hourly_report(x.hourly(), x.evidence()).select("hour_ms", "json", "csv")),
    "event_time_range_latest": _q(lambda x: source.latest_in_range(x.events, START + DAY, START + 2 * DAY, 50).select("id", "ts_utc", "monitor")),
    "monitor_status": _q(lambda x: x.events.groupBy("monitor").agg(F.max("ts_utc").alias("last_ts"), F.count(F.lit(1)).alias("n")).withColumn("age", scalars.age_text(F.lit(END) - F.col("last_ts")))),
    "hour_grid": _q(lambda x: sessions.closed_hours(sessions.spanned(x.events, HOUR, "hour_ms"), END - 7 * DAY, 5)),
    "day_grid": _q(lambda x: sessions.spanned(x.events, DAY, "day_ms")),
    "focus_sessions": _q(Inputs.sessions),
    "session_hour_clip": _q(Inputs.parts),
    "hourly_focus": _q(lambda x: metrics.hourly_wide(x.events, x.windows, START, END, IDLE).select("hour_ms", "focus_minutes", "idle_minutes", "coverage")),
    "context_switches": _q(lambda x: sessions.hourly_sessions(x.parts()).select("hour_ms", "sessions", "switches")),
    "deep_focus": _q(lambda x: sessions.hourly_sessions(x.parts()).select("hour_ms", "deep_ms")),
    "top3_apps": _q(lambda x: sessions.top_apps(x.parts())),
    "top3_evidence": _q(Inputs.evidence),
    "hourly_metrics_long": _q(lambda x: metrics.hourly_long(metrics.hourly_wide(x.events, x.windows, START, END, IDLE))),
    "hourly_input_hash": _q(lambda x: metrics.input_hashes(x.events, x.hours(), "abc123")),
    "daily_rollup": _q(lambda x: metrics.daily_summary(x.hourly()).select("day_ms", "metric_key", "value_num", "hours_counted", "low_conf_hours")),
    "daily_hash": _q(lambda x: metrics.daily_summary(x.hourly()).select("day_ms", "metric_key", "input_hash")),
    "hour_mismatches": _q(lambda x: metrics.hour_mismatches(metrics.input_hashes(x.events, x.hours()), x.changed())),
    "day_mismatches": _q(lambda x: metrics.day_mismatches(x.changed(), metrics.daily_summary(x.hourly()))),
    "upsert_diff": _q(lambda x: upsert.diff(x.hourly(), x.changed(), ["hour_ms", "metric_key"], ["value_num", "input_hash"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))),
    "dedupe_events": _q(lambda x: upsert.new_events(x.events.union(x.events.where("user_id % 3 = 0")).select("id", "ts_utc"), x.events.where("user_id % 5 = 0"))),
    "dim_first_last_seen": _q(lambda x: upsert.first_last_seen(x.events, "subject_id", carry=("action",))),
    "left_join_dim": _q(lambda x: x.events.join(x.windows.withColumnRenamed("id", "subject_id"), "subject_id", "left").groupBy("app_id").agg(F.count(F.lit(1)).alias("n"))),
    "advice_hourly": _w(lambda x: advice.hourly_advice(x.hourly(), x.evidence(), aliases=True)),
    "advice_daily": _q(lambda x: advice.daily_advice(metrics.daily_summary(x.hourly()), aliases=True)),
    "advice_catalog": _w(_rules_met),
    "digest_order": _q(lambda x: advice.hourly_advice(x.hourly(), aliases=True).select("hour_ms", "rule_key", advice.severity_rank(F.col("severity")).alias("place"))),
    "hourly_report_txt": _w(lambda x: render.hourly_report(x.hourly(), x.evidence()).select("hour_ms", "txt", "sha256")),
    "daily_report_txt": _q(lambda x: render.daily_report(metrics.daily_summary(x.hourly())).select("day_ms", "txt", "sha256")),
    "hourly_digest": _w(lambda x: render.hourly_digest(x.hourly(), x.evidence(), advice.hourly_advice(x.hourly(), x.evidence()))),
    "daily_digest": _w(lambda x: render.daily_digest(metrics.daily_summary(x.hourly()), advice.daily_advice(metrics.daily_summary(x.hourly())))),
    "daily_report_json": _q(lambda x: render.daily_report(metrics.daily_summary(x.hourly())).select("day_ms", "json", "csv")),
    "artifact_files": _w(lambda x: artifacts.files_of("hourly_report", render.hourly_report(x.hourly(), x.evidence())).union(artifacts.files_of("daily_report", render.daily_report(metrics.daily_summary(x.hourly())))).where("form <> 'json'").select("period_ms", "kind", "form", "path", "sha256")),
    "artifact_paths": _w(lambda x: x.hourly().groupBy("hour_ms").agg(F.min("input_hash").alias("h")).select("hour_ms", render.artifact_path("hourly", F.col("hour_ms"), F.col("h"), "txt").alias("path"))),
    "salted_hash": _q(lambda x: x.table("pages").select("page_id", scalars.salted_hash(F.col("url"), "url", SALT).alias("hash"))),
    "url_domain": _q(lambda x: x.table("pages").select("page_id", scalars.url_authority(F.col("url")).alias("authority"), scalars.trackable_url(F.col("url")).alias("trackable"))),
    "inter_event_stats": _q(lambda x: dynamics.interval_stats(dynamics.gaps(x.events, "monitor"), "monitor").select("monitor", "n", scalars.round4(F.col("p95_ms")).alias("p95_ms"), scalars.round4(F.col("mean_ms")).alias("mean_ms"))),
    "distance_stats": _q(lambda x: dynamics.distance(x.events.withColumn("x", F.col("value")).withColumn("y", F.col("value") * 2), "user_id")),
    "bursts": _q(lambda x: dynamics.bursts(x.events, "user_id", span=DAY, keys=3)),
    "idle_gaps": _q(lambda x: dynamics.idle_gaps(x.events, 300_000)),
    "window_changes": _q(lambda x: dynamics.changes(x.events, "user_id", ("monitor",)).select("id", "user_id", "monitor")),
    "title_dedupe": _q(lambda x: dynamics.dedupe_within(x.events, "user_id", span=DAY).select("user_id", "ts_utc", "id")),
    "count_batches": _q(lambda x: dynamics.count_batches(x.events, "monitor", 128).groupBy("monitor", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("ts_utc").alias("first_ts"))),
    "activity_counters": _q(lambda x: x.events.groupBy(scalars.floor_to(F.col("ts_utc"), HOUR).alias("hour_ms")).agg(F.count_if(F.col("monitor") == "keyboard").alias("keys"), F.count_if((F.col("monitor") == "mouse") & (F.col("action") == "error")).alias("clicks"))),
    "table_counts": _q(lambda x: x.table("events").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit("events")).unionByName(x.table("pages").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit("pages")))),
    "quota_state": _q(lambda x: retention.quota_state(x.table("pages").select(F.octet_length("html").cast("long").alias("size")), 1 << 20)),
    "retention_victims": _q(lambda x: retention.victims(x.events.select("id", F.timestamp_millis("ts_utc").alias("modified"), F.col("user_id").alias("size")), 100_000, key="id").select("id", "size")),
    "invalid_events": _q(_bad_lines),
}

_EVENTS = f"""
WITH e AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, epoch_us(ts) // 1000 AS ts_utc,
         CASE WHEN event_type IN ('view', 'purchase') THEN 'active_window' WHEN event_type IN ('click', 'signup') THEN 'keyboard' ELSE 'mouse' END AS monitor,
         event_type AS action, CAST(user_id AS VARCHAR) AS subject_id, user_id, value, props FROM events
), w AS (
  SELECT DISTINCT subject_id AS id, 'app' || CAST(user_id % 7 AS VARCHAR) AS app_id FROM e WHERE user_id % 11 <> 0
)"""
_SESSIONS = _EVENTS + f""", c AS (
  SELECT *, lead(ts_utc) OVER (ORDER BY ts_utc, id) AS nxt FROM e WHERE monitor = 'active_window' AND ts_utc >= {START} AND ts_utc < {END}
), s AS (
  SELECT ts_utc AS start_ms, least({END}, CASE WHEN nxt IS NULL THEN {END} WHEN nxt - ts_utc > {IDLE} THEN ts_utc + 1000 ELSE nxt END) AS end_ms, subject_id AS window_id, app_id
  FROM c LEFT JOIN w ON w.id = c.subject_id
), f AS (SELECT * FROM s WHERE end_ms > start_ms
), p AS (
  SELECT h * {HOUR} AS hour_ms, greatest(start_ms, h * {HOUR}) AS start_ms, least(end_ms, (h + 1) * {HOUR}) AS end_ms, window_id, app_id
  FROM (SELECT *, unnest(range(start_ms // {HOUR}, (end_ms - 1) // {HOUR} + 1)) AS h FROM f)
)"""
_FROM_PARTS = f""", r AS (
  SELECT *, CASE WHEN lag(app_id) OVER o IS NOT DISTINCT FROM app_id AND lag(end_ms) OVER o = start_ms THEN 0 ELSE 1 END AS brk FROM p WINDOW o AS (PARTITION BY hour_ms ORDER BY start_ms)
), b AS (
  SELECT *, sum(brk) OVER (PARTITION BY hour_ms ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS run FROM r
), k AS (
  SELECT hour_ms, run, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms FROM b GROUP BY ALL
), hs AS (
  SELECT hour_ms, CAST(sum(n) AS BIGINT) AS sessions, CAST(sum(ms) AS BIGINT) AS focus_ms, CAST(sum(n) - 1 AS BIGINT) AS switches, max(ms) AS deep_ms FROM k GROUP BY hour_ms
), g AS (
  SELECT unnest(range({START}, {END}, {HOUR})) AS hour_ms
), t AS (
  SELECT ts_utc // {HOUR} * {HOUR} AS hour_ms, count(*) FILTER (monitor = 'keyboard') AS keys, count(*) FILTER (monitor = 'mouse') AS clicks FROM e GROUP BY ALL
), m AS (
  SELECT g.hour_ms, coalesce(sessions, 0) AS sessions, coalesce(switches, 0) AS switches, coalesce(keys, 0) AS keys, coalesce(clicks, 0) AS clicks,
         floor(least(60.0::DOUBLE, coalesce(focus_ms, 0) / 60000.0::DOUBLE) * 100.0 + 0.5) / 100.0 AS focus_minutes,
         floor(coalesce(deep_ms, 0) / 60000.0::DOUBLE * 100.0 + 0.5) / 100.0 AS deep_focus_minutes
  FROM g LEFT JOIN hs USING (hour_ms) LEFT JOIN t USING (hour_ms)
), mw AS (
  SELECT *, floor(greatest(0.0::DOUBLE, 60.0::DOUBLE - focus_minutes) * 100.0 + 0.5) / 100.0 AS idle_minutes,
         floor(least(1.0::DOUBLE, focus_minutes / 60.0::DOUBLE) * 10000.0 + 0.5) / 10000.0 AS coverage FROM m
), ml AS (
  SELECT hour_ms, 'context_switches' AS metric_key, CAST(switches AS DOUBLE) AS value_num, sessions AS input_row_count, coverage AS coverage_ratio FROM mw
  UNION ALL SELECT hour_ms, 'deep_focus_minutes', deep_focus_minutes, sessions, coverage FROM mw
  UNION ALL SELECT hour_ms, 'focus_minutes', focus_minutes, sessions, coverage FROM mw
  UNION ALL SELECT hour_ms, 'idle_minutes', idle_minutes, sessions, coverage FROM mw
  UNION ALL SELECT hour_ms, 'keyboard_events', CAST(keys AS DOUBLE), keys, 1.0 FROM mw
  UNION ALL SELECT hour_ms, 'mouse_events', CAST(clicks AS DOUBLE), clicks, 1.0 FROM mw
)"""

_HOURLY = _SESSIONS + _FROM_PARTS
#: The same where each hour's sessions are made of its own events alone.
_ALONE = (
    _SESSIONS.replace("OVER (ORDER BY ts_utc, id)", f"OVER (PARTITION BY ts_utc // {HOUR} ORDER BY ts_utc, id)")
    .replace(f"least({END}, CASE WHEN nxt IS NULL THEN {END} ", f"least((ts_utc // {HOUR} + 1) * {HOUR}, CASE WHEN nxt IS NULL THEN (ts_utc // {HOUR} + 1) * {HOUR} ")
    + _FROM_PARTS
)


def _hashes(code: str) -> str:
    return f""", x AS (
  SELECT g.hour_ms, count(id) AS events, sha256('events|' || count(id) || '|' || coalesce(min(ts_utc), 0) || '|' || coalesce(max(ts_utc), 0) || '|' || coalesce(min(id), '') || '|' || coalesce(max(id), '') || '|git:{code}') AS input_hash
  FROM g LEFT JOIN e ON e.ts_utc // {HOUR} * {HOUR} = g.hour_ms GROUP BY g.hour_ms
)"""


_SUMMARY = _HOURLY + _hashes("-") + f""", y AS (SELECT ml.*, input_hash FROM ml JOIN x USING (hour_ms)
), old AS (
  SELECT * REPLACE (CASE WHEN hour_ms // {HOUR} % 60 = 0 THEN 'old' ELSE input_hash END AS input_hash) FROM y WHERE hour_ms // {HOUR} % 50 <> 0
), d AS (
  SELECT hour_ms // {DAY} * {DAY} AS day_ms, metric_key, floor(list_sum(list(value_num ORDER BY hour_ms)) * 100.0 + 0.5) / 100.0 AS value_num, count(*) AS hours_counted,
         count(*) FILTER (coverage_ratio < 0.6) AS low_conf_hours, sha256(string_agg(input_hash, '|' ORDER BY hour_ms) || '|git:-') AS input_hash FROM y GROUP BY ALL
), ta AS (
  SELECT hour_ms, app_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms, min(start_ms) AS seen FROM p GROUP BY ALL
), tr AS (
  SELECT hour_ms, CAST(row_number() OVER (PARTITION BY hour_ms ORDER BY ms DESC, seen) AS INTEGER) AS rank, app_id, floor(ms / 60000.0::DOUBLE * 100.0 + 0.5) / 100.0 AS minutes FROM ta
), tk AS (SELECT * FROM tr WHERE rank <= 3
), ev AS (
  SELECT hour_ms, '[' || string_agg('{{"app_id":' || coalesce('"' || app_id || '"', 'null') || ',"minutes":' || CAST(minutes AS VARCHAR) || '}}', ',' ORDER BY rank) || ']' AS evidence_json FROM tk GROUP BY hour_ms
), ah AS (
  SELECT hour_ms, max(value_num) FILTER (metric_key = 'focus_minutes') AS fm, max(value_num) FILTER (metric_key = 'context_switches') AS sw, max(value_num) FILTER (metric_key = 'deep_focus_minutes') AS df,
         max(value_num) FILTER (metric_key = 'keyboard_events') + max(value_num) FILTER (metric_key = 'mouse_events') AS inp, max(value_num) FILTER (metric_key = 'idle_minutes') AS idle FROM y GROUP BY hour_ms
), ar AS (
  SELECT hour_ms, 'low_focus' AS rule_key, 1 AS place FROM ah WHERE fm < 25 UNION ALL SELECT hour_ms, 'high_switches', 1 FROM ah WHERE sw >= 12 UNION ALL SELECT hour_ms, 'deep_focus_positive', 3 FROM ah WHERE df >= 30
  UNION ALL SELECT hour_ms, 'passive_input', 2 FROM ah WHERE inp < 5 AND fm >= 15 UNION ALL SELECT hour_ms, 'long_idle', 2 FROM ah WHERE idle >= 40
)"""


def _text(x: str) -> str:
    """A whole-numbered or decimal double as the advice writes it."""
    return f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)"


def _rule(period: str, key: str, severity: str, when: str, score: str, text: str, proof: dict[str, str], reason: dict[str, str]) -> str:
    body = lambda d: "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in sorted(d.items())) + " || '}'"
    return f"SELECT {period}, '{key}' AS rule_key, 1 AS rule_version, '{severity}' AS severity, floor(({score}) * 10000.0 + 0.5) / 10000.0 AS score, {text} AS advice_text, {body(proof)} AS evidence_json, {body(reason)} AS reason_json, input_hash FROM aw WHERE {when}"


def _clamp(x: str, low: float, high: float) -> str:
    return f"greatest({low}::DOUBLE, least({high}::DOUBLE, {x}))"


def _advice_sql(daily: bool, aliases: bool = True) -> str:
    """``aliases`` as the rules have it: without, metrics under other names count as 0."""
    names = advice.ALIASES if aliases else {}
    r2 = lambda k: f"coalesce(max(floor(value_num * 100.0 + 0.5) / 100.0) FILTER (metric_key = '{k}'), 0.0)::DOUBLE"
    if daily:
        wide = f""", aw AS (SELECT day_ms, {r2('focus_minutes')} AS fm, {r2('deep_focus_minutes')} AS df, {r2(names.get('switches', 'switches'))} AS sw, arg_max(hours_counted, metric_key) AS hc, arg_max(low_conf_hours, metric_key) AS lc, arg_max(input_hash, metric_key) AS input_hash FROM d GROUP BY day_ms)"""
        proof = lambda **x: {"hours_counted": "hc", "low_conf_hours": "lc", **x}
        reason = lambda **x: {"low_conf_hours_threshold": "4", "low_conf_hours_actual": "lc", **x}
        fm, df, sw = _text("fm"), _text("df"), _text("sw")
        rules = [
            ("low_daily_focus", "warn", "lc <= 4 AND fm < 180", _clamp("(180 - fm) / 180", 0.3, 0.8), f"'Low daily focused time (' || {fm} || 'm; target ≥ 180m). Plan deeper focus blocks.'", proof(focus_minutes=fm), reason(focus_minutes_threshold="'180.0'", focus_minutes_actual=fm)),
            ("positive_deep_focus_day", "good", "lc <= 4 AND df >= 120", _clamp("(df - 120) / 120", 0.4, 0.9), f"'Excellent daily deep focus (' || {df} || 'm). Maintain this momentum.'", proof(deep_focus_minutes=df), reason(deep_focus_minutes_threshold="'120.0'", deep_focus_minutes_actual=df)),
            ("high_switch_day", "warn", "lc <= 4 AND sw >= 150", _clamp("(sw - 150) / 150", 0.3, 0.8), "'High daily context switching (' || CAST(sw AS BIGINT) || 's). Consider time-blocking similar tasks.'", proof(switches=sw), reason(switches_threshold="'150.0'", switches_actual=sw)),
        ]
        return wide + ", adv AS (" + " UNION ALL ".join(_rule("day_ms", *r) for r in rules) + ")"
    wide = f""", aw AS (SELECT *, coalesce(evidence_json, '[]') AS apps FROM (SELECT hour_ms, {r2('focus_minutes')} AS fm, {r2(names.get('switches', 'switches'))} AS sw, {r2('deep_focus_minutes')} AS df, {r2(names.get('keyboard_minutes', 'keyboard_minutes'))} AS kb, {r2(names.get('mouse_minutes', 'mouse_minutes'))} AS ms, {r2('idle_minutes')} AS idle,
          floor(arg_max(coverage_ratio, metric_key)::DOUBLE * 10000.0 + 0.5) / 10000.0 AS cv, arg_max(input_hash, metric_key) AS input_hash FROM y GROUP BY hour_ms) LEFT JOIN ev USING (hour_ms))"""
    fm, sw, df, idle = _text("fm"), _text("sw"), _text("df"), _text("idle")
    proof = lambda **x: {"coverage_ratio": _text("cv"), "top_app_minutes": "apps", **x}
    reason = lambda **x: {"coverage_ratio_threshold": "'0.6'", "coverage_ratio_actual": _text("cv"), **x}
    rules = [
        ("low_focus", "warn", "cv >= 0.6 AND fm < 25", _clamp("(25 - fm) / 25", 0.3, 0.9), f"'Low focused time this hour (' || {fm} || 'm; target ≥ 25m). Try reducing interruptions.'", proof(focus_minutes=fm), reason(focus_minutes_threshold="'25.0'", focus_minutes_actual=fm)),
        ("high_switches", "warn", "cv >= 0.6 AND sw >= 12", _clamp("(sw - 12) / 12", 0.3, 0.8), "'High context switching (' || CAST(sw AS BIGINT) || 's). Batch tasks or pause notifications.'", proof(switches=sw), reason(switches_threshold="'12.0'", switches_actual=sw)),
        ("deep_focus_positive", "good", "cv >= 0.6 AND df >= 30", _clamp("(df - 30) / 30", 0.4, 0.9), f"'Strong deep-focus block (' || {df} || 'm). Protect similar blocks.'", proof(deep_focus_minutes=df), reason(deep_focus_minutes_threshold="'30.0'", deep_focus_minutes_actual=df)),
        ("passive_input", "info", "cv >= 0.6 AND kb + ms < 5 AND fm >= 15", "0.5::DOUBLE", "'Low input but active window time; likely reading or meeting. Capture notes to retain context.'", proof(keyboard_minutes=_text("kb"), mouse_minutes=_text("ms"), focus_minutes=fm), reason(input_minutes_threshold="'5.0'", input_minutes_actual=_text("kb + ms"), focus_minutes_threshold="'15.0'", focus_minutes_actual=fm)),
        ("long_idle", "info", "cv >= 0.6 AND idle >= 40", _clamp("(idle - 40) / 20", 0.3, 0.7), f"'Extended idle (' || {idle} || 'm). If this was a break, great; otherwise consider shorter pauses.'", proof(idle_minutes=idle), reason(idle_minutes_threshold="'40.0'", idle_minutes_actual=idle)),
    ]
    return wide + ", adv AS (" + " UNION ALL ".join(_rule("hour_ms", *r) for r in rules) + ")"


def _digest_sql(daily: bool) -> str:
    p, source = ("day_ms", "d") if daily else ("hour_ms", "y")
    shown = "',hours_counted=' || hours_counted || ',low_conf_hours=' || low_conf_hours" if daily else "',coverage_ratio=' || CAST(CAST(coverage_ratio AS DOUBLE) AS VARCHAR)"
    last = "day_hash" if daily else "hour_hash"
    evidence = "" if daily else " || coalesce(chr(10) || 'evidence[top_app_minutes]=' || evidence_json, '')"
    tail = " || chr(10) || 'day_hash=' || h" if daily else ""
    own = "" if daily else "'\"evidence\":' || coalesce('{\"top_app_minutes\":' || evidence_json || '}', '{}') || ',' || "
    stamp = f"'\"day_hash\":\"' || h || '\",\"day_start_ms\":' || day_ms || ','" if daily else f"{own}'\"hour_hash\":\"' || h || '\",\"hour_start_ms\":' || hour_ms || ','"
    return _SUMMARY + _advice_sql(daily, False) + f""", o AS (
      SELECT {p}, string_agg('metric_key=' || metric_key || ',value_num=' || CAST(value_num AS VARCHAR) || {shown}, chr(10) ORDER BY metric_key) AS t, arg_max(input_hash, metric_key) AS h,
             string_agg('"' || metric_key || '":' || CAST(value_num AS VARCHAR), ',' ORDER BY metric_key) AS m FROM {source} GROUP BY {p}
    ), al AS (
      SELECT {p}, string_agg('advice rule=' || rule_key || ',severity=' || severity || ',score=' || CAST(score AS VARCHAR) || ',text="' || advice_text || '"', chr(10) ORDER BY CASE severity WHEN 'warn' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, rule_key) AS lines,
             string_agg('{{"rule_key":"' || rule_key || '","severity":"' || severity || '","score":' || CAST(score AS VARCHAR) || ',"advice_text":"' || advice_text || '"}}', ',' ORDER BY CASE severity WHEN 'warn' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, rule_key) AS items FROM adv GROUP BY {p}
    ), z AS (
      SELECT {p}, t{evidence} || coalesce(chr(10) || lines, ''){tail} AS txt, '{{"advice":[' || coalesce(items, '') || '],' || {stamp} || '"metrics":{{' || m || '}}}}' AS json, h AS {last} FROM o LEFT JOIN al USING ({p}){"" if daily else " LEFT JOIN ev USING (hour_ms)"}
    ) SELECT {p}, txt, json, {last}, sha256(txt) AS sha256 FROM z"""


_HASHED = f"sha256(from_hex('{SALT}') || encode('url') || from_hex('00') || encode(%s))"
_OTHERS = _EVENTS + ", h AS (SELECT * REPLACE (CASE WHEN user_id % 4 = 0 THEN 'heartbeat' ELSE monitor END AS monitor) FROM e)"

#: Rows of ``@rows`` in batches of ``@n`` rows or ``@span`` ms, each with the place of the row that opens it.
_BATCHES = _EVENTS.replace("WITH e AS", "WITH RECURSIVE e AS") + """, z AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_utc, id) - 1 AS i FROM @rows
), o AS (
  SELECT user_id, i, ts_utc FROM z WHERE i = 0
  UNION ALL SELECT user_id, n.i, n.ts_utc FROM (
    SELECT o.user_id, (SELECT min(z.i) FROM z WHERE z.user_id = o.user_id AND z.i > o.i AND (z.i >= o.i + @n OR z.ts_utc >= o.ts_utc + @span)) AS i FROM o
  ) m JOIN z n USING (user_id, i)
), q AS (
  SELECT z.*, max(o.i) OVER (PARTITION BY z.user_id ORDER BY z.i) AS batch FROM z LEFT JOIN o ON o.user_id = z.user_id AND o.i = z.i
)"""
#: Hours that are missing or have an old hash, computed anew from their own events alone.
_MENDED = _SUMMARY + f""", ya AS (
  SELECT y.hour_ms, y.metric_key, CASE WHEN k THEN a.value_num ELSE y.value_num END AS value_num, y.input_hash, k
  FROM (SELECT *, hour_ms // {HOUR} % 50 = 0 OR hour_ms // {HOUR} % 60 = 0 AS k FROM y) y JOIN ({_ALONE} SELECT * FROM ml) a ON a.hour_ms = y.hour_ms AND a.metric_key = y.metric_key
)"""

ORACLE_SQL = {
    "dimension_upsert": _EVENTS + """ SELECT substr(sha256(subject_id), 1, 32) AS id, subject_id AS key_hash, arg_max(CASE WHEN action <> 'error' THEN action END, ts_utc || id) AS exe_name,
        arg_min(CASE WHEN CAST(id AS BIGINT) % 3 <> 0 THEN 'e' || CAST(id AS BIGINT) % 5 END, ts_utc || id) AS ext, min(ts_utc) AS first_seen_utc, max(ts_utc) AS last_seen_utc FROM e GROUP BY subject_id""",
    "dimension_ids": _EVENTS + """ SELECT id, a AS app_id, substr(sha256(a || chr(31) || action), 1, 32) AS window_id FROM (SELECT e.id, e.action, substr(sha256(app_id), 1, 32) AS a FROM e LEFT JOIN w ON w.id = e.subject_id)""",
    "url_records": f"""SELECT substr(sha256(url_hash), 1, 32) AS id, url_hash, CASE WHEN min(host) = '' THEN '' ELSE {_HASHED % 'min(host)'} END AS domain_hash, min(page_id) AS first_seen_utc, max(page_id) AS last_seen_utc
        FROM (SELECT page_id, {_HASHED % 'url'} AS url_hash, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS host FROM pages WHERE url <> '' AND NOT regexp_matches(url, '^(about|chrome|edge|data):')) GROUP BY url_hash""",
    "enriched_events": _EVENTS + f""" SELECT coalesce(own, substr(sha256(concat_ws(chr(31), 'mouse', session_id, ts_utc, action, 'none', subject_id, coalesce(attrs_json, ''))), 1, 32)) AS id, ts_utc, 'mouse' AS monitor, action, 'none' AS subject_type, subject_id, session_id, attrs_json
        FROM (SELECT CASE WHEN n % 4 <> 0 THEN id END AS own, CASE WHEN n % 7 <> 0 THEN ts_utc ELSE {END} END AS ts_utc, action, subject_id, CASE WHEN n % 2 = 0 THEN 's1' ELSE 's0' END AS session_id, CASE WHEN n % 3 = 0 THEN '{{' || id || '}}' END AS attrs_json
              FROM (SELECT *, CAST(id AS BIGINT) AS n FROM e) WHERE n % 11 <> 0 AND (n % 5 = 0 OR monitor = 'mouse'))""",
    "browser_rows": _EVENTS + " SELECT id, CASE user_id % 6 WHEN 0 THEN 'Chrome.exe' WHEN 2 THEN 'FIREFOX.EXE' ELSE 'iexplore.exe' END AS exe_name FROM e WHERE user_id % 6 IN (0, 2, 4)",
    "activity_rows": _OTHERS + " SELECT id, monitor FROM h WHERE monitor <> 'heartbeat'",
    "idle_snapshots": _OTHERS + """, s AS (
          SELECT id, 'idle_gap' AS trigger, ts_utc + 300000 AS ts_utc FROM (SELECT id, ts_utc, lead(ts_utc) OVER (ORDER BY ts_utc, id) - ts_utc AS gap FROM h WHERE monitor <> 'heartbeat') WHERE gap >= 300000
          UNION ALL SELECT id, 'foreground', ts_utc FROM h WHERE monitor = 'active_window'
        ) SELECT *, ts_utc - lag(ts_utc) OVER (ORDER BY ts_utc, trigger || id) AS since_ms FROM s""",
    "status": _EVENTS + f""" SELECT monitor, event_count, strftime(make_timestamp(last * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN last % 1000 <> 0 THEN '.' || lpad(CAST(last % 1000 AS VARCHAR), 3, '0') || '000' ELSE '' END || '+00:00' AS last_event_utc, a AS age_seconds,
        CASE WHEN a < 60 THEN a || 's ago' WHEN a < 3600 THEN a // 60 || 'm ago' WHEN a < 86400 THEN a // 3600 || 'h ago' ELSE a // 86400 || 'd ago' END AS age_str
        FROM (SELECT monitor, count(*) AS event_count, max(ts_utc) AS last, ({END} - max(ts_utc)) // 1000 AS a FROM e GROUP BY monitor)""",
    "metric_lines": _SUMMARY + " SELECT 'metric_key=' || k || ',unit=' || u || ',version=1' AS line FROM (VALUES ('focus_minutes', 'minutes'), ('idle_minutes', 'minutes'), ('keyboard_events', 'count'), ('mouse_events', 'count'), ('context_switches', 'count'), ('deep_focus_minutes', 'minutes')) v(k, u) WHERE k IN (SELECT metric_key FROM y)",
    "rule_lines": _SUMMARY + _advice_sql(False) + " SELECT k || ',1,' || t AS line FROM (VALUES " + ", ".join(f"('{k}', '{t}')" for k, _, t, _ in advice.CATALOG) + ") v(k, t) WHERE k IN (SELECT rule_key FROM adv)",
    "advice_lines": _SUMMARY + _advice_sql(False) + """ SELECT hour_ms, rule_key, 'advice rule=' || rule_key || ',version=' || rule_version || ',severity=' || severity || ',score=' || CAST(score AS VARCHAR) || ',text="' || advice_text || '",hash=' || input_hash AS line FROM adv""",
    "hour_preview": _EVENTS + f""", n AS (SELECT min(ts_utc) // {HOUR} * {HOUR} AS a, max(ts_utc) // {HOUR} - min(ts_utc) // {HOUR} + 1 AS n FROM e
        ) SELECT i AS place, CASE WHEN i >= 3 AND n > 6 THEN '...' ELSE '' END || 'win=' || i || ',hstart_ms=' || (a + i * {HOUR}) || ',hend_ms=' || (a + (i + 1) * {HOUR}) AS line FROM (SELECT *, unnest(range(0, n)) AS i FROM n) WHERE i < 3 OR i >= n - 3""",
    "missing_tables": _SUMMARY + " SELECT name FROM (SELECT unnest(['hourly', 'daily']) AS name) WHERE NOT EXISTS (SELECT 1 FROM y) UNION ALL SELECT unnest(['evidence', 'hourly_advice', 'daily_advice', 'hourly_report', 'daily_report', 'hourly_digest', 'daily_digest', 'runs'])",
    "tables_like": _SUMMARY + " SELECT name FROM (SELECT unnest(['hourly', 'daily']) AS name) WHERE EXISTS (SELECT 1 FROM y)",
    "largest_files": "SELECT page_id AS path, CAST(coalesce(octet_length(encode(html)), 0) AS BIGINT) AS size FROM pages ORDER BY octet_length(encode(html)) DESC NULLS LAST, page_id LIMIT 5",
    "advice_hourly": _SUMMARY + _advice_sql(False) + " SELECT * FROM adv",
    "advice_daily": _SUMMARY + _advice_sql(True) + " SELECT * FROM adv",
    "hourly_digest": _digest_sql(False),
    "daily_digest": _digest_sql(True),
    "stored_upserts": _SUMMARY + f""" SELECT name, CAST(0 AS BIGINT) AS inserts, CAST(0 AS BIGINT) AS updates, unchanged FROM (
          SELECT 'hourly' AS name, count(*) AS unchanged FROM y UNION ALL SELECT 'evidence', count(*) FROM ev UNION ALL SELECT 'daily', count(*) FROM d
          UNION ALL SELECT 'hourly_report', count(DISTINCT hour_ms) FROM y UNION ALL SELECT 'daily_report', count(DISTINCT day_ms) FROM d
          UNION ALL SELECT 'hourly_advice', n FROM (""" + "WITH " + _advice_sql(False)[2:] + f""" SELECT count(*) AS n FROM adv)
          UNION ALL SELECT 'daily_advice', n FROM (WITH """ + _advice_sql(True)[2:] + """ SELECT count(*) AS n FROM adv))""",
    "event_store": _EVENTS + " SELECT id, ts_utc, monitor FROM e",
    "journal_imports": _EVENTS + """, n AS (
          SELECT monitor, count(*) AS al, count(*) FILTER (user_id % 3 <> 0) AS known, count(*) FILTER (user_id % 5 = 0) AS bad FROM e GROUP BY monitor
        ) SELECT 0 AS run, monitor, known AS events_imported, CAST(0 AS BIGINT) AS duplicates_skipped, CAST(0 AS BIGINT) AS invalid_events, CAST(0 AS BIGINT) AS files_with_errors FROM n
        UNION ALL SELECT 1, monitor, al - known, known + (al - known), bad, 0 FROM n""",
    "recomputed_hours": _MENDED + f""" SELECT y.hour_ms, y.metric_key, y.value_num, y.input_hash, CASE WHEN k THEN 'new' ELSE 'old' END AS run_id, CASE WHEN o.hour_ms IS NULL THEN 2 ELSE 1 END::BIGINT AS created_utc_ms, CASE WHEN k THEN 2 ELSE 1 END::BIGINT AS updated_utc_ms
        FROM ya y LEFT JOIN old o ON o.hour_ms = y.hour_ms AND o.metric_key = y.metric_key
        WHERE o.hour_ms IS NOT NULL OR y.hour_ms IN (SELECT hour_ms FROM x WHERE events > 0)""",
    "recomputed_days": _MENDED + f""", yy AS (SELECT * FROM ya WHERE hour_ms // {HOUR} % 50 <> 0 OR hour_ms IN (SELECT hour_ms FROM x WHERE events > 0)
        ) SELECT hour_ms // {DAY} * {DAY} AS day_ms, metric_key, floor(list_sum(list(value_num ORDER BY hour_ms)) * 100.0 + 0.5) / 100.0 AS value_num, sha256(string_agg(input_hash, '|' ORDER BY hour_ms) || '|git:-') AS input_hash FROM yy GROUP BY ALL""",
    "keyboard_batches": _BATCHES.replace("@rows", f"(SELECT user_id, id, CASE WHEN user_id % 2 = 0 THEN ts_utc ELSE ts_utc // {DAY} * {DAY} + ts_utc % 2000 END AS ts_utc, CASE WHEN action = 'signup' THEN 'keyup' ELSE 'keydown' END AS kind FROM e WHERE monitor = 'keyboard')").replace("@n", "16").replace("@span", str(DAY)) + """, d AS (
          SELECT user_id, batch, ts_utc, row_number() OVER o AS i, ts_utc - lag(ts_utc) OVER o AS g FROM q WHERE kind = 'keydown' WINDOW o AS (PARTITION BY user_id ORDER BY ts_utc, id)
        ), h AS (
          SELECT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS held, false AS hit FROM d GROUP BY user_id
          UNION ALL SELECT user_id, i, CASE WHEN len(l) >= 5 THEN CAST([] AS BIGINT[]) ELSE l END, len(l) >= 5 FROM (
            SELECT h.user_id, d.i, list_append(list_filter(h.held, lambda t: t >= d.ts_utc - 500), d.ts_utc) AS l FROM h JOIN d ON d.user_id = h.user_id AND d.i = h.i + 1)
        ) SELECT q.user_id, q.batch, q.keydown, q.keyup, coalesce(bursts, 0) AS bursts, coalesce(mean_ms, 0) AS mean_ms, coalesce(p95_ms, 0) AS p95_ms, coalesce(stdev_ms, 0) AS stdev_ms
        FROM (SELECT user_id, batch, count(*) FILTER (kind = 'keydown') AS keydown, count(*) FILTER (kind = 'keyup') AS keyup FROM q GROUP BY ALL) q LEFT JOIN (
          SELECT d.user_id, d.batch, count(*) FILTER (hit) AS bursts, floor(avg(g) * 100.0 + 0.5) / 100.0 AS mean_ms, floor(quantile_cont(CAST(g AS DOUBLE), 0.95) * 100.0 + 0.5) / 100.0 AS p95_ms, floor(stddev_samp(g) * 100.0 + 0.5) / 100.0 AS stdev_ms
          FROM d JOIN h ON h.user_id = d.user_id AND h.i = d.i GROUP BY ALL
        ) s ON s.user_id = q.user_id AND s.batch = q.batch""",
    "timed_batches": _BATCHES.replace("@rows", "e").replace("@n", "8").replace("@span", str(2 * DAY)) + " SELECT user_id, ts_utc, id, batch FROM q",
    "mouse_batches": _BATCHES.replace("@rows", """(SELECT *, CASE WHEN action = 'error' THEN ['left', 'right', 'middle'][CAST(id AS BIGINT) % 3 + 1] WHEN action = 'click' THEN 'scroll' ELSE 'move' END AS kind FROM e WHERE action <> 'signup')""").replace("@n", "16").replace("@span", str(4 * DAY)) + """, s AS (
          SELECT user_id, batch, CAST(sum(CAST(trunc(sqrt(power(dx, 2) + power(dy, 2))) AS BIGINT)) AS BIGINT) AS far FROM (
            SELECT *, value - lag(value) OVER o AS dx, value * 2 - lag(value * 2) OVER o AS dy FROM q WHERE kind = 'move' WINDOW o AS (PARTITION BY user_id, batch ORDER BY ts_utc, id)) GROUP BY user_id, batch
        ) SELECT q.user_id, q.batch, count(*) FILTER (kind = 'move') AS moves, count(*) FILTER (kind = 'left') AS click_left, count(*) FILTER (kind = 'right') AS click_right, count(*) FILTER (kind = 'middle') AS click_middle,
                 count(*) FILTER (kind = 'scroll') AS scroll, coalesce(any_value(far), 0) AS distance_px FROM q LEFT JOIN s ON s.user_id = q.user_id AND s.batch = q.batch GROUP BY q.user_id, q.batch""",
    "counters_since_trigger": _EVENTS + """, t AS (SELECT user_id, ts_utc, lag(ts_utc) OVER (PARTITION BY user_id ORDER BY ts_utc) AS was FROM e WHERE monitor = 'active_window'
        ) SELECT t.user_id, t.ts_utc, count(*) FILTER (e.monitor = 'keyboard' AND action <> 'signup') AS kb_down, count(*) FILTER (e.monitor = 'keyboard' AND action = 'signup') AS kb_up,
                 count(*) FILTER (e.monitor = 'mouse' AND CAST(id AS BIGINT) % 3 = 0) AS mouse_moves, count(*) FILTER (e.monitor = 'mouse' AND CAST(id AS BIGINT) % 3 = 1) AS mouse_clicks, count(*) FILTER (e.monitor = 'mouse' AND CAST(id AS BIGINT) % 3 = 2) AS mouse_scroll
        FROM t LEFT JOIN e ON e.user_id = t.user_id AND e.ts_utc <= t.ts_utc AND (was IS NULL OR e.ts_utc > was) GROUP BY t.user_id, t.ts_utc""",
    "hourly_report_json": _SUMMARY + """, o AS (
          SELECT hour_ms, min(input_hash) AS h, string_agg('"' || metric_key || '":{"coverage_ratio":' || CAST(CAST(coverage_ratio AS DOUBLE) AS VARCHAR) || ',"value_num":' || CAST(value_num AS VARCHAR) || '}', ',' ORDER BY metric_key) AS m,
                 string_agg(CAST(CAST(coverage_ratio AS DOUBLE) AS VARCHAR) || ',' || metric_key || ',' || CAST(value_num AS VARCHAR), chr(13) || chr(10) ORDER BY metric_key) AS c FROM y GROUP BY hour_ms
        ) SELECT hour_ms, '{' || coalesce('"evidence":{"top_app_minutes":' || evidence_json || '},', '') || '"hour_hash":"' || h || '","hour_start_ms":' || hour_ms || ',"metrics":{' || m || '}}' AS json,
                 'coverage_ratio,metric_key,value_num' || chr(13) || chr(10) || c || chr(13) || chr(10) AS csv FROM o LEFT JOIN ev USING (hour_ms)""",
    "bursts": _EVENTS.replace("WITH e AS", "WITH RECURSIVE e AS") + f""", n AS (
          SELECT user_id, ts_utc, row_number() OVER (PARTITION BY user_id ORDER BY ts_utc) AS i FROM e
        ), u AS (
          SELECT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS held, 0 AS n FROM e GROUP BY user_id
          UNION ALL SELECT user_id, i, CASE WHEN len(h) >= 3 THEN CAST([] AS BIGINT[]) ELSE h END, n + CAST(len(h) >= 3 AS INTEGER) FROM (
            SELECT u.user_id, n.i, list_append(list_filter(u.held, lambda t: t >= n.ts_utc - {DAY}), n.ts_utc) AS h, u.n FROM u JOIN n ON n.user_id = u.user_id AND n.i = u.i + 1)
        ) SELECT user_id, max(n) AS bursts FROM u GROUP BY user_id""",
    "event_time_range_latest": _EVENTS + f" SELECT id, ts_utc, monitor FROM e WHERE ts_utc BETWEEN {START + DAY} AND {START + 2 * DAY} ORDER BY ts_utc DESC, id DESC LIMIT 50",
    "monitor_status": _EVENTS + f""" SELECT monitor, max(ts_utc) AS last_ts, count(*) AS n,
        CASE WHEN a < 60 THEN a || 's ago' WHEN a < 3600 THEN a // 60 || 'm ago' WHEN a < 86400 THEN a // 3600 || 'h ago' ELSE a // 86400 || 'd ago' END AS age
        FROM (SELECT *, ({END} - max(ts_utc) OVER (PARTITION BY monitor)) // 1000 AS a FROM e) GROUP BY monitor, a""",
    "hour_grid": _EVENTS + f" SELECT h AS hour_ms FROM (SELECT unnest(range(min(ts_utc) // {HOUR} * {HOUR}, max(ts_utc) + 1, {HOUR})) AS h FROM e) WHERE h + {HOUR} + 300000 <= {END - 7 * DAY}",
    "day_grid": _EVENTS + f" SELECT unnest(range(min(ts_utc) // {DAY} * {DAY}, max(ts_utc) + 1, {DAY})) AS day_ms FROM e",
    "focus_sessions": _SESSIONS + " SELECT start_ms, end_ms, window_id, app_id FROM f",
    "session_hour_clip": _SESSIONS + " SELECT hour_ms, start_ms, end_ms, window_id, app_id FROM p",
    "hourly_focus": _HOURLY + " SELECT hour_ms, focus_minutes, idle_minutes, coverage FROM mw",
    "context_switches": _HOURLY + " SELECT hour_ms, sessions, switches FROM hs",
    "deep_focus": _HOURLY + " SELECT hour_ms, deep_ms FROM hs",
    "top3_apps": _SUMMARY + " SELECT hour_ms, rank, app_id, minutes FROM tk",
    "top3_evidence": _SUMMARY + " SELECT hour_ms, evidence_json FROM ev",
    "hourly_metrics_long": _HOURLY + " SELECT hour_ms, metric_key, value_num, input_row_count, coverage_ratio FROM ml",
    "hourly_input_hash": _HOURLY + _hashes("abc123") + " SELECT hour_ms, events, input_hash FROM x",
    "daily_rollup": _SUMMARY + " SELECT day_ms, metric_key, value_num, hours_counted, low_conf_hours FROM d",
    "daily_hash": _SUMMARY + " SELECT day_ms, metric_key, input_hash FROM d",
    "hour_mismatches": _SUMMARY + """ SELECT hour_ms FROM x FULL JOIN (SELECT hour_ms, min(input_hash) AS h FROM old GROUP BY hour_ms) USING (hour_ms)
        WHERE (coalesce(events, 0) > 0 AND h IS NULL) OR (coalesce(events, 0) = 0 AND h IS NOT NULL) OR h <> input_hash""",
    "day_mismatches": _SUMMARY + f""" SELECT day_ms FROM (
          SELECT hour_ms // {DAY} * {DAY} AS day_ms, sha256(string_agg(h, '|' ORDER BY hour_ms) || '|git:-') AS now FROM (SELECT hour_ms, min(input_hash) AS h FROM old GROUP BY hour_ms) GROUP BY ALL
        ) FULL JOIN (SELECT day_ms, min(input_hash) AS kept FROM d GROUP BY day_ms) USING (day_ms) WHERE now IS DISTINCT FROM kept""",
    "upsert_diff": _SUMMARY + """ SELECT CASE WHEN o.hour_ms IS NULL THEN 'insert' WHEN o.value_num = y.value_num AND o.input_hash = y.input_hash THEN 'unchanged' ELSE 'update' END AS change, count(*) AS n
        FROM y LEFT JOIN old o ON o.hour_ms = y.hour_ms AND o.metric_key = y.metric_key GROUP BY 1""",
    "dedupe_events": _EVENTS + " SELECT DISTINCT id, ts_utc FROM e WHERE user_id % 5 <> 0",
    "dim_first_last_seen": _EVENTS + " SELECT subject_id, min(ts_utc) AS first_seen_utc, max(ts_utc) AS last_seen_utc, arg_max(action, ts_utc) AS action FROM e GROUP BY subject_id",
    "left_join_dim": _EVENTS + " SELECT app_id, count(*) AS n FROM e LEFT JOIN w ON w.id = e.subject_id GROUP BY app_id",
    "advice_catalog": _SUMMARY + " SELECT v.*, (SELECT count(*) FROM (" + "WITH " + _advice_sql(False)[2:] + " SELECT rule_key FROM adv) a WHERE a.rule_key = v.rule_key) + (SELECT count(*) FROM (" + "WITH " + _advice_sql(True)[2:] + " SELECT rule_key FROM adv) a WHERE a.rule_key = v.rule_key) AS met FROM (VALUES " + ", ".join(f"('{k}', {v}, '{t}', '{d}')" for k, v, t, d in advice.CATALOG) + ") v(rule_key, version, title, description)",
    "digest_order": _SUMMARY + " SELECT hour_ms, rule_key, place FROM ar",
    "hourly_report_txt": _SUMMARY + """, o AS (
          SELECT hour_ms, string_agg('metric_key=' || metric_key || ',value_num=' || CAST(value_num AS VARCHAR) || ',coverage_ratio=' || CAST(CAST(coverage_ratio AS DOUBLE) AS VARCHAR), chr(10) ORDER BY metric_key) AS t FROM y GROUP BY hour_ms
        ) SELECT hour_ms, t || coalesce(chr(10) || 'evidence[ top_app_minutes ]=' || evidence_json, '') AS txt, sha256(t || coalesce(chr(10) || 'evidence[ top_app_minutes ]=' || evidence_json, '')) AS sha256 FROM o LEFT JOIN ev USING (hour_ms)""",
    "daily_report_txt": _SUMMARY + """, o AS (
          SELECT day_ms, string_agg('metric_key=' || metric_key || ',value_num=' || CAST(value_num AS VARCHAR) || ',hours_counted=' || hours_counted || ',low_conf_hours=' || low_conf_hours, chr(10) ORDER BY metric_key)
                 || chr(10) || 'day_hash=' || min(input_hash) AS txt FROM d GROUP BY day_ms
        ) SELECT day_ms, txt, sha256(txt) AS sha256 FROM o""",
    "daily_report_json": _SUMMARY + """, o AS (
          SELECT day_ms, min(input_hash) AS h, string_agg('"' || metric_key || '":{"hours_counted":' || hours_counted || ',"low_conf_hours":' || low_conf_hours || ',"value_num":' || CAST(value_num AS VARCHAR) || '}', ',' ORDER BY metric_key) AS m,
                 string_agg(hours_counted || ',' || low_conf_hours || ',' || metric_key || ',' || CAST(value_num AS VARCHAR), chr(13) || chr(10) ORDER BY metric_key) AS c FROM d GROUP BY day_ms
        ) SELECT day_ms, '{"day_hash":"' || h || '","day_start_ms":' || day_ms || ',"metrics":{' || m || '}}' AS json, 'hours_counted,low_conf_hours,metric_key,value_num' || chr(13) || chr(10) || c || chr(13) || chr(10) AS csv FROM o""",
    "artifact_files": _SUMMARY + """, o AS (
          SELECT hour_ms, min(input_hash) AS h, string_agg('metric_key=' || metric_key || ',value_num=' || CAST(value_num AS VARCHAR) || ',coverage_ratio=' || CAST(CAST(coverage_ratio AS DOUBLE) AS VARCHAR), chr(10) ORDER BY metric_key) AS t,
                 string_agg(CAST(CAST(coverage_ratio AS DOUBLE) AS VARCHAR) || ',' || metric_key || ',' || CAST(value_num AS VARCHAR), chr(13) || chr(10) ORDER BY metric_key) AS c FROM y GROUP BY hour_ms
        ), n AS (
          SELECT day_ms, min(input_hash) AS h, string_agg('metric_key=' || metric_key || ',value_num=' || CAST(value_num AS VARCHAR) || ',hours_counted=' || hours_counted || ',low_conf_hours=' || low_conf_hours, chr(10) ORDER BY metric_key) AS t,
                 string_agg(hours_counted || ',' || low_conf_hours || ',' || metric_key || ',' || CAST(value_num AS VARCHAR), chr(13) || chr(10) ORDER BY metric_key) AS c FROM d GROUP BY day_ms
        ), af AS (
          SELECT hour_ms AS period_ms, 'hourly' AS kind, 'txt' AS form, h, t || coalesce(chr(10) || 'evidence[ top_app_minutes ]=' || evidence_json, '') AS body FROM o LEFT JOIN ev USING (hour_ms)
          UNION ALL SELECT hour_ms, 'hourly', 'csv', h, 'coverage_ratio,metric_key,value_num' || chr(13) || chr(10) || c || chr(13) || chr(10) FROM o
          UNION ALL SELECT day_ms, 'daily', 'txt', h, t || chr(10) || 'day_hash=' || h FROM n
          UNION ALL SELECT day_ms, 'daily', 'csv', h, 'hours_counted,low_conf_hours,metric_key,value_num' || chr(13) || chr(10) || c || chr(13) || chr(10) FROM n
        ) SELECT period_ms, kind, form, strftime(make_timestamp(period_ms * 1000), '%Y/%m/%d') || '/' || kind || '-' || period_ms || '-' || substr(h, 1, 8) || '.' || form AS path, sha256(body) AS sha256 FROM af""",
    "artifact_paths": _SUMMARY + " SELECT hour_ms, strftime(make_timestamp(hour_ms * 1000), '%Y/%m/%d') || '/hourly-' || hour_ms || '-' || substr(min(input_hash), 1, 8) || '.txt' AS path FROM y GROUP BY hour_ms",
    "salted_hash": f"SELECT page_id, sha256(from_hex('{SALT}') || encode('url') || from_hex('00') || encode(url)) AS hash FROM pages",
    "url_domain": "SELECT page_id, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS authority, coalesce(url <> '' AND NOT regexp_matches(url, '^(about|chrome|edge|data):'), false) AS trackable FROM pages",
    "inter_event_stats": _EVENTS + """ SELECT monitor, count(g) AS n, floor(quantile_cont(CAST(g AS DOUBLE), 0.95) * 10000.0 + 0.5) / 10000.0 AS p95_ms, floor(avg(g) * 10000.0 + 0.5) / 10000.0 AS mean_ms
        FROM (SELECT monitor, ts_utc - lag(ts_utc) OVER (PARTITION BY monitor ORDER BY ts_utc, id) AS g FROM e) GROUP BY monitor""",
    "distance_stats": _EVENTS + """ SELECT user_id, count(*) AS moves, coalesce(CAST(sum(CAST(trunc(sqrt(power(dx, 2) + power(dy, 2))) AS BIGINT)) AS BIGINT), 0) AS distance_px
        FROM (SELECT user_id, value - lag(value) OVER o AS dx, value * 2 - lag(value * 2) OVER o AS dy FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts_utc, id)) GROUP BY user_id""",
    "idle_gaps": _EVENTS + " SELECT id, ts_utc, gap FROM (SELECT id, ts_utc, lead(ts_utc) OVER (ORDER BY ts_utc, id) - ts_utc AS gap FROM e) WHERE gap >= 300000",
    "window_changes": _EVENTS + " SELECT id, user_id, monitor FROM (SELECT *, lag(monitor) OVER (PARTITION BY user_id ORDER BY ts_utc, id) AS was FROM e) WHERE was IS DISTINCT FROM monitor",
    "title_dedupe": _EVENTS.replace("WITH e AS", "WITH RECURSIVE e AS") + f""", u AS (
          SELECT user_id, min(ts_utc) AS ts_utc FROM e GROUP BY user_id
          UNION ALL SELECT u.user_id, (SELECT min(e.ts_utc) FROM e WHERE e.user_id = u.user_id AND e.ts_utc >= u.ts_utc + {DAY}) AS t FROM u WHERE t IS NOT NULL
        ) SELECT u.user_id, u.ts_utc, min(e.id) AS id FROM u JOIN e ON e.user_id = u.user_id AND e.ts_utc = u.ts_utc GROUP BY u.user_id, u.ts_utc""",
    "count_batches": _EVENTS + " SELECT monitor, batch, count(*) AS n, min(ts_utc) AS first_ts FROM (SELECT *, (row_number() OVER (PARTITION BY monitor ORDER BY ts_utc, id) - 1) // 128 AS batch FROM e) GROUP BY ALL",
    "activity_counters": _EVENTS + f" SELECT ts_utc // {HOUR} * {HOUR} AS hour_ms, count(*) FILTER (monitor = 'keyboard') AS keys, count(*) FILTER (monitor = 'mouse' AND action = 'error') AS clicks FROM e GROUP BY ALL",
    "table_counts": "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'pages', count(*) FROM pages",
    "quota_state": "SELECT used, CASE WHEN used >= 1048576 THEN 'HARD' WHEN used >= 943718.4 THEN 'SOFT' ELSE 'NORMAL' END AS state FROM (SELECT CAST(coalesce(sum(octet_length(encode(html))), 0) AS BIGINT) AS used FROM pages)",
    "retention_victims": _EVENTS + " SELECT id, size FROM (SELECT id, user_id AS size, coalesce(sum(user_id) OVER (ORDER BY ts_utc, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e) WHERE before < 100000",
    "invalid_events": _EVENTS + " SELECT id, CAST(id AS BIGINT) % 6 = 0 AS valid FROM e WHERE monitor = 'mouse' AND CAST(id AS BIGINT) % 6 <> 5",
}
