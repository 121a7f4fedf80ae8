"""The event store: every id once, over all days, commits and reruns.

A commit is a folder of Parquet files, the filters of its ids and the list of the
files it came from; it counts from the moment its entry is in the log.  A job that
stops before leaves only a folder that nothing reads.  Ids are dealt to buckets by
their hash.  Each bucket has a Bloom filter, split into segments of 32768 bits, so
new rows meet the filters and only those that may be stored meet stored ids."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources import sinks

#: Bits of a segment (those of Spark's bitmap functions) and those that an id sets.
SEGMENT_BITS, HASHES = 32768, 7
#: Ids that a segment takes with a hundredth of false answers or fewer.
SEGMENT_IDS = 3000
#: Filters of so many commits are merged into one.
MOST_FILTERS = 16
#: Buckets up to which an exact look reads only these.
MOST_BUCKETS = 1000


class EventStore:
    """A table of events (id, ts_utc, ...) in a folder that all executors share.

    ``buckets`` and ``segments`` (a bucket's share of the filter) are fixed when
    the store is made; the filter grows by itself when the ids outgrow it."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 8, segments: int = 8):
        self.spark, self.folder = spark, folder.rstrip("/")
        first = sinks.read_small(spark, f"{self.folder}/store.json")
        if first is None:
            sinks.publish(spark, f"{self.folder}/store.json", json.dumps({"buckets": buckets, "segments": segments}).encode())
            first = sinks.read_small(spark, f"{self.folder}/store.json")
        self.buckets = json.loads(first)["buckets"]
        self.first_segments = json.loads(first)["segments"]

    # the log

    def log(self) -> list[dict]:
        """The entries of all commits in order."""
        names = [c for c in sinks.children(self.spark, f"{self.folder}/log") if c.endswith(".json")]
        return [json.loads(sinks.read_small(self.spark, f"{self.folder}/log/{c}")) for c in names]

    def _publish(self, entry: dict, version: int) -> None:
        if not sinks.publish(self.spark, f"{self.folder}/log/{version:012}.json", json.dumps(entry, sort_keys=True).encode()):
            raise ConflictError(f"another writer made commit {version} of {self.folder}")

    def _commits(self, log: list[dict]) -> list[dict]:
        return [e for e in log if "commit" in e and e["events"]]

    # reading

    def read(self, since: int | None = None, until: int | None = None) -> DataFrame | None:
        """The events, or those of [since, until), of which commits outside aren't opened; None before the first."""
        inside = [e for e in self._commits(self.log()) if (since is None or e["last_ts"] >= since) and (until is None or e["first_ts"] < until)]
        if not inside:
            return None
        rows = self._events(inside).drop("commit", "bucket")
        if since is not None:
            rows = rows.where(F.col("ts_utc") >= since)
        return rows if until is None else rows.where(F.col("ts_utc") < until)

    def _events(self, entries: list[dict]) -> DataFrame:
        base = f"{self.folder}/events"
        return self.spark.read.option("basePath", base).parquet(*[f"{base}/commit={e['commit']}" for e in entries])

    # filters

    def _placed(self, rows: DataFrame, segments: int) -> DataFrame:
        """Add the bucket, the segment of its filter and the bits of each id."""
        mark = F.xxhash64("id")
        bits = F.array(*[F.pmod(F.xxhash64("id", F.lit(j)), F.lit(SEGMENT_BITS)).cast("int") for j in range(HASHES)])
        return rows.withColumn("bucket", F.pmod(mark, F.lit(self.buckets)).cast("int")).withColumn("_segment", F.pmod(F.xxhash64("id", F.lit(-1)), F.lit(segments)).cast("int")).withColumn("_bits", bits)

    def _filter_of(self, ids: DataFrame, segments: int) -> DataFrame:
        bits = self._placed(ids.select("id"), segments).select("bucket", "_segment", F.explode("_bits").alias("_bit"))
        return bits.groupBy("bucket", "_segment").agg(F.bitmap_construct_agg(F.col("_bit").cast("long")).alias("bitmap"))

    def _filters(self, entries: list[dict]) -> DataFrame | None:
        """(bucket, _segment, bitmap) of all commits; those before the last whole filter are in it."""
        paths = []
        for e in reversed(entries):
            paths.append(f"{self.folder}/filters/{e['commit']}")
            if e["whole_filter"]:
                break
        return self.spark.read.parquet(*paths) if paths else None

    def _maybe(self, placed: DataFrame, entries: list[dict]) -> DataFrame:
        """Rows with ``_maybe``: whether their ids may be stored."""
        filters = self._filters(entries)
        one = filters.groupBy("bucket", "_segment").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        bit = lambda p: F.getbit(F.conv(F.hex(F.substring("bitmap", F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long"), (p % 8).cast("int")) == 1
        return placed.join(one, ["bucket", "_segment"], "left").withColumn("_maybe", F.col("bitmap").isNotNull() & F.coalesce(F.forall("_bits", bit), F.lit(False))).drop("bitmap")

    # writing

    def insert(self, batch: DataFrame, order: tuple[str, ...] = ("ts_utc",), files: DataFrame | None = None, at: Callable[[str], None] = lambda step: None, facts: dict | None = None, by: str | None = None) -> dict:
        """Add the rows whose ids aren't stored; the log's entry of the commit.

        Of rows that share an id the first in ``order`` counts (rows equal there
        by all their columns), whatever their days.  ``files`` (any columns) are
        written beside the commit and ``facts`` go into its entry; ``by`` names a
        column whose values get counts of their added rows there.  Rows
        without an id aren't taken.  ``at`` is called before each step.  A
        second writer that commits meanwhile makes this commit look again at
        what it added; after an error nothing is stored."""
        at("begin")
        log = self.log()
        entries, commit = self._commits(log), uuid.uuid4().hex
        segments = entries[-1]["segments"] if entries else self.first_segments
        columns = [c for c in batch.columns if c != "id"]
        first = F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("_r")  # also in each task, so a repeated id doesn't meet in one
        once = batch.where(F.col("id").isNotNull()).groupBy("id").agg(first).select("id", *[F.col(f"_r.{c}").alias(c) for c in columns])
        work = f"{self.folder}/work/{commit}"
        at("stage")
        marked = self._placed(once, segments)
        if entries:
            marked = self._maybe(marked, entries)
        else:
            marked = marked.withColumn("_maybe", F.lit(False))
        marked.drop("_segment", "_bits").write.parquet(work)
        fresh = self._fresh(work, entries)
        at("events")
        target = f"{self.folder}/events/commit={commit}"
        fresh.repartition("bucket", F.floor(F.col("ts_utc") / F.lit(86_400_000.0))).sortWithinPartitions("bucket", "ts_utc").write.partitionBy("bucket").parquet(target)
        added = self.spark.read.schema(fresh.schema).parquet(target)
        n, first_ts, last_ts = added.agg(F.count(F.lit(1)), F.min("ts_utc"), F.max("ts_utc")).first()
        counts = {r[0]: r[1] for r in added.groupBy(by).count().collect()} if by and n else {}
        total = n + (entries[-1]["total"] if entries else 0)
        at("filter")
        grown = segments
        while total > grown * self.buckets * SEGMENT_IDS:
            grown *= 2
        since_whole = next((k for k, e in enumerate(reversed(entries)) if e["whole_filter"]), len(entries))
        whole = not entries or grown != segments or since_whole >= MOST_FILTERS
        if n:
            if grown != segments:
                known = self.read()
                new = self._filter_of(added if known is None else added.select("id").union(known.select("id")), grown)
            else:
                new = self._filter_of(added, grown)
                if whole and entries:
                    new = new.union(self._filters(entries)).groupBy("bucket", "_segment").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
            new.write.parquet(f"{self.folder}/filters/{commit}")
        if files is not None:
            at("files")
            files.write.parquet(f"{self.folder}/files/{commit}")
        at("commit")
        entry = {"commit": commit, "events": n, "total": total, "segments": grown, "whole_filter": whole, "first_ts": first_ts, "last_ts": last_ts, "files": files is not None, "added": counts, "at": int(time.time() * 1000), "facts": facts or {}}
        self._publish(entry, len(log) + 1)
        at("done")
        sinks.remove(self.spark, work)
        return entry

    def _fresh(self, work: str, entries: list[dict]) -> DataFrame:
        """The staged rows whose ids aren't stored: of those that may be, exact ids decide."""
        staged = self.spark.read.parquet(work)
        new = staged.where("NOT _maybe").drop("_maybe")
        maybe = staged.where("_maybe").drop("_maybe")
        if not entries:
            return new
        buckets = [r[0] for r in maybe.select("bucket").distinct().limit(MOST_BUCKETS + 1).collect()]
        if not buckets:
            return new
        stored = self._events(entries).select("bucket", "id")
        if len(buckets) <= MOST_BUCKETS:
            stored = stored.where(F.col("bucket").isin(buckets))
        return new.union(maybe.join(stored.select("id"), "id", "left_anti").select(*new.columns))

    def files(self, archived: bool) -> list[str]:
        """Folders of the file lists of commits whose files are, or aren't yet, known to be moved."""
        log = self.log()
        done = self._marked(log, "archived")
        return [f"{self.folder}/files/{e['commit']}" for e in log if e.get("files") and (e["commit"] in done) == archived]

    def unmarked(self, mark: str) -> list[dict]:
        """The entries of commits with events that don't have a mark yet."""
        log = self.log()
        done = self._marked(log, mark)
        return [e for e in self._commits(log) if e["commit"] not in done]

    def rows_of(self, entries: list[dict]) -> DataFrame:
        """The events that these commits added."""
        return self._events(entries).drop("commit", "bucket")

    def mark(self, mark: str, commits: list[str]) -> None:
        """Note in the log that something is done with these commits; a second time changes nothing."""
        for commit in commits:
            while True:
                log = self.log()
                if commit in self._marked(log, mark):
                    break
                try:
                    self._publish({"mark": mark, "of": commit}, len(log) + 1)
                    break
                except ConflictError:
                    continue

    def _marked(self, log: list[dict], mark: str) -> set[str]:
        return {e["of"] for e in log if e.get("mark") == mark}

    def vacuum(self) -> int:
        """Delete what jobs left behind that didn't commit; how many folders.  No writer may be at work."""
        known, n = {e["commit"] for e in self.log() if "commit" in e}, 0
        for kind in ("events", "filters", "files", "work"):
            for name in sinks.children(self.spark, f"{self.folder}/{kind}"):
                if kind == "work" or name.removeprefix("commit=") not in known:
                    sinks.remove(self.spark, f"{self.folder}/{kind}/{name}")
                    n += 1
        return n


class ConflictError(RuntimeError):
    """Another writer committed first; the work can be done again."""


def insert_again(store: EventStore, batch: DataFrame, tries: int = 5, **options) -> dict:
    """``insert``, done again where another writer was faster."""
    for left in range(tries, 0, -1):
        try:
            return store.insert(batch, **options)
        except ConflictError:
            if left == 1:
                raise
    raise ValueError("no tries")
