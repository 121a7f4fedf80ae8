"""Import of finished journal files with statistics, an archive and sidecars, and the sweep over unfinished ones."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources import events as source
from strandline.sources import sinks
from strandline.sources.eventstore import EventStore, insert_again

STATS = "monitor string, files_processed long, events_imported long, duplicates_skipped long, invalid_events long, files_with_errors long"
COUNTS = ("files_processed", "events_imported", "duplicates_skipped", "invalid_events", "files_with_errors")


def import_journal(spark: SparkSession, spool: str, store: EventStore, at: Callable[[str], None] = lambda step: None) -> DataFrame:
    """Import the finished files of ``spool`` into the event store; (monitor,
    files_processed, events_imported, duplicates_skipped, invalid_events,
    files_with_errors) of each monitor that had files.

    A file that doesn't unpack to the end of each of its members, or has no line
    of JSON, is left where it is, with a sidecar ``.error`` that is written
    once, and gives no rows; one without a byte isn't listed by Spark and
    stays.  Lines that are no JSON are passed over; of rows
    with one id the first by file and line counts, and ids that are stored
    already are skipped, whatever their days.

    The commit of the store is the point that counts: a run that stops before it
    stores nothing, and the next run reads the same files again; one that
    stops after it leaves files that the next run only moves to
    ``_done/<monitor>/`` (under another name if theirs is taken).  ``at`` is
    called before each step."""
    archive(spark, spool, store)
    began = time.time()
    work = f"{store.folder}/work/reading-{int(began * 1e6)}"
    at("read")
    read = source.checked(source.unpacked(spark, spool))
    read.write.partitionBy("kind").parquet(work)
    rows = spark.read.schema(read.schema).parquet(work)
    parsed = rows.where("kind = 'line' AND is_json")
    seen = parsed.groupBy("file").agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"))
    files = rows.where("kind = 'file'").select("file", "monitor", "error").join(seen, "file", "left").na.fill(0, ["valid", "invalid"])
    none = F.when(F.col("valid") + F.col("invalid") == 0, F.lit("no line of JSON"))
    files.withColumn("error", F.coalesce("error", none)).write.parquet(f"{work}-files")
    files = spark.read.parquet(f"{work}-files")
    at("sidecars")
    for r in files.where("error IS NOT NULL").select("file", "error").toLocalIterator():
        if not sinks.exists(spark, f"{r['file']}.error"):
            text = json.dumps({"error_message": r["error"], "timestamp": int(time.time() * 1000), "file_path": r["file"]}, indent=2)
            sinks.write_small(spark, f"{r['file']}.error", text.encode())
    good = files.where("error IS NULL").select("file", F.col("monitor").alias("directory"))
    valid = parsed.where("ok").select("file", "line_no", "event.*").join(good, "file").select("directory", "file", "line_no", *source.FIELDS)
    totals = files.groupBy("monitor").agg(
        F.count_if(F.col("error").isNull()).alias("files_processed"), F.sum(F.when(F.col("error").isNull(), F.col("valid"))).alias("valid"),
        F.sum(F.when(F.col("error").isNull(), F.col("invalid"))).alias("invalid"), F.count_if(F.col("error").isNotNull()).alias("files_with_errors"),
    ).collect()  # a row a monitor
    added: dict[str, int] = {}
    if any(r["files_processed"] for r in totals):
        entry = insert_again(store, valid, order=("file", "line_no"), files=good, at=at, facts={"seconds_read": round(time.time() - began, 3)}, by="directory")
        added = entry["added"]
        at("archive")
        archive(spark, spool, store, at)
    sinks.remove(spark, work)
    sinks.remove(spark, f"{work}-files")
    out = [(r["monitor"], r["files_processed"], added.get(r["monitor"], 0), (r["valid"] or 0) - added.get(r["monitor"], 0), r["invalid"] or 0, r["files_with_errors"]) for r in totals]
    return spark.createDataFrame(sorted(out), STATS)


def archive(spark: SparkSession, spool: str, store: EventStore, at: Callable[[str], None] = lambda step: None) -> int:
    """Move the files of commits that a run left in the spool to ``_done``; how many."""
    moved, made, folders = 0, set(), store.files(archived=False)
    for folder in folders:

        def put(row) -> int:
            monitor, file = row["directory"], row["file"].split("/")[-1]
            target, n = f"{spool}/_done/{monitor}/{file}", 0
            while sinks.exists(spark, target):
                n += 1
                target = f"{spool}/_done/{monitor}/{file.split('.')[0]}-{n}.{file.split('.', 1)[1]}"
            try:
                sinks.move(spark, row["file"], target, made)
            except Exception:
                if sinks.exists(spark, row["file"]):
                    raise
                return 0  # moved before that run stopped
            at("moved")
            return 1

        moved += sum(sinks.side_by_side(put, spark.read.parquet(folder).toLocalIterator()))  # a part of the list at a time
    store.mark("archived", [f.rsplit("/", 1)[1] for f in folders])
    return moved


def overall(stats: DataFrame, seconds: float) -> DataFrame:
    """One row of totals: (monitors_processed, the counts, events_per_minute) of an import that took ``seconds``."""
    sums = stats.agg(F.count(F.lit(1)).alias("monitors_processed"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])
    rate = F.col("events_imported") / F.lit(float(seconds)) * 60.0 if seconds > 0 else F.lit(0.0)
    return sums.withColumn("events_per_minute", rate)


def recover(spark: SparkSession, spool: str, only: tuple[str, ...] | None = None, at: Callable[[str], None] = lambda step: None) -> dict[str, int]:
    """Turn the unfinished files (``.part``) of a spool, or of the monitors ``only``, into finished
    ones; the totals of the sweep.

    Of gzip files that counts which unpacks before the damage, of plain ones what stands
    before the first bad line; lines that are no JSON are left out.  The lines
    go to ``<stem>_recovered.ndjson.gz`` in the file's folder, what was done to
    ``<file>.error``, and then the unfinished file goes: a second sweep finds
    nothing, and one after a stopped sweep makes the same files again.  A file
    that gives no line stays and counts as failed."""
    monitors = [m for m in sinks.children(spark, spool) if m in source.MONITORS and (only is None or m in only)]
    found = [f"{spool}/{m}/{c}" for m in monitors for c in sinks.children(spark, f"{spool}/{m}") if c.endswith(".part")]
    totals = {"monitors_processed": len(monitors), "temp_files_found": len(found), "temp_files_recovered": 0, "temp_files_failed": len(found), "total_lines_salvaged": 0, "corrupted_lines": 0}
    if not found:
        return totals
    packed, plain = [f for f in found if f.endswith(".gz.part")], [f for f in found if not f.endswith(".gz.part")]
    rows = source.salvage(spark, packed) if packed else spark.createDataFrame([], "file string, line_no long, value string, corrupt boolean")
    if plain:
        lines = spark.read.text(plain).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")
        rows = rows.union(source.salvage_plain(lines).select("file", "line_no", "value", F.lit(False)))
    at("salvage")
    rows = sinks.scratch_table(rows.withColumn("mark", F.hex(F.xxhash64("file"))), "salvaged")
    staging = f"{spool}/_recovering-{uuid.uuid4().hex[:8]}"
    good = rows.where("NOT corrupt")
    good.repartition("mark").sortWithinPartitions("mark", "line_no").select("value", "mark").write.partitionBy("mark").option("compression", "gzip").text(staging)
    sizes = sinks.scratch_table(spark.read.format("binaryFile").load(found).select(F.col("path").alias("file"), "length"), "sizes")
    counts = rows.groupBy("file", "mark").agg(F.count_if(~F.col("corrupt")).alias("good"), F.count_if("corrupt").alias("bad")).join(sizes, "file")
    damage = source.unpacked(spark, packed, "*.gz.part").where("kind = 'file'").select("file", "error") if packed else spark.createDataFrame([], "file string, error string")
    damage = sinks.scratch_table(damage, "damage")
    for r in counts.where("good > 0").join(damage, "file", "left").toLocalIterator():
        folder, name = r["file"].rsplit("/", 1)
        stem = name.removesuffix(".part").removesuffix(".ndjson.gz")
        target = f"{folder}/{stem}_recovered.ndjson.gz"
        part = next(c for c in sinks.children(spark, f"{staging}/mark={r['mark']}") if c.endswith(".gz"))
        sinks.remove(spark, target)  # of a sweep that stopped
        sinks.move(spark, f"{staging}/mark={r['mark']}/{part}", target)
        at("recovered")
        note = f'bytes_read={r["length"]}, lines_salvaged={r["good"]}, reason="{r["error"] or "complete file"}"' + (f", invalid_json_lines={r['bad']}" if r["bad"] else "")
        sinks.write_small(spark, f"{r['file']}.error", note.encode())
        at("noted")
        sinks.remove(spark, r["file"])
        totals["temp_files_recovered"] += 1
    empty = sizes.join(counts.where("good > 0").select("file"), "file", "left_anti").join(damage, "file", "left")
    for r in empty.toLocalIterator():
        if not sinks.exists(spark, f"{r['file']}.error"):
            sinks.write_small(spark, f"{r['file']}.error", f"No valid lines salvaged from {r['length']} bytes; {r['error'] or 'all lines corrupted'}".encode())
    good_lines, bad_lines = rows.agg(F.count_if(~F.col("corrupt")), F.count_if("corrupt")).first()
    sinks.remove(spark, staging)
    sinks.release(spark, rows, sizes, damage)
    return totals | {"temp_files_failed": len(found) - totals["temp_files_recovered"], "total_lines_salvaged": good_lines, "corrupted_lines": bad_lines}
