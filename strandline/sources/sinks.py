"""Sinks: the journal, small artifacts, and the archive of read files."""

from __future__ import annotations

import atexit
import csv
import hashlib
import io
import json
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandline.functions.scalars import hour_text


#: A task's files go to their folder when it ends, not one by one when the job does; for folders that are read only behind the job.
COMMIT_AT_ONCE = ("mapreduce.fileoutputcommitter.algorithm.version", "2")
#: Bytes of lines of a journal file before compression.
SEGMENT_BYTES = 8 << 20
#: Renames that are on their way at once.
MOVERS = 16


_stores: dict[tuple[str, str, str], object] = {}


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    at = urlsplit(name)
    key = spark.sparkContext.applicationId, at.scheme, at.netloc
    if key not in _stores:
        _stores[key] = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return _stores[key], path


def exists(spark: SparkSession, name: str) -> bool:
    files, path = _path(spark, name)
    return bool(files.exists(path))


def children(spark: SparkSession, name: str) -> list[str]:
    """Names in a folder of any store that Spark can reach."""
    files, path = _path(spark, name)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def move(spark: SparkSession, source: str, target: str, made: set[str] | None = None) -> None:
    """Rename a file; the target's folder is made, unless ``made`` names it."""
    files, path = _path(spark, source)
    goal = _path(spark, target)[1]
    folder = target.rsplit("/", 1)[0]
    if made is None or folder not in made:
        files.mkdirs(goal.getParent())
        if made is not None:
            made.add(folder)
    if not files.rename(path, goal):
        raise OSError(f"{source} can't be moved to {target}")


def listing(spark: SparkSession, path: str, glob: str = "*") -> Iterator[str]:
    """Paths of the files below a folder, in order; Spark lists them, and a part at a time is here."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return (r["path"] for r in found.select("path").orderBy("path").toLocalIterator())


def remove(spark: SparkSession, name: str) -> bool:
    """Delete a file or folder; whether there was one."""
    files, path = _path(spark, name)
    return bool(files.delete(path, True))


_leaving: dict[str, SparkSession] = {}


def remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Delete a folder when the driver ends; a result may read from it until then."""
    if not _leaving:
        atexit.register(_remove_leaving)
    _leaving[folder] = spark


def _remove_leaving() -> None:
    for folder, spark in _leaving.items():
        if spark.sparkContext._jsc is not None:
            remove(spark, folder)


def scratch_table(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the session's shared scratch folder and read it back: it survives
    lost executors and cuts the lineage.  It goes when released, or at the end."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    home = f"{(base or 'file:///tmp/checkpoints/strandline').rstrip('/')}/steps-{spark.sparkContext.applicationId}"
    remove_at_exit(spark, home)
    path = f"{home}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete scratch tables that no later job reads."""
    for table in tables:
        remove(spark, table._scratch)


def write_small(spark: SparkSession, name: str, content: bytes) -> None:
    """Write a sidecar or an artifact of a few KB through the driver."""
    files, path = _path(spark, name)
    out = files.create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def read_small(spark: SparkSession, name: str) -> bytes | None:
    """A file of a few KB, or None where there is none."""
    files, path = _path(spark, name)
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def publish(spark: SparkSession, name: str, content: bytes) -> bool:
    """Make a small file whole and only if there is none of its name yet; whether this call made it.

    In a folder of the machine a link does it; elsewhere the store's rename,
    which doesn't replace a file, as in HDFS."""
    files, path = _path(spark, name)
    files.mkdirs(path.getParent())
    if files.getUri().getScheme() == "file":
        target = path.toUri().getPath()
        aside = f"{os.path.dirname(target)}/.{os.path.basename(target)}-{uuid.uuid4().hex}"
        with open(aside, "wb") as f:
            f.write(content)
        try:
            os.link(aside, target)
        except FileExistsError:
            return False
        finally:
            os.remove(aside)
        return True
    aside = f"{name}-{uuid.uuid4().hex}"
    write_small(spark, aside, content)
    if files.exists(path) or not files.rename(_path(spark, aside)[1], path):
        remove(spark, aside)
        return False
    return True


def write_journal(events: DataFrame, path: str, per_file: int = 100_000, daily: bool = False) -> int:
    """Events as compressed JSON lines in ``path/<monitor>/<YYYYMMDD-HH>-<run>-<n>.ndjson.gz``,
    a new file each hour (or each UTC day, without its hour) and each ``per_file``
    rows, and how many files there are.

    Spark writes to a hidden folder; each finished file is then renamed into
    its place, so a reader never sees a part of one."""
    spark, run = events.sparkSession, uuid.uuid4().hex[:8]
    staging = f"{path}/_staging-{run}"
    line = F.to_json(F.struct(*events.columns))
    named = events.select(line.alias("value"), "monitor", (F.substring(hour_text(F.col("ts_utc")), 1, 8) if daily else hour_text(F.col("ts_utc"))).alias("hour"))
    named = named.hint("rebalance", "monitor", "hour")  # a file an hour, of a busy hour several
    named.write.partitionBy("monitor", "hour").option("maxRecordsPerFile", per_file).option("compression", "gzip").option(*COMMIT_AT_ONCE).text(staging)
    return _place_files(spark, staging, path, run)


def _place_files(spark: SparkSession, staging: str, path: str, run: str) -> int:
    """Move the files of ``staging/monitor=/hour=/`` to their names below ``path``; how many."""
    made: set[str] = set()

    def place(item: tuple[int, str]) -> int:
        n, found = item
        _, monitor, rest = re.split(r"/(?:monitor|hour)=", found)
        move(spark, found, f"{path}/{monitor}/{rest.split('/')[0]}-{run}-{n}.ndjson.gz", made)
        return 1

    n = sum(side_by_side(place, enumerate(listing(spark, staging, "*.gz")))) if children(spark, staging) else 0
    remove(spark, staging)
    return n


def spool_journal(events: DataFrame, path: str, most_bytes: int = SEGMENT_BYTES) -> dict[str, int]:
    """Events as journal files that roll over each hour and where a file has ``most_bytes`` of lines
    before compression; counters of files, rows and bytes of lines.

    Lines stand in the order of time and id.  A file takes lines until it has
    ``most_bytes`` or more, so the next one opens at the first line so many
    bytes behind its first; these lines are found by pointer doubling, and a
    file is a task's work of bounded size.  The counters are observed while the
    files are written."""
    from strandline.operators import segments

    spark, run = events.sparkSession, uuid.uuid4().hex[:8]
    staging = f"{path}/_staging-{run}"
    line = F.to_json(F.struct(*events.columns))
    named = events.select(line.alias("value"), "monitor", hour_text(F.col("ts_utc")).alias("hour"), F.concat_ws("/", "monitor", hour_text(F.col("ts_utc"))).alias("_file"), "ts_utc", "id")
    placed = segments.places(named.withColumn("_size", (F.octet_length("value") + 1).cast("long")), "_file")
    placed = scratch_table(segments.running(placed, "_file", "_size", "_bytes"), "spool")
    if not placed.limit(1).count():  # nothing would be observed
        release(spark, placed)
        return {"files": 0, "rows": 0, "bytes": 0}
    opens = segments.spaced(placed.select("_file", "_pos", "_bytes"), "_file", "_bytes", most_bytes, bucket=most_bytes)
    cut = segments.opened(placed, opens, "_file", "segment")
    counted = Observation()
    out = cut.observe(counted, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_size"), F.lit(0)).alias("bytes"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartition(tasks, "monitor", "hour", "segment").sortWithinPartitions("monitor", "hour", "segment", "_pos")
    out.select("value", "monitor", "hour", "segment").write.partitionBy("monitor", "hour", "segment").option("compression", "gzip").option(*COMMIT_AT_ONCE).text(staging)
    found = counted.get
    release(spark, placed)
    return {"files": _place_files(spark, staging, path, run), "rows": found["rows"], "bytes": found["bytes"]}


def side_by_side(call: Callable, items: Iterable) -> Iterator:
    """``call`` of each item, some at once and in order: renames are short calls to the
    file store, and a window of them is on its way at a time."""
    with ThreadPoolExecutor(MOVERS) as pool:
        items = iter(items)
        while window := list(islice(items, 64 * MOVERS)):
            yield from pool.map(call, window)


def text_bytes(text: str) -> tuple[bytes, str]:
    raw = text.encode()
    return raw, hashlib.sha256(raw).hexdigest()


def json_bytes(value: object, compact: bool = False) -> tuple[bytes, str]:
    """Sorted keys; with an indent and a last line break, or compact without."""
    return text_bytes(json.dumps(value, sort_keys=True, separators=(",", ":")) if compact else json.dumps(value, indent=2, sort_keys=True) + "\n")


def csv_bytes(rows: list[dict]) -> tuple[bytes, str]:
    """Sorted columns and CR LF; no rows give an empty file."""
    out = io.StringIO()
    if rows:
        writer = csv.DictWriter(out, sorted(rows[0]))
        writer.writeheader()
        writer.writerows(rows)
    return text_bytes(out.getvalue())
