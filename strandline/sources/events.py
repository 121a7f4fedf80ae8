"""Event sources: the journal, its validation, and salvage of damaged files."""

from __future__ import annotations

import json
import zlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the event model.
MONITORS = ("active_window", "context_snapshot", "keyboard", "mouse", "browser", "file", "heartbeat")
SUBJECTS = ("app", "window", "file", "url", "none")
#: Monitors whose events are activity of a user.
ACTIVITY = ("keyboard", "mouse", "active_window")
BROWSERS = ("chrome.exe", "msedge.exe", "brave.exe", "firefox.exe", "opera.exe", "vivaldi.exe", "safari.exe", "iexplore.exe")
REQUIRED = ("id", "ts_utc", "monitor", "action", "subject_type", "session_id")
FIELDS = {
    "id": "string", "ts_utc": "bigint", "monitor": "string", "action": "string", "subject_type": "string", "subject_id": "string", "session_id": "string", "batch_id": "string",
    "pid": "bigint", "exe_name": "string", "exe_path_hash": "string", "window_title_hash": "string", "url_hash": "string", "file_path_hash": "string", "attrs_json": "string",
}


#: Compressed bytes that are unpacked, and lines that are handed on, at once.
PIECE, LINES = 1 << 16, 2000
UNPACKED = pa.schema([("file", pa.string()), ("monitor", pa.string()), ("kind", pa.string()), ("line_no", pa.int64()), ("value", pa.string()), ("error", pa.string())])


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """(file, monitor, value) of the lines of finished journal files under
    ``path/<monitor>/``; unfinished and sidecar files don't match the glob."""
    lines = spark.read.option("pathGlobFilter", "*.ndjson.gz").option("recursiveFileLookup", "true").text(path)
    name = F.col("_metadata.file_path")
    return lines.select(name.alias("file"), F.element_at(F.split(name, "/"), -2).alias("directory"), "value").where(F.col("directory").isin(*MONITORS))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add ``event`` (variant); blank lines and lines that are no JSON are dropped."""
    return lines.where(F.trim(column) != "").withColumn("event", F.try_parse_json(column)).where(F.col("event").isNotNull())


def is_valid(event: Column) -> Column:
    """Whether an event has the required keys and values of the right types.

    Ids must be texts and times whole numbers; a number as an id, or a text as
    a time, makes an event invalid, as do unknown monitors and subject types."""
    get = lambda key, kind: F.try_variant_get(event, f"$.{key}", kind)
    kind = lambda key: F.schema_of_variant(get(key, "variant"))
    ok = F.lit(True)
    for key in REQUIRED:
        ok = ok & get(key, "variant").isNotNull()
    ok = ok & (kind("id") == "STRING") & (kind("ts_utc") == "BIGINT")
    return F.coalesce(ok & get("monitor", "string").isin(*MONITORS) & get("subject_type", "string").isin(*SUBJECTS), F.lit(False))


def project(events: DataFrame, *keep: str) -> DataFrame:
    """The 15 event columns; missing keys are null and others are dropped."""
    return events.select(*keep, *[F.try_variant_get("event", f"$.{k}", t).alias(k) for k, t in FIELDS.items()])


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events as columns, and the lines of the others for quarantine."""
    marked = events.withColumn("_ok", is_valid(F.col("event")))
    return project(marked.where("_ok")), marked.where("NOT _ok").drop("event", "_ok")


def latest_in_range(events: DataFrame, start: int, end: int, limit: int = 1000) -> DataFrame:
    """The newest events of a range with both ends."""
    return events.where(F.col("ts_utc").between(start, end)).orderBy(F.desc("ts_utc"), F.desc("id")).limit(limit)


def reject_plaintext(events: DataFrame, tokens: list[str], column: str = "attrs_json") -> DataFrame:
    """Events whose payload holds none of ``tokens``."""
    held = F.lit(False)
    for t in tokens:
        held = held | F.coalesce(F.contains(F.col(column), F.lit(t)), F.lit(False))
    return events.where(~held)


def activity_rows(events: DataFrame) -> DataFrame:
    """Events of the monitors that show a user at work."""
    return events.where(F.col("monitor").isin(*ACTIVITY))


def browser_rows(events: DataFrame, column: str = "exe_name") -> DataFrame:
    """Events of a browser's program, in any case of letters."""
    return events.where(F.lower(column).isin(*BROWSERS))


def enrich(rows: DataFrame, monitor: str, session_id: str, now: int) -> DataFrame:
    """The rows that ``monitor`` may emit, with the id, time, monitor and session that they lack.

    Rows without action or subject type, or of another monitor, are left out.
    A missing id is made of the row's values, so a rerun makes the same one and
    rows that agree in all of them count as one event."""
    ts = F.coalesce("ts_utc", F.lit(now).cast("long"))
    session = F.coalesce("session_id", F.lit(session_id))
    text = F.concat_ws("\x1f", F.lit(monitor), session, ts.cast("string"), "action", "subject_type", F.coalesce("subject_id", F.lit("")), F.coalesce("attrs_json", F.lit("")))
    own = F.substring(F.sha2(text, 256), 1, 32)
    good = F.col("action").isNotNull() & F.col("subject_type").isNotNull() & F.coalesce(F.col("monitor") == monitor, F.lit(True))
    made = {"id": F.coalesce("id", own), "ts_utc": ts, "monitor": F.lit(monitor), "session_id": session}
    return rows.where(good).select(*[made.get(c, F.col(c)).alias(c) for c in rows.columns])


def salvage(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, value, corrupt) of every whole line that damaged gzip files
    still give: each file is unpacked in pieces up to the damage and its last
    line, if unfinished, dropped, in whole files too.  ``corrupt`` marks lines that are no JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                tail, rows, n, start = b"", [], 0, 0
                while start < len(content):  # a file may have several members
                    engine, at = zlib.decompressobj(31), start
                    try:
                        while not engine.eof and at < len(content):
                            tail += engine.decompress(content[at : at + PIECE])
                            at = min(at + PIECE, len(content))
                            *whole, tail = tail.split(b"\n")
                            for line in filter(None, (x.strip() for x in whole)):
                                n += 1
                                text = line.decode("utf-8", "replace")
                                rows.append((name, n, text, not _is_json(text)))
                    except zlib.error:
                        break
                    start = at - len(engine.unused_data)
                columns = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.bool_()))], ["file", "line_no", "value", "corrupt"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, line_no long, value string, corrupt boolean")


def unpacked(spark: SparkSession, path: str | list[str], glob: str = "*.ndjson.gz", done: str = "_done") -> DataFrame:
    """(file, monitor, kind, line_no, value, error) of all finished journal files of the
    monitors below ``path``, but those in an archive: a row of kind ``line`` for
    each line that isn't blank and, after them, one of kind ``file`` with the error
    that ended the file, or null.

    A file is read once, in pieces of 64 KiB; a gzip file may have several members,
    and each must unpack to its end.  A file that ends inside a member, has other
    bytes behind one or isn't UTF-8 is in error.  One file's
    compressed bytes and a piece's lines are held at a time."""

    def lines(content: bytes) -> Iterator[bytes]:
        start, tail = 0, b""
        while start < len(content):
            engine, at = zlib.decompressobj(31), start
            while not engine.eof:
                if at >= len(content):
                    raise ValueError("truncated gzip")
                *whole, tail = (tail + engine.decompress(content[at : at + PIECE])).split(b"\n")
                at = min(at + PIECE, len(content))
                yield from whole
            start = at - len(engine.unused_data)
            if content[start : start + 1] == b"\0" and not content[start:].strip(b"\0"):
                break  # padding may follow the last member
        yield tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                file, monitor, n, rows, error = b.column("path")[k].as_py(), b.column("monitor")[k].as_py(), 0, [], None
                try:
                    for raw in lines(b.column("content")[k].as_py()):
                        text = raw.decode().strip()
                        if text:
                            n += 1
                            rows.append((n, text))
                        if len(rows) >= LINES:
                            yield _line_batch(file, monitor, rows)
                            rows = []
                except (zlib.error, ValueError) as e:
                    error = str(e) or type(e).__name__
                if rows:
                    yield _line_batch(file, monitor, rows)
                yield pa.RecordBatch.from_pylist([{"file": file, "monitor": monitor, "kind": "file", "line_no": n, "value": None, "error": error}], schema=UNPACKED)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    parts = F.split("path", "/")
    here = files.select("path", F.element_at(parts, -2).alias("monitor"), "content").where(F.col("monitor").isin(*MONITORS) & (F.coalesce(F.try_element_at(parts, F.lit(-3)), F.lit("")) != done))
    return here.mapInArrow(run, "file string, monitor string, kind string, line_no long, value string, error string")


def checked(lines: DataFrame) -> DataFrame:
    """(file, monitor, kind, line_no, error, is_json, ok, event) of the rows of ``unpacked``: whether
    a line is JSON, whether it is a valid event, and its 15 columns.

    A line is parsed once: a filter on what is made of a parsed line would parse
    it again for each part of its condition, so filters belong behind a write."""
    event = F.col("_event")
    parsed = lines.withColumn("_event", F.try_parse_json("value"))
    fields = F.struct(*[F.try_variant_get(event, f"$.{k}", t).alias(k) for k, t in FIELDS.items()])
    return parsed.select("file", "monitor", "kind", "line_no", "error", event.isNotNull().alias("is_json"), is_valid(event).alias("ok"), fields.alias("event"))


def _line_batch(file: str, monitor: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    n = len(rows)
    columns = [pa.array([file] * n), pa.array([monitor] * n), pa.array(["line"] * n), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.nulls(n, pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=UNPACKED)


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def salvage_plain(lines: DataFrame) -> DataFrame:
    """Of (file, line_no, value): the lines before the first bad one of each file."""
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.max(F.try_parse_json("value").isNull()).over(order)
    return lines.where(F.trim("value") != "").withColumn("_bad", bad).where("NOT _bad").drop("_bad")


def generate(spark: SparkSession, n: int, start: int = 1_704_067_200_000, seed: int = 1) -> DataFrame:
    """Synthetic events of all monitors, one a second."""
    pick = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(len(MONITORS))).cast("int") + 1
    monitor = F.element_at(F.array(*[F.lit(m) for m in MONITORS]), pick)
    return spark.range(n).select(
        F.lpad(F.col("id").cast("string"), 26, "0").alias("id"), (F.col("id") * 1000 + start).alias("ts_utc"), monitor.alias("monitor"), F.lit("sample").alias("action"),
        F.lit("none").alias("subject_type"), F.lit(None).cast("string").alias("subject_id"), F.lit("session").alias("session_id"), F.lit("{}").alias("attrs_json"),
    )


def from_test_table(events: DataFrame) -> DataFrame:
    """The test table as events: views and purchases are window changes, clicks and
    signups keyboard rows, errors and the rest mouse rows."""
    kind = F.col("event_type")
    monitor = F.when(kind.isin("view", "purchase"), "active_window").when(kind.isin("click", "signup"), "keyboard").otherwise("mouse")
    return events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.expr("unix_micros(cast(ts AS timestamp)) div 1000").alias("ts_utc"), monitor.alias("monitor"),
        kind.alias("action"), F.col("user_id").cast("string").alias("subject_id"), "user_id", "value", "props",
    )


def test_windows(events: DataFrame) -> DataFrame:
    """A dimension of windows: every user but each eleventh, in seven apps."""
    return events.where("user_id % 11 <> 0").select(F.col("subject_id").alias("id"), F.concat(F.lit("app"), (F.col("user_id") % 7).cast("string")).alias("app_id")).distinct()
