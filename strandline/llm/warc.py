"""WARC archives: writing, and reading by boundary chains."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import delete_path, materialize, scratch_dir

MAGIC = "WARC/1.0\r\n"
CRLF = "\r\n"
END = "\r\n\r\n"
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 1000
RECORDS_PER_FILE = 20_000
DATE = "1970-01-01T00:00:00Z"


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def choose_originals(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, refers_to): refers_to is the
    page whose payload a record repeats, or null where it is written in full.

    Of equal payloads of at least ``least`` bytes the largest page_id is
    written; rows that share that id are all written.  A null payload is empty;
    a null page_id is smaller than any other, and where a payload has no other
    all its rows are written.  Payload digests are counted before the join, and
    only repeated ones take part in it."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    heads = materialize(rows.where(F.col("payload_bytes") >= least).select("page_id", "digest"), "warc-digests")
    groups = heads.groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1 AND original IS NOT NULL")
    groups = materialize(groups.select("digest", "original"), "warc-groups")
    repeats = heads.join(groups, "digest").where("NOT (page_id <=> original)").select("page_id", F.col("digest").alias("d"), "original").distinct()
    repeats = materialize(repeats, "warc-repeats")
    same = F.col("rows.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("rows.digest") == F.col("r.d")) & (F.col("payload_bytes") >= least)
    return rows.alias("rows").join(repeats.alias("r"), same, "left").select("rows.*", F.col("original").alias("refers_to"))


def records(chosen: DataFrame) -> DataFrame:
    """One column ``value``: a WARC 1.0 record as text, without the blank lines
    that end it.  CR and LF in a url are percent-encoded; a null url or page_id
    leaves its header out."""
    full = F.col("refers_to").isNull()
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(full, F.concat(http, "payload")).otherwise(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END))
    identity = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "digest", "url"))
    parts = [F.substring(identity, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    head = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(full, F.lit("response")).otherwise(F.lit("revisit"))),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(~full, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Page-ID", F.col("page_id").cast("string")),
        _line("Page-Payload-Length", F.col("payload_bytes").cast("string")),
        _line("Page-Refers-To", F.col("refers_to").cast("string")),
        _line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(CRLF),
    )
    return chosen.withColumn("block", block).select(F.concat(head, "block").alias("value"))


def write_archives(chosen: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> str:
    """Write the records as uncompressed WARC files of at most ``per_file`` records."""
    records(chosen).write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "none").text(path)
    return path


def candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, start, succ, stop, body): each place of a file that follows the magic.

    The files are read in splits cut at the magic, so a split holds whole
    pieces and the bytes before a piece are the pieces before it: sums inside
    the split, and of the splits before it in the file.  ``start`` is where
    the magic begins; ``succ`` where the record's own length says the next
    begins (null without a readable length); ``stop`` where the piece ends."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("line"), F.col("value").alias("body"),
    )
    raw = materialize(raw.withColumn("bytes", F.octet_length("body").cast("long") + len(MAGIC)), "warc-pieces", "zstd")
    by_split = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("file", "split").agg(F.sum("bytes").alias("n")).select("file", "split", F.coalesce(F.sum("n").over(by_split), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    narrow = raw.select("file", "split", "line", "file_size", "bytes", _header_bytes("body").alias("head"), _length("body").alias("length"))
    placed = narrow.withColumn("at", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(splits, ["file", "split"])
    placed = placed.withColumn("start", F.col("before") + F.col("at") - len(MAGIC)).where("start >= 0")
    succ = F.col("start") + len(MAGIC) + F.col("head") + F.col("length") + len(END)
    spots = placed.select("file", "line", "start", F.when((F.col("head") > 0) & (succ <= F.col("file_size")), succ).alias("succ"), "file_size")
    return materialize(spots, "warc-spots"), raw


def _header_bytes(body: str) -> Column:
    """Bytes of a header with the blank line that ends it; 0 if there is none."""
    head = F.substring_index(body, END, 1)
    return F.when(F.octet_length(head) < F.octet_length(body), F.octet_length(head) + len(END)).otherwise(F.lit(0)).cast("long")


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.nullif(found, F.lit(""))


def _length(body: str) -> Column:
    return _field(F.substring_index(body, END, 1), "Content-Length").try_cast("bigint")


def reachable(spots: DataFrame) -> DataFrame:
    """(file, start) of the records on the chain from the start of each file.

    Candidates whose successor is simply the next candidate form runs, and a
    run is entered at its first or where some other run's last one points.
    Runs are cut at such places, so each is entered at its first only; then
    pointers over runs are doubled until none gains a new run."""
    order = Window.partitionBy("file").orderBy("start")
    nodes = spots.withColumn("next", F.lead("start").over(order)).withColumn("prev_succ", F.lag("succ").over(order))
    jumps = nodes.where("succ IS NOT NULL AND succ < file_size AND NOT (succ <=> next)").select("file", F.col("succ").alias("start"), F.lit(True).alias("landed")).distinct()
    marked = nodes.join(jumps, ["file", "start"], "left")
    head = F.coalesce((F.col("prev_succ") != F.col("start")) | F.col("landed").isNotNull(), F.lit(True))
    runs = marked.withColumn("run", F.max(F.when(head, F.col("start"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = materialize(runs.select("file", "start", "succ", "run"), "warc-runs")
    last = runs.groupBy("file", "run").agg(F.max_by("succ", "start").alias("to"))
    jump = materialize(last.join(last.select("file", F.col("run").alias("to")), ["file", "to"], "left_semi").select("file", "run", "to"), "warc-jump")
    live = materialize(runs.where("run = 0").select("file", "run").distinct(), "warc-live0")
    turn = 0
    while jump.limit(1).count():
        turn += 1
        gained = live.join(jump, ["file", "run"]).select("file", F.col("to").alias("run"))
        grown = materialize(live.union(gained).distinct(), f"warc-live{turn}")
        if grown.count() == live.count():
            break
        far = jump.select("file", F.col("run").alias("to"), F.col("to").alias("then"))
        jump = materialize(jump.join(far, ["file", "to"]).select("file", "run", F.col("then").alias("to")), f"warc-jump{turn}")
        live = grown
    return runs.join(live, ["file", "run"], "left_semi").select("file", "start")


def read_archives(spark: SparkSession, path: str, keep: bool = True) -> DataFrame:
    """(file, start, record_type, page_id, url, payload, payload_bytes,
    payload_digest, refers_to) of every record on the chains of the files.

    A payload that holds the magic comes apart in reading; its pieces are put
    together again behind the record that they belong to.  Bytes behind a
    broken record are not reachable and are left out; empty files give none.
    Without ``keep`` the archives are deleted once all their bytes are read."""
    spots, raw = candidates(spark, path)
    if not keep:
        delete_path(spark, path)
    kept = materialize(reachable(spots), "warc-kept")
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    owned = spots.join(kept.withColumn("on", F.lit(True)), ["file", "start"], "left")
    owned = owned.withColumn("owner", F.max(F.when(F.col("on"), F.col("start"))).over(order)).where("owner IS NOT NULL")
    loose = materialize(owned.where("on IS NULL").select("file", "owner", "start", "line"), "warc-loose")
    whole = owned.where("on").select("file", "start", "line").join(raw.select("file", "line", "body"), ["file", "line"])
    pieces = loose.join(raw.select("file", "line", "body"), ["file", "line"])
    pieces = pieces.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "body"))).alias("more")).withColumnRenamed("owner", "start")
    joined = whole.join(pieces, ["file", "start"], "left")
    body = F.when(F.col("more").isNull(), F.col("body")).otherwise(F.concat_ws(MAGIC, "body", F.col("more.body")))
    return parse_records(joined.select("file", "start", body.alias("body")))


def parse_records(bodies: DataFrame) -> DataFrame:
    """The fields of records, each the bytes behind its magic."""
    raw = F.col("body").cast("binary")
    df = bodies.withColumn("head", F.substring_index("body", END, 1)).withColumn("length", _length("body"))
    df = df.withColumn("block", F.substring(raw, F.octet_length("head") + F.lit(len(END) + 1), F.col("length").cast("int")))
    text = F.col("block").cast("string")
    http = F.col("head").contains("application/http")
    skip = F.when(http, F.octet_length(F.substring_index(text, END, 1)) + len(END)).otherwise(F.lit(0))
    revisit = _field(F.col("head"), "WARC-Type") == "revisit"
    df = df.withColumn("record_type", _field(F.col("head"), "WARC-Type"))
    df = df.withColumn("payload", F.when(revisit, F.lit(None)).otherwise(F.substring(F.col("block"), skip + 1, F.octet_length("block"))))
    return df.select(
        "file", "start", "record_type",
        _field(F.col("head"), "Page-ID").cast("long").alias("page_id"), _field(F.col("head"), "WARC-Target-URI").alias("url"), "payload",
        F.when(revisit, _field(F.col("head"), "Page-Payload-Length").cast("long")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "")).otherwise(F.sha1("payload")).alias("payload_digest"),
        _field(F.col("head"), "Page-Refers-To").cast("long").alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the scratch folder, read them
    and delete them."""
    spark = pages.sparkSession
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(spark, write_archives(choose_originals(pages), path), keep=False)
