"""Reports and digests as files: a table of what is to be written where, and its carrying out."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandline.operators.render import artifact_path
from strandline.plans.store import TABLES, Store
from strandline.sources import sinks

#: The stored tables that become files: the kind in the file's name, the forms, and the hash that names the file.
FORMS = {
    "hourly_report": ("hourly", ("txt", "json", "csv"), "hour_hash"),
    "daily_report": ("daily", ("txt", "json", "csv"), "day_hash"),
    "hourly_digest": ("hourly-digest", ("txt", "json"), "hour_hash"),
    "daily_digest": ("daily-digest", ("txt", "json"), "day_hash"),
}


@F.pandas_udf(StringType())
def indented(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys, an indent of two and a last line break."""
    return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), indent=2, sort_keys=True) + "\n")


def files_of(name: str, rows: DataFrame) -> DataFrame:
    """(period_ms, kind, form, path, content, sha256) of the files of a table's rows; the hash is that of the bytes."""
    kind, forms, digest = FORMS[name]
    period = TABLES[name][0][0]

    def file(form: str) -> Column:
        content = indented(F.col(form)) if form == "json" else F.col(form)
        return F.struct(F.lit(form).alias("form"), artifact_path(kind, F.col(period), F.col(digest), form).alias("path"), F.coalesce(content, F.lit("")).alias("content"))

    each = rows.select(F.col(period).alias("period_ms"), F.lit(kind).alias("kind"), F.explode(F.array(*[file(f) for f in forms])).alias("f")).select("period_ms", "kind", "f.*")
    return each.withColumn("sha256", F.sha2(F.encode("content", "UTF-8"), 256))


def plan(results: Store, since: int | None = None, until: int | None = None) -> DataFrame | None:
    """The files of all stored reports and digests, or of those of periods in [since, until); None without any."""
    out = None
    for name in FORMS:
        rows = results.read(name, since, until)
        if rows is not None:
            files = files_of(name, rows)
            out = files if out is None else out.union(files)
    return out


def carry_out(results: Store, files: DataFrame, folder: str, dry_run: bool = False) -> dict[str, int]:
    """Write the files of a plan below ``folder``, or only count them; how many were written
    and how many were there already with the same bytes.

    Files are a few KB each; the plan comes a part at a time, and the calls run
    some at once.  A file of other bytes under the same path is written anew."""
    spark = results.spark

    def write(row) -> bool:
        raw, target = row["content"].encode(), f"{folder}/{row['path']}"
        try:
            there = sinks.read_small(spark, target)
        except Py4JJavaError as e:
            if "ChecksumException" not in e.java_exception.getClass().getName():
                raise
            there = None  # its bytes were changed behind the file store's back
        if there is not None and hashlib.sha256(there).hexdigest() == row["sha256"]:
            return False
        if not dry_run:
            sinks.write_small(spark, target, raw)
        return True

    counts = {"written": 0, "unchanged": 0}
    for written in sinks.side_by_side(write, files.toLocalIterator()):
        counts["written" if written else "unchanged"] += 1
    return counts
