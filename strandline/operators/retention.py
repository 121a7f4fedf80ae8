"""Quota of files, and which of them to remove."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTA_BYTES, SOFT_SHARE = 512 << 20, 0.9


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, size) of journal files below ``path`` and in its archive
    ``_done``, which a recursive read leaves out by its name; contents are not read."""
    from strandline.sources.sinks import exists

    paths = [path, *([f"{path}/_done"] if exists(spark, f"{path}/_done") else [])]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ndjson.gz").load(paths)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def quota_state(files: DataFrame, quota: int = QUOTA_BYTES, soft: float = SOFT_SHARE) -> DataFrame:
    """(used, state): NORMAL, SOFT from a share of the quota, HARD from all of it."""
    used = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("used"))
    return used.withColumn("state", F.when(F.col("used") >= quota, "HARD").when(F.col("used") >= quota * soft, "SOFT").otherwise("NORMAL"))


def victims(files: DataFrame, excess: int, key: str = "path", by: str = "modified") -> DataFrame:
    """The oldest files whose removal frees ``excess`` bytes, and no more than needed."""
    day = F.to_date(by)
    dealt = files.withColumn("_day", day)
    days = dealt.groupBy("_day").agg(F.sum("size").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("_day").orderBy(by, key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_inside", inside).join(days, "_day").where(F.col("_inside") + F.col("_before") < excess).drop("_day", "_inside", "_before")


def archived(files: DataFrame, now_hour: str) -> DataFrame:
    """Files of the archive that may be removed: those whose name begins with the
    current hour (``YYYYMMDD-HH``) never are."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.contains("path", F.lit("/_done/")) & ~F.startswith(name, F.lit(now_hour)))


def trim_plan(files: DataFrame, now_hour: str, quota: int = QUOTA_BYTES, soft: float = SOFT_SHARE) -> DataFrame:
    """(path, size) of the archived files to remove so that all of ``files`` come under the soft
    share of the quota: the oldest first and no more than needed, none of the current
    hour; nothing where they are under it already."""
    used = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    excess = used - int(quota * soft)
    return victims(archived(files, now_hour), max(0, excess)).select("path", "size")


def carry_out(spark: SparkSession, plan: DataFrame, dry_run: bool = False) -> dict[str, int]:
    """Remove the files of a plan (path, size), or only count them; files removed, bytes freed, and files that were gone.

    The plan comes a part at a time, and the calls to the file store run some
    at once.  A plan may be carried out again: what is gone counts as missing."""
    from strandline.sources import sinks

    if dry_run:
        n, size = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        return {"files": n, "bytes": size, "missing": 0}
    done = [0, 0, 0]
    for gone, size in sinks.side_by_side(lambda r: (sinks.remove(spark, r["path"]), r["size"]), plan.toLocalIterator()):
        done = [done[0] + gone, done[1] + (size if gone else 0), done[2] + (not gone)]
    return {"files": done[0], "bytes": done[1], "missing": done[2]}


def expired(files: DataFrame, now, days: int, by: str = "modified") -> DataFrame:
    """Files older than so many days."""
    return files.where(F.col(by) < F.lit(now) - F.expr(f"INTERVAL {days} DAYS"))


def largest(files: DataFrame, n: int = 5, key: str = "path") -> DataFrame:
    """The ``n`` largest files, ties by name."""
    return files.orderBy(F.desc("size"), key).limit(n)
