"""Plumbing shared by the corpus operators: scratch tables, ranks, components."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where scratch tables of a session on one machine go if it names no folder.
LOCAL_SCRATCH = "file:///tmp/checkpoints/strandline"
#: Separators of words: space and the five ASCII control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch of texts.
ARROW_ROWS = 1000
#: Bytes of text that a task works on at once.
SLICE_BYTES = 2_000_000
_dirs: dict[str, SparkSession] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder for tables that cut lineage: under ``spark.checkpoint.dir``, or a
    local one where the session names none and runs on one machine; on a cluster
    without that setting, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = (base or LOCAL_SCRATCH).rstrip("/") + f"/strandline-{spark.sparkContext.applicationId}"
    if base not in _dirs:
        _dirs[base] = spark
        atexit.register(_remove, base)
    return base


def _remove(base: str) -> None:
    """Delete the scratch folder of a session that ends."""
    spark = _dirs.pop(base, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    delete_path(spark, base)


def delete_path(spark: SparkSession, name: str) -> None:
    """Delete a folder in any store that Spark can reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in pieces of at most ``most`` bytes of ``column``
    (a longer value is a piece of its own), so what a task makes of them at once
    doesn't grow with the batch."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < b.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            n = max(1, upto - at)
            yield b.slice(at, n)
            at += n
    give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task; workers are used again and
    would hold the most that any task needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most ARROW_ROWS rows: whole
    texts are long, and both sides of a Python worker hold a batch.  Results
    are lazy, so the setting can't be taken back when an operator returns."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def materialize(df: DataFrame, label: str, compression: str = "snappy", by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    The table survives lost executors and cuts the lineage.  Joins on it see a
    plain exchange on either side, so adaptive execution can split hot keys."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    small_batches(df.sparkSession)
    df.write.parquet(path, compression=compression, partitionBy=by)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that no later job reads; others are left alone."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path:
            delete_path(table.sparkSession, path)


#: A table of numbers is sent to every executor up to this many bytes.
BROADCAST_BYTES = 8_000_000


def bounded(ids: DataFrame) -> DataFrame:
    """A written table of numbers, marked for broadcast where its counted rows of
    8 bytes a column allow it; joins with a larger one shuffle."""
    return F.broadcast(ids) if ids.count() * 8 * len(ids.columns) <= BROADCAST_BYTES else ids


def rank_within(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank_in_group", buckets: int = 256) -> DataFrame:
    """Number the rows of each group from 1 without holding a group in one task.

    Rows are dealt to ``buckets`` parts of the group by a hash of ``order``; a
    window numbers each part, and the parts' counts (at most ``buckets`` rows a
    group) give the offsets.  Rows with equal ``order`` get distinct numbers."""
    part = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    df = df.withColumn("_part", part)
    counts = df.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_k_part"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    numbered = df.withColumn("_row", F.row_number().over(inside))
    same = F.col("_part") == F.col("_k_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = numbered.join(offsets, same).withColumn(rank, (F.col("_row") + F.col("_before")).cast("long"))
    return out.drop("_part", "_row", "_before", "_k_part", *[f"_k_{k}" for k in keys])


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, component) for every id of ``edges`` (u, v): the smallest id reachable.

    Minimum labels spread over the edges and then along the labels themselves
    (pointer jumping) until a round changes none."""
    both = edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = materialize(both, f"{label}-edges")
    kept = labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("component")), f"{label}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.select(F.col("id").alias("u"), "component"), "u").groupBy("v").agg(F.min("component").alias("m"))
        spread = materialize(
            labels.join(near.withColumnRenamed("v", "id"), "id", "left")
            .select("id", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("c")),
            f"{label}-{turn}a",
        )
        up = spread.select(F.col("id").alias("c"), F.col("c").alias("top"))
        moved = materialize(spread.join(up, "c", "left").select("id", "was", F.coalesce("top", "c").alias("component")), f"{label}-{turn}b")
        changed = moved.where("component <> was").limit(1).count()
        release(spread, kept)
        kept, labels = moved, moved.select("id", "component")
        if not changed:
            release(both)
            labels._scratch = kept._scratch
            return labels


def ascii_lower(col: Column) -> Column:
    """A to Z in lower case; every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Words of a text by the ASCII separators; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
