"""Greedy segmentation of long sequences: where the next kept row depends on the last one.

Rows have a place in their group; each knows its successor, the row that would be
kept next if it were kept.  The rows reached from the first ones are found by
pointer doubling: after k rounds every pointer leads 2**k kept rows on, so a run of
rows of any length takes as many rounds as its length has bits, and none of its
rows meet in one task.  Rounds are written to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources import sinks

#: Rows are ordered inside buckets of this many ms at most; only the buckets' first rows meet.
BUCKET_MS = 60_000
#: Places of a group that a task orders at once.
PLACES = 10_000


def places(rows: DataFrame, by: str, ts: str = "ts_utc", tie: str = "id", bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Add ``_pos``, each row's place from 0 in its group by time and ``tie``.

    A bucket's rows are numbered in a window, and the buckets' counts, a row a
    bucket, give the first place of each.  Null groups are a group."""
    dealt = rows.withColumn("_b", F.floor(F.col(ts) / F.lit(float(bucket_ms))).cast("long"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.select(F.col(by).alias("_k"), F.col("_b").alias("_kb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    row = F.row_number().over(Window.partitionBy(by, "_b").orderBy(ts, tie))
    placed = dealt.withColumn("_i", row).join(sums, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    return placed.withColumn("_pos", (F.col("_i") + F.col("_first") - 1).cast("long")).select(*rows.columns, "_pos")


def behind(placed: DataFrame, by: str, column: str, steps: int, name: str) -> DataFrame:
    """Add ``name``, the ``column`` of the row ``steps`` places before (null for the first ones).

    Rows are dealt to runs of places, whose last ``steps`` rows are copied to the
    next run, so a group of any size is spread evenly."""
    run = F.floor(F.col("_pos") / PLACES).cast("long")
    edge = F.when(F.col("_pos") % PLACES >= PLACES - steps, F.array(run, run + 1)).otherwise(F.array(run))
    dealt = placed.withColumn("_run", F.explode(edge))
    value = F.lag(column, steps).over(Window.partitionBy(by, "_run").orderBy("_pos"))
    return dealt.withColumn(name, value).where(F.col("_run") == run).drop("_run")


def first_from(placed: DataFrame, by: str, at: str, span: int, bucket: int) -> DataFrame:
    """(by, _pos, _next): for each row the first place of its group whose ``at`` is at least
    ``span`` more, or null.  Both sides meet in buckets of ``bucket`` units of ``at``."""
    rows = placed.select(by, F.col(at).alias("_at"), F.lit(1).alias("_kind"), "_pos")
    asked = placed.select(by, (F.col(at) + span).alias("_at"), F.lit(0).alias("_kind"), "_pos")
    both = rows.union(asked).withColumn("_b", F.floor(F.col("_at") / F.lit(float(bucket))).cast("long"))
    there = F.when(F.col("_kind") == 1, F.col("_pos"))
    heads = both.groupBy(by, "_b").agg(F.min(there).alias("_head"))
    later = Window.partitionBy(by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(F.col(by).alias("_k"), F.col("_b").alias("_kb"), F.min("_head").over(later).alias("_after"))
    down = Window.partitionBy(by, "_b").orderBy(F.desc("_at"), F.desc("_kind"), F.desc("_pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_inside", F.min(there).over(down)).where("_kind = 0")
    found = found.join(heads, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    return found.select(by, "_pos", F.coalesce("_inside", "_after").alias("_next"))


def reached(pointers: DataFrame, starts: DataFrame, by: str) -> DataFrame:
    """(by, _pos) of all rows that ``pointers`` (by, _pos, _next) lead to from ``starts`` (by, _pos), these included.

    Where the pointers end, so does a chain.  Each round doubles the pointers,
    and those that lead nowhere are dropped, so short chains cost one round."""
    spark, rounds = pointers.sparkSession, 0
    kept = sinks.scratch_table(starts.select(by, "_pos"), "reached")
    jumps = sinks.scratch_table(pointers.where("_next IS NOT NULL").select(by, "_pos", "_next"), "jumps")
    same = lambda left, right: F.col(f"{left}.{by}").eqNullSafe(F.col(f"{right}.{by}"))
    while jumps.limit(1).count():
        rounds += 1
        hop = kept.alias("k").join(jumps.alias("j"), same("k", "j") & (F.col("k._pos") == F.col("j._pos"))).select(f"k.{by}", F.col("j._next").alias("_pos"))
        grown = sinks.scratch_table(kept.union(hop), "reached")
        twice = jumps.alias("a").join(jumps.alias("b"), same("a", "b") & (F.col("a._next") == F.col("b._pos"))).select(f"a.{by}", "a._pos", "b._next")
        longer = sinks.scratch_table(twice, "jumps")
        sinks.release(spark, kept, jumps)
        kept, jumps = grown, longer
    sinks.release(spark, jumps)
    return kept


def spaced(placed: DataFrame, by: str, at: str, span: int, most: int | None = None, bucket: int = BUCKET_MS) -> DataFrame:
    """(by, _pos) of the rows kept when each kept row rules out those less than ``span`` of ``at`` after it.

    With ``most`` a kept row rules out no more than ``most`` - 1 rows after it: the
    kept rows open batches of ``most`` rows or ``span``, whichever is full first.
    A row ``span`` after the one before is kept in any case, so chains are as long
    as the kept rows of a run without such a gap.  ``placed`` has (by, _pos, at)
    with ``at`` ascending by place."""
    table = sinks.scratch_table(behind(placed.select(by, "_pos", F.col(at).alias("_at")), by, "_at", 1, "_was"), "spaced")
    free = F.col("_was").isNull() | (F.col("_at") - F.col("_was") >= span)
    starts = table.where(free).select(by, "_pos")
    found = first_from(table.select(by, "_pos", "_at"), by, "_at", span, max(bucket, span))
    if most is not None:
        last = table.groupBy(by).agg(F.max("_pos").alias("_last"))
        near = F.when(F.col("_pos") + most <= F.col("_last"), F.col("_pos") + most)
        found = found.alias("f").join(last.alias("l"), F.col(f"f.{by}").eqNullSafe(F.col(f"l.{by}"))).select(f"f.{by}", "_pos", F.least(F.col("_next"), near).alias("_next"))
    heads = starts.select(F.col(by).alias("_k"), F.col("_pos").alias("_kp"))
    inner = found.join(heads, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_next") == F.col("_kp")), "left_anti")  # free rows are kept anyway
    return reached(inner, starts, by)


def opened(placed: DataFrame, opens: DataFrame, by: str, name: str) -> DataFrame:
    """Add ``name``, the place of the last row of ``opens`` (by, _pos) at or before each row of ``placed``.

    Runs of places carry the last one on, so a group of any size is spread evenly."""
    marks = opens.select(F.col(by).alias("_k"), F.col("_pos").alias("_open"))
    marked = placed.join(marks, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_pos") == F.col("_open")), "left").drop("_k")
    marked = marked.withColumn("_run", F.floor(F.col("_pos") / PLACES).cast("long"))
    before = Window.partitionBy(by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    lasts = marked.groupBy(by, "_run").agg(F.max("_open").alias("_o")).select(F.col(by).alias("_kk"), F.col("_run").alias("_kr"), F.max("_o").over(before).alias("_carry"))
    inside = F.max("_open").over(Window.partitionBy(by, "_run").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = marked.withColumn("_inside", inside).join(lasts, F.col(by).eqNullSafe(F.col("_kk")) & (F.col("_run") == F.col("_kr")))
    return found.select(*placed.columns, F.coalesce("_inside", "_carry").alias(name))


def running(placed: DataFrame, by: str, column: str, name: str) -> DataFrame:
    """Add ``name``, the sum of ``column`` over the rows before each row of its group."""
    dealt = placed.withColumn("_run", F.floor(F.col("_pos") / PLACES).cast("long"))
    before = Window.partitionBy(by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(by, "_run").agg(F.sum(column).alias("_n")).select(F.col(by).alias("_k"), F.col("_run").alias("_kr"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum(column).over(Window.partitionBy(by, "_run").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = dealt.withColumn("_inside", inside).join(sums, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_run") == F.col("_kr")))
    return found.select(*placed.columns, (F.col("_inside") + F.col("_start")).alias(name))
