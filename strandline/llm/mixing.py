"""Mixing sources to target weights by systematic sampling (native DataFrame code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import materialize, rank_within, word_count

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MOST_COPIES = 2.0
#: Size classes an octave; documents of like size stand together in the order.
CLASSES = 16


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, docs, target) for ``sizes`` (source, size).

    Sources in code point order, null last, take ``weights`` in turn and share
    ``total_share`` of all sizes.  No target passes ``most`` times its source's
    size: what is above goes to the others by weight, again and again until
    none is above.  That fixed point is one level L with target
    min(most * size, L * weight); the caps in the order of cap / weight say
    where it lies.  The table has a row a source and stays on the executors.
    Sources of no words have target 0.  An empty table gives no rows."""
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), "mix-sources")
    ranked = _ordinal(totals)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    capped = materialize(
        ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight")),
        "mix-weights",
    )
    return capped.select("source", "source_size", "docs", F.least("cap", F.col("weight") * F.lit(_level(capped, total_share))).alias("target"))


def _ordinal(totals: DataFrame) -> DataFrame:
    """The place of each source in code point order from 0, null last: sources
    are dealt to tasks by ranges of that order, numbered there, and the counts
    of earlier ranges are added."""
    order = F.col("source").asc_nulls_last()
    dealt = materialize(totals.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    placed = dealt.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(order))).join(start, "part")
    return placed.withColumn("place", F.col("start") + F.col("i") - 1).drop("part", "i", "start")


def _level(capped: DataFrame, total_share: float) -> float:
    """The level of the targets.  It starts at total / weights; each turn takes
    out the sources whose cap lies below and raises it for the others."""
    total, weights = capped.agg(F.sum("source_size") * F.lit(total_share), F.sum("weight")).first()
    level = (total or 0.0) / (weights or 1.0)
    while True:
        held, left = capped.agg(
            F.sum(F.when(F.col("ratio") <= level, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(F.col("ratio") > level, F.col("weight")).otherwise(0.0)),
        ).first()
        if not left:
            break
        risen = (total - held) / left
        if risen <= level * (1 + 1e-12):
            break
        level = risen
    return float(level)


def copies_taken(docs: DataFrame, targets: DataFrame, seed: int = 7, key: str = "doc_id", most: float = MOST_COPIES) -> DataFrame:
    """Add source_size, target and copies to ``docs`` (key, source, size, ...).

    The documents of a source stand in the order of size class and then a hash,
    each with target / source_size expected copies.  Their running sum, moved
    by one random offset of the source, gives a copy at each whole number it
    crosses.  Like sizes stand together, so the words taken stay near the
    target.  Rows are ranked in parts: no source is held in one task."""
    size_class = F.floor(F.log2(F.col("size") + F.lit(1.0)) * CLASSES).cast("int")
    ranked = rank_within(docs.withColumn("_class", size_class), ["source", "_class"], [key, "size"], rank="_rank")
    classes = docs.groupBy("source", size_class.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = classes.select(F.col("source").alias("_s"), "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("_t", F.lit("\u0000null"))), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rates = targets.select(
        F.col("source").alias("_t"), "source_size", "target", offset.alias("_u"),
        F.coalesce(F.least(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(most)), F.lit(0.0)).alias("_rate"),
    )
    placed = ranked.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")))
    placed = placed.join(rates, F.col("source").eqNullSafe(F.col("_t")))
    at = F.col("_rank") + F.col("_start")
    crossed = F.floor(at * F.col("_rate") + F.col("_u")) - F.floor((at - 1) * F.col("_rate") + F.col("_u"))
    out = placed.withColumn("copies", F.least(crossed, F.lit(int(most))).cast("int"))
    return out.drop("_class", "_rank", "_s", "_c", "_start", "_t", "_u", "_rate")


def mix(docs: DataFrame, size: Column | None = None, seed: int = 7, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Key, source, size, source_size, target, copies and taken of every row.

    ``size`` is words of ``text`` unless given; null texts have size 0.  Null
    sources form one source of their own, null keys are rows like any other,
    repeated rows each count, and other columns of ``docs`` are not used."""
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), (word_count(F.col("text")) if size is None else size).alias("size"))
    sizes = materialize(narrow, "mix-sizes")
    taken = copies_taken(sizes, source_targets(sizes), seed)
    return taken.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
