"""Idempotent inserts and comparisons of computed with stored rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_events(batch: DataFrame, existing: DataFrame | None = None, order: tuple[str, ...] = ("ts_utc",)) -> DataFrame:
    """The first row of each id of the batch that is not among the existing ids.

    Rows that agree in ``order`` are told apart by all their columns, so reruns
    keep the same one."""
    order = (*order, *(c for c in batch.columns if c not in order and c != "id"))
    first = batch.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("_n = 1").drop("_n")
    return first if existing is None else first.join(existing.select("id"), "id", "left_anti")


def diff(computed: DataFrame, stored: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The keys, the computed values and ``change``: insert, update or unchanged.

    Stored rows that were not computed don't appear; nulls equal nulls."""
    old = stored.select(*keys, *[F.col(v).alias(f"_old_{v}") for v in values], F.lit(True).alias("_was"))
    same = reduce(lambda a, b: a & b, [F.col(v).eqNullSafe(F.col(f"_old_{v}")) for v in values])
    change = F.when(F.col("_was").isNull(), "insert").when(same, "unchanged").otherwise("update")
    return computed.join(old, keys, "left").select(*keys, *values, change.alias("change"))


def apply(computed: DataFrame, stored: DataFrame, keys: list[str], values: list[str], kept: tuple[str, ...] = ("created_utc_ms",)) -> DataFrame:
    """The table after the upsert: stored rows that stay, and computed ones.

    ``kept`` columns of an updated row stay as they were; an unchanged row stays whole."""
    marked = diff(computed, stored, keys, values).select(*keys, "change")
    unchanged = stored.join(marked.where("change <> 'unchanged'").select(*keys), keys, "left_anti")
    fresh = computed.join(marked.where("change <> 'unchanged'"), keys).drop("change")
    for c in kept:
        if c in stored.columns:
            fresh = fresh.join(stored.select(*keys, F.col(c).alias("_kept")), keys, "left").withColumn(c, F.coalesce("_kept", c)).drop("_kept")
    return unchanged.unionByName(fresh.select(*stored.columns))


def first_last_seen(rows: DataFrame, key: str, ts: str = "ts_utc", carry: tuple[str, ...] = ()) -> DataFrame:
    """A dimension: key, first and last time seen, and the latest known of ``carry``."""
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in carry]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(ts).alias("first_seen_utc"), F.max(ts).alias("last_seen_utc"), *latest)


def merge_dimension(existing: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """A dimension brought up to date: known first times stay, last times move on."""
    both = existing.select(key, "first_seen_utc", "last_seen_utc").union(seen.select(key, "first_seen_utc", "last_seen_utc"))
    return both.groupBy(key).agg(F.min("first_seen_utc").alias("first_seen_utc"), F.max("last_seen_utc").alias("last_seen_utc"))


def get_or_create(seen: DataFrame, known: DataFrame | None, keys: list[str], latest: tuple[str, ...] = (), filled: tuple[str, ...] = (), ts: str = "ts_utc", tie: str = "id") -> DataFrame:
    """A dimension (id, keys, latest, filled, first_seen_utc, last_seen_utc) after ``seen`` rows.

    Known ids and first times stay, last times move on.  A ``latest`` column
    takes the last value that isn't null, a ``filled`` one keeps its first that
    isn't null or empty.  A new id is made of the keys, so a rerun makes the
    same one; rows with a null key make none."""
    order = F.struct(ts, tie)
    some = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    values = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in latest] + [F.min_by(c, F.when(some(c), order)).alias(c) for c in filled]
    fresh = seen.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(*values, F.min(ts).alias("first_seen_utc"), F.max(ts).alias("last_seen_utc"))
    fresh = fresh.withColumn("id", F.substring(F.sha2(F.concat_ws("\x1f", *keys), 256), 1, 32))
    columns = ["id", *keys, *latest, *filled, "first_seen_utc", "last_seen_utc"]
    if known is None:
        return fresh.select(*columns)
    new = fresh.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns if c not in keys])
    picked = {c: F.coalesce(f"_{c}", c) for c in latest} | {c: F.when(some(c), F.col(c)).otherwise(F.coalesce(f"_{c}", c)) for c in filled}
    picked |= {"id": F.coalesce("id", "_id"), "first_seen_utc": F.coalesce("first_seen_utc", "_first_seen_utc"), "last_seen_utc": F.greatest("last_seen_utc", "_last_seen_utc")}
    return known.select(*columns).join(new, keys, "full_outer").select(*[picked.get(c, F.col(c)).alias(c) for c in columns])


def with_ids(rows: DataFrame, dimension: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add ``name``, the id of each row's keys in the dimension; null for null keys."""
    return rows.join(dimension.select(*keys, F.col("id").alias(name)), keys, "left")
