"""Input dynamics: what keyboard, mouse and window rows give without their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import segments
from strandline.sources import sinks
from strandline.sources.events import activity_rows

BURST_MS, BURST_KEYS = 500, 5
#: Rows are dealt to hours where their order matters.
BUCKET_MS = 3_600_000


def _before(rows: DataFrame, by: str, ts: str, tie: str, columns: dict[str, Column]) -> DataFrame:
    """Add ``columns`` of the row before of the same ``by`` (null for its first row).

    Rows are dealt to hours, so a key that holds much of all rows is spread; the
    first row of an hour gets the last one of the hour before that has any."""
    bucket = F.floor(F.col(ts) / F.lit(float(BUCKET_MS))).cast("long")
    now = F.struct(*[c.alias(n) for n, c in columns.items()])
    dealt = rows.withColumn("_b", bucket).withColumn("_now", now)
    ends = dealt.groupBy(by, "_b").agg(F.max_by("_now", F.struct(ts, tie)).alias("_last"))
    ends = ends.withColumn("_edge", F.lag("_last").over(Window.partitionBy(by).orderBy("_b"))).select(F.col(by).alias("_k"), F.col("_b").alias("_kb"), "_edge")
    inside = Window.partitionBy(by, "_b").orderBy(ts, tie)
    found = dealt.withColumn("_was", F.lag("_now").over(inside)).withColumn("_row", F.row_number().over(inside))
    found = found.join(ends, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    found = found.withColumn("_was", F.when(F.col("_row") == 1, F.col("_edge")).otherwise(F.col("_was")))
    return found.select(*rows.columns, *[F.col(f"_was.{n}").alias(n) for n in columns])


def gaps(rows: DataFrame, by: str, ts: str = "ts_utc", tie: str = "id") -> DataFrame:
    """Add ``gap``: time since the row before of the same ``by``."""
    return _before(rows, by, ts, tie, {"_ts": F.col(ts)}).withColumn("gap", F.col(ts) - F.col("_ts")).drop("_ts")


def islands(rows: DataFrame, by: str, span: int, ts: str = "ts_utc", tie: str = "id") -> DataFrame:
    """Add ``island``: the time of the first row of a run of rows of ``by`` in
    which none is more than ``span`` after the one before."""
    cut = gaps(rows, by, ts, tie).withColumn("_b", F.floor(F.col(ts) / F.lit(float(BUCKET_MS))).cast("long"))
    cut = cut.withColumn("_cut", F.when(F.col("gap").isNull() | (F.col("gap") > span), F.col(ts)))
    ends = cut.groupBy(by, "_b").agg(F.max("_cut").alias("_last"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(by).alias("_k"), F.col("_b").alias("_kb"), F.max("_last").over(before).alias("_carry"))
    inside = Window.partitionBy(by, "_b").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.max("_cut").over(inside), F.col("_carry"))
    joined = cut.join(ends, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    return joined.withColumn("island", start).select(*rows.columns, "island")


def interval_stats(rows: DataFrame, by: str, column: str = "gap") -> DataFrame:
    """(by, n, mean_ms, p95_ms, stdev_ms): NaN and infinite values are left out, none give 0."""
    x = F.col(column).cast("double")
    good = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))).groupBy(by)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return good.agg(F.count(F.lit(1)).alias("n"), zero(F.avg(x)).alias("mean_ms"), zero(F.percentile(x, F.lit(0.95))).alias("p95_ms"), zero(F.stddev_samp(x)).alias("stdev_ms"))


def distance(points: DataFrame, by: str, x: str = "x", y: str = "y", order: tuple[str, str] = ("ts_utc", "id")) -> DataFrame:
    """(by, moves, distance_px): each step's length is cut to a whole number."""
    near = _before(points, by, *order, {"_x": F.col(x), "_y": F.col(y)})
    step = F.sqrt(F.pow(F.col(x) - F.col("_x"), 2) + F.pow(F.col(y) - F.col("_y"), 2)).cast("long")
    return near.withColumn("_step", step).groupBy(by).agg(F.count(F.lit(1)).alias("moves"), F.coalesce(F.sum("_step"), F.lit(0)).alias("distance_px"))


def keyboard_batches(rows: DataFrame, by: str, n: int = 128, span: int | None = 1500, kind: str = "kind", ts: str = "ts_utc", tie: str = "id") -> DataFrame:
    """(by, batch, keydown, keyup, mean_ms, p95_ms, stdev_ms, bursts) of the batches of key
    presses and releases (``kind`` keydown or keyup).

    A batch is full with ``n`` rows, or ``span`` ms after its first one (None:
    only by rows).  An interval is the time from the press before, whichever
    batch that was in, and belongs to the batch of its own press; a burst
    counts in the batch of the press that completes it, and its presses may
    have begun in earlier ones.  Batches are numbered by their first rows' places."""
    placed = sinks.scratch_table(batches(rows.select(by, ts, tie, kind), by, n, span, ts, tie), "keys")
    presses = placed.where(F.col(kind) == "keydown")
    hits = burst_ends(presses, by, ts, tie=tie).select(F.col(by).alias("_k"), F.col(tie).alias("_t"), F.lit(1).alias("_hit"))
    timed = gaps(presses, by, ts, tie).join(hits, F.col(by).eqNullSafe(F.col("_k")) & (F.col(tie) == F.col("_t")), "left")
    x, zero = F.col("gap").cast("double"), lambda c: F.coalesce(c, F.lit(0.0))
    stats = timed.groupBy(by, "batch").agg(zero(F.avg(x)).alias("mean_ms"), zero(F.percentile(x, F.lit(0.95))).alias("p95_ms"), zero(F.stddev_samp(x)).alias("stdev_ms"), F.count("_hit").alias("bursts"))
    counts = placed.groupBy(by, "batch").agg(F.count_if(F.col(kind) == "keydown").alias("keydown"), F.count_if(F.col(kind) == "keyup").alias("keyup"))
    stats = stats.select(F.col(by).alias("_k"), F.col("batch").alias("_bt"), "mean_ms", "p95_ms", "stdev_ms", "bursts")
    both = counts.join(stats, F.col(by).eqNullSafe(F.col("_k")) & (F.col("batch") == F.col("_bt")), "left").na.fill(0, ["mean_ms", "p95_ms", "stdev_ms", "bursts"])
    return both.select(by, "batch", "keydown", "keyup", "mean_ms", "p95_ms", "stdev_ms", "bursts")


#: Kinds of mouse rows that count, and the names of their counts; releases and other buttons don't.
MOUSE = {"move": "moves", "left": "click_left", "right": "click_right", "middle": "click_middle", "scroll": "scroll"}
#: The monitor and the actions of each counter.
COUNTERS = {
    "kb_down": ("keyboard", ("keydown", "key_press")),
    "kb_up": ("keyboard", ("keyup", "key_release")),
    "mouse_moves": ("mouse", ("move",)),
    "mouse_clicks": ("mouse", ("click", "left_click", "right_click", "middle_click")),
    "mouse_scroll": ("mouse", ("scroll", "wheel")),
}


def mouse_batches(rows: DataFrame, by: str, n: int = 64, span: int | None = 1500, ts: str = "ts_utc", tie: str = "id", kind: str = "kind") -> DataFrame:
    """(by, batch, moves, click_left, click_right, click_middle, scroll, distance_px) of the batches of
    mouse rows (x, y and a kind of ``MOUSE``; others don't count).

    A batch is full with ``n`` rows, or ``span`` ms after its first one (None:
    only by rows).  The distance goes from move to move, cut to whole numbers
    each; the first move of a batch has none, as a flush forgets the last place."""
    placed = sinks.scratch_table(batches(rows.where(F.col(kind).isin(*MOUSE)).select(by, ts, tie, kind, "x", "y"), by, n, span, ts, tie), "mouse")
    counts = placed.groupBy(by, "batch").agg(*[F.count_if(F.col(kind) == k).alias(name) for k, name in MOUSE.items()])
    w = Window.partitionBy(by, "batch").orderBy(ts, tie)
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)).cast("long")
    far = placed.where(F.col(kind) == "move").withColumn("_step", step).groupBy(by, "batch").agg(F.sum("_step").alias("_far")).select(F.col(by).alias("_k"), F.col("batch").alias("_b"), "_far")
    both = counts.join(far, F.col(by).eqNullSafe(F.col("_k")) & (F.col("batch") == F.col("_b")), "left")
    return both.select(by, "batch", *MOUSE.values(), F.coalesce("_far", F.lit(0)).alias("distance_px"))


def counters_since(rows: DataFrame, triggers: DataFrame, by: str, ts: str = "ts_utc", tie: str = "id") -> DataFrame:
    """(by, ts, and each of ``COUNTERS``) of each trigger (by, ts): the rows of each counter's
    monitor and actions since the trigger before it."""
    names = list(COUNTERS)
    hit = lambda c: F.coalesce((F.col("monitor") == COUNTERS[c][0]) & F.col("action").isin(*COUNTERS[c][1]), F.lit(False)).cast("long").alias(c)
    kinds = rows.select(by, ts, *[hit(c) for c in names], F.lit(0).alias("hit"), F.col(tie).alias("tie"))
    both = kinds.union(triggers.select(by, ts, *[F.lit(0).cast("long") for _ in names], F.lit(1), F.lit(None).cast("string")))
    dealt = both.withColumn("_b", F.floor(F.col(ts) / F.lit(float(BUCKET_MS))).cast("long"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(by, "_b").agg(*[F.sum(c).alias(f"_{c}") for c in names])
    sums = sums.select(F.col(by).alias("_by"), F.col("_b").alias("_kb"), *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in names])
    inside = Window.partitionBy(by, "_b").orderBy(ts, "hit", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({c: F.sum(c).over(inside) for c in names}).where("hit = 1")
    placed = placed.join(sums, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_kb")))
    marks = placed.select(by, ts, *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in names], F.lit("").alias("tie"))
    since = _before(marks, by, ts, "tie", {f"_{c}": F.col(c) for c in names})
    return since.select(by, ts, *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names])


def burst_ends(rows: DataFrame, by: str, ts: str = "ts_utc", span: int = BURST_MS, keys: int = BURST_KEYS, tie: str = "id") -> DataFrame:
    """The rows that complete a burst: ``keys`` rows within ``span``, none of which another burst has used.

    A row may complete one if it is ``span`` or less after the row ``keys`` - 1
    places before.  Of these rows each burst rules out the next ``keys`` - 1
    places, so they are spaced by place."""
    placed = segments.places(rows, by, ts, tie)
    dense = segments.behind(placed, by, ts, keys - 1, "_from").where(F.col(ts) - F.col("_from") <= span).drop("_from")
    dense = sinks.scratch_table(dense, "dense")
    again = segments.places(dense.select(by, F.col("_pos").alias("_at"), F.col("_pos").alias("_tie")), by, "_at", "_tie", segments.PLACES)
    ends = segments.spaced(again, by, "_at", keys, bucket=segments.PLACES)
    at = again.alias("a").join(ends.alias("e"), F.col(f"a.{by}").eqNullSafe(F.col(f"e.{by}")) & (F.col("a._pos") == F.col("e._pos"))).select(F.col(f"a.{by}").alias("_k"), "_at")
    return dense.join(at, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_pos") == F.col("_at")), "left_semi").drop("_pos")


def bursts(rows: DataFrame, by: str, ts: str = "ts_utc", span: int = BURST_MS, keys: int = BURST_KEYS, tie: str = "id") -> DataFrame:
    """(by, bursts): ``keys`` rows within ``span`` count once and empty the buffer; groups without a burst have 0."""
    found = burst_ends(rows, by, ts, span, keys, tie).groupBy(by).agg(F.count(F.lit(1)).cast("int").alias("bursts"))
    groups = rows.select(F.col(by).alias("_k")).distinct()
    return groups.join(found, F.col("_k").eqNullSafe(F.col(by)), "left").select(F.col("_k").alias(by), F.coalesce("bursts", F.lit(0)).alias("bursts"))


def batches(rows: DataFrame, by: str, n: int, span: int | None = None, ts: str = "ts_utc", tie: str = "id") -> DataFrame:
    """Add ``batch``, the place of the row that opens the row's batch: a batch is full with ``n``
    rows, or when a row comes ``span`` or more after the one that opened it."""
    placed = segments.places(rows, by, ts, tie)
    if span is None:
        return placed.withColumn("batch", F.floor(F.col("_pos") / n).cast("long") * n).drop("_pos")
    placed = sinks.scratch_table(placed, "batches")
    opens = segments.spaced(placed.select(by, "_pos", ts), by, ts, span, n)
    return segments.opened(placed, opens, by, "batch").drop("_pos")


def idle_gaps(rows: DataFrame, least: int = 7000) -> DataFrame:
    """(ts_utc, gap) of rows after which nothing happens for ``least`` ms."""
    from strandline.operators.sessions import next_times

    return next_times(rows).withColumn("gap", F.col("next_ts") - F.col("ts_utc")).where(F.col("gap") >= least).select("id", "ts_utc", "gap")


def idle_snapshots(rows: DataFrame, least: int = 7000) -> DataFrame:
    """(id, trigger, ts_utc, since_ms): a snapshot for each change of window, and one
    ``least`` after the last activity before each gap; time since the one before."""
    quiet = idle_gaps(activity_rows(rows), least).select("id", F.lit("idle_gap").alias("trigger"), (F.col("ts_utc") + least).alias("ts_utc"))
    front = rows.where("monitor = 'active_window'").select("id", F.lit("foreground").alias("trigger"), "ts_utc")
    both = quiet.unionByName(front).withColumn("_all", F.lit(0)).withColumn("_tie", F.concat("trigger", "id"))
    return _before(both, "_all", "ts_utc", "_tie", {"_was": F.col("ts_utc")}).select("id", "trigger", "ts_utc", (F.col("ts_utc") - F.col("_was")).alias("since_ms"))


def changes(rows: DataFrame, by: str, columns: tuple[str, ...], order: tuple[str, str] = ("ts_utc", "id")) -> DataFrame:
    """Rows that differ from the one before in any of ``columns``; the first counts."""
    now = F.struct(*columns)
    return _before(rows, by, *order, {"_values": now}).where(~F.col("_values").eqNullSafe(now)).drop("_values")


def dedupe_within(rows: DataFrame, by: str, ts: str = "ts_utc", span: int = 5000, tie: str = "id") -> DataFrame:
    """The rows, whole, at least ``span`` after the last one kept of their group; the first
    of a group is kept, and of rows at one time the first by ``tie``."""
    placed = sinks.scratch_table(segments.places(rows, by, ts, tie), "dedupe")
    kept = segments.spaced(placed.select(by, "_pos", ts), by, ts, span).select(F.col(by).alias("_k"), F.col("_pos").alias("_kp"))
    return placed.join(kept, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_pos") == F.col("_kp")), "left_semi").drop("_pos")


def count_batches(rows: DataFrame, by: str, n: int, order: tuple[str, str] = ("ts_utc", "id")) -> DataFrame:
    """Add ``batch``: every ``n`` rows of a group from 0, numbered by hours and their counts."""
    dealt = rows.withColumn("_b", F.floor(F.col(order[0]) / F.lit(float(BUCKET_MS))).cast("long"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.select(F.col(by).alias("_k"), F.col("_b").alias("_kb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    row = F.row_number().over(Window.partitionBy(by, "_b").orderBy(*order))
    placed = dealt.withColumn("_i", row).join(sums, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    return placed.withColumn("batch", F.floor((F.col("_i") + F.col("_start") - 1) / n).cast("long")).select(*rows.columns, "batch")
