"""Focus sessions over a stream, closed by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandline.operators.sessions import IDLE_MS

#: What a session of this stream needs: timers and lists of state are kept in this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHANGE = "ts long, id string, window string"


class FocusProcessor(StatefulProcessor):
    """The window changes of one device that aren't settled yet, and a timer for the first of them.

    A change is settled once no row can come that alters its session: the
    watermark has passed the change after it, or the time up to which one would
    have joined it.  The last change lasts a second if ``until`` is None, else to
    ``until``, when the watermark gets there."""

    def __init__(self, key: str, idle_ms: int, since: int | None, until: int | None):
        self.key, self.idle_ms, self.since, self.until = key, idle_ms, since, until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", CHANGE)
        self.timer = handle.getValueState("timer", "at long")

    def settled_at(self, ts: int, after: int | None) -> int:
        """The watermark at which the change of ``ts`` before that of ``after`` is settled."""
        if after is None:
            return ts + self.idle_ms if self.until is None else self.until
        return min(after, ts + self.idle_ms)

    def ends(self, ts: int, after: int | None) -> int:
        if after is None and self.until is not None:
            return self.until
        end = ts + 1000 if after is None or after - ts > self.idle_ms else after
        return end if self.until is None else min(end, self.until)

    def settle(self, key: tuple, fresh: list[tuple], watermark: int) -> pd.DataFrame:
        """Take new changes in, give out what is settled, and wait for the next one."""
        held = sorted({*(tuple(r) for r in self.pending.get()), *fresh}) if self.pending.exists() else sorted({*fresh})
        out, n = [], 0
        while n < len(held):
            after = held[n + 1][0] if n + 1 < len(held) else None
            due = self.settled_at(held[n][0], after)
            if due > watermark:
                self.wake(due)
                break
            end = self.ends(held[n][0], after)
            if end > held[n][0]:
                out.append((key[0], held[n][0], end, held[n][2]))
            n += 1
        if n == len(held):
            self.pending.clear()
            self.wake(None)
        elif n or fresh:
            self.pending.put(held[n:])
        return pd.DataFrame(out, columns=[self.key, "start_ms", "end_ms", "window_id"])

    def wake(self, at: int | None) -> None:
        """One timer at a time."""
        was = self.timer.get()[0] if self.timer.exists() else None
        if was == at:
            return
        if was is not None and was in set(t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()):
            self.handle.deleteTimer(was)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, fresh = timerValues.getCurrentWatermarkInMs(), []
        for batch in rows:
            for ts, i, window in zip(batch["ts_utc"].tolist(), batch["id"].tolist(), batch["subject_id"].tolist()):
                if ts > watermark and (self.since is None or ts >= self.since) and (self.until is None or ts < self.until):
                    fresh.append((ts, i, window))
        yield self.settle(key, fresh, watermark)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield self.settle(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def focus_stream(events: DataFrame, windows: DataFrame | None = None, key: str = "session_id", idle_ms: int = IDLE_MS, late: str = "5 minutes", since: int | None = None, until: int | None = None) -> DataFrame:
    """(key, start_ms, end_ms, window_id[, app_id]) of the window changes of each device, in
    whatever order they come, as ``sessions.focus_sessions`` gives them for a batch.

    Changes may be up to ``late`` behind the latest event of any monitor; later
    ones are dropped.  State holds only the changes that the watermark hasn't
    settled, mostly one a device, and none once its last session is closed.
    ``since`` and ``until`` are the range of a batch: its last session lasts to
    ``until``; without them it lasts a second, as before any long gap.  ``windows``
    (id, app_id) is a table that is joined as it is when a session is closed.
    The session's state store must be the one of ``STATE_STORE``."""
    at = F.timestamp_millis("ts_utc")
    timed = events.select(F.col(key).cast("string").alias(key), "monitor", "id", "ts_utc", F.col("subject_id").cast("string").alias("subject_id"), at.alias("at")).withWatermark("at", late)
    # one condition over monitor and event time isn't moved below the watermark: events of all monitors move time on
    changes = timed.where(F.when(F.col("monitor") == "active_window", F.unix_millis("at")).isNotNull())
    processor = FocusProcessor(key, idle_ms, since, until)
    found = changes.groupBy(key).transformWithStateInPandas(processor, f"{key} string, start_ms long, end_ms long, window_id string", "append", "EventTime")
    return found if windows is None else found.join(windows.select(F.col("id").alias("window_id"), "app_id"), "window_id", "left").select(key, "start_ms", "end_ms", "window_id", "app_id")
