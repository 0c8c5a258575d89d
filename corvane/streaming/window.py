"""Successes and violations of the last minute as a stream: event time, timers, eviction."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvane.streaming.state import keyed_state


class SlidingProcessor(StatefulProcessor):
    """The rows of a key that the watermark hasn't passed, and those that still lie in the window of such a row.

    A row comes out once the watermark is past it, when no row before it can come in any more; rows are kept for the window's length and then evicted. Timers are set at the first waiting
    row, so a key without new rows gives out what waits. Rows that the watermark had passed when they came are late and count nowhere.
    """

    def __init__(self, names: list[str], seconds: int):
        self.names, self.micros = names, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rows", "id array<long>, at array<long>, bad array<boolean>, out array<boolean>")

    def _rows(self) -> list[np.ndarray]:
        kept = self.state.get() if self.state.exists() else ([], [], [], [])
        return [np.array(v, t) for v, t in zip(kept, (np.int64, np.int64, bool, bool), strict=True)]

    def _past(self, key: Any, rows: list[np.ndarray], mark: int) -> Iterator[pd.DataFrame]:
        """Give out what lies before ``mark`` (microseconds), keep the rest and what its windows hold."""
        order = np.lexsort((rows[0], rows[1]))
        ids, at, bad, out = (v[order] for v in rows)
        now = ~out & (at < mark)
        if now.any():
            upto = np.concatenate([[0], np.cumsum(bad)])
            low, high = np.searchsorted(at, at[now] - self.micros, "left"), np.searchsorted(at, at[now], "right")
            violations = upto[high] - upto[low]
            yield pd.DataFrame({self.names[0]: [key[0]] * int(now.sum()), self.names[1]: ids[now], self.names[2]: pd.to_datetime(at[now], unit="us", utc=True), "successes": high - low - violations, "violations": violations})
        keep = at >= mark - self.micros
        waiting = at[at >= mark]
        if keep.any():
            self.state.update(tuple(v[keep].tolist() for v in (ids, at, bad, out | now)))
        else:
            self.state.clear()
        if len(waiting):
            self.handle.registerTimer(int(waiting[0]) // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        new = pd.concat(list(rows))
        new = new[new["at"] >= mark]
        fresh = [new["id"].to_numpy(np.int64), new["at"].to_numpy(np.int64), new["bad"].to_numpy(bool), np.zeros(len(new), bool)]
        yield from self._past(key, [np.concatenate(v) for v in zip(self._rows(), fresh, strict=True)], mark)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._past(key, self._rows(), timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def sliding_stream(events: DataFrame, key: str, event_id: str, ts: str, violation: Any, delay: str = "1 minute", seconds: int = 60) -> DataFrame:
    """(key, event_id, ts, successes, violations) of a stream: as :func:`corvane.streaming.limiter.sliding_counts` for events that come within ``delay`` of the latest one.

    State per key is what ``delay`` and the window hold. ``event_id`` is a long; null times and violations are left out.
    """
    from pyspark.sql import functions as F

    keyed_state(events.sparkSession)
    stamp = F.col(ts).cast("timestamp")
    rows = events.select(F.col(key).alias("key"), F.col(event_id).alias("id"), stamp.alias("ts"), F.unix_micros(stamp).alias("at"), violation.alias("bad")).where("at is not null and bad is not null and id is not null")
    kind = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField(event_id, T.LongType()), T.StructField(ts, T.TimestampType()), T.StructField("successes", T.LongType()), T.StructField("violations", T.LongType())])
    return rows.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(SlidingProcessor([key, event_id, ts], seconds), kind, "Append", "EventTime")
