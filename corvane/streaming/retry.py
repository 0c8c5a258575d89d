"""Calls that busy servers turn away, asked again after growing pauses by timers in keyed state; no task sleeps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvane.streaming.limiter import BUSY
from corvane.streaming.state import keyed_state

OUTCOME = "id string, status int, result string, tries int, pauses array<double>"


class RetryProcessor(StatefulProcessor):
    """One call for each key: asked when it comes in; after a busy answer its payload, number of tries and pauses are kept, and a timer asks again. The pauses are those of
    :func:`corvane.streaming.limiter.with_backoff`. The last busy answer comes out with its status and no result."""

    def __init__(self, call: Callable[[str, str], tuple[int, str | None, float | None]], tries: int, first: float, factor: float):
        self.call, self.tries, self.first, self.factor = call, tries, first, factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("call", "payload string, tries int, pauses array<double>")

    def _ask(self, key: str, payload: str, tries: int, pauses: list[float], now: int) -> Iterator[pd.DataFrame]:
        status, result, after = self.call(key, payload)
        tries += 1
        if status in BUSY and tries < self.tries:
            pause = self.first * self.factor ** (tries - 1) + (after or 0.0)
            self.state.update((payload, tries, [*pauses, pause]))
            self.handle.registerTimer(now + int(pause * 1000))
            return
        self.state.clear()
        yield pd.DataFrame([(key, status, None if status in BUSY else result, tries, pauses)], columns=["id", "status", "result", "tries", "pauses"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        payload = next(iter(pd.concat(list(rows))["payload"].tolist()))
        if not self.state.exists():  # a call that waits isn't asked by its own repetition
            yield from self._ask(key[0], payload, 0, [], timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            payload, tries, pauses = self.state.get()
            yield from self._ask(key[0], payload, tries, list(pauses), timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def retried(calls: DataFrame, call: Callable[[str, str], tuple[int, str | None, float | None]], tries: int = 4, first: float = 0.8, factor: float = 1.8) -> DataFrame:
    """(id, status, result, tries, pauses) of a stream (id string, payload string): ``call`` gives (status, result, seconds that the server asks for or None)."""
    keyed_state(calls.sparkSession)
    return calls.groupBy("id").transformWithStateInPandas(RetryProcessor(call, tries, first, factor), OUTCOME, "Append", "ProcessingTime")
