"""Rate-limit state in event time: additive increase, multiplicative decrease, token bucket, moving averages, provider scores.

A state is a tuple, and a step takes it past one event. The batch form folds a key's events in their order within sorted partitions, so
a task holds one batch of events and one state, however long a key's history is; a key's events follow one another by
nature, so one key is one task's work. The streaming form keeps the same states in the state store.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RISE_AFTER, FALL = 20, 0.7
EWMA_WEIGHT = 0.2
#: Answers of busy servers.
BUSY = (429, 503)


def folded(events: DataFrame, key: str, order: list[str], values: list[str], start: tuple, step: Callable[..., tuple], state: str) -> DataFrame:
    """(key, state...): each key's state after all its events, taken in the order of the columns ``order``.

    ``step`` gets the state and an event's ``values``; ``state`` is the DDL of the states' fields. A null key is a key.
    """
    kind = events.schema[key].dataType.simpleString()
    columns = list(dict.fromkeys([key, *order, *values]))
    rows = events.select(*columns).repartition(key).sortWithinPartitions(key, *order).select(key, *(F.col(v).alias(f"_v{i}") for i, v in enumerate(values)))
    names = [x.split()[0] for x in state.split(",")]
    schema = f"`{key}` {kind}, {state}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, any_ = None, start, False

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{key: last} | dict(zip(names, now, strict=True))], schema=out)

        out = None
        for batch in batches:
            out = out or _arrow(schema, batch.schema.field(key).type)
            found: list[dict] = []
            for k, *v in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if any_ and k != last:
                    found.append({key: last} | dict(zip(names, now, strict=True)))
                    now = start
                last, any_ = k, True
                now = step(now, *v)
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=out)
        if any_:
            yield done()

    return rows.mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def _arrow(schema: str, key: pa.DataType) -> pa.Schema:
    first, *rest = schema.split(", ")
    fields = [f.split() for f in ", ".join(rest).replace(", ", ",").split(",")]
    return pa.schema([(first.split("`")[1], key), *((n, _ARROW[t]) for n, t in fields)])


AIMD = "capacity long, streak long, violations long"


def aimd(most: int) -> Callable[..., tuple]:
    """A step of (capacity, streak, violations) past an event, by whether it is a violation: one more for 20 successes in a row, times 0.7
    (at least 1) for a violation."""

    def step(state: tuple, bad: bool | None) -> tuple:
        capacity, streak, violations = state
        if bad:
            return max(1, int(capacity * FALL)), 0, violations + 1
        if streak + 1 >= RISE_AFTER:
            return min(capacity + 1, most), 0, violations
        return min(capacity, most), streak + 1, violations

    return step


BUCKET = "tokens double, last double, granted long"


def token_bucket(state: tuple, seconds: float, capacity: float) -> tuple:
    """(tokens, last, granted) past an event: tokens refill by capacity / 60 a second up to the capacity, an event takes one if there is one."""
    tokens, last, granted = state
    level = min(capacity, tokens + (0.0 if last is None else seconds - last) * (capacity / 60))
    return (level - 1, seconds, granted + 1) if level >= 1 else (level, seconds, granted)


def ewma(state: float | None, value: float, weight: float = EWMA_WEIGHT) -> float:
    """The moving average past a value; it begins with the first one."""
    return value if state is None else state * (1 - weight) + value * weight


def sliding_counts(events: DataFrame, key: str, ts: str, violation: Column, seconds: int = 60) -> DataFrame:
    """``events`` with successes and violations of their key within the last ``seconds``, the row included."""
    from pyspark.sql import Window

    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    last = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumns({"successes": F.sum((~violation).cast("long")).over(last), "violations": F.sum(violation.cast("long")).over(last)})


def provider_score(latency: Column, success: Column, used: Column, t: Column, n: Column) -> Column:
    """The lower the better: latency, failures, use above 0.8, less a bonus for little-tried ones."""
    bonus = F.sqrt(F.greatest(F.lit(1.0), F.log(F.greatest(F.lit(2), t))) / F.greatest(F.lit(1), n))
    return latency + 0.8 * (1 - success) + 0.5 * F.greatest(F.lit(0.0), used - 0.8) - bonus


def pick_provider(scores: DataFrame, name: str, score: str) -> DataFrame:
    """The one of the least score, ties by name."""
    return scores.agg(F.min(F.struct(score, name)).alias("b")).select(f"b.{name}", f"b.{score}")


class LimiterProcessor(StatefulProcessor):
    """Streaming twin of :func:`aimd`, :func:`token_bucket` and :func:`ewma`: the state of a provider.

    Rows of one batch are taken in the order of their time, then of all their values. The bucket's capacity is the one that the
    limiter has reached; calls that lie before the last one refill nothing.
    """

    def __init__(self, start: int = 6, most: int = 180):
        self.start, self.most = start, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("limiter", "capacity long, streak long, violations long, tokens double, last double, latency double, success double, calls long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.state.get() if self.state.exists() else (self.start, 0, 0, float(self.start), None, None, None, 0)
        limit, (tokens, last, latency, success, calls), granted = tuple(kept[:3]), kept[3:], 0
        step = aimd(self.most)
        events = pd.concat(list(rows)).sort_values(["seconds", "violation", "latency"], kind="stable")
        for now, bad, took in zip(events["seconds"].tolist(), events["violation"].tolist(), events["latency"].tolist(), strict=True):
            now = now if last is None else max(last, now)
            tokens, last, got = token_bucket((tokens, last, 0), now, float(limit[0]))
            granted += got
            limit = step(limit, bad)
            latency, success, calls = ewma(latency, took), ewma(success, 0.0 if bad else 1.0), calls + 1
        self.state.update((*limit, tokens, last, latency, success, calls))
        used = 1.0 - min(1.0, tokens / max(1.0, float(limit[0])))
        row = (key[0], *limit, tokens, granted, latency, success, calls, used, score_value(latency, success, used, calls, calls))
        yield pd.DataFrame([row], columns=[x.split()[0] for x in SNAPSHOT.split(", ")])

    def close(self) -> None:
        pass


SNAPSHOT = "provider string, capacity long, streak long, violations long, tokens double, granted long, latency double, success double, calls long, used double, score double"


def limiter_stream(events: DataFrame, start: int = 6, most: int = 180) -> DataFrame:
    """Snapshots of providers (``SNAPSHOT``) from a stream (provider, seconds double, violation boolean, latency double): the limiter, moving averages of
    latency and success, the share of the bucket that is used, and the score, with a provider's own calls in place of all."""
    return events.groupBy("provider").transformWithStateInPandas(LimiterProcessor(start, most), SNAPSHOT, "Update", "None")


def with_backoff(call: Callable[[], tuple[int, Any, float | None]], tries: int = 4, first: float = 0.8, factor: float = 1.8, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The result of ``call`` -> (status, result, retry-after seconds), again after a growing pause on 429 and 503.

    A server's own pause is kept in addition. The last failure raises.
    """
    pause = first
    for attempt in range(1, tries + 1):
        status, result, after = call()
        if status not in BUSY:
            return result
        if attempt == tries:
            raise RuntimeError(f"status {status} after {tries} tries")
        sleep(pause + (after or 0.0))
        pause *= factor
    raise RuntimeError("no try was made")


def score_value(latency: float, success: float, used: float, t: int, n: int) -> float:
    """:func:`provider_score` for one provider on the driver."""
    return latency + 0.8 * (1 - success) + 0.5 * max(0.0, used - 0.8) - math.sqrt(max(1.0, math.log(max(2, t))) / max(1, n))
