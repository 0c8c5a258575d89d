"""Limiter states of keys that no single task should fold: runs of events as summaries that compose.

Events are dealt by ranges of (key, order), so a key with many events lies in many tasks, each of which holds a run of its events. A run whose key begins in
its task is folded from the start. Only the first key of a task may have begun elsewhere: its run becomes a summary of what it does to any state, and
a key's summaries are applied one after another, one row for each task that holds the key.

* Additive increase, multiplicative decrease (:class:`AimdRuns`): successes before the first violation, successes after the last one, and a table of the
  capacity after the last violation by the one before the first. A violation sets the streak to 0, so nothing else is left of the state.
* Moving averages (:class:`EwmaRuns`): an affine map. Composed averages differ from folded ones by rounding alone.
* The token bucket doesn't compose in bounded size: whether an event is granted depends on the level, so a run's map from level to level has as many pieces as the run has
  events in the worst case. It stays a fold, a task for each key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.streaming.limiter import EWMA_WEIGHT, FALL, RISE_AFTER, _arrow, ewma


class AimdRuns:
    """Summaries (before, after, violations, table or None) of runs of violation flags, for capacities up to the larger of ``start`` and ``most``."""

    def __init__(self, start: int, most: int):
        self.most = most
        self.all = np.arange(max(start, most, 1) + 1)
        self.fallen = np.maximum(1, (self.all * FALL).astype(np.int64))

    def empty(self) -> tuple:
        return 0, 0, 0, None

    def _risen(self, capacity, streak: int, successes: int):
        return np.minimum(np.minimum(capacity, self.most) + (streak + successes) // RISE_AFTER, self.most) if successes else capacity

    def add(self, summary: tuple, flags: list) -> tuple:
        """``summary`` and then the events of ``flags``; null is a success."""
        before, after, violations, table = summary
        at = np.flatnonzero(np.array([bool(f) for f in flags], bool))
        if not len(at):
            return (before + len(flags), after, violations, table) if table is None else (before, after + len(flags), violations, table)
        gaps = np.diff(at, prepend=-1) - 1
        for n, gap in enumerate(gaps.tolist()):
            if table is None:
                before, table = before + gap, self.fallen
            else:
                table = self.fallen[self._risen(table, 0, gap + (after if n == 0 else 0))]
        return before, len(flags) - 1 - int(at[-1]), violations + len(at), table

    def combine(self, a: tuple, b: tuple) -> tuple:
        if b[3] is None:
            return (a[0] + b[0], a[1], a[2], None) if a[3] is None else (a[0], a[1] + b[0], a[2], a[3])
        if a[3] is None:
            return a[0] + b[0], b[1], b[2], b[3]
        return a[0], b[1], a[2] + b[2], b[3][self._risen(a[3], 0, a[1] + b[0])]

    def apply(self, state: tuple, summary: tuple) -> tuple:
        (capacity, streak, violations), (before, after, more, table) = state, summary
        capacity = int(self._risen(capacity, streak, before))
        if table is None:
            return capacity, (streak + before) % RISE_AFTER, violations
        return int(self._risen(int(table[capacity]), 0, after)), after % RISE_AFTER, violations + more

    def encode(self, summary: tuple) -> list[float]:
        return [float(x) for x in (*summary[:3], *(summary[3] if summary[3] is not None else ()))]

    def decode(self, values: list[float]) -> tuple:
        return *(int(x) for x in values[:3]), np.array(values[3:], np.int64) if len(values) > 3 else None


class EwmaRuns:
    """Summaries (first value, factor, addend) of runs of values: the factor and addend of all after the first, for a state may have had no value yet. Nulls
    are left out."""

    def __init__(self, weight: float = EWMA_WEIGHT):
        self.weight = weight

    def empty(self) -> tuple:
        return None, 1.0, 0.0

    def add(self, summary: tuple, values: list) -> tuple:
        first, factor, addend = summary
        some = [v for v in values if v is not None]
        if some and first is None:
            first, *some = some
        for v in some:
            factor, addend = factor * (1 - self.weight), addend * (1 - self.weight) + v * self.weight
        return first, factor, addend

    def combine(self, a: tuple, b: tuple) -> tuple:
        if a[0] is None or b[0] is None:
            return b if a[0] is None else a
        keep = 1 - self.weight
        return a[0], a[1] * keep * b[1], (a[2] * keep + b[0] * self.weight) * b[1] + b[2]

    def apply(self, state: tuple, summary: tuple) -> tuple:
        first, factor, addend = summary
        return state if first is None else (ewma(state[0], first, self.weight) * factor + addend,)

    def encode(self, summary: tuple) -> list[float]:
        return [] if summary[0] is None else list(summary)

    def decode(self, values: list[float]) -> tuple:
        return tuple(values) if values else self.empty()


def ewma_step(state: tuple, value: float | None) -> tuple:
    """A step of a moving average; nulls are left out."""
    return state if value is None else (ewma(state[0], value),)


def parts_of(events: DataFrame, key: str, order: list[str], values: list[str], start: tuple, step: Callable[..., tuple], state: str, runs, tasks: int | None = None) -> DataFrame:
    """(key, part, whole, numbers): for each key and task the state from the start (``whole``) or the summary of its run there."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(*dict.fromkeys([key, *order, *values]))
    rows = rows.repartitionByRange(*([tasks] if tasks else []), key, *order).sortWithinPartitions(key, *order).select(key, *(F.col(v).alias(f"_v{i}") for i, v in enumerate(values)))
    fields = f"`{key}` {kind}, part long, whole boolean, numbers array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, begun, first, now = TaskContext.get().partitionId(), None, False, True, None
        key_type = None

        def row() -> pa.RecordBatch:
            numbers = runs.encode(now) if first else [None if x is None else float(x) for x in now]
            return pa.RecordBatch.from_arrays([pa.array([last], key_type), pa.array([part], pa.int64()), pa.array([not first]), pa.array([numbers], pa.list_(pa.float64()))], [key, "part", "whole", "numbers"])

        for batch in batches:
            key_type = batch.schema.field(key).type
            keys, columns = batch.column(0).to_pylist(), [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
            at = 0
            while at < len(keys):
                stop = at + 1
                while stop < len(keys) and keys[stop] == keys[at]:
                    stop += 1
                if begun and keys[at] != last:
                    yield row()
                    first, now = False, start
                if not begun:
                    begun, now = True, runs.empty()
                last = keys[at]
                if first:
                    now = runs.add(now, *(c[at:stop] for c in columns))
                else:
                    for v in zip(*(c[at:stop] for c in columns), strict=True):
                        now = step(now, *v)
                at = stop
        if begun:
            yield row()

    return rows.mapInArrow(run, fields)


def composed(events: DataFrame, key: str, order: list[str], values: list[str], start: tuple, step: Callable[..., tuple], state: str, runs, tasks: int | None = None) -> DataFrame:
    """(key, state...) as :func:`corvane.streaming.limiter.folded`, with the events of one key in as many tasks as their number asks for."""
    kind = events.schema[key].dataType.simpleString()
    parts = parts_of(events, key, order, values, start, step, state, runs, tasks).repartition(key).sortWithinPartitions(key, "part")
    schema, types = f"`{key}` {kind}, {state}", [x.split() for x in state.split(",")]

    def shown(now: tuple) -> dict:
        return {n: (v if v is None or t == "double" else int(v)) for (n, t), v in zip(types, now, strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, begun, out = None, start, False, None
        for batch in batches:
            out = out or _arrow(schema, batch.schema.field(key).type)
            found: list[dict] = []
            for k, whole, numbers in zip(batch.column(0).to_pylist(), batch.column("whole").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
                if begun and k != last:
                    found.append({key: last} | shown(now))
                if not begun or k != last:
                    now = start
                last, begun = k, True
                if whole:
                    now = tuple(None if x is None else (x if t == "double" else int(x)) for x, (_, t) in zip(numbers, types, strict=True))
                else:
                    now = runs.apply(now, runs.decode(numbers))
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=out)
        if begun:
            yield pa.RecordBatch.from_pylist([{key: last} | shown(now)], schema=out)

    return parts.mapInArrow(run, schema)
