"""What a stream's limiters look like while it runs: the newest snapshot of each provider, and the progress of its queries."""

from __future__ import annotations

import collections
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from corvane.streaming.limiter import SNAPSHOT

#: Progress reports that are kept of each query, and queries that are kept.
REPORTS, QUERIES = 100, 100


class Monitor(StreamingQueryListener):
    """Keeps the last ``REPORTS`` progress reports of each of the last ``QUERIES`` queries of a session, and the newest snapshot of each provider that
    :meth:`watched` streams give. What is kept grows with the number of providers, not with time."""

    def __init__(self, spark: SparkSession):
        self.spark, self._lock = spark, threading.Lock()
        self._reports: collections.OrderedDict[str, collections.deque] = collections.OrderedDict()
        self._state: dict[str, str] = {}
        self._snapshots: dict[str, tuple] = {}
        spark.streams.addListener(self)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        with self._lock:
            self._reports[str(event.id)] = collections.deque(maxlen=REPORTS)
            self._state[str(event.id)] = "running"
            while len(self._reports) > QUERIES:
                gone, _ = self._reports.popitem(last=False)
                self._state.pop(gone, None)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        p = event.progress
        with self._lock:
            rows = sum(o.numRowsTotal for o in p.stateOperators)
            self._reports.setdefault(str(p.id), collections.deque(maxlen=REPORTS)).append((str(p.id), p.name, p.batchId, p.numInputRows, p.batchDuration, rows))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        with self._lock:
            self._state[str(event.id)] = "failed" if event.exception else "ended"

    def stop(self) -> None:
        self.spark.streams.removeListener(self)

    def watched(self, snapshots: DataFrame) -> DataStreamWriter:
        """A writer of a limiter stream that keeps each provider's newest snapshot here. Its rows are one for each provider and batch."""

        def keep(batch: DataFrame, batch_id: int) -> None:
            new = {r["provider"]: (batch_id, *r) for r in batch.toLocalIterator()}
            with self._lock:
                self._snapshots |= new

        return snapshots.writeStream.foreachBatch(keep).outputMode("update")

    def snapshots(self) -> DataFrame:
        """(batch, ``SNAPSHOT``): the newest of each provider."""
        with self._lock:
            rows = sorted(self._snapshots.values(), key=lambda r: str(r[1]))
        return self.spark.createDataFrame(rows, f"batch long, {SNAPSHOT}")

    def reports(self) -> DataFrame:
        """(query, name, batch, rows, milliseconds, state_rows, state), the oldest first."""
        with self._lock:
            rows = [(*r, self._state.get(q)) for q, kept in self._reports.items() for r in kept]
        return self.spark.createDataFrame(rows, "query string, name string, batch long, rows long, milliseconds long, state_rows long, state string")

    def worst(self, k: int = 5) -> DataFrame:
        """The ``k`` providers of the highest score, which are asked last."""
        return self.snapshots().orderBy(F.desc("score"), "provider").limit(k)
