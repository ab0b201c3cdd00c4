"""Progress of streams as a table: a row per micro-batch, with metrics observed on its rows, and how the query ended."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidelayer.session import run_dir

SCHEMA = "query_id STRING, run_id STRING, name STRING, event STRING, batch_id BIGINT, at STRING, input_rows BIGINT, duration_ms BIGINT, metrics MAP<STRING, STRING>, error STRING"


class ProgressTable(StreamingQueryListener):
    """A listener that appends to a table: `with ProgressTable(spark) as log: ...; log.read()`.

    `event` is progress or ended; the row of a query that failed has its error. Rows of a batch are a handful of numbers that
    the driver has anyway, and each query's are written when it ends, or every `flush_every` batches.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, flush_every: int = 100):
        self.spark, self.path, self.flush_every = spark, path or run_dir(spark, "progress"), flush_every
        self.rows: list[tuple] = []
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def __enter__(self) -> ProgressTable:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)
        self.flush()

    def _end(self, run_id: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run_id, threading.Event())

    def onQueryStarted(self, event) -> None:  # noqa: N802 (Spark's name)
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        metrics = {f"{name}.{k}": str(v) for name, row in (p.observedMetrics or {}).items() for k, v in row.asDict().items()}
        self._add((str(p.id), str(p.runId), p.name, "progress", p.batchId, p.timestamp, p.numInputRows, p.durationMs.get("triggerExecution"), metrics, None))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._add((str(event.id), str(event.runId), None, "ended", None, None, None, None, {}, event.exception))
        self._end(str(event.runId)).set()

    def _add(self, row: tuple) -> None:
        with self.lock:
            self.rows.append(row)
            full = len(self.rows) >= self.flush_every
        if full:
            self.flush()

    def flush(self) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def wait_for(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Events come after the query has ended; waits for the last one."""
        if not self._end(str(query.runId)).wait(seconds):
            raise TimeoutError(f"no end of query {query.runId} within {seconds} s")
        self.flush()

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)


