"""Jobs side by side in one session, each surviving the others' failure.

``Monitor`` listens to the session's streaming queries and keeps what it hears
until ``flush`` writes it: one row per start, micro-batch and end, failures with
their whole error.  ``Service`` starts jobs, restarts one that fails (from its
checkpoint, a bounded number of times) and lets the others run on.

A listener is called on Spark's event thread, so it only takes notes; the rows
are written by the thread that runs the service.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources.tables import create_if_absent

EVENTS = T.StructType([
    T.StructField("job", T.StringType(), False),
    T.StructField("query", T.StringType(), False),
    T.StructField("attempt", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("batch_no", T.LongType()),
    T.StructField("input_rows", T.LongType()),
    T.StructField("error", T.StringType()),
])


def query_name(job: str) -> str:
    """A name that no other query of the session has; the job is its start."""
    return f"{job}/{uuid.uuid4().hex}"


def job_of(name: str | None) -> str:
    return (name or "unnamed").split("/")[0]


class Monitor(StreamingQueryListener):
    """Notes on every streaming query of a session, in the order heard."""

    def __init__(self):
        self._lock, self._rows, self._jobs, self._seq = threading.Lock(), [], {}, 0

    def _note(self, job, query, attempt, kind, batch_no=None, rows=None, error=None) -> None:
        with self._lock:
            self._seq += 1
            self._rows.append((job, str(query), str(attempt), kind, self._seq, batch_no, rows, error))

    def onQueryStarted(self, event) -> None:
        self._jobs[str(event.id)] = job_of(event.name)
        self._note(job_of(event.name), event.id, event.runId, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._note(job_of(p.name), p.id, p.runId, "progress", p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._note(self._jobs.get(str(event.id), "unnamed"), event.id, event.runId,
                   "failed" if event.exception else "ended", error=event.exception)

    def heard(self, query, attempt) -> bool:
        """Has the end of this attempt been heard?"""
        with self._lock:
            return any(r[1] == str(query) and r[2] == str(attempt) and r[3] in ("failed", "ended")
                       for r in self._rows)

    def flush(self, spark: SparkSession, path: str) -> None:
        """Append the notes taken since the last time."""
        with self._lock:
            rows, self._rows = self._rows, []
        create_if_absent(spark, path, EVENTS)
        if rows:
            spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    create_if_absent(spark, path, EVENTS)
    return spark.read.schema(EVENTS).parquet(path)


@dataclass
class Job:
    name: str
    start: Callable[[], StreamingQuery]
    query: StreamingQuery | None = None
    failures: int = 0
    errors: list[str] = field(default_factory=list)
    done: bool = False


class Service:
    """Runs jobs until each has ended or failed more than ``restarts`` times."""

    def __init__(self, spark: SparkSession, events_path: str, restarts: int = 0, poll_seconds: float = 0.2,
                 heard_seconds: float = 10.0):
        self.spark, self.events_path, self.restarts = spark, events_path, restarts
        self.poll, self.wait_heard, self.jobs = poll_seconds, heard_seconds, []
        self.monitor = Monitor()

    def add(self, name: str, start: Callable[[], StreamingQuery]) -> None:
        self.jobs.append(Job(name, start))

    def _begin(self, job: Job) -> None:
        try:
            job.query = job.start()
        except Exception as exc:                      # a job that cannot start stops no other
            self._failed(job, str(exc))

    def _failed(self, job: Job, error: str) -> None:
        job.failures += 1
        job.errors.append(error)
        job.query = None
        job.done = job.failures > self.restarts

    def _look(self, job: Job) -> None:
        if job.query is None:
            self._begin(job)
            return
        if job.query.isActive:
            return
        try:
            job.query.awaitTermination()
            error = job.query.exception()
        except StreamingQueryException as exc:
            error = exc
        self._hear(job.query)
        if error is None:
            job.done = True
        else:
            self._failed(job, str(error))

    def _hear(self, query: StreamingQuery) -> None:
        """The end of a query reaches the listener a moment after it."""
        until = time.monotonic() + self.wait_heard
        while not self.monitor.heard(query.id, query.runId) and time.monotonic() < until:
            time.sleep(self.poll / 4)

    def run(self) -> dict[str, Job]:
        """All jobs to their ends; what each did is in the tables they write."""
        self.spark.streams.addListener(self.monitor)
        try:
            for job in self.jobs:
                self._begin(job)
            while not all(j.done for j in self.jobs):
                for job in self.jobs:
                    if not job.done:
                        self._look(job)
                time.sleep(self.poll)
        finally:
            for job in self.jobs:
                if job.query is not None and job.query.isActive:
                    job.query.stop()
            self.spark.streams.removeListener(self.monitor)
            self.monitor.flush(self.spark, self.events_path)
        return {j.name: j for j in self.jobs}
